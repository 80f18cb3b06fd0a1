"""Plan guards: what every registered relational query must never contain."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from gatecast.oracle_queries import ORACLE
from test_oracle import SF

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroupsInPandas"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


# Fits and their results are read back from models; their plans hold no relational choice.
MODELS = {"fit_gbt_validated", "fit_gbt_final", "fit_gbt_no_weather", "fit_lasso", "fit_random_forest", "tune_random_search",
          "model_roundtrip", "predict_requests", "stream_predict", "fit_boosted_patience", "score_one_pass", "tune_adaptive",
          "stream_asof", "stream_weather", "stream_scores"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) - MODELS))
def test_no_pairs_no_python(spark, name):
    plan = _plan(entry.queries()[name](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plan has {op}"


def test_flagship_shape(spark):
    plan = _plan(entry.queries()["clean_features"](spark, SF))
    assert plan.count("Window (") == 1            # one running window for the as-of step
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan
    # column pruning: no scan reads the unused props column
    assert "props" not in plan
