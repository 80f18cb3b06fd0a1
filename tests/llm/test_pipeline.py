"""The pipeline's stages, each held against brute force on its own input."""

from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline as cp
from gatecast.llm import line_dedup, pieces
from gatecast.llm.queries import MIX_PLAN

from .test_line_dedup import brute as left_lines
from .test_mixing import brute as mixed
from .test_ngram_join import brute as linked

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [[tuple(r) for r in docs.collect()]]
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = spark.createDataFrame(out[-1], docs.schema)
        result = stage(spark, docs, SF)
        out.append([tuple(r) for r in result.collect()])
        if name != cp.STAGES[-1][0]:
            assert result.columns == columns
            docs = result
    return out


def test_toxicity_drops_few_and_changes_nothing(stages):
    assert set(stages[1]) <= set(stages[0])
    assert len(stages[0]) * 0.7 < len(stages[1]) < len(stages[0])


def test_line_dedup_equals_brute_force(stages):
    want = left_lines([r[:2] for r in stages[1]], line_dedup.NO_FLOOR)
    before = {r[0]: r[1] for r in stages[1]}
    want = {d: t for d, t in want.items() if t == before[d] or t.strip(" ")}
    assert {r[0]: r[1] for r in stages[2]} == want


def test_one_of_each_group_stays(stages):
    keep = {d for d, _, c in linked([r[:2] for r in stages[2]], 5, 80) if c == d}
    assert Counter(r[0] for r in stages[3]) == Counter(keep)


def test_mixing_equals_brute_force(stages):
    rows = [(r[0], r[2], r[3], r[1]) for r in stages[3]]
    want = Counter()
    for r in mixed(rows, MIX_PLAN):
        want[r[0]] += r[-1]
    assert Counter(r[0] for r in stages[4]) == Counter({d: n for d, n in want.items() if n})


def test_ids_equal_the_library(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    text = {r[0]: r[1] for r in stages[4]}
    assert Counter(r[0] for r in stages[5]) == Counter(r[0] for r in stages[4])
    for r in stages[5]:
        assert r[3] == library.encode(text[r[0]])
