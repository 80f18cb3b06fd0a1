"""Entry points shaped like the reference's functions, backed by the Spark plans.

``clean_data`` -> feature pipeline, ``onehot`` -> category codes + null-row
drop, ``load_model`` -> every saved (airport, variant) model, ``predict`` ->
one (airport, prediction time) call of the scorer.  Tables may be Spark or
pandas DataFrames; one airport's tables need no ``airport`` column.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecast.operators.encode import category_codes
from gatecast.operators.nulls import drop_null_rows
from gatecast.plans.features import feature_pipeline
from gatecast.plans.models import load_models
from gatecast.plans.predict import score_requests
from gatecast.schemas import CATEGORICAL, SCHEMAS


def _spark_df(spark: SparkSession, df, table: str, airport: str | None) -> DataFrame:
    """Spark or pandas in; Spark out with the table's schema and an airport column."""
    schema = SCHEMAS[table]
    if not isinstance(df, DataFrame):
        present = T.StructType([T.StructField(f.name, f.dataType, True)
                                for f in schema.fields if f.name in df.columns])
        df = spark.createDataFrame(df[present.names], schema=present)
    if "airport" not in df.columns:
        df = df.withColumn("airport", F.lit(airport))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in df.columns])


def clean_data(pushback, etd, lamp, mfs, airport: str | None = None, strict: bool = True,
               spark: SparkSession | None = None) -> DataFrame:
    """The reference's ``clean_data`` for any number of airports at once."""
    spark = spark or SparkSession.getActiveSession()
    t = {k: _spark_df(spark, v, k, airport) for k, v in
         {"labels": pushback, "etd": etd, "lamp": lamp, "mfs": mfs}.items()}
    return feature_pipeline(t["labels"], t["etd"], t["lamp"], t["mfs"], strict=strict)


def onehot(features: DataFrame, drop_nulls: bool = True) -> DataFrame:
    """The reference's ``onehot``: categories to codes, then rows with nulls dropped."""
    coded, _ = category_codes(features, CATEGORICAL)
    return drop_null_rows(coded) if drop_nulls else coded


def load_model(solution_directory: str | Path, airports: list[str] | None = None
               ) -> dict[tuple[str, str], PipelineModel]:
    """Every model that was saved under ``solution_directory`` (or those of ``airports``).

    What is missing or unreadable is an error, never a silent gap.
    """
    return load_models(str(solution_directory), airports)


def predict(config=None, etd=None, first_position=None, lamp=None, mfs=None, runways=None,
            standtimes=None, tbfm=None, tfm=None, airport: str | None = None, prediction_time=None,
            partial_submission_format=None, model=None, solution_directory=None,
            spark: SparkSession | None = None, router: str = "batch") -> DataFrame:
    """One scoring call: requests of ``airport`` at ``prediction_time``.

    Only ``etd``, ``lamp`` and ``mfs`` are read, as in the reference.  An
    empty request frame is returned as it is.  ``model`` is the dict from
    ``load_model``.  The call is one batch, as in the reference: a null feature
    in any of its rows sends all to the no-weather model; ``router="row"``
    decides row by row.
    """
    spark = spark or SparkSession.getActiveSession()
    req = _spark_df(spark, partial_submission_format, "labels", airport)
    if req.isEmpty():
        return req
    inputs = {k: _spark_df(spark, v, k, airport) for k, v in {"etd": etd, "lamp": lamp, "mfs": mfs}.items()}
    return score_requests(req, inputs, model, router=router)
