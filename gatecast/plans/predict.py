"""Batch scoring of prediction requests (S4, F7, M7, M16, T1 batch).

Requests of every airport and prediction time are scored in one job
instead of one call per (airport, time):

requests -> distinct keys -> scoring-mode features (30-hour visibility)
         -> written once, partitioned by airport (cuts lineage; each
            airport's model then reads only its partition)
         -> per-airport models, row- or batch-level routing
         -> keyed back onto the requests.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.functions.timeops import add_minutes
from gatecast.plans.features import feature_pipeline
from gatecast.plans.models import FULL, NO_WEATHER, Variant, predictor
from gatecast.plans.scoring import attach_predictions, dispatch_by_airport, route_batches, route_rows
from gatecast.schemas import REQUEST_KEYS, VISIBLE_HISTORY_HOURS, WEATHER_OFFSETS_MINUTES
from gatecast.session import fresh_dir, materialize
from gatecast.sources.files import read_feature_table, write_feature_table


def predictors_by_airport(models: dict[tuple[str, str], PipelineModel]):
    """airport -> (full, no-weather) predictors, None where there is no model."""
    def one(a: str, variant: Variant):
        model = models.get((a, variant.name))
        return predictor(model, variant) if model is not None else None

    return {a: (one(a, FULL), one(a, NO_WEATHER)) for a in sorted({a for a, _ in models})}


def time_bounded_inputs(requests: DataFrame, etd: DataFrame, lamp: DataFrame):
    """Restrict the static inputs to what the requests' time span can see.

    Two scalars (min and max request time) come to the driver; the filters
    then reach the scans as pushed predicates.  Nothing visible is lost: an
    update older than 30 hours is hidden anyway, and a forecast serves only
    slots 30-75 minutes after its issue.
    """
    # carried as text so no driver-side time zone touches the NTZ values
    r = requests.agg(F.min("timestamp").cast("string").alias("lo"),
                     F.max("timestamp").cast("string").alias("hi")).first()
    if r["lo"] is None:
        return etd.limit(0), lamp.limit(0)
    lo, hi = F.lit(r["lo"]).cast("timestamp_ntz"), F.lit(r["hi"]).cast("timestamp_ntz")
    etd_b = etd.where((F.col("timestamp") > add_minutes(lo, -60 * VISIBLE_HISTORY_HOURS))
                      & (F.col("timestamp") <= hi))
    lamp_b = lamp.where((F.col("timestamp") >= add_minutes(lo, -max(WEATHER_OFFSETS_MINUTES)))
                        & (F.col("timestamp") <= hi))
    return etd_b, lamp_b


ROUTERS = {"row": route_rows, "batch": route_batches}


def score_requests(requests: DataFrame, inputs: dict[str, DataFrame],
                   models: dict[tuple[str, str], PipelineModel], bound_inputs: bool = True,
                   router: str = "row", workdir: str | None = None) -> DataFrame:
    """Scores every request row; returns the requests, repeated ones included, with
    ``minutes_until_pushback`` (int, null when unscorable) and ``model_variant``.

    ``router`` is ``row`` (a row with a null weather value takes the no-weather
    model) or ``batch`` (all rows of an airport and prediction time do if one
    has a null feature).  Features are written to ``workdir``, a new shared
    folder by default, which the result reads.
    """
    if not models:
        raise ValueError("no models to score with")
    spark = requests.sparkSession
    keys = materialize(requests.select(*REQUEST_KEYS).distinct(), "request-keys")
    etd, lamp = inputs["etd"], inputs["lamp"]
    if bound_inputs:
        etd, lamp = time_bounded_inputs(keys, etd, lamp)
    feats = feature_pipeline(keys, etd, lamp, inputs["mfs"], strict=False, bounded=True)
    path = write_feature_table(feats, workdir or fresh_dir(spark, "scoring-features"))
    stored = read_feature_table(spark, path, schema=feats.schema)
    scored = dispatch_by_airport(stored, predictors_by_airport(models), ROUTERS[router])
    return attach_predictions(requests, scored)
