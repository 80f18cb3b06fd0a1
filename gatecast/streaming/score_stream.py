"""Scoring requests as they come due, from streams of updates, forecasts and requests.

The stateful lookup answers each request with the estimate known at its time.
Every micro-batch of answers gets its metadata, weather and time features and is scored by both
variants' models, all airports in one plan.  Its rows replace those of an
earlier attempt of the same batch, so a restart never repeats a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.functions.scalar import fill_other
from gatecast.operators.metadata import one_per_flight
from gatecast.operators.weather import weather_lookup
from gatecast.plans.boosting import Boosted, score_boosted
from gatecast.plans.features import add_time_features
from gatecast.plans.predict import time_bounded_inputs
from gatecast.schemas import FEATURE_COLUMNS, LABEL, REQUEST_KEYS
from gatecast.streaming.asof_stream import estimate_stream


def answered_features(answers: DataFrame, lamp: DataFrame, mfs: DataFrame) -> DataFrame:
    """Scoring features of answered requests, as the batch pipeline makes them, and ``rows`` and ``late``."""
    known = answers.withColumn(LABEL, F.lit(None).cast("int")).join(one_per_flight(mfs), ["airport", "gufi"], "left")
    out = fill_other(add_time_features(weather_lookup(known, lamp)))
    return out.select(*FEATURE_COLUMNS, "rows", "late")


def start_scoring(updates: DataFrame, requests: DataFrame, lamp: DataFrame, mfs: DataFrame, full: Boosted, no_weather: Boosted,
                  out_dir: str, checkpoint: str, delay: str = "1 hour", available_now: bool = True):
    """Score streamed requests into ``out_dir``; returns the query.

    ``lamp`` and ``mfs`` are read anew for every batch, the forecasts only as
    far back as the batch's requests can see; a forecast serves times at least
    half an hour after its issue, so it is there when they come due.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        answers = batch.persist()  # the times' range and the rows; a lost block is made again from the batch
        try:
            _, forecasts = time_bounded_inputs(answers, lamp.limit(0), lamp)
            scored = score_boosted(answered_features(answers, forecasts, mfs), full, no_weather)
            rows = scored.select(*REQUEST_KEYS, "rows", "late", "model_variant", F.col("prediction").alias(LABEL))
            rows.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")
        finally:
            answers.unpersist()

    w = estimate_stream(updates, requests, delay).writeStream.outputMode("append").foreachBatch(score).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
