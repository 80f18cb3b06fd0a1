"""The four model inputs (labels, etd, lamp, mfs) derived from the driver's tables.

The driver ships TPC-H-like tables, not flight data, so the inputs are
views over ``events`` and ``customer`` (definitions in FIXTURES.md).  They
are plain DataFrame transformations, so they scale with the base tables
and Catalyst prunes the columns each query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.functions.timeops import US_PER_MINUTE, ceil_slot, floor_slot


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _airport_of(col: str) -> F.Column:
    return F.concat(F.lit("A"), (F.col(col) % 10).cast("string"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (gufi, prediction slot, airport) with the label in minutes."""
    ev = _events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return (
        ev.select(
            F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("gufi"),
            ceil_slot("ts").alias("timestamp"),
            _airport_of("user_id").alias("airport"),
            F.bround("value", 0).cast("int").alias("minutes_until_pushback"),
        )
        .groupBy("gufi", "timestamp", "airport")
        .agg(F.min("minutes_until_pushback").alias("minutes_until_pushback"))
    )


def etd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departure-time estimate updates: issue time and estimated runway time."""
    ev = _events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return ev.select(
        _airport_of("user_id").alias("airport"),
        F.concat(F.lit("G"), F.col("user_id").cast("string")).alias("gufi"),
        F.col("ts").alias("timestamp"),
        F.timestamp_add("SECOND", F.bround(F.col("value") * 60, 0).cast("int"), F.col("ts"))
        .alias("departure_runway_estimated_time"),
    )


def lamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather forecasts: issue hour, forecast time, readings."""
    ev = _events(spark, sf_dir).where(F.col("event_type").isin("error", "signup"))
    # hour truncation in integer microseconds: no session time zone involved
    issue = floor_slot("ts", 60 * US_PER_MINUTE)
    lead = ((F.col("event_id") % 2 + 1) * 30).cast("int")
    return (
        ev.select(
            _airport_of("user_id").alias("airport"),
            issue.alias("timestamp"),
            F.timestamp_add("MINUTE", lead, issue).alias("forecast_timestamp"),
            "event_id", "user_id", "event_type", "value",
        )
        .groupBy("airport", "timestamp", "forecast_timestamp")
        .agg(
            F.min("value").alias("temperature"),
            (F.max(F.col("event_id") % 36) * 10).cast("double").alias("wind_direction"),
            F.max("value").alias("wind_speed"),
            F.when(F.min("event_id") % 5 == 0, F.lit(None))
            .otherwise(F.min(F.col("event_id") % 11)).cast("double").alias("wind_gust"),
            F.min(F.col("event_id") % 7).cast("double").alias("cloud_ceiling"),
            F.min(F.col("event_id") % 5).cast("double").alias("visibility"),
            F.min(F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string"))).alias("cloud"),
            F.min(F.concat(F.lit("L"), (F.col("event_id") % 4).cast("string"))).alias("lightning_prob"),
            F.when(F.bool_or(F.col("event_type") == "error"), F.lit("True"))
            .otherwise(F.lit("False")).alias("precip"),
        )
    )


def mfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flight metadata, one row per flight."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    nat = F.col("c_nationkey")
    return c.select(
        _airport_of("c_custkey").alias("airport"),
        F.concat(F.lit("G"), key.cast("string")).alias("gufi"),
        F.concat(F.lit("E"), (nat % 3).cast("string")).alias("aircraft_engine_class"),
        F.col("c_mktsegment").alias("aircraft_type"),
        F.when(key % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("M"), (nat % 5).cast("string"))).alias("major_carrier"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("F"), (nat % 2).cast("string"))).alias("flight_type"),
        (F.col("c_acctbal") > 0).alias("isdeparture"),
    )


def load_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "labels": labels(spark, sf_dir),
        "etd": etd(spark, sf_dir),
        "lamp": lamp(spark, sf_dir),
        "mfs": mfs(spark, sf_dir),
    }
