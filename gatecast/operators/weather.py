"""Weather-forecast lookup (F2, J1, U1, J2, F5, J3 and their composite J7).

A forecast issued at ``i`` with a 30-minute lead serves the four
prediction slots ``i+30, i+45, i+60, i+75``.  Instead of four equi-joins
and a union, each forecast row is exploded into its four slots, reduced
to one row per (airport, slot) keeping the freshest issue, and joined to
the labels once.  The slot table grows with airports x time, not with
the number of labels; whether it is broadcast is left to the planner, which
goes by its bytes at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.functions.timeops import add_minutes
from gatecast.schemas import (FORECAST_LEAD_MINUTES, LABEL, WEATHER,
                              WEATHER_OFFSETS_MINUTES)

WEATHER_OUT = ["forecast_timestamp"] + WEATHER


def drop_unused_weather(lamp: DataFrame) -> DataFrame:
    """The wind direction is never used."""
    return lamp.drop("wind_direction")


def forecasts_with_lead(lamp: DataFrame, lead_minutes: int = FORECAST_LEAD_MINUTES) -> DataFrame:
    """F2 + D1: keep forecasts whose lead over their issue time is exactly ``lead``."""
    return lamp.where(F.col("forecast_timestamp") == add_minutes("timestamp", lead_minutes))


def _slotted(lamp: DataFrame) -> DataFrame:
    """One row per (forecast, served slot); U1 without a union."""
    offsets = F.array(*[F.lit(m) for m in WEATHER_OFFSETS_MINUTES])
    return (
        forecasts_with_lead(drop_unused_weather(lamp))
        .withColumn("offset_minutes", F.explode(offsets))
        .withColumn("slot", add_minutes("timestamp", F.col("offset_minutes")))
        .withColumnRenamed("timestamp", "issue_timestamp")
    )


def weather_slots(lamp: DataFrame) -> DataFrame:
    """(airport, slot) -> freshest forecast serving it.

    ``max(struct(issue, ...))`` is a partial (map-side) aggregation, so a
    busy airport never funnels its raw forecasts through one task; ties on
    the issue time fall to the remaining fields, which makes it total.
    """
    best = F.max(F.struct("issue_timestamp", *WEATHER_OUT)).alias("w")
    return (
        _slotted(lamp)
        .groupBy("airport", "slot")
        .agg(best)
        .select("airport", F.col("slot").alias("timestamp"),
                F.col("w.issue_timestamp").alias("issue_timestamp"),
                *[F.col(f"w.{c}").alias(c) for c in WEATHER_OUT])
    )


def weather_matched(labels: DataFrame, lamp: DataFrame) -> DataFrame:
    """J1 + U1: every (label, forecast) pair the four shifted equi-joins produce."""
    slotted = _slotted(lamp).withColumnRenamed("slot", "timestamp")
    return labels.join(slotted, ["airport", "timestamp"], "inner").select(
        "gufi", "timestamp", "airport", LABEL, "issue_timestamp", *WEATHER_OUT)


def weather_unmatched(labels: DataFrame, lamp: DataFrame) -> DataFrame:
    """J2 + F5: labels no forecast serves (the ``left_only`` side)."""
    keys = weather_slots(lamp).select("airport", "timestamp")
    return labels.join(keys, ["airport", "timestamp"], "left_anti")


def join_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a full outer join on ``keys`` (null-safe, as pandas matches
    NaN) with a ``_merge`` column of ``both`` / ``left_only`` / ``right_only``.

    Written as a left join against the right side's distinct keys plus an
    anti join for the right-only keys.  A full outer join cannot have a hot
    key split at run time; a left join can (AQE splits the left side), and
    duplicate keys never multiply into all pairs.  The rows and indicator
    equal those of the full outer join with the right side's keys deduped.
    """
    def null_safe(a: DataFrame, b: DataFrame):
        cond = None
        for k in keys:
            c = a[k].eqNullSafe(b[f"_r_{k}"])
            cond = c if cond is None else cond & c
        return cond

    lk = left.select(*keys)
    rk = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct()
    matched = lk.join(rk.withColumn("_in_right", F.lit(True)), null_safe(lk, rk), "left")
    left_rows = matched.select(*keys, F.when(F.col("_in_right"), F.lit("both"))
                               .otherwise(F.lit("left_only")).alias("_merge"))
    lkd = lk.distinct()
    right_only = rk.join(lkd, null_safe(lkd, rk), "left_anti").select(
        *[F.col(f"_r_{k}").alias(k) for k in keys], F.lit("right_only").alias("_merge"))
    return left_rows.unionByName(right_only)


def weather_lookup(labels: DataFrame, lamp: DataFrame) -> DataFrame:
    """J7 (= J1, U1, J2, F5, J3): every label once, with the freshest forecast
    that serves its slot, or nulls when none does."""
    slots = weather_slots(lamp).drop("issue_timestamp")
    return labels.join(slots, ["airport", "timestamp"], "left")
