"""The end-to-end feature pipeline.

labels (keys + label only)
       -> as-of estimate + departure metadata: joined to each other on the
          small per-slot table, then to the labels in the one shuffle the
          label side takes, while it is still four columns wide
       -> weather lookup (broadcast; no second shuffle of the labels)
       -> baseline, calendar parts, category fill.

The weather join is a left join on a key that is unique in the slot
table, so it commutes with the as-of step; running it last keeps the
weather columns out of the shuffle and, in strict mode, skips rows the
as-of step drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.functions import timeops as t
from gatecast.functions.scalar import fill_other
from gatecast.operators.asof import DEP, asof_etd
from gatecast.operators.metadata import one_per_flight
from gatecast.operators.weather import weather_lookup
from gatecast.schemas import FEATURE_COLUMNS, LABEL, VISIBLE_HISTORY_HOURS


def add_time_features(df: DataFrame) -> DataFrame:
    """D5-D9 from the estimate known at prediction time."""
    dep = F.col(DEP)
    return df.select(
        "*",
        t.baseline_minutes("timestamp", dep).alias("benchmark_pushback"),
        t.day_name(dep).alias("day_of_week"),
        t.month_name(dep).alias("month"),
        F.hour(dep).alias("hour"),
        F.year(dep).alias("year"),
    )


def feature_pipeline(labels: DataFrame, etd: DataFrame, lamp: DataFrame, mfs: DataFrame,
                     strict: bool = True, bounded: bool = False,
                     keep_estimate: bool = False) -> DataFrame:
    """One feature row per label row.

    ``strict`` (training) drops rows with no earlier estimate and repeated
    labels, as the reference does; scoring keeps both, with null estimate and
    features.  Repeated metadata of a flight never multiplies rows.
    ``bounded`` applies the 30-hour visibility rule (T2).  ``keep_estimate``
    also returns the raw estimate, for exact integer-microsecond metrics.
    """
    if LABEL not in labels.columns:
        labels = labels.withColumn(LABEL, F.lit(None).cast("int"))
    base = labels.select("gufi", "timestamp", "airport", LABEL)
    if strict:
        base = base.distinct()  # A2: a repeated label counts once in training
    joined = asof_etd(base, etd, strict=strict,
                      max_age_hours=VISIBLE_HISTORY_HOURS if bounded else None, extra=one_per_flight(mfs))
    out = fill_other(add_time_features(weather_lookup(joined, lamp)))
    return out.select(*FEATURE_COLUMNS, *([DEP] if keep_estimate else []))
