"""Flight metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.operators.asof import keep_latest
from gatecast.schemas import FLIGHT_CATEGORICAL


def departures(mfs: DataFrame) -> DataFrame:
    """F1 + P1: departing flights only (a null flag drops the row)."""
    return mfs.where(F.col("isdeparture")).drop("isdeparture")


def one_per_flight(mfs: DataFrame) -> DataFrame:
    """Departure metadata with one row per (airport, gufi): the greatest by its columns, null last."""
    meta = departures(mfs).select("airport", "gufi", *FLIGHT_CATEGORICAL)
    return keep_latest(meta, ["airport", "gufi"], FLIGHT_CATEGORICAL)


def left_join_metadata(df: DataFrame, mfs: DataFrame) -> DataFrame:
    """Attach departure metadata, keyed by airport as well as gufi."""
    meta = departures(mfs).select("airport", "gufi", *FLIGHT_CATEGORICAL)
    return df.join(meta, ["airport", "gufi"], "left")
