"""Null analysis.

Whole-frame questions ("which columns have nulls", "does this batch have
a null") are answered with one aggregation pass, never by pulling rows
to the driver; only per-column counts (bounded by the schema) come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.functions.scalar import any_null


def drop_null_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any (or the given) column."""
    return df.na.drop("any", subset=cols)


def null_profile(df: DataFrame) -> DataFrame:
    """A7 (first half): one row per column with its null count; one scan."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "null_count")


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Keep only columns with no nulls (the schema depends on the data)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if row[c] == 0])


def with_row_null_flag(df: DataFrame, cols: list[str], name: str = "has_null") -> DataFrame:
    """Per-row any-null flag over ``cols``."""
    return df.withColumn(name, any_null(cols))


def with_batch_null_flag(df: DataFrame, cols: list[str], batch_keys: list[str],
                         name: str = "batch_has_null") -> DataFrame:
    """Whether any row of the batch (``batch_keys``) has a null in ``cols``.

    A partial aggregate per batch joined back, rather than a window, so a
    huge batch is reduced map-side instead of buffered in one task.
    """
    flags = df.groupBy(*batch_keys).agg(F.bool_or(any_null(cols)).alias(name))
    return df.join(flags, batch_keys, "left")
