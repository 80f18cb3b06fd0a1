"""Scalar helpers: null fill, row null test, rounding, clipping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.schemas import FILL_VALUE, FILLED_WITH_OTHER


def fill_other(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fill null categories with the fixed fill value."""
    return df.fillna(FILL_VALUE, subset=cols or FILLED_WITH_OTHER)


def any_null(cols: list[str]) -> Column:
    """True when any of ``cols`` is null in this row."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols], F.lit(False))


def round_half_even_int(col: Column | str) -> Column:
    """Numpy-style round (half to even) then cast to int."""
    c = F.col(col) if isinstance(col, str) else col
    return F.bround(c, 0).cast("int")


def clip(col: Column | str, lo: Column, hi: Column) -> Column:
    """Clamp into [lo, hi]."""
    c = F.col(col) if isinstance(col, str) else col
    return F.least(F.greatest(c, lo), hi)


def choose_by_row(has_null: Column, when_null: Column, otherwise: Column) -> Column:
    """Pick the no-weather prediction for rows flagged by A8."""
    return F.when(has_null, when_null).otherwise(otherwise)
