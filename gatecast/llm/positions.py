"""Exact positions of rows in a sorted order, without sorting anything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecast.llm.store import keep


def with_positions(df: DataFrame, order: list[Column], group: str | None = None, out: str = "position",
                   total: str | None = None) -> DataFrame:
    """All rows of ``df`` with their position (long, from 0) by ``order`` within ``group``, or in all.

    ``total`` names a column for the number of rows in the group, or in all.

    Rows are dealt to ranges of (group, order), so a hot group spans as many
    ranges as its share of the rows; a row's position is the number of its
    group's rows in earlier ranges and its place in its own.  Rows that tie in
    ``order`` keep an arbitrary but fixed order, and even a run of them longer
    than a range is split.  ``group`` must hold no nulls; an empty table stays
    empty.  Columns ``__tie``, ``__range``, ``__n``, ``__before`` and
    ``__total`` are reserved.
    """
    keys = ([F.col(group)] if group else []) + order
    stable = keep(df, "unordered")  # what follows reads it twice, and ties need a row number that stays
    dealt = (stable.withColumn("__tie", F.monotonically_increasing_id())
             .repartitionByRange(*keys, F.col("__tie")).withColumn("__range", F.spark_partition_id()))
    ranged = keep(dealt, "ranges")
    by = ([group] if group else []) + ["__range"]
    sizes = ranged.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    same = Window.partitionBy(group or F.lit(0))  # holds one row a range, not the group's rows
    earlier = same.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
                           F.sum("__n").over(same).alias(total or "__total"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order, "__tie"))
    return (ranged.join(offsets, by).withColumn(out, F.col("__before") + place - 1)
            .drop("__tie", "__range", "__before", "__total"))
