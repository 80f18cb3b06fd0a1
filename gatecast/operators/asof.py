"""Backward as-of join of estimate updates to prediction requests.

An update issued at ``u`` counts for prediction time ``t`` once its
quarter-hour ceiling is <= ``t``; among those the latest (by issue time,
then by estimate) wins.

Plan, chosen so that no group grows with row counts:

1. A1: updates are reduced to one row per (airport, gufi, slot) with a
   partial aggregate ``max(struct(issue, estimate))``.
2. Requests are reduced to their distinct (airport, gufi, floor-slot).
3. Both sides, now on the 15-minute grid, are unioned and a running
   ``last(e, ignorenulls)`` over (airport, gufi) ordered by (slot, side)
   carries the latest update forward.  A group holds at most two rows
   per quarter-hour of the flight's life, whatever the data volume.
4. The per-slot answer is joined back to the requests (N:1 equi-join;
   AQE splits a skewed request key).

No request/update pairs are ever formed, so the cost is linear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecast.functions.timeops import add_minutes, ceil_slot, floor_slot

DEP = "departure_runway_estimated_time"


def latest_per_slot(etd: DataFrame) -> DataFrame:
    """A1 (+O1): latest update per (airport, gufi, rounded slot)."""
    e = F.max(F.struct(F.col("timestamp"), F.col(DEP))).alias("e")
    return (
        etd.withColumn("rounded_timestamp", ceil_slot("timestamp"))
        .groupBy("airport", "gufi", "rounded_timestamp")
        .agg(e)
        .select("airport", "gufi", "rounded_timestamp",
                F.col("e.timestamp").alias("timestamp"), F.col(f"e.{DEP}").alias(DEP))
    )


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A2 (+O1): one row per ``keys``, the one greatest in ``order`` (then the
    other columns, so the choice is total).  A partial aggregate, not a window,
    so duplicate-heavy keys are reduced map-side."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(
        *keys, *[F.col(f"_best.{c}").alias(c) for c in order + rest]).select(*df.columns)


def asof_per_slot(request_keys: DataFrame, etd: DataFrame) -> DataFrame:
    """(airport, gufi, slot) -> latest update struct ``e`` (null when none)."""
    updates = latest_per_slot(etd).select(
        "airport", "gufi", F.col("rounded_timestamp").alias("slot"), F.lit(0).alias("side"),
        F.struct(F.col("timestamp"), F.col(DEP)).alias("e"))
    requests = request_keys.select(
        "airport", "gufi", floor_slot("timestamp").alias("slot")).distinct().select(
        "airport", "gufi", "slot", F.lit(1).alias("side"),
        F.lit(None).cast(updates.schema["e"].dataType).alias("e"))
    w = (Window.partitionBy("airport", "gufi").orderBy("slot", "side")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        updates.unionByName(requests)
        .withColumn("known", F.last("e", ignorenulls=True).over(w))
        .where(F.col("side") == 1)
        .select("airport", "gufi", "slot", "known")
    )


def asof_etd(requests: DataFrame, etd: DataFrame, strict: bool = True,
             max_age_hours: int | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Attach ``update_timestamp`` and the estimate known at each request.

    ``strict`` drops requests with no usable update (the reference's filter);
    otherwise they are kept with nulls.  ``max_age_hours`` (T2) hides updates
    issued more than that long before the request.  ``extra`` is an optional
    per-(airport, gufi) table joined onto the per-slot answer before it meets
    the requests, so the wide request side is shuffled once for both.
    """
    per_slot = asof_per_slot(requests, etd)
    if extra is not None:
        per_slot = per_slot.join(extra, ["airport", "gufi"], "left")
    r = requests.withColumn("slot", floor_slot("timestamp"))
    j = r.join(per_slot, ["airport", "gufi", "slot"], "left")
    known_ts = F.col("known.timestamp")
    visible = known_ts.isNotNull()
    if max_age_hours is not None:
        visible = visible & (known_ts > add_minutes("timestamp", -60 * max_age_hours))
    j = j.withColumn("known", F.when(visible, F.col("known")))
    if strict:
        j = j.where(F.col("known").isNotNull())
    return j.select(
        *[c for c in j.columns if c not in ("slot", "known")],
        known_ts.alias("update_timestamp"), F.col(f"known.{DEP}").alias(DEP))
