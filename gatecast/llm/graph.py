"""Distributed union-find and the linking of bucketed items.

DataFrame operations only.  Every round is written to the shared folder, so
no lineage grows and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.llm.store import broadcast_ids, keep

SMALL_EDGES = 50_000  # of two longs each: under 1 MB, stepped in one partition without a shuffle

def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step followed by one small-star step (edges child -> parent)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (both.join(low, "u").where(F.col("v") > F.col("u"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = (large.join(least, "u").where(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return small.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    Alternating large-star and small-star steps until every node points at
    its root.  Only counts and a checksum come to the driver.  Up to
    SMALL_EDGES counted edges are stepped in one partition, as a broadcast
    side of that size would be; beyond, the steps are shuffled.  An empty
    table gives an empty table; self-links and repeated links change nothing.
    """
    links = links.where("a is not null and b is not null")
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if now == state or now["n"] == 0:
            break
        state = now
        edges = keep(_stars(edges.coalesce(1) if now["n"] <= SMALL_EDGES else edges), "edges")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.union(tops)


SHARED_KEYS = 1_000_000  # of a key and a count: what one broadcast holds


def shared_buckets(buckets: DataFrame, passes: int = 1) -> DataFrame:
    """The rows of ``buckets(key, node)`` whose key others share, and ``n``, how many have it; written once.

    Up to ``passes`` times SHARED_KEYS shared keys are broadcast, a part of them in each pass over ``buckets``; beyond,
    all rows are shuffled to their keys.
    """
    count = keep(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "count")
    parts = -(-count.count() // SHARED_KEYS)
    if not 1 < parts <= passes:
        return keep(buckets.join(broadcast_ids(count, SHARED_KEYS), "key"), "shared")
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    found = [keep(buckets.join(F.broadcast(count.where(part == k)), "key"), "shared") for k in range(parts)]
    return reduce(DataFrame.unionByName, found)


def link_buckets(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], marks: Callable[[DataFrame], DataFrame],
                 may_link: Callable[[str, str], Column], exact: bool = False) -> DataFrame:
    """Components of the items that share a bucket and pass ``verify``.

    ``shared`` is that of ``shared_buckets``; ``verify`` takes pairs ``(a, b)``
    and returns those linked.  ``marks`` gives ``(node, mark)`` for a table of
    nodes, and ``may_link``, a condition on the names of two marks, rules out
    pairs across components before they are listed.  ``exact``: no linked pair is
    ever ruled out, so the pairs with a hub are held against it too before they
    are verified.

    First every member is held against its bucket's most central member, the
    one whose buckets are the fullest.  Buckets whose members then lie in one
    component need no more, whatever their size; in the others just the pairs
    across components are held against each other.  The components are those
    of all linked pairs that share a bucket, and the pairs inside a large group
    of copies are never listed.
    """
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = (shared.join(weight, "node").groupBy("key")
            .agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("hub"))
            .select("key", (-F.col("hub.node")).alias("hub")))
    first = (shared.join(hubs, "key").where("node <> hub")
             .select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct())
    if exact:
        marked = marks(keep(shared.select("node").distinct(), "sharing"))
        for c in "ab":
            first = first.join(marked.toDF(c, f"mark_{c}"), c)
        first = first.where(may_link("mark_a", "mark_b")).select("a", "b")
    first = keep(first, "pairs")
    comp = keep(components(verify(first)), "components")
    placed = shared.join(comp, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    rest = keep(placed.join(mixed, "key"), "mixed")
    rest = rest.join(marks(keep(rest.select("node").distinct(), "across")), "node")
    sides = [rest.select("key", *[F.col(c).alias(f"{c}_{x}") for c in rest.columns if c != "key"]) for x in "ab"]
    across = ((F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & may_link("mark_a", "mark_b"))
    left, right = sides[0].alias("l"), sides[1].alias("r")
    more = (left.join(right, (F.col("l.key") == F.col("r.key")) & across)
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
            .join(first, ["a", "b"], "left_anti"))
    more = keep(more, "pairs")
    if more.isEmpty():
        return comp
    # the later links join whole components, so only the roots' links are walked again
    roots = comp.toDF("node", "root")
    ends = keep(verify(more), "links")
    for c in ("a", "b"):
        ends = (ends.join(roots.toDF(c, "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root"))
    over = components(ends).toDF("root", "top")
    joined = comp.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = over.join(comp, F.col("node") == over["root"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return keep(joined.union(alone), "components")
