"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

What is packed are groups of equal texts.  A group that holds 1/64 of a
shard's share or more of any measure is an item of its own, cut by a hash of
the id into parts of about that share if it is larger; the other groups are
gathered by hash into a fixed number of items.  So the number of items is
bounded whatever the data, their exact measures fit on the driver, and no
group is cut unless it is large.  Items go, largest first, to the shard where
the dot product of item and residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecast.llm.store import keep, word_count

FINE = 64                # a large group has 1/FINE of a shard's share
GATHERED = 128           # items per shard that gather the other groups
BLOCK_ROWS = 200_000     # rows of a shard that are numbered in one task
MEASURES = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item, given the measures as rows.

    Measures count as shares of the capacity, which is the mean per shard.
    Ties go to the lower shard.  Afterwards items move from the shard with the
    most bytes to the one with the fewest as long as that evens them.
    """
    total = np.maximum(items.sum(0, keepdims=True), 1e-9)
    share = items / total * shards
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-share.max(1), kind="stable"):
        out[i] = int(np.argmax(left @ share[i]))
        left[out[i]] -= share[i]
    load = np.bincount(out, weights=items[:, 0], minlength=shards)
    for _ in range(20 * shards):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        mine = np.flatnonzero(out == high)
        if not len(mine):
            break
        best = mine[np.argmin(np.abs(items[mine, 0] - gap / 2))]
        if not 0 < items[best, 0] < gap:
            break
        out[best] = low
        load[high] -= items[best, 0]
        load[low] += items[best, 0]
    return out


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Deal all rows of ``docs(doc_id, text)`` to shards 0 to ``shards`` - 1.

    Returns doc_id, size (UTF-8 bytes plus 8; a null text has none), n_tokens
    (words), text_crc32, law (``bytes``: sizes are near equal), shard, slot
    (gapless from 0 within the shard) and grown_shard (null: the law is not
    ``key``).  Null and empty texts are one group.  Repeated rows each take a
    slot.  Null ids hash alike, so a large group of them cannot be cut.  Other
    columns are left aside; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                            word_count("text").alias("n_tokens"), F.crc32(text).alias("text_crc32"),
                            F.xxhash64(text).alias("text_hash")), "rows")
    same = ["text_hash", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    all_ = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(m) for c, m in (("size", "bytes"), ("n_tokens", "tokens"))], F.count("*").alias("rows")).first()
    fine = shards * FINE
    # shares of 1/fine: at most 3 * fine groups reach one, so this side is small by construction
    parts = F.ceil(F.greatest(*[F.col(m) * F.lit(fine) / F.lit(max(all_[m], 1)) for m in MEASURES])).cast("int")
    large = groups.withColumn("parts", parts).where(F.greatest(*[F.col(m) * F.lit(fine) / F.lit(max(all_[m], 1)) for m in MEASURES]) >= 1)
    marked = rows.join(F.broadcast(large.select(*same, "parts")), same, "left")
    item = F.when(F.col("parts").isNull(), F.struct(F.pmod("text_hash", F.lit(shards * GATHERED)).alias("a"), F.lit(-1).cast("long").alias("b"))) \
        .otherwise(F.struct(F.col("text_hash").alias("a"), F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("long").alias("b")))
    marked = keep(marked.select("doc_id", "size", "n_tokens", "text_crc32", item["a"].alias("item"), item["b"].alias("part")), "items")
    measured = (marked.groupBy("item", "part").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
                .orderBy("item", "part").collect())
    where = pack(np.array([[r[m] for m in MEASURES] for r in measured], float).reshape(-1, 3), shards)
    plan = docs.sparkSession.createDataFrame([(r["item"], r["part"], int(s)) for r, s in zip(measured, where)], "item bigint, part bigint, shard int")
    blocks = max(1, -(-all_["rows"] // (shards * BLOCK_ROWS)))
    placed = keep(marked.join(F.broadcast(plan), ["item", "part"])
                  .withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks))), "placed")
    count = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    starts = count.withColumn("start", start).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return (placed.withColumn("number", number).join(starts, ["shard", "block"])
            .select("doc_id", "size", "n_tokens", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
