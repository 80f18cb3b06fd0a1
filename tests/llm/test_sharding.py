import random
import zlib
from collections import defaultdict

import numpy as np

from gatecast.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join("wort" + str(rng.randrange(99)) for _ in range(rng.randint(1, 60))), "x") for i in range(1500)]
    rows += [(5000 + i, "the same text again and again", "x") for i in range(700)]
    rows += [(6000, None, None), (6001, ""), (6002, None), (None, "no id"), (7, rows[7][1], "x"), (8000, "é" * 5000, "x")]
    return [(*r, None)[:3] for r in rows]


def test_bytes_are_even_and_slots_gapless(spark):
    rows = corpus()
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 6).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted(
        (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    slots, load = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert set(slots) == set(range(6))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= 1.05 * min(load.values())
    count = [len(s) for s in slots.values()]
    assert max(count) <= 1.5 * min(count)


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i % 400} of some length", None) for i in range(1200)]
    out = sharding.shard_documents(spark.createDataFrame(rows, SCHEMA), 4).collect()
    where = defaultdict(set)
    for r in out:
        where[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == 0


def test_empty_and_tiny_tables(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    assert len(sharding.shard_documents(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()) == 1


def test_pack_takes_the_highest_dot_product():
    items = np.array([[8, 1, 1], [8, 1, 1], [1, 8, 8], [1, 8, 8]], float)
    out = sharding.pack(items, 2)
    assert sorted(items[out == 0][:, 0]) == sorted(items[out == 1][:, 0]) == [1, 8]
