import random

import pytest
from pyspark.sql import functions as F

from gatecast.llm import graph


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_of_chains_stars_and_cycles(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(500, 100 + i) for i in range(60)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 3)]
    links += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    rng.shuffle(links)
    got = graph.components(spark.createDataFrame(links + links[:9], "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shared_keys_in_passes_are_those_of_one_join(spark, monkeypatch):
    buckets = spark.createDataFrame([(k, n) for n in range(40) for k in (n % 7, 100 + n, 200 + n // 2)], "key long, node long")
    once = sorted(map(tuple, graph.shared_buckets(buckets, 16).collect()))
    monkeypatch.setattr(graph, "SHARED_KEYS", 5)
    assert len(once) == 80 and sorted(map(tuple, graph.shared_buckets(buckets, 16).collect())) == once
    assert sorted(map(tuple, graph.shared_buckets(buckets, 2).collect())) == once


@pytest.mark.parametrize("exact, asked", [(True, {(2, 1)}), (False, {(2, 1), (3, 1), (3, 2)})])
def test_pairs_with_a_hub_are_held_against_the_marks_first(spark, exact, asked):
    shared = spark.createDataFrame([(7, n, 3) for n in (1, 2, 3)] + [(8, 2, 2), (8, 3, 2)], "key long, node long, n long")
    seen = set()

    def verify(pairs):
        seen.update((r.a, r.b) for r in pairs.collect())
        return pairs.where("a = 2 and b = 1")

    comp = graph.link_buckets(shared, verify, lambda of: of.select("node", (F.col("node") > 2).alias("mark")), lambda a, b: F.col(a) == F.col(b), exact)
    assert seen <= asked and (2, 1) in seen and ((3, 2) in seen) != exact
    assert {r.node: r.root for r in comp.collect()} == {1: 1, 2: 1}
