import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatecast.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k):
    vectors = sorted({(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v, _ in rows
                      if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, q in vectors:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i and len(v) == len(q) > 0)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("cell, block", [(2048, 4096), (60, 64)])
def test_equals_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(topk, "CELL_ROWS", cell)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = random.Random(1)
    rows = []
    for i in range(900):
        centre = 3 * (i % 4)
        rows.append((i, [centre * (d == i % 4) + rng.gauss(0, 0.2) for d in range(8)], "x"))
    rows += [(1000 + i, [0.25] * 8, "x") for i in range(300)]
    rows += [(2000, None, "x"), (2020, [1.0, None] * 4, "x"), (2040, [float("nan")] * 8, "x"), (2060, [float("inf")] * 8, "x"), (None, [0.1] * 8, "x"),
             (2080, [0.5, 0.5], "x"), (2081, [0.5, -0.5], "x"), (2100, [], "x"), (0, rows[0][1], "x"), (2120, [1e7] * 8, "x"), (2121, [-1e7] * 8, "x")]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 7).collect())
    assert got == brute(rows, 7)


def test_large_finite_components_take_part(spark):
    rows = [(0, [2.0 ** 30, 1.0], "x"), (1, [2.0 ** 20, 3.0], "x"), (2, [0.0, 2.0 ** 54], "x"), (3, [-1.0, 0.25], "x"), (20, [0.0, 0.015625], "x")]
    whole = {r.vec_id: r.v for r in topk.scale(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert whole[2] == [0, 2 ** 60] and len(whole) == 5
    small = [rows[4], rows[2], rows[3]]
    assert sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(small, SCHEMA), F.col("vec_id") % 20 == 0, 7).collect()) == brute(small, 7)


def test_a_component_beyond_a_long_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        topk.scale(spark.createDataFrame([(0, [2.0 ** 60], "x")], SCHEMA)).collect()


def test_empty_table_and_single_row(spark):
    for rows in ([], [(20, [1.0], "x")]):
        assert topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def test_far_cells_are_not_needed():
    pivots = np.array([[100.0, 0], [0, 100.0], [-100.0, 0]])
    q, s = pd.DataFrame({"cell": [0], "n": [5], "far": [1.0]}), pd.DataFrame({"cell": [0, 1, 2], "n": [50, 50, 50], "far": [1.0, 1.0, 1.0]})
    assert topk.needed_pairs(pivots, q, s, 20) == [(0, 0)]
    assert len(topk.needed_pairs(pivots, q, s, 60)) == 2
