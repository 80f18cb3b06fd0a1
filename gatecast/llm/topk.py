"""Exact top-k search by inner product: a Voronoi join of queries and data.

Pivots cut the vectors into cells (nearest pivot).  Per cell a summary is
taken: the number of vectors, the largest distance to the pivot and the
largest norm.  For a query cell and a data cell these bound every inner
product from above and below.  From the lower bounds and the counts follows a
score that each query of the cell reaches with k vectors at least; a data cell
whose upper bound is smaller is not needed.  Only needed pairs of cells are
joined.  Cells go in blocks of bounded size, so a cell that holds a third of
all vectors is many blocks; a pair of blocks is solved in one matrix product,
and the k best of each query are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecast.llm.store import keep

CELL_ROWS = 2048       # vectors per cell aimed at
MAX_PIVOTS = 256       # pivots and summaries are the only thing that comes to the driver
BLOCK_ROWS = 4096


def scale(vectors: DataFrame) -> DataFrame:
    """Rows ``(vec_id, dim, v)`` with v the floor of 64 times each component; rows not fit for it go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fit = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    fits = lambda c: (c >= F.lit(-2.0 ** 57)) & (c < F.lit(2.0 ** 57))
    whole = lambda c: F.when(fits(c), F.floor(c * 64).cast("long")).otherwise(F.raise_error(F.lit("64 times a component does not fit a long")).cast("long"))
    # a distinct vector id is one vector; repeated rows count once
    return (fit.where(~F.coalesce(bad, F.lit(False)))
            .select("vec_id", F.size("x").alias("dim"), F.transform("x", whole).alias("v"))
            .dropDuplicates(["vec_id", "v"]))


def _pivots(vectors: DataFrame, dim: int, rows: int) -> np.ndarray:
    n = int(min(MAX_PIVOTS, max(1, rows // CELL_ROWS)))
    picked = (vectors.where(F.col("dim") == dim).groupBy("v").agg(F.min(F.xxhash64("vec_id")).alias("h"))
              .orderBy("h", "v").limit(n).collect())
    return np.array([r["v"] for r in picked], float).reshape(len(picked), dim)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _celled(vectors: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """Each vector's cell, distance to its pivot and norm."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        pp = (p * p).sum(1)
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            d = pp[None, :] - 2 * (x @ p.T)
            cell = d.argmin(1)
            far = np.sqrt(np.maximum(((x - p[cell]) ** 2).sum(1), 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int64)), pa.array(far),
                                              pa.array(np.sqrt((x * x).sum(1)))], names=["vec_id", "v", "cell", "far", "norm"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id bigint, v array<bigint>, cell bigint, far double, norm double")


def needed_pairs(pivots: np.ndarray, q: pd.DataFrame, s: pd.DataFrame, k: int) -> list[tuple[int, int]]:
    """Pairs of query cell and data cell that can hold one of a query's k best.

    With q = p + a and s = r + b: q.s = p.r + p.b + a.r + a.b, so it differs
    from p.r by at most |p||b| + |a||r| + |a||b|.  One vector more than k is
    asked for, as the query's own row does not count.
    """
    dot = pivots @ pivots.T
    norm = np.sqrt((pivots * pivots).sum(1))
    out = []
    data, count, far = s["cell"].to_numpy(), s["n"].to_numpy(), s["far"].to_numpy()
    for cell, a in zip(q["cell"].to_numpy(), q["far"].to_numpy()):
        spread = norm[cell] * far + a * norm[data] + a * far + 1e-6 * (1 + norm[cell] * norm[data])
        low, high = dot[cell, data] - spread, dot[cell, data] + spread
        order = np.argsort(-low, kind="stable")
        reach = np.searchsorted(np.cumsum(count[order]), k + 1)
        least = low[order[reach]] if reach < len(order) else -np.inf
        out += [(int(cell), int(d)) for d in data[high >= least]]
    return out


def _blocks(celled: DataFrame, side: str) -> DataFrame:
    """One row per block: its cell and its vectors, packed."""
    count = celled.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS / 2)).alias("parts"))
    dealt = celled.join(F.broadcast(count), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(rows["v"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})

    packed = dealt.select("cell", "part", "vec_id", "v").groupBy("cell", "part").applyInPandas(pack, "cell bigint, part bigint, ids binary, m binary")
    return packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns])


def _solve(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """The k best of every query of a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qi, qm, si, sm = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("q_ids", "q_m", "s_ids", "s_m"))
                q, s = qm.reshape(-1, dim), sm.reshape(-1, dim)
                # whole numbers below 2**53 are exact in floating point, else Python's own are used
                exact = dim * (np.abs(q).max(initial=0).astype(float) + 1) * (np.abs(s).max(initial=0).astype(float) + 1) < 2 ** 53
                for lo in range(0, len(q), 512):
                    part = q[lo:lo + 512]
                    score = (part.astype(float) @ s.T.astype(float)).astype(np.int64) if exact else part.astype(object) @ s.T.astype(object)
                    if not exact:
                        if max(abs(int(score.min())), abs(int(score.max()))) >= 2 ** 63:
                            raise OverflowError("an inner product does not fit a long")
                        score = score.astype(np.int64)
                    own = qi[lo:lo + 512, None] == si[None, :]
                    least = np.iinfo(np.int64).min
                    score = np.where(own, least, score)
                    if len(si) > k:
                        cut = np.partition(score, len(si) - k, axis=1)[:, len(si) - k]
                        row, col = np.nonzero((score >= cut[:, None]) & ~own)
                    else:
                        row, col = np.nonzero(~own)
                    val, ids = score[row, col], si[col]
                    order = np.lexsort((ids, -val, row))
                    row, val, ids = row[order], val[order], ids[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    best = place < k
                    yield pa.RecordBatch.from_arrays([pa.array(qi[lo:lo + 512][row[best]]), pa.array(ids[best]), pa.array(val[best])],
                                                     names=["query_id", "vec_id", "score"])

    return pairs.select("q_ids", "q_m", "s_ids", "s_m").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries, k: int = 20) -> DataFrame:
    """The ``k`` highest inner products of each query vector with all others: query_id, rank, vec_id, score.

    ``vectors`` needs vec_id and embedding; ``queries`` is a condition on
    vec_id that picks the queries out of them.  Components become
    floor(64 * x).  Ties go to the smaller vec_id.  Vectors that are null or
    hold a null or non-finite component take no part, nor do null ids.  A
    finite component or an inner product that does not fit a long is an error.  Repeated rows count once; rows of the query's own vec_id
    are not among its candidates.  Vectors of different length never meet.  A
    query without candidates has no row; an empty table gives an empty result.
    """
    whole = keep(scale(vectors), "vectors")
    results = None
    for shape in whole.groupBy("dim").agg(F.count("*").alias("n")).where("dim > 0").orderBy("dim").collect():
        dim = shape["dim"]
        pivots = _pivots(whole, dim, shape["n"])
        data = keep(_celled(whole.where(F.col("dim") == dim), pivots, dim), "cells")
        asked = data.where(queries)
        summary = [x.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).orderBy("cell").toPandas() for x in (asked, data)]
        pairs = needed_pairs(pivots, *summary, k)
        wanted = data.sparkSession.createDataFrame(pairs, "q_cell bigint, s_cell bigint")
        q, s = _blocks(asked, "q"), _blocks(data, "s")
        met = q.join(F.broadcast(wanted), "q_cell").join(s, "s_cell")
        found = _solve(met.repartition("q_cell", "q_part", "s_cell", "s_part"), dim, k)
        results = found if results is None else results.union(found)
    if results is None:
        results = whole.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (results.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
