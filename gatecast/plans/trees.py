"""Many regression trees of an airport at once: random forests and the trials of a search.

Rows are binned once (numbers by quantiles, categories by level) and written as
chunks: some thousand rows by column in one compressed binary value.  Trees need
copies of the rows, and a table is copied as often as there are tasks to run at
once, not once a model.  A tree is grown from the top in two phases.

1. While a node holds more than ``GROUP_ROWS`` rows, its rows are spread over
   slices: every (copy, slice) group sums weights and targets by feature and
   bin, the sums of a node meet in one group, and its best split, one row, comes
   to the driver.
2. A node with fewer rows is one group, and the tree below it is grown there.

So no group holds more rows than that, and a table whose airports are small needs
one shuffle for all trees.  Where nodes have to be dealt to groups, WAVE models at
a time are, so that the disk holds no more copies of the rows.  Deep nodes hold few
rows: they never leave their task,
where a histogram a node would cost more than the rows themselves.  Trees go to a
table of one row a part (the top of a tree, or what is below one of its nodes);
scoring brings the blocks of trees and the rows' distinct codes together.

Splits maximise the gain of squared loss; categories are ordered by their mean in
the node, and levels that the node has not seen go right.  Weights, feature draws
and splits depend on the rows, the seed and the node only, not on partitions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.schemas import LABEL
from gatecast.session import fresh_dir

GROUP_ROWS = 1_000_000
SLICE_ROWS = 250_000  # of a table that is beyond GROUP_ROWS
CHUNK = 1 << 15       # rows in one binary value
BLOCK = 10            # trees of a forest that go together
WAVE = 10             # models whose nodes are dealt at once
COPIES = 16          # equal rows that are drawn as one
PARTITIONS = 400
ACCURACY = 10_000    # of the bins' borders
OPEN_CELLS = 1 << 22  # cells of a histogram held at once
LEAF, BELOW = -1, -2  # instead of a feature; BELOW: the tree goes on in the part of that node
TOLERANCE = 1e-6      # of a gain, in squared minutes


@dataclass(frozen=True)
class TreeParams:
    depth: int
    min_rows: int = 1
    fraction: float = 1.0  # of the features, drawn anew for every node
    seed: int = 0
    rate: float = 1.0      # of the values in the sum of all trees


@dataclass(frozen=True)
class Shape:
    """Bins of every feature; the first ``categories`` are categories."""

    widths: tuple[int, ...]
    categories: int

    @property
    def mask(self) -> int:
        """Bytes that say which bins go left."""
        return -(-max(self.widths) // 8)


# ---- numpy, inside tasks ---------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _stream(seed: int, model: int) -> np.uint64:
    return _mix(np.array([seed * 1_000_003 + model], dtype=np.int64))[0]


def uniform(rows: np.ndarray, seed: int, model: int) -> np.ndarray:
    """A number from [0, 1) for every row's hash."""
    return (_mix(rows.astype(np.uint64) ^ _stream(seed, model)) >> np.uint64(11)) * 2.0 ** -53


def poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson draws at the quantiles ``u``: how often a bootstrap takes ``mean`` equal rows."""
    p = np.exp(-mean.astype(float))
    below, out, k = p.copy(), np.zeros(len(u)), 0
    while (more := u >= below).any() and p.max() > 1e-18:
        k += 1
        out += more
        p = p * mean / k
        below += p
    return out


def _sums(codes: np.ndarray, at: np.ndarray, nodes: int, width: int, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = at * width + codes
    return tuple(np.bincount(cell, x, nodes * width).reshape(nodes, width) for x in (w, s))


def best_cut(n: np.ndarray, s: np.ndarray, category: bool, min_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every node's (row's) weights and sums by bin: the best gain, and the bins that go left."""
    place = np.arange(n.shape[1])
    if category:
        order = np.argsort(np.divide(s, n, out=np.full(s.shape, np.inf), where=n > 0), axis=1, kind="stable")
        n, s = np.take_along_axis(n, order, 1), np.take_along_axis(s, order, 1)
    nl, sl = n.cumsum(1), s.cumsum(1)
    na, sa = nl[:, -1:], sl[:, -1:]
    nr, sr = na - nl, sa - sl
    least = max(min_rows, 1)
    gain = sl * sl / np.maximum(nl, 1) + sr * sr / np.maximum(nr, 1)
    gain[(nl < least) | (nr < least)] = -np.inf
    cut = gain.argmax(1)
    best = gain[np.arange(len(cut)), cut] - (sa * sa / na)[:, 0]
    if category:
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(place, order.shape), 1)
        return best, rank <= cut[:, None]
    return best, place <= cut[:, None]


def _tried(paths: np.ndarray, features: int, p: TreeParams, model: int) -> np.ndarray | None:
    """Which features every node may use; None: all."""
    if p.fraction >= 1.0:
        return None
    draw = _mix((paths[:, None] * features + np.arange(features)).astype(np.uint64) ^ _stream(p.seed, model))
    return draw.argsort(1).argsort(1) < max(1, math.ceil(p.fraction * features))


def best_splits(cells: Callable, paths: np.ndarray, shape: Shape, p: TreeParams, model: int) -> tuple[np.ndarray, np.ndarray]:
    """Every node's feature (LEAF: none gains) and bins that go left; ``cells(k)`` gives weights and sums by node and bin of feature k."""
    gains = np.full(len(paths), TOLERANCE)
    feature = np.full(len(paths), LEAF, np.int16)
    left = np.zeros((len(paths), shape.mask * 8), bool)
    tried = _tried(paths, len(shape.widths), p, model)
    for k, width in enumerate(shape.widths):
        gain, goes = best_cut(*cells(k), k < shape.categories, p.min_rows)
        better = gain > gains if tried is None else (gain > gains) & tried[:, k]
        gains[better], feature[better] = gain[better], k
        left[better, :width], left[better, width:] = goes[better], False
    return feature, left


def _sparse_splits(codes: np.ndarray, at: np.ndarray, w: np.ndarray, s: np.ndarray, paths: np.ndarray, shape: Shape, p: TreeParams,
                   model: int) -> tuple[np.ndarray, np.ndarray]:
    """``best_splits`` over the cells that have rows, all features of a batch at once: for many nodes of few rows."""
    nodes, n, width = len(paths), len(at), max(shape.widths)
    bits, least = np.int64(n.bit_length()), max(p.min_rows, 1)
    na, sa = np.bincount(at, w, nodes), np.bincount(at, s, nodes)
    gains = np.full(nodes, TOLERANCE)
    feature = np.full(nodes, LEAF, np.int16)
    left = np.zeros((nodes, shape.mask * 8), bool)
    tried = _tried(paths, len(shape.widths), p, model)
    step = max(1, OPEN_CELLS // n)
    cuts = [*range(0, shape.categories, step), *range(shape.categories, len(shape.widths), step), len(shape.widths)]
    for lo, hi in zip(cuts, cuts[1:]):
        b = hi - lo
        key = ((np.arange(b)[:, None] * nodes + at) * width + codes[lo:hi]).ravel()
        key = (key << bits) | np.tile(np.arange(n), b)
        key.sort()
        row, cell = key & ((1 << bits) - 1), key >> bits
        new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        nl, sl, cell = np.add.reduceat(w[row], new), np.add.reduceat(s[row], new), cell[new]
        seg = cell // width
        bin_ = cell - seg * width
        if lo < shape.categories:
            order = np.lexsort((sl / nl, seg))
            nl, sl, bin_ = nl[order], sl[order], bin_[order]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))  # every node has a row, so b * nodes of them
        for x in (nl, sl):
            own = x[first]
            np.cumsum(x, out=x)
            x -= (x[first] - own)[seg]
        node = seg % nodes
        nr, sr = na[node] - nl, sa[node] - sl
        gain = sl * sl / np.maximum(nl, 1) + sr * sr / np.maximum(nr, 1)
        gain[(nl < least) | (nr < least)] = -np.inf
        most = np.maximum.reduceat(gain, first)
        place = np.arange(len(gain))
        best = np.minimum.reduceat(np.where(gain == most[seg], place, len(gain)), first)
        own = (most.reshape(b, nodes) - sa * sa / na)
        if tried is not None:
            own[~tried[:, lo:hi].T] = -np.inf
        k = own.argmax(0)
        top = own[k, np.arange(nodes)]
        better = top > gains
        gains[better], feature[better] = top[better], (lo + k)[better]
        taken = np.zeros(b * nodes, bool)
        taken[(k * nodes + np.arange(nodes))[better]] = True
        left[better] = False
        if lo < shape.categories:
            goes = taken[seg] & (place <= best[seg])
            left[node[goes], bin_[goes]] = True
        else:
            cut = bin_[best[np.flatnonzero(taken)]]
            left[np.flatnonzero(taken) % nodes] = np.arange(shape.mask * 8) <= cut[:, None]
    return feature, left


def grow(codes: np.ndarray, w: np.ndarray, target: np.ndarray, shape: Shape, p: TreeParams, model: int, path: int = 1) -> dict:
    """The tree below node ``path`` (root 1, children 2i and 2i + 1) over its rows; ``codes`` has a row a feature."""
    keep = w > 0
    codes, w = codes[:, keep], w[keep]
    s = w * target[keep]
    at, paths, first = np.zeros(len(w), np.int64), np.array([path], np.int64), 0
    made = {"feature": [], "yes": [], "value": [], "mask": []}
    level = path.bit_length() - 1
    step = max(1, OPEN_CELLS // max(shape.widths))
    while len(paths):
        n = len(paths)
        feature, left = np.full(n, LEAF, np.int16), np.zeros((n, shape.mask * 8), bool)
        if level < p.depth:
            for lo in range(0, n, step):
                here = slice(None) if n <= step else np.flatnonzero((at >= lo) & (at < lo + step))
                some = min(step, n - lo)
                c, a, ww, ss = codes[:, here], at[here] - lo, w[here], s[here]
                if some * max(shape.widths) > len(a):
                    found = _sparse_splits(c, a, ww, ss, paths[lo:lo + some], shape, p, model)
                else:
                    found = best_splits(lambda k: _sums(c[k], a, some, shape.widths[k], ww, ss), paths[lo:lo + some], shape, p, model)
                feature[lo:lo + some], left[lo:lo + some] = found
        split = feature >= 0
        rank = np.cumsum(split) - 1
        made["feature"].append(feature)
        made["yes"].append(np.where(split, first + n + 2 * rank, 0).astype(np.int32))
        made["value"].append(p.rate * (np.bincount(at, s, n) / np.bincount(at, w, n)))
        made["mask"].append(np.packbits(left, axis=1))
        on = split[at]
        codes, w, s, at = codes[:, on], w[on], s[on], at[on]
        right = ~left[at, codes[feature[at], np.arange(len(at))]]
        at = 2 * rank[at] + right
        paths = np.stack([2 * paths[split], 2 * paths[split] + 1], 1).ravel()
        first, level = first + n, level + 1
    return {k: np.concatenate(v) for k, v in made.items()}


def route(part: dict, codes: np.ndarray) -> np.ndarray:
    """The node of ``part`` where every row ends."""
    at = np.zeros(codes.shape[1], np.int64)
    rows = np.arange(len(at))
    while True:
        f = part["feature"][at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        if not len(rows):
            return at
        here, bin_ = at[rows], codes[f, rows]
        left = (part["mask"][here, bin_ >> 3] >> (7 - (bin_ & 7))) & 1
        at[rows] = part["yes"][here] + 1 - left


def evaluate(parts: dict[int, dict], codes: np.ndarray) -> np.ndarray:
    """Values of a tree given by its parts (path -> part) for every row."""
    def below(path: int, codes: np.ndarray) -> np.ndarray:
        part = parts[path]
        end = route(part, codes)
        out = part["value"][end]
        open_ = part["feature"][end] == BELOW
        for p in np.unique(part["yes"][end[open_]]):
            rows = np.flatnonzero(open_ & (part["yes"][end] == p))
            out[rows] = below(int(p), codes[:, rows])
        return out

    return below(1, codes)


PARTS = "block int, model int, path bigint, feature binary, yes binary, value binary, cut binary, mask binary"
ARROW_PARTS = pa.schema([("block", pa.int32()), ("model", pa.int32()), ("path", pa.int64()),
                          *((k, pa.binary()) for k in ("feature", "yes", "value", "cut", "mask"))])


def part_row(block: int, model: int, path: int, part: dict, shape: Shape) -> dict:
    """A part as it is stored: values of the ends, the last bin that goes left of a number's split, and a category's bins.
    Children that follow each other level by level need no numbers."""
    f, yes = part["feature"], part["yes"]
    split = f >= 0
    category = split & (f < shape.categories)
    plain = not (f == BELOW).any() and np.array_equal(yes[split], 1 + 2 * np.arange(split.sum()))
    left = np.unpackbits(part["mask"][split & ~category], axis=1).sum(1) - 1
    return {"block": block, "model": model, "path": path, "feature": f.astype(np.int16).tobytes(), "yes": b"" if plain else yes.tobytes(),
            "value": part["value"][~split].tobytes(), "cut": left.astype(np.int16).tobytes(), "mask": part["mask"][category].tobytes()}


def _part(row: dict, shape: Shape) -> dict:
    f = np.frombuffer(row["feature"], np.int16)
    split = f >= 0
    category = split & (f < shape.categories)
    yes, value, mask = np.zeros(len(f), np.int32), np.zeros(len(f)), np.zeros((len(f), shape.mask), np.uint8)
    if row["yes"]:
        yes = np.frombuffer(row["yes"], np.int32)
    else:
        yes[split] = 1 + 2 * np.arange(split.sum())
    value[~split] = np.frombuffer(row["value"])
    mask[category] = np.frombuffer(row["mask"], np.uint8).reshape(-1, shape.mask)
    mask[split & ~category] = np.packbits(np.arange(shape.mask * 8) <= np.frombuffer(row["cut"], np.int16)[:, None], axis=1)
    return {"feature": f, "yes": yes, "value": value, "mask": mask}


def codes_of(table: pa.Table, shape: Shape) -> np.ndarray:
    return np.stack([table[f"c{k}"].to_numpy() for k in range(len(shape.widths))]).astype(np.int16)


# ---- chunks of rows -------------------------------------------------------------------------

CHUNKS = "chunk string, slice int, rows binary"
_ARROW_CHUNKS = pa.schema([("chunk", pa.string()), ("slice", pa.int32()), ("rows", pa.binary())])


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(values: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in values])


def pack(points: DataFrame, shape: Shape, slices: int, label: str | None) -> DataFrame:
    """``points(codes, h, ...)`` as chunks: their columns, the codes as c0, c1, ...; a slice is the hash modulo ``slices``.

    They are written if they have a ``label``: what reads them more than once must find the same chunks.
    """
    kinds = [pa.uint8() if w <= 256 else pa.int16() for w in shape.widths]

    def run(batches):
        held: dict[int, list[pa.Table]] = {}

        def flush(k):
            return pa.RecordBatch.from_pylist([{"chunk": uuid.uuid4().hex, "slice": k, "rows": to_bytes(pa.concat_tables(held.pop(k)).combine_chunks())}],
                                              _ARROW_CHUNKS)

        for batch in batches:
            flat = batch["codes"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(kinds))
            table = pa.table({f"c{k}": pa.array(np.ascontiguousarray(flat[:, k])).cast(t) for k, t in enumerate(kinds)}
                             | {c: batch[c] for c in batch.schema.names if c != "codes"})
            of = np.mod(batch["h"].to_numpy(), slices)
            for k in np.unique(of):
                k = int(k)
                held.setdefault(k, []).append(table if slices == 1 else table.filter(pa.array(of == k)))
                if sum(map(len, held[k])) >= CHUNK:
                    yield flush(k)
        for k in [*held]:
            yield flush(k)

    chunks = points.mapInArrow(run, CHUNKS)
    if not label:
        return chunks
    spark = points.sparkSession
    path = fresh_dir(spark, label)
    chunks.write.parquet(path)
    return spark.read.schema(CHUNKS).parquet(path)


def copies_of(spark, blocks: int) -> int:
    return max(1, min(blocks, 2 * spark.sparkContext.defaultParallelism))


def copied(table: DataFrame, copies: int, slices: int) -> DataFrame:
    """``table`` once for each copy, dealt to (copy, slice)."""
    return table.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(
        min(4 * copies * slices, PARTITIONS), "copy", "slice")


# ---- binning ------------------------------------------------------------------------------

@dataclass
class Bins:
    borders: list[list[float]]
    levels: list[list[str]]
    categorical: list[str]
    numeric: list[str]

    @property
    def shape(self) -> Shape:
        # categories: one more for unseen and null; numbers: one above the last border, one for null
        return Shape(tuple([len(x) + 1 for x in self.levels] + [len(b) + 2 for b in self.borders]), len(self.categorical))

    def add(self, rows: DataFrame, name: str = "codes") -> DataFrame:
        """``rows`` with the bins of all features."""
        def category(c: str, levels: list[str]) -> Column:
            known = F.array(*[F.lit(x) for x in levels]).cast("array<string>")
            return F.coalesce(F.array_position(known, F.col(c).cast("string")), F.lit(0))

        def number(k: int, c: str) -> Column:
            x, b = F.col(c).cast("double"), F.col("__borders")[k]
            return F.when(x.isNotNull(), F.size(F.filter(b, lambda t: t < x))).otherwise(F.size(b) + 1)

        made = [category(c, x) for c, x in zip(self.categorical, self.levels)] + [number(k, c) for k, c in enumerate(self.numeric)]
        borders = rows.sparkSession.createDataFrame([(self.borders,)], "__borders array<array<double>>")
        return rows.crossJoin(F.broadcast(borders)).withColumn(name, F.array(*[m.cast("smallint") for m in made])).drop("__borders")


def fit_bins(rows: DataFrame, categorical: list[str], numeric: list[str], levels: dict[str, list[str]], bins: int) -> Bins:
    """Quantiles that cut the numbers into ``bins``; only these and the levels come to the driver."""
    shares = [k / bins for k in range(1, bins)]
    cut = [F.array_sort(F.array_distinct(F.percentile_approx(F.col(c).cast("double"), shares, ACCURACY))).alias(c) for c in numeric]
    found = rows.agg(*cut).first()
    return Bins([list(found[c] or []) for c in numeric], [levels[c] for c in categorical], categorical, numeric)


# ---- growing on Spark -----------------------------------------------------------------------

@dataclass(frozen=True)
class Growth:
    """What a task needs: the blocks of a copy, the models of a block, their parameters, and each one's weights and targets of a group's rows."""

    shape: Shape
    blocks: Callable[[int], list[int]]
    models: Callable[[int], list[int]]
    params: Callable[[int], TreeParams]
    weigh: Callable[[pa.Table, int], tuple[np.ndarray, np.ndarray]]

    def of(self, copy: int) -> list[tuple[int, int]]:
        return [(b, m) for b in self.blocks(copy) for m in self.models(b)]


_CELLS = "block int, model int, path bigint, w binary, s binary"
_SPLITS = "block int, model int, path bigint, feature int, mask binary, value double, left double, right double"


def _histograms(points: DataFrame, g: Growth, tops: dict[int, dict], open_: dict[int, list[int]]) -> DataFrame:
    """Weights and sums by feature and bin of every open node, of each (copy, slice)."""
    names = pa.schema([("block", pa.int32()), ("model", pa.int32()), ("path", pa.int64()), ("w", pa.binary()), ("s", pa.binary())])

    def run(key, table):
        table, out = from_bytes(table["rows"].to_pylist()), []
        codes = codes_of(table, g.shape)
        for block, m in g.of(key[0].as_py()):
            if m not in open_:
                continue
            w, t = g.weigh(table, m)
            part = tops[m]
            end = route(part, codes)
            reached = np.where(part["feature"][end] == BELOW, part["yes"][end], 0)
            for path in open_[m]:
                rows = (reached == path) & (w > 0)
                c, ww, at = codes[:, rows], w[rows], np.zeros(int(rows.sum()), np.int64)
                cells = [_sums(c[k], at, 1, width, ww, ww * t[rows]) for k, width in enumerate(g.shape.widths)]
                out.append({"block": block, "model": m, "path": path, "w": np.concatenate([x[0][0] for x in cells]).tobytes(),
                            "s": np.concatenate([x[1][0] for x in cells]).tobytes()})
        return pa.Table.from_pylist(out, names)

    return points.groupBy("copy", "slice").applyInArrow(run, _CELLS)


def _node_splits(cells: DataFrame, g: Growth) -> DataFrame:
    """The best split of every node whose sums are spread over slices."""
    names = pa.schema([("block", pa.int32()), ("model", pa.int32()), ("path", pa.int64()), ("feature", pa.int32()), ("mask", pa.binary()),
                       ("value", pa.float64()), ("left", pa.float64()), ("right", pa.float64())])
    ends = np.cumsum(g.shape.widths)

    def run(key, table):
        block, m, path = (k.as_py() for k in key)
        # summed in one order whatever came first
        w, s = (sum(np.frombuffer(b) for b in sorted(table[c].to_pylist())) for c in ("w", "s"))
        part = lambda x, k: x[None, ends[k] - g.shape.widths[k]:ends[k]]
        p = g.params(m)
        feature, left = best_splits(lambda k: (part(w, k), part(s, k)), np.array([path]), g.shape, p, m)
        k = int(feature[0]) if path.bit_length() - 1 < p.depth else LEAF
        first = part(w, 0).sum()
        goes = part(w, k)[0][left[0, :g.shape.widths[k]]].sum() if k >= 0 else 0.0
        return pa.Table.from_pylist([{"block": block, "model": m, "path": path, "feature": k, "mask": np.packbits(left[0]).tobytes(),
                                      "value": float(p.rate * (part(s, 0).sum() / max(first, 1))), "left": float(goes), "right": float(first - goes)}], names)

    return cells.groupBy("block", "model", "path").applyInArrow(run, _SPLITS)


def _as_part(nodes: list[dict], shape: Shape) -> dict:
    return {"feature": np.array([n["feature"] for n in nodes], np.int16), "yes": np.array([n["yes"] for n in nodes], np.int32),
            "value": np.array([n["value"] for n in nodes], float),
            "mask": np.frombuffer(b"".join(n["mask"] for n in nodes), np.uint8).reshape(-1, shape.mask)}


def _tops(points: DataFrame, g: Growth, models: dict[int, int], group_rows: int) -> dict[int, dict]:
    """The tops of all trees (model -> part), split until every open node holds at most ``group_rows`` rows."""
    def fresh(path: int) -> dict:
        return {"feature": BELOW, "yes": path, "value": 0.0, "mask": bytes(g.shape.mask)}

    nodes = {m: [fresh(1)] for m in models}
    open_ = {m: [1] for m in models}
    while open_:
        tops = {m: _as_part(n, g.shape) for m, n in nodes.items()}
        more: dict[int, list[int]] = {}
        for r in _node_splits(_histograms(points, g, tops, open_), g).collect():
            own = nodes[r["model"]]
            n = next(x for x in own if x["feature"] == BELOW and x["yes"] == r["path"])
            if r["feature"] < 0:
                n |= {"feature": LEAF, "yes": 0, "value": r["value"]}
                continue
            n |= {"feature": r["feature"], "yes": len(own), "value": r["value"], "mask": bytes(r["mask"])}
            for path, rows in ((2 * r["path"], r["left"]), (2 * r["path"] + 1, r["right"])):
                own.append(fresh(path))
                if rows > group_rows:
                    more.setdefault(r["model"], []).append(path)
        open_ = more
    return {m: _as_part(n, g.shape) for m, n in nodes.items()}


def _grown(points: DataFrame, g: Growth) -> DataFrame:
    """Whole trees, each copy's rows being one group."""
    def run(key, table):
        table = from_bytes(table["rows"].to_pylist()).sort_by("h")
        codes = codes_of(table, g.shape)
        made = []
        for block, m in g.of(key[0].as_py()):
            w, t = g.weigh(table, m)
            if not w.any():  # a draw that took none of a few rows
                w = np.ones(len(w))
            made.append(part_row(block, m, 1, grow(codes, w, t, g.shape, g.params(m), m), g.shape))
        return pa.Table.from_pylist(made, ARROW_PARTS)

    return points.groupBy("copy", "slice").applyInArrow(run, PARTS)


def _below(points: DataFrame, g: Growth, tops: dict[int, dict]) -> DataFrame:
    """What is below the open nodes of ``tops``: every node's rows are sent to one group."""
    def deal(key, table):
        table, out = from_bytes(table["rows"].to_pylist()), []
        codes = codes_of(table, g.shape)
        kept = table.select(["h", *[f"c{k}" for k in range(len(g.shape.widths))]])
        for block, m in g.of(key[0].as_py()):
            w, t = g.weigh(table, m)
            end = route(tops[m], codes)
            reached = np.where((tops[m]["feature"][end] == BELOW) & (w > 0), tops[m]["yes"][end], 0)
            for path in np.unique(reached[reached > 0]):
                rows = np.flatnonzero(reached == path)
                part = kept.take(pa.array(rows)).append_column("w", pa.array(w[rows])).append_column("t", pa.array(t[rows]))
                out.append({"block": block, "model": m, "path": int(path), "rows": to_bytes(part.combine_chunks())})
        return pa.Table.from_pylist(out, pa.schema([*list(ARROW_PARTS)[:3], ("rows", pa.binary())]))

    def run(key, table):
        block, m, path = (k.as_py() for k in key)
        table = from_bytes(table["rows"].to_pylist()).sort_by("h")
        part = grow(codes_of(table, g.shape), table["w"].to_numpy(), table["t"].to_numpy(), g.shape, g.params(m), m, path)
        return pa.Table.from_pylist([part_row(block, m, path, part, g.shape)], ARROW_PARTS)

    dealt = points.groupBy("copy", "slice").applyInArrow(deal, "block int, model int, path bigint, rows binary")
    return dealt.groupBy("block", "model", "path").applyInArrow(run, PARTS)


def slices_of(rows: int, group_rows: int) -> int:
    """1: a group holds the whole table."""
    return 1 if rows <= group_rows else -(-rows // min(group_rows, SLICE_ROWS))


def grow_trees(chunks: DataFrame, slices: int, shape: Shape, models: Callable[[int], list[int]], params: Callable[[int], TreeParams],
               weigh: Callable, blocks: int, path: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One tree of every model of every block over the rows of ``chunks``, as a table of parts written to ``path``."""
    spark = chunks.sparkSession
    if slices == 1:
        copies = copies_of(spark, blocks)
        g = Growth(shape, lambda copy: list(range(copy, blocks, copies)), models, params, weigh)
        _grown(copied(chunks, copies, 1), g).write.parquet(path)
        return spark.read.schema(PARTS).parquet(path)
    at = 0
    while at < blocks:
        upto = at + 1
        while upto < blocks and sum(len(models(b)) for b in range(at, upto + 1)) <= WAVE:
            upto += 1
        g = Growth(shape, lambda copy, at=at: [at + copy], models, params, weigh)
        dealt = copied(chunks, upto - at, slices)
        tops = _tops(dealt, g, {m: b for b in range(at, upto) for m in models(b)}, group_rows)
        _below(dealt, g, tops).write.mode("append").parquet(path)
        spark.createDataFrame([part_row(b, m, 1, tops[m], shape) for b in range(at, upto) for m in models(b)], PARTS).write.mode("append").parquet(path)
        at = upto
    return spark.read.schema(PARTS).parquet(path)


def whole_trees(parts: pa.Table, shape: Shape):
    """(block, model, its parts) of every tree, one at a time."""
    rows: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(zip(parts["block"].to_pylist(), parts["model"].to_pylist())):
        rows.setdefault(key, []).append(i)
    for (block, m), at in sorted(rows.items()):
        yield block, m, {r["path"]: _part(r, shape) for r in parts.take(pa.array(at)).to_pylist()}


def block_values(chunks: DataFrame, trees: DataFrame, shape: Shape, blocks: int, slices: int) -> DataFrame:
    """``chunks`` (chunk, slice, rows) and ``f``, the sum of all trees' values of each of its rows, in whole billionths.

    A block's sum is rounded on its own, so the total depends neither on copies nor on order.
    """
    copies = copies_of(chunks.sparkSession, blocks)
    parts = trees.withColumn("copy", F.col("block") % copies)
    if slices == 1:
        parts = parts.withColumn("slice", F.lit(0))
    else:
        parts = parts.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    parts = parts.repartition(min(4 * copies * slices, PARTITIONS), "copy", "slice")
    names = pa.schema([("chunk", pa.string()), ("f", pa.binary())])

    def run(key, rows, parts):
        if not len(rows):
            return names.empty_table()
        tables = [from_bytes([x]) for x in rows["rows"].to_pylist()]
        codes = codes_of(pa.concat_tables(tables), shape)
        total, block = np.zeros(codes.shape[1], np.int64), None
        for b, _, tree in whole_trees(parts, shape):
            if b != block:
                total += np.rint(f * 1e9).astype(np.int64) if block is not None else 0
                f, block = np.zeros(codes.shape[1]), b
            f += evaluate(tree, codes)
        if block is not None:
            total += np.rint(f * 1e9).astype(np.int64)
        ends = np.cumsum([len(t) for t in tables])
        return pa.Table.from_pylist([{"chunk": c, "f": x.tobytes()} for c, x in zip(rows["chunk"].to_pylist(), np.split(total, ends[:-1]))], names)

    found = copied(chunks, copies, slices).groupBy("copy", "slice").cogroup(parts.groupBy("copy", "slice")).applyInArrow(run, "chunk string, f binary")
    n = min(4 * copies * slices, PARTITIONS)
    return chunks.repartition(n, "chunk").join(found.repartition(n, "chunk").groupBy("chunk").agg(F.collect_list("f").alias("f")), "chunk")


@dataclass
class Ensemble:
    """Fitted trees: a prediction is ``scale`` times the sum of all trees' values."""

    bins: Bins
    trees: DataFrame
    blocks: int
    scale: float

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with a double ``prediction``; each distinct row of bins is scored once."""
        coded = self.bins.add(df, "__codes")
        points = coded.select(F.col("__codes").alias("codes")).distinct().withColumn("h", F.xxhash64("codes"))
        shape, scale = self.bins.shape, self.scale
        slices = slices_of(df.count(), GROUP_ROWS)
        chunks = pack(points, shape, slices, "scored-rows")
        names = pa.schema([("__codes", pa.list_(pa.int16())), ("prediction", pa.float64())])

        def run(batches):
            for batch in batches:
                for rows, f in zip(batch["rows"].to_pylist(), batch["f"].to_pylist()):
                    codes = codes_of(from_bytes([rows]), shape)
                    total = sum(np.frombuffer(x, np.int64) for x in f)
                    flat = pa.array(np.ascontiguousarray(codes.T).ravel())
                    ends = pa.array(np.arange(codes.shape[1] + 1, dtype=np.int32) * codes.shape[0])
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, flat), pa.array(total / 1e9 * scale)], schema=names)

        found = block_values(chunks, self.trees, shape, self.blocks, slices).select("rows", "f").mapInArrow(
            run, "__codes array<smallint>, prediction double")
        return coded.join(found, "__codes", "left").drop("__codes")


# ---- a random forest --------------------------------------------------------------------------

def bootstrap_points(coded: DataFrame) -> DataFrame:
    """Distinct (codes, y) with how often they occur; more than COPIES equal rows are several points."""
    counted = coded.groupBy("codes", "y").agg(F.count(F.lit(1)).alias("c"))
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("c") - 1) / COPIES).cast("int")))
    return counted.withColumn("piece", piece).select(
        "codes", "y", F.least(F.lit(COPIES), F.col("c") - COPIES * F.col("piece")).cast("double").alias("c"), F.xxhash64("codes", "y", "piece").alias("h"))


@dataclass(frozen=True)
class ForestGrower:
    """Bagged trees, every tree over its own bootstrap of the rows."""

    categorical: list[str]
    numeric: list[str]
    levels: dict[str, list[str]]
    num_trees: int
    params: TreeParams
    max_bins: int
    n_rows: int
    group_rows: int = GROUP_ROWS

    def fit(self, rows: DataFrame) -> Ensemble:
        bins = fit_bins(rows, self.categorical, self.numeric, self.levels, self.max_bins)
        coded = bins.add(rows.select(F.col(LABEL).cast("double").alias("y"), *self.categorical, *self.numeric)).select("codes", "y")
        n, p = self.num_trees, self.params
        blocks = -(-n // BLOCK)
        slices = slices_of(self.n_rows, self.group_rows)
        chunks = pack(bootstrap_points(coded), bins.shape, slices, "forest-rows" if slices > 1 else None)

        def models(block: int) -> list[int]:
            return list(range(block * BLOCK, min(n, (block + 1) * BLOCK)))

        def weigh(table: pa.Table, model: int):
            return poisson(uniform(table["h"].to_numpy(), p.seed, model), table["c"].to_numpy()), table["y"].to_numpy()

        trees = grow_trees(chunks, slices, bins.shape, models, lambda m: p, weigh, blocks, fresh_dir(rows.sparkSession, "forest"), self.group_rows)
        return Ensemble(bins, trees, blocks, 1.0 / n)
