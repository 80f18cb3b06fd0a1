"""Hyper-parameter search.

The reference runs a sequential TPE search.  Here a seeded sampler draws
the same kinds of distributions (log-uniform learning rate, depth choice,
uniform feature fraction, leaf minimum) and evaluates them side by side
on an 80/20 hash split by MAE; every trial makes up to the reference's 1000 rounds and
ends after ten without a better held error, as the reference's do.  The best setting is refitted
on the training rows.  The reference fixes the leaf minimum at 250 or 200
rows; here it is drawn log-uniformly up to that, as a table whose airports
have fewer rows could not split at all.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecast.operators import split
from gatecast.operators.encode import category_levels
from gatecast.plans.boosting import BoostParams, Boosted, fit_boosted, predict, prepare
from gatecast.plans.models import GbtParams, Variant, training_rows
from gatecast.plans.tpe import Choice, Space, Uniform, suggest, values
from gatecast.plans.trees import (ARROW_PARTS, CHUNK, GROUP_ROWS, PARTITIONS, PARTS, Ensemble, Shape, TreeParams, codes_of, copied, copies_of,
                                  evaluate, fit_bins, from_bytes, grow, grow_trees, pack, part_row, slices_of, to_bytes, uniform, whole_trees)
from gatecast.schemas import LABEL
from gatecast.session import fresh_dir, remove_dir

# ---- fixed values: the reference's search settings -------------------------
# (no MLlib counterpart for num_leaves, reg_alpha and reg_lambda, so they
# are not drawn)
LEARNING_RATE_LOG_RANGE = (-4.0, 0.0)
FEATURE_FRACTION_RANGE = (0.5, 1.0)
DEPTH_CHOICES = {"full": list(range(10, 21)), "na": list(range(5, 21))}
MIN_ROWS_PER_LEAF = {"full": 250, "na": 200}
EVALS_FULL = 25
EVALS_NO_WEATHER = 10
PATIENCE = 10
SEARCH = GbtParams(max_iter=1000, max_bins=255)  # rounds at most; the bins are LightGBM's own default
# ------------------------------------------------------------------------------

TRIAL_SCHEMA = T.StructType([
    T.StructField("airport", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("trial", T.IntegerType()),
    T.StructField("step_size", T.DoubleType()),
    T.StructField("max_depth", T.IntegerType()),
    T.StructField("feature_fraction", T.DoubleType()),
    T.StructField("min_instances_per_node", T.IntegerType()),
    T.StructField("validation_mae", T.DoubleType()),
    T.StructField("is_best", T.BooleanType()),
    T.StructField("train_mae", T.DoubleType()),
    T.StructField("test_mae", T.DoubleType()),
])


def sample_space(n: int, variant: str = "full", seed: int = 23) -> list[dict]:
    """M8: ``n`` seeded draws from the variant's search space."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append({
            "step_size": math.exp(rng.uniform(*LEARNING_RATE_LOG_RANGE)),
            "max_depth": rng.choice(DEPTH_CHOICES[variant]),
            "feature_fraction": rng.uniform(*FEATURE_FRACTION_RANGE),
            "min_instances_per_node": round(math.exp(rng.uniform(0.0, math.log(MIN_ROWS_PER_LEAF[variant])))),
        })
    return out


def search_split(rows: DataFrame) -> DataFrame:
    """Adds ``held``: a fifth of the rows, by a hash of the key that is independent of ``hash_split``."""
    return rows.withColumn("held", split.bucket_of(F.concat(F.lit("search|"), split.row_key())) >= split.SPLIT_TRAIN_PERCENT)


def _tree_params(d: dict, base: GbtParams, r: int) -> TreeParams:
    return TreeParams(d["max_depth"], d["min_instances_per_node"], d["feature_fraction"], base.seed, d["step_size"] if r else 1.0)


def _weights(table, base: GbtParams, model: int):
    w = 1.0 - table["held"].to_numpy()
    if base.subsampling_rate < 1.0:
        drawn = w * (uniform(table["h"].to_numpy(), base.seed, model) < base.subsampling_rate)
        w = drawn if drawn.any() else w
    return w


def _sums_of_errors(y, f, held) -> np.ndarray:
    """Of the rows not held, then of the held ones: how many, and the sums of absolute and squared errors."""
    return np.array([(at.sum(), np.abs(y - f)[at].sum(), ((y - f)[at] ** 2).sum()) for at in (held == 0, held == 1)])


class _Best:
    """The prefix of a draw's trees with the least squared error on the rows that judge it, as far as it came."""

    def __init__(self, judge: int, patience: int | None):
        self.judge, self.patience, self.kept, self.least, self.gaps = judge, patience, 0, None, (None, None)

    def goes_on(self, rounds: int, sums: np.ndarray) -> bool:
        loss = sums[self.judge, 2] / max(sums[self.judge, 0], 1)
        if self.patience is None or self.least is None or loss < self.least:
            self.kept, self.least = rounds, loss
            self.gaps = tuple(float(gap / n) if n else None for n, gap, _ in sums)
        return self.patience is None or rounds - self.kept < self.patience


_RESULT = -1  # instead of a model: what a draw came to


def _boost_in_tasks(chunks: DataFrame, shape: Shape, draws: list[dict], base: GbtParams, judge: int, patience: int | None,
                    keep_trees: bool) -> DataFrame:
    """Parts of the trees (if wanted), and a row a draw with the rounds it kept and its errors; each draw is boosted within a task."""
    n = len(draws)
    copies = copies_of(chunks.sparkSession, n)

    def run(key, table):
        table, out = from_bytes(table["rows"].to_pylist()).sort_by("h"), []
        codes, y, held = codes_of(table, shape), table["y"].to_numpy(), table["held"].to_numpy()
        for k in range(key[0].as_py(), n, copies):
            f, best, made = np.zeros(len(y)), _Best(judge, patience), []
            for r in range(base.max_iter):
                model = k + n * r
                tree = grow(codes, _weights(table, base, model), 2 * (y - f) if r else y, shape, _tree_params(draws[k], base, r), model)
                f = f + evaluate({1: tree}, codes)
                if keep_trees:
                    made.append(part_row(k, model, 1, tree, shape))
                if not best.goes_on(r + 1, _sums_of_errors(y, f, held)):
                    break
            gaps = [math.nan if g is None else g for g in best.gaps]
            out += [*made[:best.kept], {"block": k, "model": _RESULT, "path": 0, "value": np.array([best.kept, *gaps]).tobytes()}]
        return pa.Table.from_pylist(out, ARROW_PARTS)

    return copied(chunks, copies, 1).groupBy("copy", "slice").applyInArrow(run, PARTS)


def _boost_on_spark(chunks: DataFrame, slices: int, shape: Shape, draws: list[dict], base: GbtParams, judge: int, patience: int | None,
                    path: str | None, group_rows: int) -> dict[int, _Best]:
    """The same round by round for rows that no group holds: chunks carry every draw's sums, trees go to ``path`` if given."""
    spark, n = chunks.sparkSession, len(draws)
    best = {k: _Best(judge, patience) for k in range(n)}
    now, active, last = chunks, list(range(n)), None
    names = pa.schema([("chunk", pa.string()), ("slice", pa.int32()), ("rows", pa.binary()), ("sums", pa.binary())])
    for r in range(base.max_iter):
        def weigh(table, model: int, r=r):
            y = table["y"].to_numpy()
            return _weights(table, base, model), 2 * (y - table[f"f{model % n}"].to_numpy()) if r else y

        grown = fresh_dir(spark, "trial-trees")
        trees = grow_trees(now, slices, shape, lambda b, r=r, active=active: [active[b] + n * r],
                           lambda model, r=r: _tree_params(draws[model % n], base, r), weigh, len(active), grown, group_rows)

        def add(key, rows, parts):
            table = from_bytes(rows["rows"].to_pylist()).sort_by("h")
            codes = codes_of(table, shape)
            for _, model, tree in whole_trees(parts, shape):
                name = f"f{model % n}"
                f = evaluate(tree, codes)
                if r:
                    table = table.set_column(table.column_names.index(name), name, pa.array(table[name].to_numpy() + f))
                else:
                    table = table.append_column(name, pa.array(f))
            out = []
            for i, lo in enumerate(range(0, len(table), CHUNK)):
                t = table.slice(lo, CHUNK)
                sums = np.array([_sums_of_errors(t["y"].to_numpy(), t[f"f{k}"].to_numpy(), t["held"].to_numpy()) for k in range(n)])
                out.append({"chunk": f"{key[0].as_py()}-{i}", "slice": key[0].as_py(), "rows": to_bytes(t.combine_chunks()), "sums": sums.tobytes()})
            return pa.Table.from_pylist(out, names)

        parts = trees.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        at = fresh_dir(spark, "trial-rows")
        now.select("slice", "rows").repartition(min(4 * slices, PARTITIONS), "slice").groupBy("slice").cogroup(
            parts.repartition(min(4 * slices, PARTITIONS), "slice").groupBy("slice")).applyInArrow(
            add, "chunk string, slice int, rows binary, sums binary").write.parquet(at)
        now = spark.read.parquet(at)
        sums = sum(np.frombuffer(x["sums"]).reshape(n, 2, 3) for x in sorted(now.select("chunk", "sums").collect()))
        if path:
            trees.write.mode("append").parquet(path)
        for spent in (grown, last):
            if spent:
                remove_dir(spark, spent)
        last = at
        active = [k for k in active if best[k].goes_on(r + 1, sums[k])]
        if not active:
            break
    return best


def boost_side_by_side(points: DataFrame, shape: Shape, draws: list[dict], base: GbtParams, rows: int, judge: int, patience: int | None = None,
                       keep_trees: bool = False, group_rows: int = GROUP_ROWS) -> tuple[dict[int, tuple], DataFrame | None]:
    """Boosted trees of all ``draws`` over ``points(h, codes, y, held)``: (rounds kept, errors of rows not held and held) by draw, and the trees.

    As in MLlib: the first tree fits the labels and counts whole, the others fit
    twice the residuals and count ``step_size``.  Held rows are only predicted.
    A draw ends after ``patience`` rounds without a smaller squared error on the rows that
    judge it (0: those learnt from, 1: the held ones) and is the prefix of its trees with the least; without patience
    it makes all rounds.  A tree's number is the draw's and ``len(draws)`` times the round's.
    """
    spark = points.sparkSession
    slices = slices_of(rows, group_rows)
    chunks = pack(points, shape, slices, "search-rows" if slices > 1 else None)
    made = fresh_dir(spark, "trial-parts") if keep_trees or slices == 1 else None
    if slices == 1:
        _boost_in_tasks(chunks, shape, draws, base, judge, patience, keep_trees).write.parquet(made)
        parts = spark.read.schema(PARTS).parquet(made)
        found = {r["block"]: np.frombuffer(r["value"]).tolist() for r in parts.where(F.col("model") == _RESULT).collect()}
        found = {k: (int(kept), *(None if math.isnan(g) else g for g in gaps)) for k, (kept, *gaps) in found.items()}
        trees = parts.where(F.col("model") != _RESULT)
    else:
        best = _boost_on_spark(chunks, slices, shape, draws, base, judge, patience, made, group_rows)
        found = {k: (b.kept, *b.gaps) for k, b in best.items()}
        trees = spark.read.schema(PARTS).parquet(made) if made else None
    return found, trees if keep_trees else None


def tune(train: DataFrame, variant: Variant, n_evals: int, base: GbtParams | None = None,
         seed: int = 23, test: DataFrame | None = None, group_rows: int = GROUP_ROWS, patience: int = PATIENCE):
    """M9 + M10 + M11 for one training frame: returns (trials, the best setting's model).

    The draws do not depend on each other, so all trials are boosted at once.
    They learn from four fifths of the rows and are judged on the rest, or
    on the same rows if the split leaves one part empty; each makes up to ``base.max_iter`` rounds and ends after
    ``patience`` without a smaller squared error.  The best setting is
    refitted on all training rows with as many rounds as it kept and scored on them and on ``test`` (M11's
    train and test MAE, on the best trial's row).
    """
    base = base or GbtParams()
    rows = search_split(training_rows(train, variant))
    n = {r["held"]: r["n"] for r in rows.groupBy("held").agg(F.count("*").alias("n")).collect()}
    if not n:
        return [], None
    total = sum(n.values())
    bins = fit_bins(rows, variant.categorical, variant.numeric, category_levels(rows, variant.categorical), base.max_bins)
    draws = sample_space(n_evals, variant.name, seed)

    def points(df: DataFrame, held) -> DataFrame:
        coded = bins.add(df.select(F.xxhash64(split.row_key()).alias("h"), F.col(LABEL).cast("double").alias("y"),
                                   held.cast("double").alias("held"), *variant.categorical, *variant.numeric))
        return coded.select("h", "codes", "y", "held")

    judge = len(n) - 1
    found, _ = boost_side_by_side(points(rows, F.col("held") if judge else F.lit(False)), bins.shape, draws, base, total, judge, patience,
                                  group_rows=group_rows)
    errors = {k: gaps[judge] for k, (_, *gaps) in found.items()}
    best = min(range(n_evals), key=errors.__getitem__)
    both, scored = points(rows, F.lit(False)), total
    if test is not None:
        held = training_rows(test, variant)
        both, scored = both.unionByName(points(held, F.lit(True))), total + held.count()
    refit, trees = boost_side_by_side(both, bins.shape, [draws[best]], replace(base, max_iter=found[best][0]), scored, 0, keep_trees=True,
                                      group_rows=group_rows)
    _, train_mae, test_mae = refit[0]
    trials = [(i, d["step_size"], d["max_depth"], d["feature_fraction"], d["min_instances_per_node"], float(errors[i]), i == best,
               train_mae if i == best else None, test_mae if i == best else None)
              for i, d in enumerate(draws)]
    return trials, Ensemble(bins, trees, 1, 1.0)


def tune_per_airport(features: DataFrame, airports: list[str], variant: Variant, n_evals: int,
                     base: GbtParams | None = None, threads: int = 10) -> DataFrame:
    """Search per airport (airports concurrently); one row per trial.

    With a ``split`` column, the search uses the ``train`` rows and the best
    refit is also scored on the ``test`` rows.
    """
    has_split = "split" in features.columns

    def one(a):
        rows = features.where(F.col("airport") == a)
        train = rows.where(F.col("split") == "train") if has_split else rows
        test = rows.where(F.col("split") == "test") if has_split else None
        trials, _ = tune(train, variant, n_evals, base, test=test)
        return [(a, variant.name, *t) for t in trials]

    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(airports)))) as pool:
        rows = [r for part in pool.map(one, airports) for r in part]
    return features.sparkSession.createDataFrame(rows, TRIAL_SCHEMA)


def boosted_space(variant: str = "full") -> Space:
    """M8 for ``tune_adaptive``: the reference's ranges of every setting that level-wise trees have."""
    return {
        "learning_rate": Uniform(*LEARNING_RATE_LOG_RANGE, log=True),
        "depth": Choice(tuple(DEPTH_CHOICES[variant])),
        "feature_fraction": Uniform(*FEATURE_FRACTION_RANGE),
        "min_rows": Uniform(0.0, math.log(MIN_ROWS_PER_LEAF[variant]), log=True, step=1),
        "l1": Uniform(0.0, 1.0),
        "l2": Uniform(0.0, 1.0),
    }


ADAPTIVE_SCHEMA = "airport string, variant string, trial int, learning_rate double, depth int, feature_fraction double, " \
    "min_rows int, l1 double, l2 double, validation_mae double, kept int, is_best boolean"


def tune_adaptive(train: DataFrame, variant: Variant, n_evals: int, base: BoostParams = BoostParams(),
                  space: Space | None = None, seed: int = 23) -> tuple[DataFrame, Boosted]:
    """M8-M11 by adaptive search, all airports side by side: (trials, model refitted on all rows).

    Every airport has a search of its own, whose n-th trial follows from its first
    n - 1; the n-th trials of all airports are one fit, which stops each with
    patience.  Trials learn from four fifths of the rows and are judged
    on the rest; the best setting of each airport is refitted on all rows with as many rounds as it kept.
    """
    space = space or boosted_space(variant.name)
    rows = search_split(train)
    ready = prepare(rows, variant, base.bins, "held")
    history: dict[str, list] = {a: [] for a in ready.airports}
    out = []
    for trial in range(n_evals):
        points = {a: suggest(space, history[a], seed) for a in ready.airports}
        settings = {a: replace(base, **values(space, point)) for a, point in points.items()}
        model = fit_boosted(rows, variant, base, "held", settings, ready)
        for m in model.models.select("airport", "error", "kept").collect():
            history[m["airport"]].append((points[m["airport"]], m["error"]))
            out.append((m["airport"], variant.name, trial, settings[m["airport"]], m["error"], m["kept"]))
    best = {}
    for a, _, trial, setting, error, kept in out:
        if a not in best or (error is not None and (best[a][1] is None or error < best[a][1])):
            best[a] = (trial, error, setting, kept)
    trials = [(a, v, t, float(s.learning_rate), s.depth, float(s.feature_fraction), s.min_rows, float(s.l1), float(s.l2), e, k, best[a][0] == t)
              for a, v, t, s, e, k in out]
    rounds = max([b[3] for b in best.values()], default=1)
    refit = fit_boosted(train, variant, replace(base, rounds=rounds), None, {a: b[2] for a, b in best.items()})
    wanted = train.sparkSession.createDataFrame([(a, b[3]) for a, b in best.items()], "airport string, wanted int")
    refit.models = refit.models.join(wanted, "airport", "left").withColumn("kept", F.coalesce("wanted", "kept")).drop("wanted")
    return train.sparkSession.createDataFrame(trials, ADAPTIVE_SCHEMA), refit


def boosted_mae(rows: DataFrame, model: Boosted) -> DataFrame:
    """Mean absolute error in minutes of a model on ``rows``, by airport."""
    return predict(rows, model).where(F.col("prediction").isNotNull()).groupBy("airport").agg(
        F.avg(F.abs(F.col(LABEL) - F.col("prediction"))).alias("mae"))
