"""Gradient-boosted trees of many airports in one fit, stopped with patience.

All airports of a variant are trained together.  One level of one round is one
aggregate over the rows of every airport: rows find their node, and
(airport, node, feature, bin) sums of residuals give each node's best split.
So the number of jobs depends on rounds and depth, not on how many airports
there are, and a busy airport is as many partial aggregates as it has
partitions.  To the driver come the categories' levels, the best split of
every open node (airports times leaves, a round's trees) and one error an
airport; finished trees go to a table, which is what scoring reads.

Targets, predictions and residuals are whole millionths of a minute, so sums
are exact and a fit gives the same trees under any partitioning.  Splits
maximise the gain of squared loss with L1 and L2 penalties on leaves;
categories are ordered by their mean residual in the node, as is usual for
regression, and levels not seen there go right.

After each round the validation rows' absolute error is taken per airport.  An
airport whose error has not improved for ``patience`` rounds takes no part in
later rounds, and its model is the prefix of its trees with the least error.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatecast.functions.scalar import any_null
from gatecast.operators.encode import category_levels
from gatecast.operators.nulls import with_batch_null_flag
from gatecast.plans.models import REFERENCE, Variant, training_rows
from gatecast.plans.scoring import BATCH_FLAG_COLUMNS, _finish
from gatecast.schemas import LABEL, WEATHER
from gatecast.session import fresh_dir, remove_dir

SCALE = 1_000_000  # units a minute
# fixed value: the reference waits ten rounds without a better validation error
PATIENCE = 10
ACCURACY = 10_000  # of the bins' borders


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 20
    patience: int = PATIENCE
    depth: int = 5
    learning_rate: float = 0.1
    min_rows: int = 1
    l1: float = 0.0          # in minutes, as in the sum of residuals
    l2: float = 0.0
    feature_fraction: float = 1.0
    bins: int = 64
    seed: int = 23


# fixed values: the reference's leaf penalties; its other settings are in models.REFERENCE
_PENALTIES = {"full": (0.9752885124310164, 0.9845786100240768), "na": (0.3254746622061918, 0.3196716454118168)}


def reference_params(variant: str, rounds: int | None = None) -> BoostParams:
    """The reference's settings; trees grow level by level, so ``num_leaves`` has no counterpart."""
    p, (l1, l2) = REFERENCE[variant], _PENALTIES[variant]
    return BoostParams(rounds=rounds or p.max_iter, depth=p.max_depth, learning_rate=p.step_size, min_rows=p.min_instances_per_node,
                       l1=l1, l2=l2, feature_fraction=p.feature_fraction, bins=255, seed=p.seed)


NODE = "struct<idx: int, feature: int, cut: int, codes: array<int>, yes: int, value: bigint>"
TREES = "airport string, tree int, idx int, feature int, cut int, codes array<int>, yes int, value bigint"
STATES = "airport string, kept int, rounds int, error double"
MODELS = "airport string, base bigint, kept int, rounds int, error double, borders array<array<double>>, levels array<array<string>>"


@dataclass
class Boosted:
    """Fitted models of a variant: ``trees`` has a row a node, ``models`` a row an airport."""

    variant: Variant
    trees: DataFrame
    models: DataFrame
    depth: int

    def save(self, path: str) -> None:
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        self.models.withColumn("depth", F.lit(self.depth)).write.mode("overwrite").parquet(f"{path}/models")


def load_boosted(spark: SparkSession, path: str, variant: Variant) -> Boosted:
    models = spark.read.schema(MODELS + ", depth int").parquet(f"{path}/models")
    depth = models.agg(F.max("depth")).first()[0] or 0
    return Boosted(variant, spark.read.schema(TREES).parquet(f"{path}/trees"), models.drop("depth"), depth)


def _keep(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _codes(variant: Variant, levels: Column, borders: Column) -> Column:
    """Bins of all features of a row: categories by level (-1 if unseen or null), numbers by border (null if null)."""
    made = [F.coalesce(F.array_position(levels[k], F.col(c).cast("string")), F.lit(0)).cast("int") - 1
            for k, c in enumerate(variant.categorical)]

    def numeric(k: int, c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNotNull(), F.size(F.filter(borders[k], lambda t: t < x)))

    return F.array(*made, *[numeric(k, c) for k, c in enumerate(variant.numeric)])


def _borders(rows: DataFrame, variant: Variant, bins: int) -> DataFrame:
    """Per airport, the quantiles that cut each number into bins."""
    shares = [k / bins for k in range(1, bins)]
    cut = [F.array_sort(F.array_distinct(F.percentile_approx(F.col(c).cast("double"), shares, ACCURACY))) for c in variant.numeric]
    return rows.groupBy("airport").agg(F.array(*cut).alias("borders"),
                                       F.floor(F.sum(F.col(LABEL).cast("bigint") * SCALE) / F.count(F.lit(1))).alias("base"))


def _end(nodes: str, codes: str, depth: int, n_categories: int) -> str:
    """SQL for the place (from 1) of the node where a row ends in the tree ``nodes``."""
    at = f"{nodes}[i - 1]"
    left = (f"CASE WHEN {at}.feature < {n_categories} THEN array_contains({at}.codes, {codes}[{at}.feature]) "
            f"ELSE {codes}[{at}.feature] <= {at}.cut END")
    return (f"aggregate(sequence(1, {max(depth, 1)}), 1, (i, step) -> "
            f"CASE WHEN {at}.feature < 0 THEN i WHEN {left} THEN {at}.yes ELSE {at}.yes + 1 END)")


def _shrunk(total: Column) -> Column:
    return F.signum(total) * F.greatest(F.abs(total) - F.col("p.l1"), F.lit(0.0))


def _score(total: Column, n: Column) -> Column:
    s = _shrunk(total.cast("double"))
    return s * s / (n + F.col("p.l2"))


def _value(total: Column, n: Column) -> Column:
    """A leaf's step, in whole units."""
    return F.floor(F.col("p.rate") * (_shrunk(total.cast("double")) / (n + F.col("p.l2"))))


def best_splits(rows: DataFrame, n_categories: int) -> DataFrame:
    """Per (airport, node) of ``rows(airport, node, codes, r, chosen, p)``: its best split and both children's values.

    ``codes`` are the levels that go left; a number goes left up to ``cut``.
    Of equal gains the first feature's and the earliest cut win.  ``chosen`` are
    the features to try and ``p`` the airport's parameters.
    """
    cells = F.transform("chosen", lambda k: F.struct(k.alias("feature"), F.get("codes", k).alias("bin")))
    hist = (rows.select("airport", "node", "r", "p", F.explode(cells).alias("c")).groupBy("airport", "node", "p", "c.feature", "c.bin")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s")))
    group = Window.partitionBy("airport", "node", "feature")
    category = F.col("feature") < n_categories
    along = group.orderBy(F.when(category, F.col("s").cast("double") / F.col("n")).otherwise(F.col("bin").cast("double")), "bin")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    run = hist.select("airport", "node", "p", "feature", F.col("bin").alias("cut"), F.row_number().over(along).alias("place"),
                      F.sum("n").over(so_far).alias("nl"), F.sum("s").over(so_far).alias("sl"), F.sum("n").over(group).alias("na"),
                      F.sum("s").over(group).alias("sa"), F.collect_list(F.when(category, F.col("bin"))).over(so_far).alias("codes"))
    nr, sr = F.col("na") - F.col("nl"), F.col("sa") - F.col("sl")
    gain = _score(F.col("sl"), F.col("nl")) + _score(sr, nr) - _score(F.col("sa"), F.col("na"))
    enough = (F.col("nl") >= F.col("p.min_rows")) & (nr >= F.col("p.min_rows")) & (nr > 0)
    able = run.where(enough).withColumn("gain", gain).where("gain >= 1")
    best = able.groupBy("airport", "node").agg(F.max(F.struct(
        "gain", (-F.col("feature")).alias("f"), (-F.col("place")).alias("p"), "cut", F.sort_array("codes").alias("codes"),
        _value(F.col("sl"), F.col("nl")).alias("left"), _value(sr, nr).alias("right"))).alias("b"))
    return best.select("airport", "node", (-F.col("b.f")).alias("feature"), "b.cut", "b.codes", "b.left", "b.right")


def _leaf(idx: int, value: int = 0) -> dict:
    return {"idx": idx, "feature": -1, "cut": 0, "codes": [], "yes": 0, "value": value}


_ARROW_NODE = pa.struct([("idx", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("codes", pa.list_(pa.int32())),
                         ("yes", pa.int32()), ("value", pa.int64())])


_ARROW_PARAMS = pa.struct([("rate", pa.float64()), ("min_rows", pa.int64()), ("l1", pa.float64()), ("l2", pa.float64())])


def _table(spark: SparkSession, trees: dict[str, list[dict]], first: dict[str, int] | None = None,
           params: dict[str, BoostParams] | None = None, chosen: dict[str, list[int]] | None = None) -> DataFrame:
    """One row an airport: its tree; to grow it, the place from which nodes are open, its parameters and features to try."""
    columns = {"airport": pa.array(list(trees), pa.string()), "nodes": pa.array(list(trees.values()), pa.list_(_ARROW_NODE))}
    if first is not None:
        own = [params[a] for a in trees]
        columns |= {"first": pa.array([first[a] for a in trees], pa.int32()),
                    "chosen": pa.array([chosen[a] for a in trees], pa.list_(pa.int32())),
                    "p": pa.array([{"rate": p.learning_rate, "min_rows": p.min_rows, "l1": p.l1 * SCALE, "l2": p.l2} for p in own], _ARROW_PARAMS)}
    return spark.createDataFrame(pa.table(columns))


def _chosen(p: BoostParams, tree: int, n: int) -> list[int]:
    """The features that a tree may use, drawn from the seed."""
    return sorted(random.Random(f"{p.seed}:{tree}").sample(range(n), max(1, round(p.feature_fraction * n))))


@dataclass
class Prepared:
    """Binned rows of a variant, written once; several fits may start from them."""

    data: DataFrame      # airport, held, codes, y, f: the airport's mean to begin with
    bases: DataFrame     # airport, borders, base
    levels: Column
    airports: list[str]
    judged: bool


def prepare(features: DataFrame, variant: Variant, bins: int = BoostParams.bins, held: str | None = None) -> Prepared:
    """Bins and codes for ``fit_boosted``."""
    root = fresh_dir(features.sparkSession, "boosting-rows")
    is_held = F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)
    rows = training_rows(features, variant).withColumn("__held", is_held)
    train = rows.where(~F.col("__held"))
    levels = F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in category_levels(train, variant.categorical).values()])
    bases = _keep(_borders(train, variant, bins), f"{root}/bases")
    data = _keep(rows.join(bases, "airport").select(
        "airport", F.col("__held").alias("held"), _codes(variant, levels, F.col("borders")).alias("codes"),
        (F.col(LABEL).cast("bigint") * SCALE).alias("y"), F.col("base").alias("f")), f"{root}/rows")
    return Prepared(data, bases, levels, sorted(r["airport"] for r in bases.select("airport").collect()), held is not None)


def fit_boosted(features: DataFrame, variant: Variant, p: BoostParams = BoostParams(), held: str | None = None,
                per_airport: dict[str, BoostParams] | None = None, prepared: Prepared | None = None) -> Boosted:
    """One model for every airport with a usable row, all in one fit.

    ``held`` names a boolean column: its rows are only judged on (null counts
    as false), and an airport with any stops after ``p.patience`` rounds without a
    smaller error.  An airport without a row to train on has no model.
    ``per_airport`` gives airports their own learning rate, depth, leaf size,
    penalties, feature fraction and seed; rounds, patience and bins are those of ``p``.
    """
    spark, n_cat = features.sparkSession, len(variant.categorical)
    ready = prepared or prepare(features, variant, p.bins, held)
    root = fresh_dir(spark, "boosting")
    data, data_path = ready.data, None
    params = {a: (per_airport or {}).get(a, p) for a in ready.airports}
    state = {a: {"kept": 0, "rounds": 0, "error": None} for a in ready.airports}
    active, depth = sorted(state), max([q.depth for q in params.values()], default=1)
    end = _end("nodes", "codes", depth, n_cat)
    n_features = n_cat + len(variant.numeric)
    for tree in range(1, p.rounds + 1):
        if not active:
            break
        chosen = {a: _chosen(params[a], tree, n_features) for a in active}
        grown = {a: [_leaf(1)] for a in active}
        first = dict.fromkeys(active, 1)
        for level in range(depth):
            open_now = {a: grown[a] for a in first if params[a].depth > level}
            if not open_now:
                break
            here = (data.where("not held").join(_table(spark, open_now, first, params, chosen), "airport")
                    .select("airport", "codes", "chosen", "p", (F.col("y") - F.col("f")).alias("r"), "first", F.expr(end).alias("node"))
                    .where("node >= first"))
            splits = best_splits(here, n_cat).collect()
            first = {a: len(grown[a]) + 1 for a in {s["airport"] for s in splits}}
            for s in splits:
                nodes = grown[s["airport"]]
                nodes[s["node"] - 1] |= {"feature": s["feature"], "cut": s["cut"], "codes": s["codes"], "yes": len(nodes) + 1}
                nodes += [_leaf(len(nodes) + 1, s["left"]), _leaf(len(nodes) + 2, s["right"])]
        trees = _table(spark, grown)
        trees.select("airport", F.lit(tree).alias("tree"), F.explode("nodes").alias("n")).select("airport", "tree", "n.*").write.mode(
            "append").parquet(f"{root}/trees")
        new = F.col("f") + F.coalesce(F.expr(f"nodes[{end} - 1].value"), F.lit(0))
        after = f"{root}/data-{tree}"
        data = _keep(data.join(trees, "airport", "left").withColumn("f", new).drop("nodes"), after)
        if data_path:
            remove_dir(spark, data_path)
        data_path = after
        errors = {}
        if ready.judged:
            gap = F.sum(F.abs(F.col("y") - F.col("f"))).cast("double") / F.count(F.lit(1)) / SCALE
            errors = dict(data.where("held").groupBy("airport").agg(gap).collect())
        for a in active:
            state[a]["rounds"] = tree
            if a not in errors:
                state[a]["kept"] = tree
            elif state[a]["error"] is None or errors[a] < state[a]["error"]:
                state[a] |= {"kept": tree, "error": errors[a]}
        active = [a for a in active if tree - state[a]["kept"] < p.patience]
    if data_path:
        remove_dir(spark, data_path)
    kept = spark.createDataFrame([(a, s["kept"], s["rounds"], s["error"]) for a, s in state.items()], STATES)
    models = ready.bases.join(kept, "airport").select("airport", "base", "kept", "rounds", "error", "borders", ready.levels.alias("levels"))
    spark.createDataFrame([], TREES).write.mode("append").parquet(f"{root}/trees")
    return Boosted(variant, spark.read.schema(TREES).parquet(f"{root}/trees"), _keep(models, f"{root}/models"), depth)


def _whole(model: Boosted) -> DataFrame:
    """One row an airport: base, borders, levels, and the kept trees as an array of arrays."""
    kept = model.trees.join(model.models.select("airport", "kept"), "airport").where("tree <= kept")
    cell = F.struct("idx", "feature", "cut", "codes", "yes", "value").cast(NODE)
    tree = kept.groupBy("airport", "tree").agg(F.array_sort(F.collect_list(cell)).alias("nodes"))
    all_trees = tree.groupBy("airport").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "nodes"))), lambda x: x["nodes"]).alias("trees"))
    out = model.models.join(all_trees, "airport", "left")
    return out.select("airport", "base", "borders", "levels", F.coalesce("trees", F.array().cast(f"array<array<{NODE}>>")).alias("trees"))


def prefix_errors(features: DataFrame, model: Boosted) -> DataFrame:
    """Mean absolute error in minutes of every prefix of every airport's saved trees: ``airport, trees, error``."""
    v, n_cat = model.variant, len(model.variant.categorical)
    grown = model.models.withColumn("kept", F.col("rounds"))
    whole = _whole(Boosted(v, model.trees, grown, model.depth))
    coded = training_rows(features, v).join(whole, "airport").withColumn("codes", _codes(v, F.col("levels"), F.col("borders")))
    step = F.expr(f"transform(trees, t -> t[{_end('t', 'codes', model.depth, n_cat)} - 1].value)")
    each = coded.select("airport", (F.col(LABEL).cast("bigint") * SCALE - F.col("base")).alias("r"), step.alias("steps"))
    sums = each.select("airport", "r", F.posexplode(F.expr(
        "transform(steps, (x, k) -> aggregate(slice(steps, 1, k + 1), 0L, (a, b) -> a + b))")).alias("k", "f"))
    gap = F.sum(F.abs(F.col("r") - F.col("f"))).cast("double") / F.count(F.lit(1)) / SCALE
    return sums.groupBy("airport", (F.col("k") + 1).alias("trees")).agg(gap.alias("error"))


def predict(features: DataFrame, model: Boosted, out: str = "prediction") -> DataFrame:
    """M7 + M16: ``features`` with a double ``out``, every airport's rows by its own model in one pass.

    The models are a table joined by airport: the plan has one scan of the
    features and does not depend on the number of airports.  Null where the
    airport has no model or a number that the variant needs is null.
    """
    v, n_cat = model.variant, len(model.variant.categorical)
    cells = F.struct("base", "borders", "levels", "trees").alias("__m")
    joined = features.join(_whole(model).select("airport", cells), "airport", "left")
    coded = joined.withColumn("__codes", _codes(v, F.col("__m.levels"), F.col("__m.borders")))
    step = f"t[{_end('t', '__codes', model.depth, n_cat)} - 1].value"
    total = F.expr(f"aggregate(__m.trees, __m.base, (sum, t) -> sum + {step})")
    whole = F.col("__m").isNotNull()
    for c in v.required:
        whole = whole & F.col(c).isNotNull()
    return coded.withColumn(out, F.when(whole, total / F.lit(float(SCALE)))).select(*features.columns, out)


def score_boosted(features: DataFrame, full: Boosted, no_weather: Boosted, router: str = "row") -> DataFrame:
    """M14-M16 over tables of models: ``model_variant`` and a whole-minute ``prediction`` for every row.

    Rows with a missing weather value (``router='row'``), or batches with any missing feature
    (``'batch'``), take the no-weather model; so do airports that have no other.
    """
    if router == "row":
        flagged, flag = features.withColumn("weather_has_null", any_null(WEATHER)), "weather_has_null"
    else:
        flagged, flag = with_batch_null_flag(features, BATCH_FLAG_COLUMNS, ["airport", "timestamp"], "batch_has_null"), "batch_has_null"
    known = full.models.select("airport", F.lit(True).alias("_has_full"))
    scored = predict(predict(flagged.join(known, "airport", "left"), full, "_p_full"), no_weather, "_p_na")
    use_na = F.col(flag) | F.col("_has_full").isNull()
    return _finish(scored, use_na, full).drop("_has_full")
