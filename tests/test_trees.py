"""Trees of many models at once: splits, bootstraps, nodes above and below a group's size, and how many jobs a fit takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatecast.operators.encode import category_levels
from gatecast.plans import trees as t
from gatecast.plans.models import NO_WEATHER, ForestParams, GbtParams, fit_per_airport, forest_fit, forest_pipeline, training_rows
from gatecast.plans.tuning import tune

SCHEMA = ("airport string, gufi string, aircraft_type string, major_carrier string, flight_type string, aircraft_engine_class string, "
          "day_of_week string, month string, hour int, year int, benchmark_pushback double, minutes_until_pushback int")


@pytest.fixture(scope="module")
def rows(spark):
    made = [("A1", f"G{i}", f"T{i % 7}", f"C{i % 3}", None if i % 5 == 0 else "F0", "E0", "Monday", "January", 10 + i % 5, 2024,
             float(i % 90), (i % 7) * 9 + (i * i) % 11) for i in range(400)]
    made += made[:40]  # equal rows are rows
    return spark.createDataFrame(made, SCHEMA).withColumn("timestamp", F.expr("timestamp_ntz '2024-01-01 00:00:00'")).cache()


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _scores(model, df):
    return sorted((r.gufi, r.prediction) for r in model.transform(df).collect())


def _grower(rows, n_trees, depth, **kw):
    train = training_rows(rows, NO_WEATHER)
    g = forest_pipeline(NO_WEATHER, ForestParams(num_trees=n_trees, max_depth=depth), category_levels(train, NO_WEATHER.categorical), 440)
    return t.ForestGrower(**(vars(g) | kw)), train


def test_a_forest_takes_few_jobs_whatever_its_depth(spark, rows):
    grower, train = _grower(rows, 24, 15)
    model, jobs = _jobs(spark, "forest", lambda: grower.fit(train))
    assert jobs <= 6
    assert model.trees.count() == 24 and model.blocks == 3
    got = _scores(model, rows)
    assert len(got) == 440 and all(p is not None for _, p in got)
    y = {r.gufi: r.minutes_until_pushback for r in rows.collect()}
    mean = sum(y.values()) / len(y)
    assert sum(abs(y[g] - p) for g, p in got) < 0.5 * sum(abs(y[g] - mean) for g, _ in got)


def test_nodes_above_a_groups_size_give_the_same_forest(rows):
    whole, train = _grower(rows, 12, 6)
    parted, _ = _grower(rows, 12, 6, group_rows=60)
    a, b = whole.fit(train), parted.fit(train)
    assert b.trees.count() > 12  # tops, and what is below them
    assert [p for _, p in _scores(a, rows)] == pytest.approx([p for _, p in _scores(b, rows)])
    assert _scores(whole.fit(train.repartition(7)), rows) == _scores(a, rows)


def test_trials_are_boosted_at_once_and_the_same_in_parts(spark, rows):
    base = GbtParams(max_iter=2)
    (trials, model), jobs = _jobs(spark, "trials", lambda: tune(rows, NO_WEATHER, 6, base, test=rows.limit(50)))
    assert jobs <= 45  # six trials of two trees, ten levels and more each, and a refit
    assert len({m for *_, m, _, _, _ in trials}) > 1
    best = [x for x in trials if x[6]]
    assert len(best) == 1 and best[0][5] == min(x[5] for x in trials) and best[0][7] is not None and best[0][8] is not None
    gaps = [abs(r.minutes_until_pushback - r.prediction) for r in model.transform(rows).collect()]
    assert sum(gaps) / len(gaps) == pytest.approx(best[0][7])
    again, _ = tune(rows, NO_WEATHER, 6, base, test=rows.limit(50), group_rows=60)
    assert [x[5] for x in again] == pytest.approx([x[5] for x in trials])


def test_a_split_is_the_best_of_all():
    rng = np.random.default_rng(3)
    shape = t.Shape((4, 9), 1)
    codes = np.stack([rng.integers(0, 4, 60), rng.integers(0, 9, 60)]).astype(np.int32)
    y, w = rng.integers(0, 50, 60).astype(float), rng.integers(0, 3, 60).astype(float)

    def loss(left):
        return sum((w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() for m in (left, ~left) if w[m].sum())

    best = min([loss(codes[1] <= c) for c in range(8)] + [loss(np.isin(codes[0], [k for k in range(4) if s >> k & 1])) for s in range(1, 15)])
    tree = t.grow(codes, w, y, shape, t.TreeParams(1), 0)
    assert loss(t.route(tree, codes) == 1) == pytest.approx(best)
    deep = t.grow(codes, np.ones(60), 10.0 * codes[0] + codes[1], shape, t.TreeParams(15), 0)
    assert t.evaluate({1: deep}, codes) == pytest.approx(10.0 * codes[0] + codes[1])
    least = t.grow(codes, w, y, shape, t.TreeParams(15, min_rows=20), 0)
    assert np.bincount(t.route(least, codes), w)[least["feature"] == t.LEAF].min() >= 20


def test_bootstrap_weights_are_poisson():
    rows = np.arange(200_000, dtype=np.int64)
    for mean in (1.0, 16.0):
        w = t.poisson(t.uniform(rows, 1994, 7), np.full(len(rows), mean))
        assert w.mean() == pytest.approx(mean, rel=0.01) and w.var() == pytest.approx(mean, rel=0.02)
    assert (t.uniform(rows, 1994, 7) != t.uniform(rows, 1994, 8)).all()


@pytest.mark.parametrize("n", [1, 2, 18])
def test_few_rows_make_a_forest(spark, rows, n):
    few = rows.limit(n)
    models = fit_per_airport(few, ["A1"], [NO_WEATHER], forest_fit(ForestParams(num_trees=30, max_depth=3)))
    assert all(p is not None for _, p in _scores(models["A1", "na"], rows))


def test_bins_of_every_value(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), (None, None), ("z", 3.0), ("b", 9.0)], "c string, x double")
    bins = t.Bins([[1.0, 3.0]], [["a", "b"]], ["c"], ["x"])
    assert [tuple(r.codes) for r in bins.add(df).collect()] == [(1, 2), (2, 0), (0, 3), (0, 1), (2, 2)]
    assert bins.shape == t.Shape((3, 4), 1)


def test_trees_are_stored_in_few_bytes(rows):
    grower, train = _grower(rows, 12, 15)
    trees = grower.fit(train).trees
    stored = sum((F.length(c) for c, kind in trees.dtypes if kind == "binary"), F.lit(0))
    size = trees.agg(F.sum(stored).alias("bytes"), (F.sum(F.length("feature")) / 2).alias("nodes")).first()
    assert size["nodes"] > 500 and size["bytes"] < 12 * size["nodes"]


def test_rows_are_copied_for_tasks_and_nodes_are_dealt_in_waves(spark, rows, monkeypatch):
    dealt, below = [], t._below
    monkeypatch.setattr(t, "_below", lambda points, g, tops: dealt.append(len(tops)) or below(points, g, tops))
    grower, train = _grower(rows, 24, 4, group_rows=150)
    model = grower.fit(train)
    assert sum(dealt) == 24 and max(dealt) <= 10
    assert len(_scores(model, rows)) == 440
    copies = t.copies_of(spark, 50)
    assert copies == min(50, 2 * spark.sparkContext.defaultParallelism)
    assert spark.range(7).transform(lambda d: t.copied(d.withColumn("slice", F.lit(0)), copies, 1)).count() == 7 * copies


def test_parts_are_read_as_they_were_stored(rows):
    rng = np.random.default_rng(4)
    shape = t.Shape((5, 300, 9), 1)
    codes = np.stack([rng.integers(0, w, 500) for w in shape.widths])
    tree = t.grow(codes, np.ones(500), rng.integers(0, 90, 500).astype(float), shape, t.TreeParams(12), 0)
    read = t._part(t.part_row(0, 0, 1, tree, shape), shape)
    assert (t.route(read, codes) == t.route(tree, codes)).all() and (t.evaluate({1: read}, codes) == t.evaluate({1: tree}, codes)).all()


@pytest.mark.parametrize("n", [30, 400, 3000])
def test_sparse_splits_are_those_of_histograms(n):
    rng = np.random.default_rng(n)
    shape = t.Shape((4, 7, 90, 128), 2)
    codes = np.stack([rng.integers(0, w, n) for w in shape.widths])
    at, s = rng.integers(0, 5, n), rng.integers(-50, 50, n).astype(float)
    at[:5] = range(5)
    w = np.ones(n)
    for p in (t.TreeParams(5), t.TreeParams(5, min_rows=3, fraction=0.5, seed=2)):
        paths = np.arange(32, 37)
        a = t._sparse_splits(codes, at, w, s, paths, shape, p, 3)
        b = t.best_splits(lambda k: t._sums(codes[k], at, 5, shape.widths[k], w, s), paths, shape, p, 3)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
