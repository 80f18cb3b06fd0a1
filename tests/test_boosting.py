"""One boosted fit for all airports: against plain Python, with patience, and scored in one pass."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gatecast.plans import boosting as b
from gatecast.plans.models import FULL, NO_WEATHER, Variant
from gatecast.schemas import CATEGORICAL, FEATURE_COLUMNS, LABEL, NUMERIC
from gatecast.session import fresh_dir

SMALL = Variant("na", ["aircraft_type", "major_carrier"], ["benchmark_pushback", "hour"])


def feature_rows(spark, rows):
    """Feature rows from dicts; what is not named gets a plain value."""
    kinds = {c: "string" for c in CATEGORICAL} | {c: "double" for c in NUMERIC} | {"hour": "int", "year": "int"}
    full = {"airport": "string", "gufi": "string", "timestamp": "timestamp_ntz", LABEL: "int"} | kinds
    schema = ", ".join(f"{c} {full[c]}" for c in FEATURE_COLUMNS) + ", held boolean"
    plain = {c: {"string": "X", "double": 1.0, "int": 1, "timestamp_ntz": datetime(2024, 1, 1)}[full[c]] for c in FEATURE_COLUMNS}
    return spark.createDataFrame([tuple(({**plain, "held": False} | r)[c] for c in [*FEATURE_COLUMNS, "held"]) for r in rows], schema)


def some_rows(n, seed, airports=("A1", "A2")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind, carrier, x, hour = rng.choice("abcd"), rng.choice(["m1", "m2", None]), rng.uniform(-50, 90), rng.randrange(24)
        y = x + {"a": 20, "b": -10, "c": 5, "d": 0}[kind] * (1 + (hour > 12)) + rng.gauss(0, 3)
        out.append({"airport": rng.choice(airports), "gufi": f"G{i}", LABEL: round(y), "aircraft_type": kind, "major_carrier": carrier,
                    "benchmark_pushback": x, "hour": hour, "held": i % 4 == 0})
    return out


def bins(row, levels, borders):
    codes = [levels[k].index(row[c]) if row[c] in levels[k] else -1 for k, c in enumerate(SMALL.categorical)]
    return codes + [sum(t < float(row[c]) for t in borders[k]) for k, c in enumerate(SMALL.numeric)]


def plain_fit(rows, levels, borders, p):
    """The same rules for one airport, row by row; returns a tree's predictions in order and a scoring function."""
    shrink = lambda s: math.copysign(max(abs(s) - p.l1 * b.SCALE, 0.0), s)
    score = lambda s, n: shrink(float(s)) ** 2 / (n + p.l2)
    value = lambda s, n: math.floor(p.learning_rate * (shrink(float(s)) / (n + p.l2)))
    data = [(bins(r, levels, borders), r[LABEL] * b.SCALE) for r in rows if not r["held"]]
    base = math.floor(sum(y for _, y in data) / len(data))
    f, trees = [base] * len(data), []

    def grow(members, depth):
        if depth == p.depth:
            return None
        best = None
        total, n = sum(data[i][1] - f[i] for i in members), len(members)
        for k in range(4):
            hist = {}
            for i in members:
                c, s = hist.get(data[i][0][k], (0, 0))
                hist[data[i][0][k]] = (c + 1, s + data[i][1] - f[i])
            order = sorted(hist, key=lambda v: ((hist[v][1] / hist[v][0]) if k < 2 else v, v))
            nl = sl = 0
            for place, v in enumerate(order):
                nl, sl = nl + hist[v][0], sl + hist[v][1]
                if nl >= p.min_rows and n - nl >= p.min_rows and n > nl:
                    gain = score(sl, nl) + score(total - sl, n - nl) - score(total, n)
                    if gain >= 1 and (best is None or gain > best[0]):
                        best = (gain, k, set(order[:place + 1]), v, value(sl, nl), value(total - sl, n - nl))
        if best is None:
            return None
        _, k, left, cut, lv, rv = best
        goes = lambda c: c[k] in left if k < 2 else c[k] <= cut
        yes = [i for i in members if goes(data[i][0])]
        no = [i for i in members if not goes(data[i][0])]
        return goes, (grow(yes, depth + 1), lv), (grow(no, depth + 1), rv)

    def end(node, codes, v=0):
        while node is not None:
            goes, left, right = node
            node, v = left if goes(codes) else right
        return v

    for _ in range(p.rounds):
        tree = grow(range(len(data)), 0)
        trees.append(tree)
        f = [f[i] + end(tree, data[i][0]) for i in range(len(data))]
    return lambda row, k: base + sum(end(t, bins(row, levels, borders)) for t in trees[:k])


@pytest.mark.parametrize("p", [b.BoostParams(rounds=3, depth=3, bins=8, learning_rate=0.3),
                               b.BoostParams(rounds=2, depth=2, bins=5, min_rows=6, l1=0.9, l2=1.5, learning_rate=0.5)])
def test_fit_equals_plain_python(spark, p):
    rows = some_rows(160, 1)
    df = feature_rows(spark, rows).repartition(5)
    model = b.fit_boosted(df, SMALL, p)
    rows = [r | {"held": False} for r in rows]
    got = {r.gufi: r.prediction for r in b.predict(df, model).collect()}
    for m in model.models.collect():
        own = [r for r in rows if r["airport"] == m.airport]
        plain = plain_fit(own, m.levels, m.borders, p)
        assert m.kept == m.rounds == p.rounds and m.error is None
        for r in own:
            assert got[r["gufi"]] == plain(r, p.rounds) / b.SCALE


def test_patience_keeps_the_best_prefix(spark):
    rows = some_rows(400, 2) + [{"airport": "A3", "gufi": "x", LABEL: 5, "benchmark_pushback": 1.0}]
    p = b.BoostParams(rounds=25, depth=3, learning_rate=0.9, patience=2)
    df = feature_rows(spark, rows)
    model = b.fit_boosted(df, SMALL, p, "held")
    models = {m.airport: m for m in model.models.collect()}
    errors = {}
    for e in b.prefix_errors(df.where("held"), model).collect():
        errors.setdefault(e.airport, {})[e.trees] = e.error
    assert set(errors) == {"A1", "A2"}
    for a, by in errors.items():
        m = models[a]
        assert m.kept == min(by, key=lambda k: (by[k], k)) and m.error == by[m.kept]
        assert m.rounds == min(m.kept + p.patience, p.rounds) == max(by)
        own = [r for r in rows if r["airport"] == a]
        plain = plain_fit(own, m.levels, m.borders, p)
        held = [r for r in own if r["held"]]
        for k in by:  # the errors themselves, from a fit in plain Python
            assert by[k] == sum(abs(r[LABEL] * b.SCALE - plain(r, k)) for r in held) / len(held) / b.SCALE
    assert any(m.rounds < p.rounds for m in models.values())
    assert models["A3"].kept == models["A3"].rounds == p.rounds and models["A3"].error is None


def test_unseen_nulls_other_airports_and_saved_models(spark):
    df = feature_rows(spark, some_rows(100, 3))
    model = b.fit_boosted(df, SMALL, b.BoostParams(rounds=2, depth=2))
    odd = feature_rows(spark, [{"airport": "A1", "gufi": "u", "aircraft_type": "new", "major_carrier": None, "benchmark_pushback": 2.0},
                               {"airport": "A1", "gufi": "n", "benchmark_pushback": None}, {"airport": "Z", "gufi": "z"},
                               {"airport": None, "gufi": "0"}])
    got = {r.gufi: r.prediction for r in b.predict(odd, model).collect()}
    assert got["u"] is not None and got["n"] is None and got["z"] is None and got["0"] is None
    path = fresh_dir(spark, "boosted")
    model.save(path)
    again = b.predict(df, b.load_boosted(spark, path, SMALL)).collect()
    assert sorted(map(str, again)) == sorted(map(str, b.predict(df, model).collect()))
    none = b.fit_boosted(df.where("false"), SMALL)
    assert none.models.collect() == [] and [r.prediction for r in b.predict(odd, none).collect()] == [None] * 4


def test_many_airports_in_one_plan(spark):
    """2100 airports: the same number of joins and scans as for two, and no limit."""
    p = b.BoostParams(rounds=1, depth=1, bins=3)

    def fitted(n):
        rows = [{"airport": f"A{k}", "gufi": f"G{k}-{j}", LABEL: 10 * k + 5 * j, "benchmark_pushback": float(j)} for k in range(n) for j in range(2)]
        df = feature_rows(spark, rows)
        return b.predict(df, b.fit_boosted(df, SMALL, p))

    few, many = fitted(2), fitted(2100)
    lines = [df._jdf.queryExecution().optimizedPlan().toString().count("\n") for df in (few, many)]
    assert lines[0] == lines[1]
    got = {r.gufi: r.prediction for r in many.collect()}
    assert len(got) == 4200 and got["G7-0"] < got["G7-1"] and abs(got["G2000-1"] - 20002.5) < 1


def test_rows_and_batches_take_their_variant(spark):
    rows = some_rows(120, 4, ("A1",)) + [{"airport": "A2", "gufi": f"N{k}", LABEL: k, "wind_gust": None} for k in range(5)]
    df = feature_rows(spark, rows)
    p = b.BoostParams(rounds=2, depth=2)
    full, na = b.fit_boosted(df, FULL, p), b.fit_boosted(df, NO_WEATHER, p)
    ask = feature_rows(spark, [{"airport": "A1", "gufi": "a"}, {"airport": "A1", "gufi": "b", "wind_gust": None}, {"airport": "A2", "gufi": "c"},
                               {"airport": "Z", "gufi": "d"}, {"airport": "A1", "gufi": "e", "benchmark_pushback": None}])
    got = {r.gufi: (r.model_variant, r.prediction) for r in b.score_boosted(ask, full, na).collect()}
    want = {r.gufi: r for r in b.predict(b.predict(ask, full, "f"), na, "n").collect()}
    even = lambda x: int(round(x))
    assert got == {"a": ("full", even(want["a"].f)), "b": ("na", even(want["b"].n)), "c": ("na", even(want["c"].n)),
                   "d": ("none", None), "e": ("none", None)}
    batch = {r.gufi: r.model_variant for r in b.score_boosted(ask, full, na, "batch").collect()}
    assert batch == {"a": "na", "b": "na", "c": "na", "d": "none", "e": "none"}


def test_reference_settings():
    p = b.reference_params("full")
    assert (p.rounds, p.patience, p.depth, p.min_rows) == (1000, 10, 17, 250) and 0 < p.l1 < 1 and 0 < p.l2 < 1
    assert b.reference_params("na", 3).rounds == 3


def test_airports_may_have_their_own_settings(spark):
    rows = some_rows(160, 5)
    df = feature_rows(spark, rows)
    p = b.BoostParams(rounds=2, depth=3, bins=6)
    own = {"A1": b.BoostParams(rounds=2, depth=1, bins=6, learning_rate=0.7, l1=0.2), "A2": b.BoostParams(rounds=2, depth=3, bins=6, min_rows=9)}
    model = b.fit_boosted(df, SMALL, p, per_airport=own)
    got = {r.gufi: r.prediction for r in b.predict(df, model).collect()}
    rows = [r | {"held": False} for r in rows]
    for m in model.models.collect():
        mine = [r for r in rows if r["airport"] == m.airport]
        plain = plain_fit(mine, m.levels, m.borders, own[m.airport])
        assert all(got[r["gufi"]] == plain(r, 2) / b.SCALE for r in mine)
