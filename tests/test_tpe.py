"""Adaptive search: same seed, same trials; each draw follows from those before; it beats random draws."""

import math

from gatecast.plans import tpe, tuning
from gatecast.plans.boosting import BoostParams
from test_boosting import SMALL, feature_rows, some_rows

SPACE = {"rate": tpe.Uniform(-4.0, 0.0, log=True), "share": tpe.Uniform(0.5, 1.0), "leaves": tpe.Uniform(100, 1000, step=25),
         "depth": tpe.Choice(tuple(range(10, 21)))}


def loss(v):
    return (math.log(v["rate"]) + 2.5) ** 2 + 8 * abs(v["share"] - 0.6) + ((v["leaves"] - 800) / 300) ** 2 + 0.1 * abs(v["depth"] - 17)


def search(seed, n=25, objective=loss, adaptive=True):
    trials = []
    for k in range(n):
        point = tpe.suggest(SPACE, trials if adaptive else [], seed if adaptive else seed * 1000 + k)
        trials.append((point, objective(tpe.values(SPACE, point))))
    return trials


def test_draws_are_repeatable_and_inside_the_space():
    assert search(3) == search(3) != search(4)
    for point, _ in search(3, 40):
        v = tpe.values(SPACE, point)
        assert math.exp(-4) <= v["rate"] <= 1 and 0.5 <= v["share"] <= 1 and v["depth"] in range(10, 21)
        assert v["leaves"] % 25 == 0 and 100 <= v["leaves"] <= 1000 and isinstance(v["leaves"], int)


def test_each_draw_follows_from_all_before():
    trials = search(3, 12)
    nxt = tpe.suggest(SPACE, trials, 3)
    for k in range(12):
        other = list(trials)
        other[k] = (other[k][0], other[k][1] + 100 if other[k][1] == min(t[1] for t in trials) else -100)
        assert tpe.suggest(SPACE, other, 3) != nxt
    assert tpe.suggest(SPACE, [(p, None) for p, _ in trials], 3)  # failed trials are no reason to stop
    assert tpe.suggest(SPACE, [(p, math.nan) for p, _ in trials], 3) == tpe.suggest(SPACE, [(p, None) for p, _ in trials], 3)


def test_lower_loss_than_random_draws_at_25_evaluations():
    best = lambda trials: min(t[1] for t in trials)
    seeds = range(40)
    adaptive = sorted(best(search(s)) for s in seeds)
    drawn = sorted(best(search(s, adaptive=False)) for s in seeds)
    assert sum(adaptive) < 0.85 * sum(drawn) and adaptive[20] < drawn[20]


def test_search_over_all_airports(spark):
    df = feature_rows(spark, some_rows(240, 7))
    space = {"learning_rate": tpe.Uniform(-3.0, 0.0, log=True), "depth": tpe.Choice((1, 2))}
    base = BoostParams(rounds=2, patience=1)
    trials, model = tuning.tune_adaptive(df, SMALL, 7, base, space)
    rows = trials.collect()
    assert sorted((r.airport, r.trial) for r in rows) == [(a, t) for a in ("A1", "A2") for t in range(7)]
    by = {a: sorted((r for r in rows if r.airport == a), key=lambda r: r.trial) for a in ("A1", "A2")}
    kept = {m.airport: m.kept for m in model.models.collect()}
    for a, own in by.items():
        assert [r.is_best for r in own].count(True) == 1
        best = next(r for r in own if r.is_best)
        assert best.validation_mae == min(r.validation_mae for r in own) and kept[a] == best.kept
        history = []
        for r in own:  # the recorded trials are those that the earlier ones call for
            point = tpe.suggest(space, history, 23)
            assert tpe.values(space, point) == {"learning_rate": r.learning_rate, "depth": r.depth}
            history.append((point, r.validation_mae))
    mae = {r.airport: r.mae for r in tuning.boosted_mae(df, model).collect()}
    assert set(mae) == {"A1", "A2"} and all(0 < x < 60 for x in mae.values())
