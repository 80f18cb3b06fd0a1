"""Randomised checks of the as-of estimate and the weather lookup against a
brute-force definition written directly from the reference's semantics."""

import random
from datetime import datetime, timedelta

import pytest

from gatecast.operators.asof import asof_etd
from gatecast.operators.weather import weather_lookup
from gatecast.schemas import ETD_SCHEMA, LABELS_SCHEMA, LAMP_SCHEMA

T0 = datetime(2024, 1, 1)
Q = timedelta(minutes=15)


def _ceil15(t):
    r = (t - T0) % Q
    return t if r == timedelta(0) else t + (Q - r)


def _brute_asof(labels, etd, max_age=None):
    out = {}
    for g, t, a, m in labels:
        seen = [(u, d) for (ea, eg, u, d) in etd if ea == a and eg == g and _ceil15(u) <= t]
        if max_age is not None:
            seen = [(u, d) for u, d in seen if u > t - max_age]
        best = max(seen, key=lambda x: (x[0], x[1] or datetime.min)) if seen else None
        out[(g, t, a)] = best
    return out


@pytest.mark.parametrize("seed", range(4))
def test_asof_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    airports, gufis = ["A", "B"], [f"G{i}" for i in range(4)]
    labels = list({(rng.choice(gufis), T0 + Q * rng.randint(0, 200), rng.choice(airports), rng.randint(0, 60))
                   for _ in range(60)})
    etd = [(rng.choice(airports), rng.choice(gufis),
            T0 + timedelta(seconds=rng.choice([rng.randint(0, 200 * 900), 900 * rng.randint(0, 200)])),
            None if rng.random() < 0.1 else T0 + timedelta(minutes=rng.randint(0, 4000)))
           for _ in range(120)]
    ldf = spark.createDataFrame(labels, LABELS_SCHEMA)
    edf = spark.createDataFrame(etd, ETD_SCHEMA)
    for max_age in (None, 30):
        got = asof_etd(ldf, edf, strict=False, max_age_hours=max_age).collect()
        want = _brute_asof(labels, etd, None if max_age is None else timedelta(hours=max_age))
        assert len(got) == len(labels)
        for r in got:
            w = want[(r["gufi"], r["timestamp"], r["airport"])]
            assert (r["update_timestamp"], r["departure_runway_estimated_time"]) == (w if w else (None, None))


@pytest.mark.parametrize("seed", range(3))
def test_weather_lookup_matches_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    labels = list({(f"G{rng.randint(0, 5)}", T0 + Q * rng.randint(0, 40), rng.choice("AB"), 1)
                   for _ in range(50)})
    lamp = {}
    for _ in range(40):
        a, issue = rng.choice("AB"), T0 + Q * rng.randint(-8, 40)
        lead = timedelta(minutes=rng.choice([30, 30, 60]))
        lamp[(a, issue, issue + lead)] = float(rng.randint(0, 99))
    rows = [(a, i, f, v, 1.0, 2.0, 3.0, 4.0, 5.0, "C", "L", "P") for (a, i, f), v in lamp.items()]
    got = {(r["gufi"], r["timestamp"], r["airport"]): r["temperature"]
           for r in weather_lookup(spark.createDataFrame(labels, LABELS_SCHEMA),
                                   spark.createDataFrame(rows, LAMP_SCHEMA)).collect()}
    assert len(got) == len(labels)
    for g, t, a, _ in labels:
        serving = [(i, v) for (la, i, f), v in lamp.items()
                   if la == a and f - i == timedelta(minutes=30) and t - i in
                   [timedelta(minutes=m) for m in (30, 45, 60, 75)]]
        want = max(serving)[1] if serving else None
        assert got[(g, t, a)] == want
