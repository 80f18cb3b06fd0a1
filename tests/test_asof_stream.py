"""The stateful stream: timers, late rows, restarts, and the end of state."""

import json

import pytest
from pyspark.sql import functions as F

from gatecast.operators import asof
from gatecast.operators.weather import weather_lookup
from gatecast.session import fresh_dir
from gatecast.sources import fixtures as fx
from gatecast.streaming import asof_stream as s
from gatecast.functions.timeops import epoch_us

from conftest import ts

HOUR = s.HOUR_US


class Feed:
    """Two feeds, a sink and a checkpoint; every ``run`` starts the query anew."""

    def __init__(self, spark, delay="0 seconds"):
        self.spark, self.delay = spark, delay
        self.updates, self.requests, self.out, self.checkpoint = (fresh_dir(spark, f"t-{k}") for k in ("u", "r", "o", "c"))
        self.query = None

    def run(self, updates=None, requests=None, beat=None):
        for rows, path, feed in ((updates, self.updates, "updates"), (requests, self.requests, "requests")):
            if rows is not None:
                s.append_to_feed(rows, path, feed)
        if beat:
            us = self.spark.range(1).select(epoch_us(F.lit(beat).cast("timestamp_ntz"))).first()[0]
            s.heartbeat(self.spark, self.updates, "updates", us)
        for path, feed in ((self.updates, "updates"), (self.requests, "requests")):
            self.spark.createDataFrame([], s.FEEDS[feed]).limit(0).write.mode("append").parquet(path)
        answers = s.estimate_stream(s.read_feed(self.spark, self.updates, "updates", 100),
                                    s.read_feed(self.spark, self.requests, "requests", 100), self.delay)
        self.query = s.run_available(answers, self.out, self.checkpoint)
        rows = self.spark.read.schema(answers.schema).parquet(self.out).collect()
        return sorted(((r.timestamp, r.gufi, r.rows, r.update_timestamp, r[asof.DEP], r.late) for r in rows), key=str)

    def dropped(self):
        return sum(o["numRowsDroppedByWatermark"] for p in self.query.recentProgress for o in p["stateOperators"])

    def states(self):
        return self.query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_answers_wait_for_the_clock_and_late_rows_have_their_fate(spark, frames):
    feed = Feed(spark)
    etd = lambda *rows: frames["etd"]([("A1", "G1", f"2024-01-01 {t}", f"2024-01-01 {d}") for t, d in rows])
    ask = lambda *times: frames["labels"]([("G1", f"2024-01-01 {t}", "A1", None) for t in times])
    at = lambda t: ts(f"2024-01-01 {t}")
    assert feed.run(etd(("10:00", "12:00"), ("09:59", "11:00")), ask("10:20", "10:20", "11:30")) == []
    # an update between the two requests, and one that counts from 10:15 on
    assert feed.run(etd(("10:10", "12:10"), ("10:50", "12:50"))) == [(at("10:20"), "G1", 2, at("10:10"), at("12:10"), False)]
    first = feed.run(beat="2024-01-01 11:00:00")
    assert len(first) == 1  # 11:30 is not due yet
    # a late update is not used; a late request is answered at once, from what is known
    got = feed.run(etd(("10:55", "23:00")), ask("10:40"))
    assert got[1] == (at("10:40"), "G1", 1, at("10:10"), at("12:10"), True) and len(got) == 2
    assert feed.dropped() >= 1
    got = feed.run(beat="2024-01-01 12:00:00")
    assert got[2] == (at("11:30"), "G1", 1, at("10:50"), at("12:50"), False) and len(got) == 3
    assert feed.states() == 1
    # after 30 hours nothing is left, and a request finds nothing
    feed.run(beat="2024-01-02 17:00:00")
    assert feed.states() == 0
    got = feed.run(None, ask("12:30"))
    assert got[3] == (at("12:30"), "G1", 1, None, None, True) and len(got) == 4
    assert feed.run() == got  # started again without new rows


def test_history_is_visible_for_30_hours(spark, frames):
    feed = Feed(spark)
    etd = frames["etd"]([("A1", "G1", "2024-01-01 00:00", "2024-01-03 00:00"), ("A2", "G1", "2024-01-01 00:00:00.000001", "2024-01-03 01:00"),
                         ("A1", "G2", "2024-01-01 00:00", None)])
    asks = frames["labels"]([("G1", "2024-01-02 06:00", "A1", None), ("G1", "2024-01-02 06:00", "A2", 3), ("G2", "2024-01-01 00:00", "A1", None),
                             ("G3", "2024-01-01 00:00", "A1", None)])
    feed.run(etd, asks)
    got = feed.run(beat="2024-01-05 00:00:00")
    want = asof.asof_etd(asks, etd, strict=False, max_age_hours=30)
    assert sorted(str((r.timestamp, r.gufi, r.update_timestamp, r[asof.DEP])) for r in want.collect()) == \
        sorted(str((t, g, u, d)) for t, g, _, u, d, _ in got)
    assert feed.states() == 0


def test_random_feeds_equal_the_batch_join(spark, frames):
    import random
    rng = random.Random(9)
    def moment():
        return f"2024-01-{rng.randint(1, 4):02d} {rng.randrange(24):02d}:{rng.choice(['00', '07', '15', '30', '44', '45'])}"

    flights = ["HOT"] * 3 + [f"G{i}" for i in range(6)]
    etd = frames["etd"]([("A1", rng.choice(flights), moment(), rng.choice([None, moment()])) for _ in range(300)])
    asks = frames["labels"]([(rng.choice(flights), moment(), "A1", None) for _ in range(120)])
    got = s.replay(spark, etd, asks, "updates", s.estimate_stream, periods=4)
    want = asof.asof_etd(asks, etd, strict=False, max_age_hours=30).groupBy("gufi", "timestamp", "airport", "update_timestamp", asof.DEP).agg(
        F.count("*").alias("rows")).withColumn("late", F.lit(False))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_forecast_stream_equals_the_batch_lookup(spark, frames):
    lamp = frames["lamp"]([("A1", "2024-01-01 10:00", "2024-01-01 10:30", 1.0), ("A1", "2024-01-01 10:15", "2024-01-01 10:45", 2.0),
                           ("A1", "2024-01-01 10:15", "2024-01-01 11:15", 9.0), ("A2", "2024-01-01 10:00", "2024-01-01 10:30", None),
                           ("A1", "2024-01-01 10:15", "2024-01-01 10:45", 2.5, {"wind_gust": None})])
    asks = frames["labels"]([("G1", f"2024-01-01 {t}", a, None) for t in ("10:30", "10:45", "11:15", "11:30", "11:45") for a in ("A1", "A2")])
    got = s.replay(spark, lamp, asks, "forecasts", s.weather_stream, periods=2)
    want = weather_lookup(asks, lamp)
    cols = [c for c in want.columns if c not in ("gufi", "minutes_until_pushback")]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_fresher_update_and_empty_feeds(spark, frames):
    value = lambda v: json.dumps({"estimate": v})
    assert s._fresher((2, value(None)), (1, value(5))) and s._fresher((1, value(5)), (1, value(None)))
    assert not s._fresher((1, value(None)), (1, value(None)))
    assert s.answer({}, 5, 10) is None and s.answer({6: (5, "x")}, 5, 10) is None
    assert s.answer({1: (0, "a"), 5: (4, "b")}, 5, 10) == (4, "b") and s.answer({1: (-5, "a")}, 5, 10) is None
    none = s.replay(spark, frames["etd"]([]), frames["labels"]([]), "updates", s.estimate_stream, periods=1)
    assert none.collect() == []


@pytest.mark.parametrize("feed", sorted(s.FEEDS))
def test_heartbeat_has_the_feed_schema(spark, feed):
    path = fresh_dir(spark, "beat")
    s.heartbeat(spark, path, feed, 0)
    assert [f.name for f in spark.read.parquet(path).schema] == s.FEEDS[feed].names


def test_requests_are_scored_as_they_come_due(spark, frames):
    """Streamed scores equal the batch pipeline's, row by row, over several started queries."""
    from gatecast.plans import boosting as b
    from gatecast.plans.features import feature_pipeline
    from gatecast.plans.models import FULL, NO_WEATHER
    from gatecast.streaming.score_stream import start_scoring
    i = {t: getattr(fx, t)(spark, "/root/testdata/sf0.001") for t in ("labels", "etd", "lamp", "mfs")}
    f = feature_pipeline(i["labels"], i["etd"], i["lamp"], i["mfs"])
    p = b.BoostParams(rounds=2, depth=2)
    full, na = b.fit_boosted(f, FULL, p), b.fit_boosted(f, NO_WEATHER, p)
    twice = i["labels"].unionByName(i["labels"].limit(3))
    got = s.replay(spark, i["etd"], twice, "updates", None, periods=2,
                   run=lambda u, r, out, c: s.finish(start_scoring(u, r, i["lamp"], i["mfs"], full, na, out, c)))
    keys = ["gufi", "timestamp", "airport"]
    want = b.score_boosted(feature_pipeline(i["labels"].select(*keys).distinct(), i["etd"], i["lamp"], i["mfs"], strict=False, bounded=True), full, na)
    rows = got.collect()
    assert sum(r.rows for r in rows) == twice.count() and not any(r.late for r in rows)
    assert sorted(str((r.gufi, r.timestamp, r.airport, r.model_variant, r.minutes_until_pushback)) for r in rows) == \
        sorted(str((r.gufi, r.timestamp, r.airport, r.model_variant, r.prediction)) for r in want.collect())


def test_many_flights_share_few_states_and_files(spark, frames):
    """A call and a state for every flight would take longer than its rows; a period's files are one batch."""
    flights = [f"G{i}" for i in range(40)]
    etd = frames["etd"]([("A1", g, f"2024-01-01 {8 + k:02d}:{i:02d}", f"2024-01-02 {k:02d}:{i:02d}") for i, g in enumerate(flights) for k in range(3)])
    asks = frames["labels"]([(g, f"2024-01-01 {9 + k:02d}:45", "A1", None) for g in flights for k in range(3)])
    queries, most = [], []

    def run(u, r, out, checkpoint):
        q = s.run_available(s.estimate_stream(u, r, bundles=4), out, checkpoint)
        queries.append(q)
        most.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress))

    got = s.replay(spark, etd.repartition(6, "timestamp"), asks.repartition(3), "updates", None, run=run)
    want = asof.asof_etd(asks, etd, strict=False, max_age_hours=30).groupBy("gufi", "timestamp", "airport", "update_timestamp", asof.DEP).agg(
        F.count("*").alias("rows")).withColumn("late", F.lit(False))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert max(most) == 4
    assert queries[-1].lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    assert all(sum(p["numInputRows"] > 0 for p in q.recentProgress) == 1 for q in queries)
