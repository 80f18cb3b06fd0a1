"""Edge frames for the weather lookup (J7 and parts)."""

from conftest import ts

from gatecast.operators.weather import weather_lookup, weather_matched, weather_slots


def _lookup(frames, label_times, lamp_rows, airport="A"):
    lab = frames["labels"]([(f"G{i}", t, airport, 1) for i, t in enumerate(label_times)])
    out = weather_lookup(lab, frames["lamp"](lamp_rows)).collect()
    return {r["timestamp"]: r for r in out}


def test_issue_serves_four_slots(frames):
    times = ["2024-01-01 11:00:00", "2024-01-01 11:15:00", "2024-01-01 11:30:00", "2024-01-01 11:45:00",
             "2024-01-01 10:45:00", "2024-01-01 12:00:00"]
    got = _lookup(frames, times, [("A", "2024-01-01 10:30:00", "2024-01-01 11:00:00", 7.0)])
    served = {t for t, r in got.items() if r["temperature"] is not None}
    assert served == {ts(t) for t in times[:4]}
    assert len(got) == len(times)


def test_only_thirty_minute_lead(frames):
    got = _lookup(frames, ["2024-01-01 11:00:00"],
                  [("A", "2024-01-01 10:00:00", "2024-01-01 11:00:00", 9.0)])  # 60-min lead
    assert got[ts("2024-01-01 11:00:00")]["temperature"] is None


def test_freshest_issue_wins_one_row_per_label(frames):
    got = _lookup(frames, ["2024-01-01 11:30:00"], [
        ("A", "2024-01-01 10:15:00", "2024-01-01 10:45:00", 1.0),
        ("A", "2024-01-01 10:30:00", "2024-01-01 11:00:00", 2.0),
        ("A", "2024-01-01 10:45:00", "2024-01-01 11:15:00", 3.0)])
    assert len(got) == 1 and got[ts("2024-01-01 11:30:00")]["temperature"] == 3.0


def test_other_airport_not_matched(frames):
    got = _lookup(frames, ["2024-01-01 11:00:00"],
                  [("B", "2024-01-01 10:30:00", "2024-01-01 11:00:00", 7.0)])
    assert got[ts("2024-01-01 11:00:00")]["temperature"] is None


def test_matched_keeps_every_pair(frames):
    lab = frames["labels"]([("G1", "2024-01-01 11:30:00", "A", 1)])
    lamp = frames["lamp"]([("A", "2024-01-01 10:15:00", "2024-01-01 10:45:00", 1.0),
                           ("A", "2024-01-01 10:30:00", "2024-01-01 11:00:00", 2.0)])
    assert weather_matched(lab, lamp).count() == 2


def test_slot_table_unique(frames):
    lamp = frames["lamp"]([("A", "2024-01-01 10:15:00", "2024-01-01 10:45:00", 1.0),
                           ("A", "2024-01-01 10:30:00", "2024-01-01 11:00:00", 2.0)])
    s = weather_slots(lamp)
    assert s.count() == s.select("airport", "timestamp").distinct().count() == 5


def test_join_indicator_null_safe_and_right_only(spark):
    from gatecast.operators.weather import join_indicator
    left = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (1, "a"), (2, "c"), (None, "b")], "k int, v string")
    out = sorted((r["k"] if r["k"] is not None else -1, r["v"], r["_merge"])
                 for r in join_indicator(left, right, ["k", "v"]).collect())
    assert out == [(-1, "b", "both"), (1, "a", "both"), (1, "a", "both"), (2, "c", "right_only")]


def test_lookup_without_broadcast_gives_the_same_rows(spark):
    from gatecast.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    lab, lamp = fx.labels(spark, sf), fx.lamp(spark, sf)
    want = sorted(map(tuple, weather_lookup(lab, lamp).collect()), key=str)
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        assert sorted(map(tuple, weather_lookup(lab, lamp).collect()), key=str) == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
