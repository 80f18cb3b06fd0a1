"""Edge frames for the as-of estimate."""

from conftest import ts

from gatecast.operators.asof import asof_etd, latest_per_slot

DEP = "departure_runway_estimated_time"


def _one(df, gufi, t):
    rows = [r for r in df.collect() if r["gufi"] == gufi and r["timestamp"] == ts(t)]
    assert len(rows) <= 1
    return rows[0] if rows else None


def test_update_at_prediction_time_counts(frames):
    lab = frames["labels"]([("G1", "2024-01-01 10:00:00", "A", 5)])
    etd = frames["etd"]([("A", "G1", "2024-01-01 10:00:00", "2024-01-01 10:30:00")])
    r = _one(asof_etd(lab, etd), "G1", "2024-01-01 10:00:00")
    assert r is not None and r[DEP] == ts("2024-01-01 10:30:00")


def test_update_one_microsecond_later_is_not_used(frames):
    lab = frames["labels"]([("G1", "2024-01-01 10:00:00", "A", 5)])
    etd = frames["etd"]([
        ("A", "G1", "2024-01-01 09:40:00", "2024-01-01 10:20:00"),
        ("A", "G1", "2024-01-01 10:00:00.000001", "2024-01-01 10:45:00")])
    r = _one(asof_etd(lab, etd), "G1", "2024-01-01 10:00:00")
    assert r[DEP] == ts("2024-01-01 10:20:00")


def test_half_quarter_updates_round_up(frames):
    etd = frames["etd"]([("A", "G1", "2024-01-01 10:07:30", "2024-01-01 11:00:00"),
                         ("A", "G1", "2024-01-01 10:22:30", "2024-01-01 11:05:00")])
    slots = sorted(r["rounded_timestamp"] for r in latest_per_slot(etd).collect())
    assert slots == [ts("2024-01-01 10:15:00"), ts("2024-01-01 10:30:00")]


def test_latest_in_slot_then_largest_estimate(frames):
    etd = frames["etd"]([
        ("A", "G1", "2024-01-01 10:01:00", "2024-01-01 11:00:00"),
        ("A", "G1", "2024-01-01 10:09:00", "2024-01-01 11:10:00"),
        ("A", "G1", "2024-01-01 10:09:00", "2024-01-01 11:20:00"),
        ("A", "G1", "2024-01-01 10:05:00", "2024-01-01 11:30:00")])
    rows = latest_per_slot(etd).collect()
    assert len(rows) == 1
    assert rows[0]["timestamp"] == ts("2024-01-01 10:09:00")
    assert rows[0][DEP] == ts("2024-01-01 11:20:00")


def test_no_update_strict_drops_scoring_keeps(frames):
    lab = frames["labels"]([("G1", "2024-01-01 10:00:00", "A", 5), ("G2", "2024-01-01 10:00:00", "A", 6)])
    etd = frames["etd"]([("A", "G1", "2024-01-01 09:00:00", "2024-01-01 10:30:00")])
    assert {r["gufi"] for r in asof_etd(lab, etd, strict=True).collect()} == {"G1"}
    loose = {r["gufi"]: r for r in asof_etd(lab, etd, strict=False).collect()}
    assert set(loose) == {"G1", "G2"} and loose["G2"][DEP] is None


def test_thirty_hour_bound(frames):
    lab = frames["labels"]([("G1", "2024-01-03 10:00:00", "A", 5)])
    etd = frames["etd"]([("A", "G1", "2024-01-02 03:00:00", "2024-01-03 11:00:00")])  # 31 h old
    assert _one(asof_etd(lab, etd, strict=True), "G1", "2024-01-03 10:00:00") is not None
    r = _one(asof_etd(lab, etd, strict=False, max_age_hours=30), "G1", "2024-01-03 10:00:00")
    assert r[DEP] is None


def test_same_gufi_two_airports_no_fanout(frames):
    lab = frames["labels"]([("G1", "2024-01-01 10:00:00", "A", 5)])
    etd = frames["etd"]([("A", "G1", "2024-01-01 09:00:00", "2024-01-01 10:30:00"),
                         ("B", "G1", "2024-01-01 09:50:00", "2024-01-01 12:00:00")])
    out = asof_etd(lab, etd).collect()
    assert len(out) == 1 and out[0][DEP] == ts("2024-01-01 10:30:00")


def test_off_grid_request_uses_floor_slot(frames):
    lab = frames["labels"]([("G1", "2024-01-01 10:07:00", "A", 5)])
    etd = frames["etd"]([("A", "G1", "2024-01-01 10:01:00", "2024-01-01 10:30:00"),
                         ("A", "G1", "2024-01-01 09:59:00", "2024-01-01 10:40:00")])
    # 10:01 rounds to 10:15 > 10:07: not yet known; 09:59 rounds to 10:00
    r = _one(asof_etd(lab, etd), "G1", "2024-01-01 10:07:00")
    assert r[DEP] == ts("2024-01-01 10:40:00")


def test_duplicate_requests_preserved(frames):
    lab = frames["labels"]([("G1", "2024-01-01 10:00:00", "A", 5), ("G1", "2024-01-01 10:00:00", "A", 5),
                            ("G1", "2024-01-01 10:00:00", "A", None)])
    etd = frames["etd"]([("A", "G1", "2024-01-01 09:00:00", "2024-01-01 10:30:00")])
    assert asof_etd(lab, etd).count() == 3


def test_hot_flight_window_group_is_bounded(spark):
    """A flight holding a third of all rows still feeds the as-of window at most
    two rows per quarter-hour slot (updates and requests are pre-aggregated)."""
    from pyspark.sql import functions as F

    from gatecast.operators.asof import asof_per_slot
    from gatecast.schemas import ETD_SCHEMA, LABELS_SCHEMA
    base = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("G"), F.col("id").cast("string"))).alias("gufi"),
        (F.lit("2024-01-01 10:00:00").cast("timestamp_ntz")).alias("t0"), F.col("id"))
    etd = base.select(F.lit("A").alias("airport"), "gufi",
                      F.timestamp_add("SECOND", F.col("id") % 3600, F.col("t0")).alias("timestamp"),
                      F.timestamp_add("MINUTE", F.lit(90), F.col("t0")).alias("departure_runway_estimated_time"))
    req = base.select("gufi", F.timestamp_add("MINUTE", (F.col("id") % 4) * 15 + 60, F.col("t0")).alias("timestamp"),
                      F.lit("A").alias("airport"), F.lit(1).alias("minutes_until_pushback"))
    etd = spark.createDataFrame(etd.rdd, ETD_SCHEMA)
    req = spark.createDataFrame(req.rdd, LABELS_SCHEMA)
    per_slot = asof_per_slot(req, etd)
    hot = per_slot.where("gufi = 'HOT'").count()
    assert hot == 4                                   # one answer per distinct request slot
    out = asof_etd(req, etd).where("gufi = 'HOT'")
    assert out.count() == 2000                        # every hot request kept, none duplicated
    # latest update at or before each slot: ceil15(u) <= t  <=>  u <= t on the grid
    got = {r["timestamp"]: r["update_timestamp"] for r in out.select("timestamp", "update_timestamp").distinct().collect()}
    ups = sorted(r[0] for r in etd.where("gufi = 'HOT'").select("timestamp").collect())
    for t, u in got.items():
        assert u == max(x for x in ups if x <= t)
