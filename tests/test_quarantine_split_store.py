"""Bad CSV rows, the exact grouped split, the feature table by day, and bucketed inputs."""

from collections import Counter
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gatecast.operators import asof, split
from gatecast.operators.metadata import left_join_metadata
from gatecast.schemas import ETD_SCHEMA, LAMP_SCHEMA
from gatecast.session import fresh_dir
from gatecast.sources import feature_store as store
from gatecast.sources.quarantine import read_csv_checked


def test_every_row_is_good_or_rejected_with_its_reason(spark, tmp_path):
    lines = ["gufi,extra,airport,departure_runway_estimated_time,timestamp",
             "G1,x,A1,2024-01-01 10:00:00,2024-01-01 09:00:00.5", "G2,x,A1,,2024-01-01 09:00:00", 'G3,"a, b",A1,2024-01-01T10:00:00,2024-01-01 09:00:00',
             "G4,x,A1,2024-01-01 10:00:00,", "G5,x,,2024-01-01 10:00:00,2024-01-01 09:00:00", "G6,x,A1,2024-02-30 10:00:00,2024-01-01",
             "G7,x,A1", "G8,x,A1,2024-01-01 10:00:00,2024-01-01 09:00:00,more", "G9,x,A1,never,2024-01-01 09:00:00"]
    (tmp_path / "one.csv").write_text("\n".join(lines[:6]) + "\n")
    (tmp_path / "two.csv").write_text("\n".join([lines[0], *lines[6:]]) + "\n")
    good, rejects = read_csv_checked(spark, str(tmp_path), ETD_SCHEMA)
    assert good.columns == ETD_SCHEMA.names and [f.dataType for f in good.schema] == [f.dataType for f in ETD_SCHEMA]
    rows = {r.gufi: r for r in good.collect()}
    assert set(rows) == {"G1", "G2", "G3"} and rows["G2"].departure_runway_estimated_time is None
    assert rows["G1"].timestamp == datetime(2024, 1, 1, 9, 0, 0, 500000)
    bad = {r.record.split(",")[0]: r for r in rejects.collect()}
    assert set(bad) == {"G4", "G5", "G6", "G7", "G8", "G9"}
    assert {Path(r.file).name for r in bad.values()} == {"one.csv", "two.csv"}
    reasons = {k: r.reasons for k, r in bad.items()}
    assert reasons["G4"] == ["timestamp: missing"] and reasons["G5"] == ["airport: missing"]
    assert reasons["G6"] == ["timestamp: not timestamp_ntz: 2024-01-01", "departure_runway_estimated_time: not timestamp_ntz: 2024-02-30 10:00:00"]
    assert reasons["G7"] == reasons["G8"] == ["not 5 cells"] and bad["G8"].record == lines[8]
    assert reasons["G9"] == ["departure_runway_estimated_time: not timestamp_ntz: never"]


def test_numbers_and_flags_are_checked_too(spark, tmp_path):
    names = LAMP_SCHEMA.names
    plain = {"airport": "A1", "timestamp": "2024-01-01 09:00:00", "forecast_timestamp": "2024-01-01 09:30:00", "temperature": "1.5", "precip": "True"}
    cells = [plain, plain | {"temperature": "warm"}, plain | {"temperature": "NaN"}, plain | {"temperature": ""}]
    (tmp_path / "w.csv").write_text("\n".join([",".join(names), *[",".join(c.get(n, "") for n in names) for c in cells]]) + "\n")
    good, rejects = read_csv_checked(spark, str(tmp_path), LAMP_SCHEMA)
    assert [r.temperature for r in good.orderBy("temperature").collect()] == [None, 1.5]
    assert sorted(r.reasons for r in rejects.collect()) == [["temperature: not double: NaN"], ["temperature: not double: warm"]]
    with pytest.raises(ValueError, match="lacks"):
        read_csv_checked(spark, str(tmp_path), ETD_SCHEMA)


@pytest.mark.parametrize("percent", [0, 37, 80, 100])
def test_exact_split_misses_by_less_than_one_flight(spark, percent):
    sizes = {f"G{i}": 1 + (i * 7) % 13 for i in range(300)} | {"HOT": 700, None: 5}
    df = spark.createDataFrame([(g, k) for g, n in sizes.items() for k in range(n)], "gufi string, k int").repartition(7)
    rows = split.exact_grouped_split(df, percent).collect()
    total = sum(sizes.values())
    assert Counter(r.gufi for r in rows) == Counter(sizes)
    sides = {}
    for r in rows:
        sides.setdefault(r.gufi, set()).add(r.split)
    assert all(len(v) == 1 for v in sides.values())
    train = sum(r.split == "train" for r in rows)
    import hashlib
    order = sorted(sizes, key=lambda g: (hashlib.md5((g or "").encode()).hexdigest()[:16], g or ""))
    upto, want = 0, 0
    for g in order:
        upto += sizes[g]
        if upto * 100 > total * percent:
            break
        want = upto
    assert train == want
    again = split.exact_grouped_split(df.repartition(2), percent).where("split = 'train'").count()
    assert again == train
    assert split.exact_grouped_split(df.where("false")).collect() == []


def test_one_day_is_rewritten_alone(spark):
    rows = [(a, f"G{i}", datetime(2024, 1, d, i), i) for a in ("A1", "A2") for d in (1, 2, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "airport string, gufi string, timestamp timestamp_ntz, v int")
    path = fresh_dir(spark, "by-day")
    store.write_days(df, path)
    files = {p.relative_to(path) for p in Path(path).rglob("*.parquet")}
    new = df.withColumn("v", F.col("v") + 100).where("not (airport = 'A2' and day(timestamp) = 2)")
    store.write_days(new, path, ["2024-01-02"])
    after = {p.relative_to(path) for p in Path(path).rglob("*.parquet")}
    assert {p.parts[0] for p in files ^ after} == {"day=2024-01-02"}
    got = {(r.airport, r.timestamp.day): [] for r in store.read_days(spark, path, df.schema).collect()}
    assert (("A2", 2) not in got) and len(got) == 5
    for r in store.read_days(spark, path, df.schema).collect():
        got[r.airport, r.timestamp.day].append(r.v)
    assert all(min(v) == (100 if d == 2 else 0) for (_, d), v in got.items())
    one = store.read_days(spark, path, df.schema, ["2024-01-03"])
    assert one.count() == 8 and "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()


def test_bucketed_inputs_are_not_exchanged(spark, frames):
    labels = frames["labels"]([(f"G{i}", f"2024-01-01 {i % 24:02d}:00", "A1", i) for i in range(50)])
    etd = frames["etd"]([("A1", f"G{i}", f"2024-01-01 {i % 20:02d}:10", "2024-01-01 23:00") for i in range(50)])
    mfs = frames["mfs"]([("A1", f"G{i}", "E", "T", "M", "F", True) for i in range(50)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sql("DROP TABLE IF EXISTS labels_by_flight")
        spark.sql("DROP TABLE IF EXISTS updates_by_flight")
        stored = store.write_bucketed(labels, "labels_by_flight", 4)
        updates = store.write_bucketed(etd, "updates_by_flight", 4)

        def exchanges(df):
            return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

        plain, laid_out = left_join_metadata(labels, mfs), left_join_metadata(stored, mfs)
        assert sorted(map(str, plain.collect())) == sorted(map(str, laid_out.collect()))
        assert exchanges(left_join_metadata(stored, mfs)) < exchanges(left_join_metadata(labels, mfs))
        slots = asof.latest_per_slot(updates)
        assert exchanges(slots) == 0 and exchanges(asof.latest_per_slot(etd)) == 1
        assert sorted(map(str, asof.asof_etd(stored, updates).collect())) == sorted(map(str, asof.asof_etd(labels, etd).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
