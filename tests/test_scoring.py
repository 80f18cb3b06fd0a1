"""Routing, rounding, attaching, splitting, encoding."""

from conftest import ts
from pyspark.sql import functions as F

from gatecast.functions.scalar import round_half_even_int
from gatecast.operators.encode import category_codes, one_hot
from gatecast.operators.split import hash_split
from gatecast.plans.features import feature_pipeline
from gatecast.plans.scoring import attach_predictions, expression_predictor, route_batches, route_rows


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "p double")
    assert [r[0] for r in df.select(round_half_even_int("p")).collect()] == [0, 2, 2, 0]


def _scoring_features(frames, labels):
    lab = frames["labels"](labels)
    etd = frames["etd"]([("A", "G1", "2024-01-01 09:00:00", "2024-01-01 10:30:00"),
                         ("A", "G2", "2024-01-01 09:00:00", "2024-01-01 10:40:00")])
    lamp = frames["lamp"]([("A", "2024-01-01 09:30:00", "2024-01-01 10:00:00", 7.0)])
    mfs = frames["mfs"]([("A", "G1", "E1", "T1", "M1", "F1", True)])
    return feature_pipeline(lab, etd, lamp, mfs, strict=False)


def test_routing_and_attach(frames):
    reqs = [("G2", "2024-01-01 11:00:00", "A", None), ("G1", "2024-01-01 10:00:00", "A", None),
            ("G3", "2024-01-01 10:00:00", "A", None), ("G1", "2024-01-01 10:00:00", "A", None)]
    feats = _scoring_features(frames, [r for r in reqs[:3]])
    full = expression_predictor(F.lit(100.0))
    na = expression_predictor(F.lit(200.0))
    scored = route_rows(feats, full, na)
    requests = frames["labels"](reqs)
    out = attach_predictions(requests, scored).collect()
    assert len(out) == 4
    by = {(r["gufi"], r["timestamp"]): (r["minutes_until_pushback"], r["model_variant"]) for r in out}
    assert by[("G1", ts("2024-01-01 10:00:00"))] == (100, "full")   # weather present
    assert by[("G2", ts("2024-01-01 11:00:00"))] == (200, "na")     # 09:30 issue serves up to 10:45
    assert by[("G3", ts("2024-01-01 10:00:00"))] == (None, "none")  # no estimate at all


def test_batch_routing(frames):
    feats = _scoring_features(frames, [("G1", "2024-01-01 10:00:00", "A", None),
                                       ("G2", "2024-01-01 10:00:00", "A", None)])
    feats = feats.withColumn("temperature", F.when(F.col("gufi") == "G2", None).otherwise(F.col("temperature")))
    out = route_batches(feats, expression_predictor(F.lit(1.0)), expression_predictor(F.lit(2.0))).collect()
    assert {r["model_variant"] for r in out} == {"na"}


def test_empty_requests(frames, spark):
    feats = _scoring_features(frames, [])
    scored = route_rows(feats, expression_predictor(F.lit(1.0)), expression_predictor(F.lit(2.0)))
    assert attach_predictions(frames["labels"]([]), scored).count() == 0


def test_hash_split_layout_independent(spark):
    df = spark.range(2000).select(F.concat(F.lit("G"), (F.col("id") % 300).cast("string")).alias("gufi"),
                                  F.lit("A").alias("airport"),
                                  F.timestamp_seconds(F.col("id") * 900).cast("timestamp_ntz").alias("timestamp"))
    a = {tuple(r) for r in hash_split(df).collect()}
    b = {tuple(r) for r in hash_split(df.repartition(7, "timestamp")).collect()}
    assert a == b
    g = hash_split(df, grouped=True).groupBy("gufi").agg(F.countDistinct("split").alias("n"))
    assert g.where("n > 1").count() == 0
    share = hash_split(df).where("split = 'train'").count() / 2000
    assert 0.7 < share < 0.9


def test_codes_keep_unseen_and_null(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "cat string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "cat string")
    out, _ = category_codes(test, ["cat"], fit_on=train)
    assert [r["cat_code"] for r in out.collect()] == [0, 3, 3]


def test_one_hot_drops_first_level_nulls_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "cat string")
    out = one_hot(df, ["cat"]).collect()
    assert out[0]["cat_b"] == 0 and out[1]["cat_b"] == 1 and out[2]["cat_c"] == 1
    assert out[3]["cat_b"] == 0 and out[3]["cat_c"] == 0
    assert "cat_a" not in one_hot(df, ["cat"]).columns


def test_feature_table_prunes_partitions(spark):
    from gatecast.session import fresh_dir
    from gatecast.sources.files import read_feature_table, write_feature_table
    df = spark.createDataFrame([("A1", 1), ("A2", 2), ("0123", 3)], "airport string, v int")
    path = write_feature_table(df, fresh_dir(spark, "prune-test"))
    one = read_feature_table(spark, path, ["A2"], schema=df.schema)
    assert [r["v"] for r in one.collect()] == [2]
    codes = {r["airport"] for r in read_feature_table(spark, path, schema=df.schema).collect()}
    assert codes == {"A1", "A2", "0123"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(airport" in plan and "A2" in plan


def test_batch_flag_with_a_hot_batch(spark):
    """One (airport, time) batch holding a third of the rows: the flag is a
    partial aggregate joined back, and every row of the batch gets it."""
    from gatecast.operators.nulls import with_batch_null_flag
    df = spark.range(3000).select(
        F.lit("A").alias("airport"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("timestamp"),
        F.when(F.col("id") == 9, F.lit(None)).otherwise(F.lit(1.0)).alias("w"))
    out = with_batch_null_flag(df, ["w"], ["airport", "timestamp"], "flag")
    assert out.count() == 3000
    hot = out.where("timestamp = 0").groupBy("flag").count().collect()
    assert [(r["flag"], r["count"]) for r in hot] == [(True, 1000)]
    assert out.where("timestamp <> 0 AND flag").count() == 0
