"""Session helpers: scale defaults never override the job's own conf."""

from gatecast.session import SCALE_DEFAULTS, apply_scale_defaults, materialize, shared_dir


def test_scale_defaults_fill_only_unset(spark):
    given = spark.sparkContext.getConf()
    before = {k: spark.conf.get(k, None) for k in SCALE_DEFAULTS}
    try:
        apply_scale_defaults(spark)
        for k, v in SCALE_DEFAULTS.items():
            if given.contains(k):
                assert spark.conf.get(k) == before[k]      # e.g. the tests' shuffle partitions
            else:
                assert spark.conf.get(k) == v
        assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    finally:
        for k, v in before.items():
            if v is not None:
                spark.conf.set(k, v)


def test_materialize_round_trip(spark):
    df = spark.range(100).selectExpr("id", "cast(id as string) as s")
    back = materialize(df, "test-mat")
    assert back.count() == 100 and back.columns == ["id", "s"]
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
