"""Jobs over the reference's folder layout, written from the fixture tables."""

from pyspark.sql import functions as F

from gatecast.operators.split import hash_split
from gatecast.plans.jobs import predict_job, read_inputs, train_job
from gatecast import cli
from gatecast.api import load_model
from gatecast.session import fresh_dir
from gatecast.sources import fixtures as fx
from gatecast.sources.files import write_csv

SF = "/root/testdata/sf0.001"
AIRPORTS = ["A1", "A2"]


def _write_reference_layout(spark, root):
    i = fx.load_inputs(spark, SF)
    for t in ("etd", "lamp", "mfs"):
        for a in AIRPORTS:
            rows = i[t].where(F.col("airport") == a).drop("airport")
            write_csv(rows, f"{root}/{a}/{a}_{t}.csv.bz2", bz2=True)
    labels = hash_split(i["labels"].where(F.col("airport").isin(AIRPORTS)))
    write_csv(labels.where("split = 'train'").drop("split"), f"{root}/train_labels.csv")
    write_csv(labels.where("split = 'test'").drop("split"), f"{root}/submission_format.csv")
    return i


def test_reference_layout_jobs(spark):
    root = fresh_dir(spark, "ref-layout")
    i = _write_reference_layout(spark, root)
    got = read_inputs(spark, root)
    for t in ("etd", "lamp", "mfs"):
        want = i[t].where(F.col("airport").isin(AIRPORTS))
        assert got[t].count() == want.count()
        assert got[t].exceptAll(want.select(*got[t].columns)).count() == 0
    model_root = fresh_dir(spark, "job-models")
    report = train_job(spark, root, f"{root}/train_labels.csv", model_root, rounds=3).collect()
    assert any(r["model_variant"] == "baseline" for r in report)
    models = load_model(model_root, AIRPORTS)
    assert models
    out = fresh_dir(spark, "job-predictions")
    scored = predict_job(spark, root, f"{root}/submission_format.csv", models, out)
    n_req = spark.read.option("header", True).csv(f"{root}/submission_format.csv").count()
    assert scored.count() == n_req
    assert spark.read.option("header", True).csv(out).count() == n_req
    cli_out = fresh_dir(spark, "cli-predictions")
    cli.main(["predict", "--local", "--data", root, "--submission", f"{root}/submission_format.csv",
              "--models", model_root, "--out", cli_out])
    written = spark.read.option("header", True).csv(cli_out)
    assert written.count() == n_req
    # every request with an estimate is scored, by the models of just these airports
    assert written.where("minutes_until_pushback is not null").count() == scored.where("minutes_until_pushback is not null").count() > 0
    assert written.where(r"timestamp rlike '^[0-9-]{10}[ T][0-9:]{8}$'").count() == n_req


def test_csv_columns_are_bound_by_name(spark):
    from gatecast.schemas import LABELS_SCHEMA
    from gatecast.sources.files import read_csv
    path = fresh_dir(spark, "reordered")
    rows = [("A1", "2024-01-01 10:00:00", "x", "G1", 7)]
    spark.createDataFrame(rows, "airport string, timestamp string, extra string, gufi string, minutes_until_pushback int").write.option("header", True).csv(path)
    got = read_csv(spark, path, LABELS_SCHEMA).first()
    assert (got["gufi"], got["airport"], got["minutes_until_pushback"], str(got["timestamp"])) == ("G1", "A1", 7, "2024-01-01 10:00:00")
    lacking = fresh_dir(spark, "lacking")
    spark.createDataFrame([("A1",)], "airport string").write.option("header", True).csv(lacking)
    import pytest
    with pytest.raises(ValueError, match="gufi"):
        read_csv(spark, lacking, LABELS_SCHEMA)
