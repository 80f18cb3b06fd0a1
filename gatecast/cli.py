"""Command line for the jobs over the per-airport CSV layout.

    python -m gatecast.cli tune    --data ROOT --labels LABELS --out TRIALS_DIR
    python -m gatecast.cli train   --data ROOT --labels LABELS --models MODEL_DIR --out REPORT_DIR
    python -m gatecast.cli predict --data ROOT --submission SUBMISSION --models MODEL_DIR --out OUT_DIR

``--rounds N`` shortens the boosting of tune and train from the reference's 1000.

Under spark-submit the session comes from the submit-time conf (set
``spark.checkpoint.dir`` to shared storage); run locally it uses local[*].
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from gatecast.api import load_model
from gatecast.plans.jobs import predict_job, train_job, tune_job
from gatecast.session import apply_scale_defaults, build_session
from gatecast.sources.files import write_csv


def _session(local: bool) -> SparkSession:
    if local:
        return build_session("local[*]")
    return apply_scale_defaults(SparkSession.builder.appName("gatecast").getOrCreate())


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="gatecast")
    p.add_argument("job", choices=["tune", "train", "predict"])
    p.add_argument("--data", required=True, help="folder with {AIRPORT}/{AIRPORT}_{table}.csv.bz2")
    p.add_argument("--labels", help="training labels CSV (tune, train)")
    p.add_argument("--submission", help="requests CSV to score (predict)")
    p.add_argument("--models", help="model folder (train writes, predict reads)")
    p.add_argument("--out", required=True, help="output folder")
    p.add_argument("--rounds", type=int, help="boosting rounds (tune, train; default: the reference's)")
    p.add_argument("--local", action="store_true", help="run on local[*]")
    a = p.parse_args(argv)
    spark = _session(a.local)
    if a.job == "tune":
        tune_job(spark, a.data, a.labels, a.out, a.rounds)
    elif a.job == "train":
        write_csv(train_job(spark, a.data, a.labels, a.models, a.rounds), a.out)
    else:
        predict_job(spark, a.data, a.submission, load_model(a.models), a.out)


if __name__ == "__main__":
    main()
