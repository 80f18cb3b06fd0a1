"""End-to-end jobs over the reference's on-disk layout.

    {root}/{AIRPORT}/{AIRPORT}_etd.csv.bz2
    {root}/{AIRPORT}/{AIRPORT}_lamp.csv.bz2
    {root}/{AIRPORT}/{AIRPORT}_mfs.csv.bz2
    {labels}: CSV of gufi, timestamp, airport, minutes_until_pushback (any number of files)

Every airport is read in one scan per table (airport taken from the path),
so one job replaces the per-airport script runs:

* ``tune_job``    - random search per airport and variant, trials to CSV
* ``train_job``   - fit and save both variants per airport, baseline and model MAE
* ``predict_job`` - score a submission file, write it back as CSV
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.operators import metrics, split
from gatecast.plans.features import feature_pipeline
from gatecast.plans.models import FULL, NO_WEATHER, REFERENCE, VARIANTS, fit_per_airport, predictor, reference_fit, save_models
from gatecast.plans.predict import score_requests
from gatecast.plans.tuning import EVALS_FULL, EVALS_NO_WEATHER, tune_per_airport
from gatecast.schemas import ETD_SCHEMA, LABEL, LABELS_SCHEMA, LAMP_SCHEMA, MFS_SCHEMA
from gatecast.session import fresh_dir
from gatecast.sources.files import TS_SECONDS, read_airport_tables, read_csv, read_feature_table, write_csv, write_feature_table

TABLES = {"etd": ETD_SCHEMA, "lamp": LAMP_SCHEMA, "mfs": MFS_SCHEMA}


def _airport_pattern(table: str) -> str:
    # the folder that holds ``{AIRPORT}_{table}.csv.bz2`` (a file, or a folder of parts)
    return rf"/([^/]+)/[^/]*_{table}\.csv\.bz2(?:/|$)"


def read_inputs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """etd, lamp and mfs of every airport under ``root``."""
    return {t: read_airport_tables(spark, f"{root.rstrip('/')}/*/*_{t}.csv.bz2", s, _airport_pattern(t))
            for t, s in TABLES.items()}


def _features(spark: SparkSession, root: str, labels_path: str) -> DataFrame:
    i = read_inputs(spark, root)
    labels = read_csv(spark, labels_path, LABELS_SCHEMA)
    f = split.hash_split(feature_pipeline(labels, i["etd"], i["lamp"], i["mfs"], keep_estimate=True))
    path = write_feature_table(f, fresh_dir(spark, "job-features"))
    return read_feature_table(spark, path, schema=f.schema)


MAX_AIRPORTS = 1000  # models are fitted one by one from the driver


def distinct_airports(df: DataFrame) -> list[str]:
    found = sorted(r[0] for r in df.select("airport").distinct().limit(MAX_AIRPORTS + 1).collect())
    if len(found) > MAX_AIRPORTS:
        raise ValueError(f"more than {MAX_AIRPORTS} airports")
    return found


def tune_job(spark: SparkSession, root: str, labels_path: str, out_path: str, rounds: int | None = None) -> DataFrame:
    """Search both variants per airport; trials written as CSV."""
    f = _features(spark, root, labels_path)
    airports = distinct_airports(f)
    parts = [tune_per_airport(f, airports, v, n, REFERENCE[v.name] if rounds is None else replace(REFERENCE[v.name], max_iter=rounds))
             for v, n in ((FULL, EVALS_FULL), (NO_WEATHER, EVALS_NO_WEATHER))]
    trials = parts[0].unionByName(parts[1])
    write_csv(trials, out_path)
    return trials


def train_job(spark: SparkSession, root: str, labels_path: str, model_root: str,
              rounds: int | None = None) -> DataFrame:
    """Fit both variants per airport on the train half with the reference's
    settings (``rounds`` shortens the boosting), save them, and report baseline
    and model MAE per airport, variant and half."""
    f = _features(spark, root, labels_path)
    models = fit_per_airport(f.where(F.col("split") == "train"), distinct_airports(f), [FULL, NO_WEATHER], reference_fit(rounds))
    save_models(models, model_root)
    parts = [metrics.baseline_mae(f, by=["airport", "split"])
             .withColumn("model_variant", F.lit("baseline"))]
    for (a, v), m in sorted(models.items()):
        rows = f.where(F.col("airport") == a).na.drop("any", subset=VARIANTS[v].required)
        scored = predictor(m, VARIANTS[v])(rows)
        parts.append(metrics.prediction_mae(scored, by=["airport", "split"]).withColumn("model_variant", F.lit(v)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def predict_job(spark: SparkSession, root: str, submission_path: str,
                models: dict, out_path: str) -> DataFrame:
    """Score every row of a submission file and write it back as CSV."""
    requests = read_csv(spark, submission_path, LABELS_SCHEMA)
    scored = score_requests(requests, read_inputs(spark, root), models)
    write_csv(scored.select("gufi", "timestamp", "airport", LABEL), out_path, timestamps=TS_SECONDS)
    return scored
