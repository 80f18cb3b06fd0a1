"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's base tables through the fixture views in
``gatecast.sources.fixtures`` and runs over them whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.functions import timeops as t
from gatecast.operators import asof, metadata, metrics, split, weather
from gatecast.plans.features import feature_pipeline
from gatecast.schemas import LABEL, WEATHER
from gatecast.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _features(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    i = fx.load_inputs(spark, sf_dir)
    return feature_pipeline(i["labels"], i["etd"], i["lamp"], i["mfs"], **kw)


KEYS = ["airport", "gufi", "timestamp"]


def _features_once(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, **kw) -> DataFrame:
    """Features (of them ``columns``) written once to the shared folder, for queries that read them twice."""
    from gatecast.session import materialize
    f = _features(spark, sf_dir, **kw)
    return materialize(f.select(*columns) if columns else f, "features")


# ---- flagship ----------------------------------------------------------------

@query
def clean_features(spark, sf_dir):
    """The end-to-end clean feature table (the reference's ``clean_data``)."""
    return _features(spark, sf_dir)


# ---- weather lookup -------------------------------------------------------------

@query
def weather_lookup(spark, sf_dir):
    return weather.weather_lookup(fx.labels(spark, sf_dir), fx.lamp(spark, sf_dir))


@query
def weather_matched(spark, sf_dir):
    return weather.weather_matched(fx.labels(spark, sf_dir), fx.lamp(spark, sf_dir))


@query
def weather_unmatched(spark, sf_dir):
    return weather.weather_unmatched(fx.labels(spark, sf_dir), fx.lamp(spark, sf_dir))


@query
def join_indicator(spark, sf_dir):
    labels = fx.labels(spark, sf_dir)
    matched = weather.weather_matched(labels, fx.lamp(spark, sf_dir))
    return weather.join_indicator(labels, matched, ["airport", "gufi", "timestamp", LABEL])


@query
def dedupe_keep_latest(spark, sf_dir):
    matched = weather.weather_matched(fx.labels(spark, sf_dir), fx.lamp(spark, sf_dir))
    return asof.keep_latest(matched, ["airport", "gufi", "timestamp", LABEL], ["issue_timestamp"])


# ---- as-of estimate -------------------------------------------------------------

@query
def latest_per_slot(spark, sf_dir):
    return asof.latest_per_slot(fx.etd(spark, sf_dir))


@query
def asof_etd(spark, sf_dir):
    return asof.asof_etd(fx.labels(spark, sf_dir), fx.etd(spark, sf_dir), strict=True)


@query
def asof_bounded_30h(spark, sf_dir):
    return asof.asof_etd(fx.labels(spark, sf_dir), fx.etd(spark, sf_dir), strict=False,
                         max_age_hours=30)


@query
def left_join_metadata(spark, sf_dir):
    return metadata.left_join_metadata(fx.labels(spark, sf_dir), fx.mfs(spark, sf_dir))


# ---- metrics --------------------------------------------------------------------

@query
def mae_global(spark, sf_dir):
    return metrics.baseline_mae(_features(spark, sf_dir, keep_estimate=True))


@query
def mae_by_airport(spark, sf_dir):
    return metrics.baseline_mae(_features(spark, sf_dir, keep_estimate=True), by=["airport"])


@query
def mae_by_split(spark, sf_dir):
    f = split.hash_split(_features(spark, sf_dir, keep_estimate=True))
    return metrics.baseline_mae(f, by=["split"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


# ---- filters, projections --------------------------------------------------------

FILTER_AIRPORT = "A3"


@query
def filter_departures(spark, sf_dir):
    return metadata.departures(fx.mfs(spark, sf_dir))


@query
def filter_forecast_lead(spark, sf_dir):
    return weather.forecasts_with_lead(fx.lamp(spark, sf_dir))


@query
def filter_airport(spark, sf_dir):
    return _features(spark, sf_dir).where(F.col("airport") == FILTER_AIRPORT)


@query
def project_drop(spark, sf_dir):
    """Drop one column, keep named columns, drop a list."""
    lamp = weather.drop_unused_weather(fx.lamp(spark, sf_dir))
    kept = lamp.select("airport", "timestamp", "forecast_timestamp", *WEATHER)
    return kept.drop(*["timestamp"])


@query
def project_positional(spark, sf_dir):
    """The first 13 columns of a wider frame, by position: the metadata columns behind them go."""
    df = weather.weather_lookup(fx.labels(spark, sf_dir), fx.lamp(spark, sf_dir))
    wide = metadata.left_join_metadata(df, fx.mfs(spark, sf_dir))
    return wide.select(*wide.columns[:13])


@query
def align_schema(spark, sf_dir):
    """Drop the columns of one frame that another frame lacks."""
    from gatecast.schemas import NO_WEATHER_CATEGORICAL, NO_WEATHER_NUMERIC
    target = {"airport", "gufi", "timestamp", LABEL, *NO_WEATHER_CATEGORICAL, *NO_WEATHER_NUMERIC}
    f = _features(spark, sf_dir)
    extra = sorted(set(f.columns) - target)
    return f.drop(*extra)


# ---- scalar time functions -------------------------------------------------------

@query
def ceil_15min(spark, sf_dir):
    e = fx.etd(spark, sf_dir)
    return e.select("airport", "gufi", "timestamp", t.ceil_slot("timestamp").alias("rounded_timestamp"))


@query
def round_15min(spark, sf_dir):
    e = fx.etd(spark, sf_dir)
    return e.select("airport", "gufi", "timestamp",
                    t.round_slot_half_even("timestamp").alias("nearest_timestamp"))


@query
def baseline_minutes(spark, sf_dir):
    a = asof.asof_etd(fx.labels(spark, sf_dir), fx.etd(spark, sf_dir), strict=True)
    return a.select("airport", "gufi", "timestamp",
                    t.baseline_minutes("timestamp", asof.DEP).alias("benchmark_pushback"))


@query
def calendar_parts(spark, sf_dir):
    e = fx.etd(spark, sf_dir)
    d = F.col(asof.DEP)
    return e.select("airport", "gufi", "timestamp", t.day_name(d).alias("day_of_week"),
                    t.month_name(d).alias("month"), F.hour(d).alias("hour"), F.year(d).alias("year"))


@query
def coerce_timestamp(spark, sf_dir):
    """Timestamps arriving as text are parsed back to TIMESTAMP_NTZ."""
    as_text = fx.labels(spark, sf_dir).select(
        "gufi", F.col("timestamp").cast("string").alias("timestamp"), "airport")
    return as_text.withColumn("timestamp", t.coerce_timestamp("timestamp"))


@query
def round_half_even(spark, sf_dir):
    f = _features(spark, sf_dir)
    from gatecast.functions.scalar import round_half_even_int
    return f.select("airport", "gufi", "timestamp",
                    round_half_even_int("benchmark_pushback").alias("rounded_minutes"))


# ---- nulls ------------------------------------------------------------------------

@query
def fill_other(spark, sf_dir):
    from gatecast.functions.scalar import fill_other as fill
    return fill(metadata.left_join_metadata(fx.labels(spark, sf_dir), fx.mfs(spark, sf_dir)))


@query
def drop_null_rows(spark, sf_dir):
    from gatecast.operators.nulls import drop_null_rows as drop
    return drop(_features(spark, sf_dir))


@query
def null_profile(spark, sf_dir):
    from gatecast.operators.nulls import null_profile as profile
    return profile(_features(spark, sf_dir))


@query
def drop_null_columns(spark, sf_dir):
    from gatecast.operators.nulls import drop_null_columns as drop
    return drop(_features_once(spark, sf_dir))


@query
def row_has_null(spark, sf_dir):
    from gatecast.operators.nulls import with_row_null_flag
    f = with_row_null_flag(_features(spark, sf_dir), WEATHER, "weather_has_null")
    return f.select("airport", "gufi", "timestamp", "weather_has_null")


@query
def batch_has_null(spark, sf_dir):
    """Whether any row of the batch has a null in any feature column."""
    from gatecast.operators.nulls import with_batch_null_flag
    from gatecast.plans.scoring import BATCH_FLAG_COLUMNS
    f = _features_once(spark, sf_dir, [*KEYS, *BATCH_FLAG_COLUMNS], strict=False)
    return with_batch_null_flag(f, BATCH_FLAG_COLUMNS, ["airport", "timestamp"], "batch_has_null").select(*KEYS, "batch_has_null")


# ---- sets, order ------------------------------------------------------------------

@query
def union_train_test(spark, sf_dir):
    """U2 + D11 + F6: flag the halves, union them, keep the test flag."""
    f = split.hash_split(_features(spark, sf_dir))
    train = f.where(F.col("split") == "train").drop("split").withColumn("test", F.lit(0))
    test = f.where(F.col("split") == "test").drop("split").withColumn("test", F.lit(1))
    both = train.unionByName(test)
    return both.where(F.col("test") == 1).select("airport", "gufi", "timestamp", LABEL, "test")


@query
def sorted_output(spark, sf_dir):
    return _features(spark, sf_dir).orderBy("gufi", "timestamp")


@query
def head_preview(spark, sf_dir):
    """O3: the first row (by gufi, timestamp) of each airport's features."""
    f = _features(spark, sf_dir)
    first = F.min(F.struct("gufi", "timestamp")).alias("first")
    return f.groupBy("airport").agg(first).select(
        "airport", F.col("first.gufi").alias("gufi"), F.col("first.timestamp").alias("timestamp"))


# ---- encode, split -----------------------------------------------------------------

@query
def category_codes(spark, sf_dir):
    from gatecast.operators.encode import category_codes as codes
    from gatecast.schemas import CATEGORICAL
    out, _ = codes(_features_once(spark, sf_dir, [*KEYS, *CATEGORICAL]), CATEGORICAL)
    return out.select("airport", "gufi", "timestamp", *[c + "_code" for c in CATEGORICAL])


@query
def one_hot(spark, sf_dir):
    """D17 over all categories, in long form: a row per feature row and indicator that is 1."""
    from gatecast.operators.encode import one_hot as encode
    from gatecast.schemas import CATEGORICAL
    f = _features_once(spark, sf_dir, [*KEYS, *CATEGORICAL])
    wide = encode(f, CATEGORICAL)
    made = wide.columns[len(f.columns):]
    return wide.unpivot(KEYS, made, "indicator", "value").where("value = 1").select(*KEYS, "indicator")


@query
def hash_split(spark, sf_dir):
    return split.hash_split(_features(spark, sf_dir)).select("airport", "gufi", "timestamp", "split")


@query
def hash_split_grouped(spark, sf_dir):
    return split.hash_split(_features(spark, sf_dir), grouped=True).select(
        "airport", "gufi", "timestamp", "split")


@query
def clip_to_train_range(spark, sf_dir):
    """A5 + D14: test-half baseline predictions clamped to the train label range."""
    from gatecast.functions.scalar import clip
    f = split.hash_split(_features_once(spark, sf_dir, [*KEYS, LABEL, "benchmark_pushback"]))
    lo, hi = metrics.label_range(f.where(F.col("split") == "train"))
    test = f.where(F.col("split") == "test")
    return test.select("airport", "gufi", "timestamp",
                       clip("benchmark_pushback", F.lit(lo), F.lit(hi)).alias("clipped_prediction"))


@query
def features_and_label(spark, sf_dir):
    """P5 + M3: feature columns, label, key and validation flag side by side."""
    f = split.hash_split(_features(spark, sf_dir))
    return f.withColumn("is_validation", F.col("split") == "test").drop("split")


# ---- routing with deterministic stand-in predictors -----------------------------

def standin_predictors():
    from gatecast.plans.scoring import expression_predictor
    full = expression_predictor(F.col("benchmark_pushback") + F.col("visibility") - F.col("cloud_ceiling"))
    na = expression_predictor(F.col("benchmark_pushback") - F.lit(1.0))
    return full, na


@query
def route_row_variant(spark, sf_dir):
    from gatecast.plans.scoring import route_rows
    full, na = standin_predictors()
    out = route_rows(_features(spark, sf_dir, strict=False), full, na)
    return out.select("airport", "gufi", "timestamp", "weather_has_null", "model_variant", "prediction")


@query
def route_batch_variant(spark, sf_dir):
    from gatecast.plans.scoring import route_batches
    full, na = standin_predictors()
    out = route_batches(_features_once(spark, sf_dir, strict=False), full, na)
    return out.select("airport", "gufi", "timestamp", "batch_has_null", "model_variant", "prediction")


@query
def attach_predictions(spark, sf_dir):
    from gatecast.plans.scoring import attach_predictions as attach, route_rows
    i = fx.load_inputs(spark, sf_dir)
    requests = i["labels"]
    keys = requests.select("gufi", "timestamp", "airport").distinct()
    feats = feature_pipeline(keys, i["etd"], i["lamp"], i["mfs"], strict=False)
    full, na = standin_predictors()
    return attach(requests, route_rows(feats, full, na))


# ---- sources and sinks (round trips through the shared folder) --------------------

@query
def scan_csv_bz2(spark, sf_dir):
    """S1 + S2: estimate updates written as bzip2 CSV and read back with a schema."""
    from gatecast.schemas import ETD_SCHEMA
    from gatecast.session import fresh_dir
    from gatecast.sources.files import read_csv, write_csv
    path = write_csv(fx.etd(spark, sf_dir), fresh_dir(spark, "etd-csv-bz2"), bz2=True)
    return read_csv(spark, f"{path}/*.csv.bz2", ETD_SCHEMA)


@query
def scan_multi_airport(spark, sf_dir):
    """S3 + U3: forecasts written one folder per airport, read in one scan."""
    from gatecast.schemas import LAMP_SCHEMA
    from gatecast.session import fresh_dir
    from gatecast.sources.files import AIRPORT_FROM_PARTITION_PATH, read_airport_tables, write_csv
    path = write_csv(fx.lamp(spark, sf_dir), fresh_dir(spark, "lamp-by-airport"), bz2=True,
                     partition_by=["airport"])
    return read_airport_tables(spark, f"{path}/airport=*/*.csv.bz2", LAMP_SCHEMA,
                               AIRPORT_FROM_PARTITION_PATH)


@query
def sink_csv_roundtrip(spark, sf_dir):
    """Routed predictions written as CSV (no index, times to the second) and read back."""
    from gatecast.session import fresh_dir
    from gatecast.sources.files import TS_SECONDS, read_csv, write_csv
    out = attach_predictions(spark, sf_dir)
    path = write_csv(out, fresh_dir(spark, "predictions-csv"), timestamps=TS_SECONDS)
    return read_csv(spark, path, out.schema)


@query
def feature_table_cache(spark, sf_dir):
    """Feature table written partitioned by airport and read back whole
    (per-airport reads prune partitions; see the model fits)."""
    from gatecast.session import fresh_dir
    from gatecast.sources.files import read_feature_table, write_feature_table
    f = _features(spark, sf_dir)
    path = write_feature_table(f, fresh_dir(spark, "features"))
    return read_feature_table(spark, path, schema=f.schema)


# ---- repeated input rows -----------------------------------------------------------

def repeated_inputs(spark, sf_dir) -> dict[str, DataFrame]:
    """The fixture views with every third label twice, and a second, different metadata row for every second flight."""
    i = fx.load_inputs(spark, sf_dir)
    number = F.substring("gufi", 2, 20).cast("long")
    again = i["labels"].where(number % 3 == 0)
    other = i["mfs"].where(number % 2 == 0).withColumn("aircraft_type", F.lit("SECOND")).withColumn("flight_type", F.lit(None).cast("string"))
    return i | {"labels": i["labels"].unionByName(again), "mfs": i["mfs"].unionByName(other)}


@query
def features_of_repeated_rows(spark, sf_dir):
    """M18 + A2: repeated labels count once and repeated metadata never multiplies rows."""
    i = repeated_inputs(spark, sf_dir)
    return feature_pipeline(i["labels"], i["etd"], i["lamp"], i["mfs"])


@query
def requests_of_repeated_rows(spark, sf_dir):
    """Every request row comes back once for each time it was made, whatever the metadata repeats."""
    from gatecast.plans.scoring import attach_predictions as attach, route_rows
    i = repeated_inputs(spark, sf_dir)
    keys = i["labels"].select(*KEYS).distinct()
    full, na = standin_predictors()
    scored = route_rows(feature_pipeline(keys, i["etd"], i["lamp"], i["mfs"], strict=False), full, na)
    return attach(i["labels"], scored).groupBy(*KEYS).agg(F.count("*").alias("rows"))


# ---- models: keys, variants and checks that the predictions must pass ------------------
# Boosting rounds of registered fits; jobs and CLI, and the search, use the reference's 1000.

QUERY_ROUNDS = 20


def _training_features(spark, sf_dir) -> DataFrame:
    """Strict features with the hash split, written once partitioned by airport."""
    from gatecast.session import fresh_dir
    from gatecast.sources.files import read_feature_table, write_feature_table
    f = split.hash_split(_features(spark, sf_dir))
    path = write_feature_table(f, fresh_dir(spark, "train-features"))
    return read_feature_table(spark, path, schema=f.schema)


def _predict_all(models, feats, variants) -> DataFrame:
    """Predictions of every variant for the rows it can take; null where an airport has no model."""
    from gatecast.plans.models import predictor, weather_complete
    parts = []
    for v in variants:
        rows = weather_complete(feats) if v.name == "full" else feats
        have = sorted(a for a, name in models if name == v.name)
        for a in have:
            parts.append(predictor(models[a, v.name], v)(rows.where(F.col("airport") == a)))
        parts.append(rows.where(~F.col("airport").isin(have)).withColumn("prediction", F.lit(None).cast("double")))
        k = len(have) + 1
        parts[-k:] = [p.select(*KEYS, "split", LABEL, F.lit(v.name).alias("model_variant"), "prediction") for p in parts[-k:]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _finite(c: str = "prediction"):
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(1e12)), F.lit(False))


def _checked(preds: DataFrame) -> DataFrame:
    return preds.select(*KEYS, "split", "model_variant", _finite().alias("predicted"))


def _fitted(f, variants, fit, train_only: bool):
    from gatecast.plans.jobs import distinct_airports
    from gatecast.plans.models import fit_per_airport
    rows = f.where(F.col("split") == "train") if train_only else f
    return fit_per_airport(rows, distinct_airports(f), variants, fit)


@query
def fit_gbt_validated(spark, sf_dir):
    """M4: boosted trees per airport, stopping early on the validation half."""
    from gatecast.plans.models import FULL, GbtParams, gbt_fit
    f = _training_features(spark, sf_dir).withColumn("is_validation", F.col("split") == "test")
    models = _fitted(f, [FULL], gbt_fit(GbtParams(max_iter=QUERY_ROUNDS), "is_validation"), False)
    return _checked(_predict_all(models, f, [FULL]))


@query
def fit_gbt_final(spark, sf_dir):
    """M5: boosted trees per airport on all rows, weather variant."""
    from gatecast.plans.models import FULL, GbtParams, gbt_fit
    f = _training_features(spark, sf_dir)
    return _checked(_predict_all(_fitted(f, [FULL], gbt_fit(GbtParams(max_iter=QUERY_ROUNDS)), False), f, [FULL]))


@query
def fit_gbt_no_weather(spark, sf_dir):
    """M6: boosted trees per airport without any weather input."""
    from gatecast.plans.models import NO_WEATHER, GbtParams, gbt_fit
    f = _training_features(spark, sf_dir)
    models = _fitted(f, [NO_WEATHER], gbt_fit(GbtParams(max_iter=QUERY_ROUNDS)), False)
    return _checked(_predict_all(models, f, [NO_WEATHER]))


@query
def fit_lasso(spark, sf_dir):
    """M12 + D14: L1 linear model per airport, predictions clamped to the airport's training label range."""
    from gatecast.functions.scalar import clip
    from gatecast.plans.models import FULL, lasso_fit
    f = _training_features(spark, sf_dir)
    preds = _predict_all(_fitted(f, [FULL], lasso_fit(), True), f, [FULL])
    train = f.where(F.col("split") == "train")
    ranges = train.groupBy("airport").agg(F.min(LABEL).alias("lo"), F.max(LABEL).alias("hi"))
    out = preds.join(ranges, ["airport"], "left").withColumn(
        "prediction", F.when(F.col("prediction").isNotNull(), clip("prediction", F.col("lo"), F.col("hi"))))
    inside = F.coalesce(F.col("prediction").between(F.col("lo"), F.col("hi")), F.lit(False))
    return out.select(*KEYS, "split", "model_variant", _finite().alias("predicted"), inside.alias("in_train_range"))


@query
def fit_random_forest(spark, sf_dir):
    """Random forest per airport (500 trees, depth 15, seed 1994)."""
    from gatecast.plans.models import FULL, forest_fit
    f = _training_features(spark, sf_dir)
    return _checked(_predict_all(_fitted(f, [FULL], forest_fit(), True), f, [FULL]))


@query
def tune_random_search(spark, sf_dir):
    """Seeded random search per airport, both variants with the reference's numbers of trials, rounds and patience."""
    from gatecast.plans.jobs import distinct_airports
    from gatecast.plans.models import FULL, NO_WEATHER
    from gatecast.plans.tuning import EVALS_FULL, EVALS_NO_WEATHER, SEARCH, tune_per_airport
    f = _training_features(spark, sf_dir)
    parts = [tune_per_airport(f, distinct_airports(f), v, n, SEARCH)
             for v, n in ((FULL, EVALS_FULL), (NO_WEATHER, EVALS_NO_WEATHER))]
    trials = parts[0].unionByName(parts[1])
    per = trials.groupBy("airport", "variant").agg(
        F.min("validation_mae").alias("least"), F.countDistinct("validation_mae").alias("different"), F.count_if("is_best").alias("best"))
    return trials.join(per, ["airport", "variant"]).select(
        "airport", "variant", "trial", _finite("validation_mae").alias("evaluated"), (F.col("different") > 1).alias("trials_differ"),
        ((F.col("best") == 1) & (~F.col("is_best") | (F.col("validation_mae") == F.col("least")))).alias("best_is_least"),
        (F.col("train_mae").isNotNull() == F.col("is_best")).alias("best_is_refitted"))


def train_both(spark, sf_dir):
    from gatecast.plans.models import FULL, NO_WEATHER, GbtParams, gbt_fit
    f = _training_features(spark, sf_dir)
    return f, _fitted(f, [FULL, NO_WEATHER], gbt_fit(GbtParams(max_iter=QUERY_ROUNDS)), True)


@query
def model_roundtrip(spark, sf_dir):
    """S7 + S8: save every (airport, variant) model, load them by the manifest, and score with both copies."""
    from gatecast.plans.models import FULL, NO_WEATHER, load_models, save_models
    from gatecast.session import fresh_dir
    f, models = train_both(spark, sf_dir)
    root = fresh_dir(spark, "models")
    save_models(models, root)
    loaded = load_models(root)
    both = [FULL, NO_WEATHER]
    a = _predict_all(models, f, both)
    b = _predict_all(loaded, f, both).select(*KEYS, "model_variant", F.col("prediction").alias("loaded"))
    return a.join(b, [*KEYS, "model_variant"]).select(
        *KEYS, "model_variant", _finite().alias("predicted"), F.col("prediction").eqNullSafe(F.col("loaded")).alias("same"))


@query
def predict_requests(spark, sf_dir):
    """Score the requests of every airport in one job."""
    from gatecast.plans.predict import score_requests
    i = fx.load_inputs(spark, sf_dir)
    _, models = train_both(spark, sf_dir)
    return score_requests(i["labels"], i, models).select(*KEYS, "model_variant", F.col(LABEL).isNotNull().alias("predicted"))


@query
def stream_predict(spark, sf_dir):
    """T1 as a stream: the same requests through Structured Streaming, held against the batch scorer."""
    from gatecast.plans.predict import score_requests
    from gatecast.streaming.predict_stream import stream_score
    i = fx.load_inputs(spark, sf_dir)
    _, models = train_both(spark, sf_dir)
    batch = score_requests(i["labels"], i, models).select(*KEYS, F.col(LABEL).alias("expected"))
    streamed = stream_score(spark, i["labels"], i, models)
    return streamed.join(batch, KEYS).select(*KEYS, "model_variant", F.col(LABEL).isNotNull().alias("predicted"),
                                             F.col(LABEL).eqNullSafe(F.col("expected")).alias("same_as_batch"))


@query
def stream_asof(spark, sf_dir):
    """T1 + T2: estimates and requests both as streams, with keyed state, timers and restarts; one row per distinct request."""
    from gatecast.streaming.asof_stream import estimate_stream, replay
    return replay(spark, fx.etd(spark, sf_dir), fx.labels(spark, sf_dir), "updates", estimate_stream)


@query
def stream_weather(spark, sf_dir):
    """T1 + J7: forecasts and requests both as streams; one row per distinct (airport, time) asked for."""
    from gatecast.streaming.asof_stream import replay, weather_stream
    return replay(spark, fx.lamp(spark, sf_dir), fx.labels(spark, sf_dir), "forecasts", weather_stream)


# ---- one fit for all airports ------------------------------------------------------------

PATIENT = dict(rounds=6, patience=2, depth=2)


@query
def fit_boosted_patience(spark, sf_dir):
    """M4: all airports in one fit, stopped with patience; the kept prefix against errors computed anew from the saved trees."""
    from gatecast.plans.boosting import BoostParams, fit_boosted, prefix_errors
    from gatecast.plans.models import FULL
    f = _training_features(spark, sf_dir).withColumn("held", F.col("split") == "test")
    model = fit_boosted(f, FULL, BoostParams(**PATIENT), "held")
    errors = prefix_errors(f.where("held"), model)
    best = errors.groupBy("airport").agg(F.min(F.struct("error", "trees")).alias("b"), F.max("trees").alias("made"))
    m = model.models.join(best, "airport", "left")
    judged = F.col("b").isNotNull()
    stopped = F.when(judged, F.least(F.col("kept") + PATIENT["patience"], F.lit(PATIENT["rounds"]))).otherwise(F.lit(PATIENT["rounds"]))
    return m.select("airport", judged.alias("judged"), F.when(judged, F.col("kept") == F.col("b.trees")).otherwise(
        F.col("kept") == F.col("rounds")).alias("kept_is_best"), (F.col("rounds") == stopped).alias("stopped_in_time"),
        F.col("error").eqNullSafe(F.col("b.error")).alias("error_is_of_its_trees"))


@query
def score_one_pass(spark, sf_dir):
    """Both variants fitted over all airports at once, every request scored by a join with the models' table."""
    from gatecast.plans.boosting import BoostParams, fit_boosted, score_boosted
    from gatecast.plans.models import FULL, NO_WEATHER
    from gatecast.plans.scoring import attach_predictions as attach
    f = _training_features(spark, sf_dir).where("split = 'train'")
    p = BoostParams(rounds=3, depth=2)
    i = fx.load_inputs(spark, sf_dir)
    keys = i["labels"].select(*KEYS).distinct()
    feats = feature_pipeline(keys, i["etd"], i["lamp"], i["mfs"], strict=False, bounded=True)
    scored = score_boosted(feats, fit_boosted(f, FULL, p), fit_boosted(f, NO_WEATHER, p))
    return attach(i["labels"], scored).select(*KEYS, "model_variant", F.col(LABEL).isNotNull().alias("predicted"))


ADAPTIVE_EVALS = 8


@query
def tune_adaptive(spark, sf_dir):
    """An adaptive search for every airport, the n-th trials of all airports in one fit; each trial against the
    draw that the recorded ones before it call for."""
    from gatecast.plans.boosting import BoostParams
    from gatecast.plans.models import FULL
    from gatecast.plans.tpe import Choice, suggest, values
    from gatecast.plans.tuning import boosted_mae, boosted_space, tune_adaptive as tune
    f = _training_features(spark, sf_dir)
    train, test = f.where("split = 'train'"), f.where("split = 'test'")
    space = boosted_space("full") | {"depth": Choice((1, 2))}
    trials, model = tune(train, FULL, ADAPTIVE_EVALS, BoostParams(rounds=2), space)
    per = trials.groupBy("airport").agg(F.min("validation_mae").alias("least"), F.count_if("is_best").alias("best"),
                                        F.countDistinct("learning_rate").alias("different"))
    first = values(space, suggest(space, [], 23))["learning_rate"]
    scored = boosted_mae(train, model).withColumnRenamed("mae", "train_mae").join(boosted_mae(test, model), "airport", "left")
    return trials.join(per, "airport").join(scored, "airport", "left").select(
        "airport", "variant", "trial", (F.col("different") == ADAPTIVE_EVALS).alias("all_trials_differ"),
        ((F.col("trial") > 0) | (F.col("learning_rate") == first)).alias("starts_from_the_seed"),
        ((F.col("best") == 1) & (~F.col("is_best") | F.col("validation_mae").eqNullSafe(F.col("least")))).alias("best_is_least"),
        _finite("train_mae").alias("refitted"))


# ---- exact split, quarantine, incremental table ---------------------------------------------

@query
def exact_grouped_split(spark, sf_dir):
    """M2: whole flights, 80 % of the rows up to less than one flight."""
    return split.exact_grouped_split(fx.labels(spark, sf_dir)).select("airport", "gufi", "timestamp", "split")


@query
def scan_csv_quarantine(spark, sf_dir):
    """S1 + S5: estimate updates written with bad cells in some rows; the good rows typed, the others with their reasons."""
    from gatecast.schemas import ETD_SCHEMA
    from gatecast.session import fresh_dir
    from gatecast.sources.files import write_csv
    from gatecast.sources.quarantine import read_csv_checked
    e = fx.etd(spark, sf_dir)
    number = F.substring("gufi", 2, 20).cast("long")
    text = e.select(*[F.col(c).cast("string").alias(c) for c in e.columns])
    bad = text.withColumns({
        "timestamp": F.when(number % 7 == 0, F.lit("soon")).when(number % 11 == 0, F.lit("2024-01-01")).otherwise(F.col("timestamp")),
        "departure_runway_estimated_time": F.when(number % 5 == 0, F.lit("25:99")).otherwise(F.col("departure_runway_estimated_time"))})
    good, rejects = read_csv_checked(spark, write_csv(bad, fresh_dir(spark, "etd-bad"), bz2=True), ETD_SCHEMA)
    none = F.lit(None).cast("string")
    return good.withColumns({"gufi": F.col("gufi"), "reasons": none}).unionByName(
        rejects.select(none.alias("airport"), F.split("record", ",")[1].alias("gufi"), none.cast("timestamp_ntz").alias("timestamp"),
                       none.cast("timestamp_ntz").alias("departure_runway_estimated_time"), F.array_join("reasons", "; ").alias("reasons")))


@query
def feature_table_incremental(spark, sf_dir):
    """The feature table by day; one day spoilt, then written anew alone, and the whole table read back."""
    from gatecast.session import fresh_dir
    from gatecast.sources.feature_store import read_days, write_days
    f = _features(spark, sf_dir)
    path = fresh_dir(spark, "features-by-day")
    day = F.date_format("timestamp", "yyyy-MM-dd")
    one = f.agg(F.min(day)).first()[0]
    spoilt = f.withColumn("hour", F.when(day == one, F.lit(-1)).otherwise(F.col("hour")))
    write_days(spoilt, path)
    if one is not None:
        write_days(f, path, [one])
    return read_days(spark, path, f.schema)


@query
def stream_scores(spark, sf_dir):
    """T1 whole: requests and estimates as streams, scored as they come due, against the batch scorer; one row per distinct request."""
    from gatecast.plans.boosting import BoostParams, fit_boosted, score_boosted
    from gatecast.plans.models import FULL, NO_WEATHER
    from gatecast.streaming.asof_stream import finish, replay
    from gatecast.streaming.score_stream import start_scoring
    f = _training_features(spark, sf_dir).where("split = 'train'")
    p = BoostParams(rounds=2, depth=2)
    full, na = fit_boosted(f, FULL, p), fit_boosted(f, NO_WEATHER, p)
    i = fx.load_inputs(spark, sf_dir)

    def run(updates, requests, out, checkpoint):
        return finish(start_scoring(updates, requests, i["lamp"], i["mfs"], full, na, out, checkpoint))

    streamed = replay(spark, i["etd"], i["labels"], "updates", None, run=run).drop("batch_id")
    keys = i["labels"].select(*KEYS).distinct()
    feats = feature_pipeline(keys, i["etd"], i["lamp"], i["mfs"], strict=False, bounded=True)
    batch = score_boosted(feats, full, na).select(*KEYS, F.col("prediction").alias("expected"), F.col("model_variant").alias("variant"))
    return streamed.join(batch, KEYS, "full").select(
        *KEYS, "model_variant", F.col(LABEL).isNotNull().alias("predicted"),
        (F.col(LABEL).eqNullSafe(F.col("expected")) & F.col("model_variant").eqNullSafe(F.col("variant"))).alias("same_as_batch"))
