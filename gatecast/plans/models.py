"""Model pipelines per (airport, variant) on MLlib.

Each model is a ``PipelineModel``: category indexer (alphabetical, unseen
and null kept; fitted once per variant over all airports) -> vector
assembler -> regressor.  Every airport with one usable labelled row gets a
model: where its training rows are fewer than a category has levels, which
MLlib's bins cannot hold, the trees see the codes as plain numbers.  Two variants exist per
airport: ``full`` (weather features) and ``na`` (none of them), the
latter serving rows or batches with missing weather.

A forest is no ``PipelineModel``: its 500 deep trees are grown by ``trees``, which
keeps them in a table; the driver could not hold them.

Per-airport fits read the feature table written partitioned by airport,
so each fit scans only its partition; fits for different airports are
submitted from a small driver thread pool and run as concurrent jobs.
"""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.operators.encode import as_category_strings, category_levels, indicators
from gatecast.plans.trees import ForestGrower, TreeParams
from gatecast.schemas import (CATEGORICAL, LABEL, NO_WEATHER_CATEGORICAL, NO_WEATHER_NUMERIC,
                              NUMERIC, WEATHER)


@dataclass(frozen=True)
class Variant:
    name: str
    categorical: list[str]
    numeric: list[str]

    @property
    def required(self) -> list[str]:
        """Columns that must be non-null for a row to train this variant: its
        numbers, and the weather categories when it uses weather."""
        return self.numeric + [c for c in self.categorical if c in WEATHER]


FULL = Variant("full", CATEGORICAL, NUMERIC)
NO_WEATHER = Variant("na", NO_WEATHER_CATEGORICAL, NO_WEATHER_NUMERIC)
VARIANTS = {v.name: v for v in (FULL, NO_WEATHER)}


@dataclass(frozen=True)
class GbtParams:
    """MLlib analogue of the reference's LightGBM settings.

    The jobs train with ``REFERENCE_FULL`` / ``REFERENCE_NO_WEATHER``: the
    reference's rounds, learning rate, depth, leaf size and feature fraction.
    These small defaults are for the registered fits and tests; the search has ``tuning.SEARCH``.  With a
    validation column, boosting stops at the first round whose gain is below
    ``validation_tol``; the reference waits ten rounds without any gain, which
    MLlib cannot, so the tolerance is near 0.
    """
    max_iter: int = 20
    max_depth: int = 5
    step_size: float = 0.1
    min_instances_per_node: int = 1
    feature_fraction: float = 1.0
    subsampling_rate: float = 1.0
    max_bins: int = 128
    seed: int = 23
    validation_tol: float = 1e-6
    max_memory_mb: int = 1024


# ---- fixed values: the reference's final boosting settings per variant -------
REFERENCE_FULL = GbtParams(max_iter=1000, max_depth=17, step_size=0.053555531051409686,
                           min_instances_per_node=250, feature_fraction=0.9932740303336315,
                           max_bins=1000)
REFERENCE_NO_WEATHER = GbtParams(max_iter=1000, max_depth=13, step_size=0.08369562410523884,
                                 min_instances_per_node=200, feature_fraction=0.8360831187256348,
                                 max_bins=1000)
REFERENCE = {"full": REFERENCE_FULL, "na": REFERENCE_NO_WEATHER}
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class ForestParams:
    # fixed values: the reference's random forest (500 trees, depth 15, seed 1994)
    num_trees: int = 500
    max_depth: int = 15
    seed: int = 1994
    max_bins: int = 128


@dataclass(frozen=True)
class LassoParams:
    # fixed value: the reference's L1 strength
    alpha: float = 0.01
    max_iter: int = 100


def _subset(fraction: float) -> str:
    return "all" if fraction >= 1.0 else repr(float(fraction))


def training_rows(features: DataFrame, variant: Variant) -> DataFrame:
    """A6 for the variant: rows with a label and all its numeric inputs."""
    need = [LABEL, *variant.required]
    return as_category_strings(features.na.drop("any", subset=need), variant.categorical)


def scoring_rows(features: DataFrame, variant: Variant) -> DataFrame:
    types = {f.name: f.dataType.typeName() for f in features.schema.fields}
    non_string = [c for c in variant.categorical if types[c] != "string"]
    return features.withColumns({c: F.col(c).cast("string") for c in non_string}) if non_string else features


def fit_indexer(rows: DataFrame, variant: Variant) -> StringIndexerModel:
    """The variant's category codes, over the training rows of every airport."""
    return StringIndexer(inputCols=variant.categorical, outputCols=[c + "_idx" for c in variant.categorical],
                         stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)


def _assembler(inputs: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")


def widest_category(indexer: StringIndexerModel) -> int:
    """Levels of the widest category and its slot for unseen values."""
    return max(map(len, indexer.labelsArray)) + 1


def tree_stages(variant: Variant, indexer: StringIndexerModel, n_rows: int) -> list:
    """M3: codes -> features.  Codes carry category metadata only if MLlib's bins,
    which never outnumber the training rows, can hold every level."""
    codes = [c + "_idx" for c in variant.categorical]
    if n_rows > widest_category(indexer):
        return [indexer, _assembler(codes + variant.numeric)]
    plain = SQLTransformer(statement="SELECT *, " + ", ".join(f"{c} + 0.0 AS {c}_plain" for c in codes) + " FROM __THIS__")
    return [indexer, plain, _assembler([f"{c}_plain" for c in codes] + variant.numeric)]


def gbt_pipeline(variant: Variant, p: GbtParams, indexer: StringIndexerModel, n_rows: int,
                 validation_col: str | None = None) -> Pipeline:
    """M3 + M4/M5/M6: codes -> features -> boosted trees."""
    extra = {"validationIndicatorCol": validation_col, "validationTol": p.validation_tol} \
        if validation_col else {}
    gbt = GBTRegressor(labelCol=LABEL, featuresCol="features", maxIter=p.max_iter,
                       maxDepth=p.max_depth, stepSize=p.step_size,
                       minInstancesPerNode=p.min_instances_per_node,
                       featureSubsetStrategy=_subset(p.feature_fraction),
                       subsamplingRate=p.subsampling_rate, maxBins=max(p.max_bins, widest_category(indexer)), seed=p.seed,
                       maxMemoryInMB=p.max_memory_mb, cacheNodeIds=True, lossType="squared", **extra)
    return Pipeline(stages=[*tree_stages(variant, indexer, n_rows), gbt])


def forest_pipeline(variant: Variant, p: ForestParams, levels: dict[str, list[str]], n_rows: int) -> ForestGrower:
    """Random forest; every tree sees every feature, as scikit-learn's does."""
    return ForestGrower(variant.categorical, variant.numeric, levels, p.num_trees, TreeParams(p.max_depth, seed=p.seed), p.max_bins, n_rows)


def lasso_pipeline(variant: Variant, p: LassoParams, levels: dict[str, list[str]]) -> Pipeline:
    """M12 + D17: L1 linear model on the indicators of ``one_hot`` (scikit-learn's
    Lasso objective: squared loss / 2n + alpha * |w|_1, unstandardised)."""
    made = {f"ind_{i}": e for i, e in enumerate(indicators(levels).values())}
    expand = SQLTransformer(statement="SELECT *" + "".join(f", {e} AS {n}" for n, e in made.items()) + " FROM __THIS__")
    lr = LinearRegression(labelCol=LABEL, featuresCol="features", elasticNetParam=1.0,
                          regParam=p.alpha, standardization=False, maxIter=p.max_iter)
    return Pipeline(stages=[expand, _assembler([*made, *variant.numeric]), lr])


def gbt_fit(p: GbtParams = GbtParams(), validation_col: str | None = None):
    """M4-M6 for ``fit_per_airport``."""
    def prepare(rows: DataFrame, variant: Variant):
        indexer = fit_indexer(rows, variant)
        return lambda n_rows, validated=True: gbt_pipeline(variant, p, indexer, n_rows, validation_col if validated else None)
    prepare.validation_col = validation_col
    return prepare


def forest_fit(p: ForestParams = ForestParams()):
    """M13 for ``fit_per_airport``."""
    def prepare(rows: DataFrame, variant: Variant):
        levels = category_levels(rows, variant.categorical)
        return lambda n_rows, validated=True: forest_pipeline(variant, p, levels, n_rows)
    return prepare


def lasso_fit(p: LassoParams = LassoParams()):
    """M12 for ``fit_per_airport``."""
    def prepare(rows: DataFrame, variant: Variant):
        levels = category_levels(rows, variant.categorical)
        return lambda n_rows, validated=True: lasso_pipeline(variant, p, levels)
    return prepare


def reference_fit(rounds: int | None = None):
    """The reference's boosting settings of each variant; ``rounds`` shortens them."""
    def prepare(rows: DataFrame, variant: Variant):
        p = REFERENCE[variant.name]
        return gbt_fit(p if rounds is None else replace(p, max_iter=rounds))(rows, variant)
    return prepare


def fit_per_airport(train: DataFrame, airports: list[str], variants: list[Variant],
                    fit=None, threads: int = 10) -> dict[tuple[str, str], PipelineModel]:
    """One model per (airport, variant) with at least one usable labelled row.

    Per variant, the categories are read once over all airports and the rows
    counted once; then airports are fitted concurrently as separate jobs.  Rows
    of a validation column do not count as training rows.  An airport without
    a usable row has no model, and a warning says so.
    """
    fit = fit or gbt_fit()
    jobs = []
    for v in variants:
        rows = training_rows(train, v)
        validation = getattr(fit, "validation_col", None)
        held = F.col(validation) if validation else F.lit(False)
        counted = rows.groupBy("airport").agg(F.count_if(~held).alias("n"), F.count_if(held).alias("held")).where("n > 0").collect()
        count = {r["airport"]: (r["n"], r["held"] > 0) for r in counted}
        if count:
            pipeline = fit(rows.where(~held), v)
            # without a validation row there is nothing to stop on
            jobs += [(a, v, pipeline(*count[a]), rows) for a in airports if a in count]
        for a in airports:
            if a not in count:
                warnings.warn(f"no usable training row for airport {a}, variant {v.name}: no model", stacklevel=2)
    if not jobs:
        return {}

    def one(job):
        a, v, pipeline, rows = job
        return (a, v.name), pipeline.fit(rows.where(F.col("airport") == a))

    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(jobs)))) as pool:
        return dict(pool.map(one, jobs))


def predictor(model: PipelineModel, variant: Variant):
    """Wrap a model as ``(df, name='prediction') -> df`` adding one double column.

    Categories are cast to string for the indexer in place; one final select
    restores the input types, drops the model's helper columns and names the
    prediction (few DataFrame operations keep per-airport dispatch cheap to plan).
    """
    def run(df: DataFrame, name: str = "prediction") -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}
        out = model.transform(scoring_rows(df, variant))
        return out.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()],
                          F.col("prediction").alias(name))
    return run


MANIFEST_SCHEMA = "airport string, variant string, folder string"


def save_models(models: dict[tuple[str, str], PipelineModel], root: str) -> dict[tuple[str, str], str]:
    """One folder per (airport, variant), and a manifest that lists them."""
    root = root.rstrip("/")
    paths = {(a, v): f"{root}/airport={a}/variant={v}" for a, v in models}
    for key, path in paths.items():
        models[key].write().overwrite().save(path)
    rows = [(a, v, f"airport={a}/variant={v}") for a, v in sorted(paths)]
    spark = SparkSession.getActiveSession()
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return paths


def load_models(root: str, airports: list[str] | None = None) -> dict[tuple[str, str], PipelineModel]:
    """Every model of the manifest under ``root`` (of ``airports`` only, if given).

    A missing folder, an empty manifest, an airport without any model, and a
    model that cannot be read are errors.
    """
    root = root.rstrip("/")
    spark = SparkSession.getActiveSession()
    listed = {(r["airport"], r["variant"]): r["folder"] for r in spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/manifest").collect()}
    if airports is not None:
        if absent := sorted(set(airports) - {a for a, _ in listed}):
            raise ValueError(f"{root} holds no model for {absent}")
        listed = {k: f for k, f in listed.items() if k[0] in airports}
    if not listed:
        raise ValueError(f"{root} holds no models")
    return {k: PipelineModel.load(f"{root}/{f}") for k, f in sorted(listed.items())}


def weather_complete(df: DataFrame) -> DataFrame:
    return df.na.drop("any", subset=WEATHER)
