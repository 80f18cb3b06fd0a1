"""The feature table kept up to date day by day, and inputs laid out for their joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatecast.session import fresh_dir

DAY = "day"
BUCKET_KEYS = ["airport", "gufi"]


def _with_day(features: DataFrame) -> DataFrame:
    return features.withColumn(DAY, F.date_format("timestamp", "yyyy-MM-dd"))


def write_days(features: DataFrame, path: str, days: list[str] | None = None) -> None:
    """Write the features by (day, airport).

    With ``days``, just these days are computed and written: their partitions
    are replaced, those of other days are not touched, and an airport that has no
    more rows on such a day loses its partition.  Without, the table is written anew.
    """
    dated = _with_day(features)
    if days is not None:
        dated = dated.where(F.col(DAY).isin(days))
    w = dated.hint("rebalance", DAY, "airport").write.mode("overwrite").partitionBy(DAY, "airport")
    if days is None:
        w.parquet(path)
        return
    spark = features.sparkSession
    before = {r[0] for r in _partitions(spark, path, days)}
    w.option("partitionOverwriteMode", "dynamic").parquet(path)
    # partitions that the new rows do not name are still the old ones
    made = {r[0] for r in dated.select(F.concat_ws("/", DAY, "airport")).distinct().collect()} if before else set()
    for stale in before - made:
        day, airport = stale.split("/", 1)
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{DAY}={day}/airport={airport}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _partitions(spark: SparkSession, path: str, days: list[str]) -> list:
    """day/airport of the days' partitions, from the files' paths."""
    stored = spark.read.schema(f"{DAY} string, airport string").parquet(path)
    return stored.where(F.col(DAY).isin(days)).select(F.concat_ws("/", DAY, "airport")).distinct().collect()


def read_days(spark: SparkSession, path: str, schema: T.StructType, days: list[str] | None = None) -> DataFrame:
    """The features, of some days only if given: other partitions are not read."""
    fields = [f for f in schema.fields if f.name != DAY]
    df = spark.read.schema(T.StructType([*fields, T.StructField(DAY, T.StringType())])).parquet(path)
    if days is not None:
        df = df.where(F.col(DAY).isin(days))
    return df.select(*[f.name for f in fields])


def write_bucketed(df: DataFrame, table: str, buckets: int, keys: list[str] = BUCKET_KEYS) -> DataFrame:
    """``df`` as a table bucketed and sorted by ``keys``, below the shared folder.

    Joins on the keys need no exchange of this side, nor do windows and
    aggregates by them.  ``buckets`` should suit the table's size, not the cluster's.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, table)
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return spark.table(table)
