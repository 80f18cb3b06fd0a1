"""File sources and sinks.

* CSV (optionally bzip2, chosen by the ``.bz2`` extension on read) with an
  explicit schema: no inference pass, types fixed up front.
* Reference layout ``{root}/{AIRPORT}/{AIRPORT}_{table}.csv.bz2`` read in
  one scan; the airport comes from each file's path (``_metadata``).
* The feature table cached as parquet partitioned by airport, so a
  per-airport read prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TS_WRITE_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SECONDS = "yyyy-MM-dd HH:mm:ss"
TS_READ_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"
AIRPORT_FROM_REFERENCE_PATH = r"/([^/]+)/[^/]*_[a-z_]+\.csv\.bz2$"
AIRPORT_FROM_PARTITION_PATH = r"airport=([^/]+)/"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, path_column: str | None = None) -> DataFrame:
    """Header CSV, plain or ``.bz2`` (the codec follows the extension).

    Columns are bound by the names in the header, in whatever order they come;
    columns that ``schema`` lacks are ignored, and one that the header lacks is
    an error, as is a file whose header differs from the others'.  With
    ``path_column``, each row also gets its file's path under that name.
    """
    reader = spark.read.option("header", True)
    header = reader.csv(path).columns
    kinds = {f.name: f for f in schema.fields}
    if missing := [n for n in kinds if n not in header]:
        raise ValueError(f"{path}: the header lacks {missing}")
    in_file = T.StructType([kinds.get(n, T.StructField(n, T.StringType())) for n in header])
    df = (spark.read.schema(in_file).option("header", True).option("enforceSchema", False)
          .option("timestampNTZFormat", TS_READ_FORMAT).option("mode", "FAILFAST").csv(path))
    return df.select(*schema.names, *[F.col("_metadata.file_path").alias(c) for c in [path_column] if c])


def read_airport_tables(spark: SparkSession, glob: str, schema: T.StructType,
                        airport_pattern: str = AIRPORT_FROM_REFERENCE_PATH) -> DataFrame:
    """S3 + U3: all airports' files in one scan, with ``airport`` from the path.

    ``schema`` describes the file's columns; an ``airport`` column in it is
    ignored and filled from the path instead.
    """
    file_schema = T.StructType([f for f in schema.fields if f.name != "airport"])
    df = read_csv(spark, glob, file_schema, "__path")
    airport = F.regexp_extract("__path", airport_pattern, 1)
    return df.select(airport.alias("airport"), *file_schema.names)


def write_csv(df: DataFrame, path: str, bz2: bool = False, partition_by: list[str] | None = None,
              timestamps: str = TS_WRITE_FORMAT) -> str:
    """Header CSV without an index; inputs keep microseconds, predictions
    take ``TS_SECONDS``.  A folder per value gets files of even size."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", timestamps)
    if bz2:
        w = w.option("compression", "bzip2")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def write_feature_table(df: DataFrame, path: str) -> str:
    """S9 (write): parquet partitioned by airport, in files of even size (a busy
    airport's rows are split over several)."""
    df.hint("rebalance", "airport").write.mode("overwrite").partitionBy("airport").parquet(path)
    return path


def read_feature_table(spark: SparkSession, path: str, airports: list[str] | None = None,
                       schema: T.StructType | None = None) -> DataFrame:
    """S9 (read): partition pruning when ``airports`` is given.

    Pass the written frame's ``schema`` so the airport partition column is
    read as a string instead of type-inferred from folder names.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if schema is not None:
        df = df.select(*schema.names)
    return df.where(F.col("airport").isin(airports)) if airports else df
