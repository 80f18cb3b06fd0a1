"""Reading CSV without losing bad rows.

Every row of the files comes back exactly once: typed among the good rows, or
among the rejects with its file, its text and the reasons.  A value is null
only if the file has none there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
RECORD = "_record"
REJECTS = "file string, record string, reasons array<string>"


def _typed(field: T.StructField) -> Column:
    """The column's value, null if its text cannot be read."""
    text = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return text
    value = F.trim(text).try_cast(field.dataType)
    if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
        return F.when(F.trim(text).rlike(TIMESTAMP), value)  # a date alone is not taken for midnight
    if isinstance(field.dataType, T.DoubleType):
        return F.when(~F.isnan(value), value)
    return value


def _reason(field: T.StructField) -> Column:
    name = field.name
    unread = F.col(name).isNotNull() & _typed(field).isNull()
    wrong = F.when(unread, F.concat(F.lit(f"{name}: not {field.dataType.simpleString()}: "), F.col(name)))
    return wrong if field.nullable else F.coalesce(wrong, F.when(F.col(name).isNull(), F.lit(f"{name}: missing")))


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows of ``schema``, rejects) of header CSV files, plain or bzip2.

    Columns are bound by the header's names, as in ``read_csv``: names that the
    schema lacks are ignored, a missing one is an error.  Rejects are rows with
    too few or too many cells, with a cell that cannot be read as its column's
    type, and with nothing in a column that must not be null.  Both results read the files when used;
    write the rejects where several jobs need them.
    """
    header = spark.read.option("header", True).csv(path).columns
    if missing := [f.name for f in schema.fields if f.name not in header]:
        raise ValueError(f"{path}: the header lacks {missing}")
    if RECORD in header:
        raise ValueError(f"{path}: a column is called {RECORD}")
    cells = T.StructType([*(T.StructField(n, T.StringType()) for n in header), T.StructField(RECORD, T.StringType())])
    rows = (spark.read.schema(cells).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False)  # all cells are counted
            .csv(path).select("*", F.col("_metadata.file_path").alias("_file")))
    found = F.filter(F.array(*[_reason(f) for f in schema.fields]), lambda r: r.isNotNull())
    broken = F.col(RECORD).isNotNull()
    reasons = F.when(broken, F.array(F.lit(f"not {len(header)} cells"))).otherwise(found)
    rows = rows.withColumn("reasons", reasons)
    good = rows.where(F.size("reasons") == 0).select(*[_typed(f).alias(f.name) for f in schema.fields])
    text = F.coalesce(F.col(RECORD), F.to_csv(F.struct(*header)))
    return good, rows.where(F.size("reasons") > 0).select(F.col("_file").alias("file"), text.alias("record"), "reasons")
