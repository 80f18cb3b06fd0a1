"""Layout-independent hash split (M1, M2).

``exact_grouped_split`` cuts the flights, in hash order, where their rows reach the
wanted share; ``hash_split`` meets it in expectation only.

A row's side depends only on its key: the first 32 bits of md5(key) mod
100.  The split is the same under any partitioning or re-run, which
``randomSplit`` does not promise.  Splitting on ``gufi`` alone keeps all
rows of a flight on one side (the grouped split).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecast.functions.timeops import epoch_us
from gatecast.schemas import SPLIT_TRAIN_PERCENT


def bucket_of(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % 100


def row_key() -> Column:
    return F.concat_ws("|", F.col("airport"), F.col("gufi"), epoch_us("timestamp").cast("string"))


def hash_split(df: DataFrame, grouped: bool = False,
               train_percent: int = SPLIT_TRAIN_PERCENT) -> DataFrame:
    """Adds ``split`` = 'train' / 'test'."""
    key = F.col("gufi") if grouped else row_key()
    return df.withColumn("split", F.when(bucket_of(key) < train_percent, F.lit("train"))
                         .otherwise(F.lit("test")))


SLOT_DIGITS = 3  # hex digits of a flight's hash that name one of 4096 slots


def _flight_hash(gufi: Column) -> Column:
    return F.substring(F.md5(gufi), 1, 16)


def grouped_boundary(df: DataFrame, train_percent: int = SPLIT_TRAIN_PERCENT) -> tuple[str, str] | None:
    """The last training flight in hash order, as (hash, gufi), such that flights up to it hold at most ``train_percent`` of the rows.

    Flights are counted, rows summed per slot of the hash, and running sums
    taken within each slot only; the one row that comes back is the boundary.
    None if not even the first flight fits.
    """
    key = F.coalesce("gufi", F.lit(""))
    flights = df.groupBy(key.alias("gufi")).agg(F.count(F.lit(1)).alias("n")).withColumn("h", _flight_hash(F.col("gufi")))
    flights = flights.withColumn("slot", F.substring("h", 1, SLOT_DIGITS))
    whole = Window.partitionBy(F.lit(0))  # of the slots' sums: 4096 rows at most
    slots = flights.groupBy("slot").agg(F.sum("n").alias("s")).select(
        "slot", F.sum("s").over(whole).alias("all"), (F.sum("s").over(whole.orderBy("slot")) - F.col("s")).alias("before"))
    run = F.sum("n").over(Window.partitionBy("slot").orderBy("h", "gufi").rowsBetween(Window.unboundedPreceding, 0))
    inside = flights.join(slots, "slot").withColumn("upto", F.col("before") + run).where(F.col("upto") * 100 <= F.col("all") * train_percent)
    last = inside.agg(F.max(F.struct("h", "gufi")).alias("last")).first()["last"]
    return (last["h"], last["gufi"]) if last is not None else None


def exact_grouped_split(df: DataFrame, train_percent: int = SPLIT_TRAIN_PERCENT) -> DataFrame:
    """M2: adds ``split``; whole flights, and the training share misses ``train_percent`` by less than one flight.

    Rows without a flight count as one flight.  The rows themselves are neither
    sorted nor shuffled: each is compared with the boundary.
    """
    boundary = grouped_boundary(df, train_percent)
    if boundary is None:
        return df.withColumn("split", F.lit("test"))
    key = F.coalesce("gufi", F.lit(""))
    h, (last_h, last_gufi) = _flight_hash(key), boundary
    train = (h < last_h) | ((h == last_h) & (key <= last_gufi))
    return df.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))
