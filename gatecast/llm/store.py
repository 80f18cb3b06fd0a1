"""Intermediate tables and small shared helpers for the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatecast.session import remove_dir, shared_dir

WORD = r"[^\x20\x09-\x0D]+"


_open_scopes: list[list[str]] = []


def keep(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Cuts lineage on storage that survives executors.  The schema is passed to
    the reader, so an empty table reads back like any other.  Inside
    ``scratch`` the table goes with the scope unless it is ``lasting``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    if _open_scopes and not lasting:
        _open_scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope whose kept tables are deleted at its end; what leaves it must be ``lasting``."""
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            remove_dir(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_bucket(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is in bucket 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus)), F.lit(0))


BROADCAST_IDS = 2_000_000  # rows of one or two longs: 32 MB at most


def broadcast_ids(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (a few longs a row), marked for broadcast if its counted size is within the bound; else joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids
