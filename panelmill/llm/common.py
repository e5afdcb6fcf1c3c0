"""Table access, row keys and text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill import session
from panelmill.session import discard, staged

__all__ = ["ascii_lower", "checked_partitions", "discard", "read_table", "row_key", "short_batches", "staged", "staged_in_short_batches", "text_or_empty", "total_bytes"]

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
SHORT_BATCH = 1_000  # rows of texts or sets that an Arrow batch holds at most


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands its rows to Python in batches of ``SHORT_BATCH``: both sides hold whole batches of texts or sets."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(before), SHORT_BATCH) if int(before) > 0 else SHORT_BATCH))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def staged_in_short_batches(df: DataFrame, label: str = "stage") -> DataFrame:
    with short_batches(df.sparkSession):
        return session.staged(df, label)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; all other characters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def row_key(text: Column) -> Column:
    """Tells rows apart that share a document id: the 64-bit hash of their text."""
    return F.xxhash64(text)


def total_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)


def checked_partitions(total: int, each: int) -> int:
    """Parts needed so that none of evenly dealt parts holds more than about ``each``."""
    return max(1, -(-int(total) // each))
