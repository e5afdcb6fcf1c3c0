"""CSV and Parquet readers and writers with declared schemas, and tables made in code."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain_name(name: str) -> str:
    """Header as an identifier: other characters become dots, a leading digit gets an ``X``."""
    dotted = re.sub(r"[^0-9A-Za-z._]", ".", name)
    return f"X{dotted}" if re.match(r"[0-9_]", dotted) else dotted


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    select: Sequence[str] | None = None,
    plain_names: bool = False,
) -> DataFrame:
    """CSV with a header row and a declared schema; ``select`` prunes columns at the scan."""
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, nullValue="NA")
    if select is not None:
        df = df.select(*[F.col(f"`{c}`") for c in select])
    return df.toDF(*[plain_name(c) for c in df.columns]) if plain_names else df


def peek(df: DataFrame) -> DataFrame:
    """One row, to look at the columns."""
    return df.limit(1)


def read_table(spark: SparkSession, path: str, select: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*select) if select is not None else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet; partition microdata by year so that year filters prune folders."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, for other tools."""
    df.write.mode(mode).csv(path, header=True, nullValue="NA")


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def year_bins(spark: SparkSession, first: int, groups: int, width: int) -> DataFrame:
    """``(year, grp, rank)``: consecutive periods of ``width`` years, ranked inside each period."""
    offset = F.col("id")
    return spark.range(groups * width).select(
        (offset + first).alias("year"),
        (F.floor(offset / width) + 1).cast("long").alias("grp"),
        (offset % width + 1).alias("rank"),
    )


def distinct_lookup(df: DataFrame, *keys: str) -> DataFrame:
    """Lookup table of the distinct values of ``keys``."""
    return df.select(*keys).distinct()
