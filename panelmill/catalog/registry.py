"""Query registry, the driver-table roles, and the SQL fragments the twins share."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.plans.panels import weighted_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULES = ("scans", "columns", "joins", "aggregates", "windows", "models", "plots", "recipes", "fits", "choices")


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def load_all() -> None:
    for name in MODULES:
        import_module(f"panelmill.catalog.{name}")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_years(when: str, years: Sequence[int]) -> Column:
    """Date ranges rather than ``year(...)``, so that the scan can skip row groups."""
    ranges = [
        (F.col(when) >= F.lit(date(y, 1, 1))) & (F.col(when) < F.lit(date(y + 1, 1, 1))) for y in years
    ]
    return reduce(Column.__or__, ranges)


def facts(spark: SparkSession, folder: str, years: Sequence[int] = ()) -> DataFrame:
    """Order lines in the role of weighted person rows; unread columns are pruned at the scan."""
    lines = table(spark, folder, "lineitem")
    if years:
        lines = lines.where(in_years("l_shipdate", years))
    return lines.select(
        F.col("l_suppkey").alias("area"), F.year("l_shipdate").cast("long").alias("yr"),
        F.col("l_quantity").alias("wt"), F.col("l_extendedprice").alias("wage"), F.col("l_tax").alias("score"),
        F.col("l_discount").alias("disc"), (F.col("l_discount") >= 0.05).alias("coll"),
        (F.col("l_linestatus") == "O").alias("emp"), F.col("l_returnflag").alias("flag"),
        F.col("l_partkey").alias("part_id"), F.col("l_orderkey").alias("order_id"),
    )


def areas(spark: SparkSession, folder: str) -> DataFrame:
    """(area, state)"""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("area"), F.col("s_nationkey").cast("long").alias("state")
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """(part_id, occ, ind)"""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_type").alias("occ"), F.col("p_brand").alias("ind")
    )


def origins(spark: SparkSession, folder: str) -> DataFrame:
    """(order_id, origin)"""
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("origin"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("c_custkey"))
    return orders.join(customers, "c_custkey").drop("c_custkey")


def facts_state(spark, folder, years: Sequence[int] = ()) -> DataFrame:
    return facts(spark, folder, years).join(areas(spark, folder), "area")


def facts_job(spark, folder, years: Sequence[int] = ()) -> DataFrame:
    return facts(spark, folder, years).join(jobs(spark, folder), "part_id")


def facts_flow(spark, folder) -> DataFrame:
    return facts_state(spark, folder).join(origins(spark, folder), "order_id")


def area_panel(spark, folder, years: Sequence[int] = ()) -> DataFrame:
    """(area, yr, exp, w, frac_col, emp): one row per area and year."""
    return weighted_panel(
        facts(spark, folder, years), ["area", "yr"], "wt", {"exp": "score", "w": "wage"}, {"frac_col": F.col("coll")}, {"emp": None}
    )


def off_tie(digits: int) -> float:
    """Shift applied before rounding on both sides.

    Means over counts such as 32 or 640 end exactly on a rounding tie, which the last digit of a
    float sum would decide either way; shifted, such values are never near a tie.
    """
    return 0.137 * 10.0**-digits


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Results compared with SQL are rounded on both sides; sums of floats differ in the last place."""
    return df.withColumns({n: r(n, digits) for n in names})


def r(x: str | Column, digits: int = 6) -> Column:
    value = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.round(value + F.lit(off_tie(digits)), digits)


# SQL side -----------------------------------------------------------------------------------------


def R(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded double, with negative zero made plain zero."""
    out = f"(round(CAST({expr} AS DOUBLE) + {off_tie(digits)!r}::DOUBLE, {digits}) + 0)"
    return f"{out} AS {name}" if name else out


def Rs(names: Sequence[str] | str, digits: int = 6, prefix: str = "") -> str:
    names = names.split() if isinstance(names, str) else names
    return ", ".join(R(prefix + n, n, digits) for n in names)


FACTS = """facts AS (
  SELECT l_suppkey AS area, CAST(year(l_shipdate) AS BIGINT) AS yr, l_quantity AS wt, l_extendedprice AS wage,
         l_tax AS score, l_discount AS disc, l_discount >= CAST(0.05 AS DOUBLE) AS coll, l_linestatus = 'O' AS emp,
         l_returnflag AS flag, l_partkey AS part_id, l_orderkey AS order_id
  FROM lineitem)"""
FACTS_STATE = FACTS + """, persons AS (
  SELECT f.*, CAST(s_nationkey AS BIGINT) AS state FROM facts f JOIN supplier ON area = s_suppkey)"""
FACTS_JOB = FACTS + """, persons AS (
  SELECT f.*, p_type AS occ, p_brand AS ind FROM facts f JOIN part ON part_id = p_partkey)"""
FACTS_FLOW = FACTS + """, persons AS (
  SELECT f.*, CAST(s_nationkey AS BIGINT) AS state, CAST(c_nationkey AS BIGINT) AS origin
  FROM facts f JOIN supplier ON area = s_suppkey JOIN orders ON order_id = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
PANEL = FACTS + """, panel AS (
  SELECT area, yr, sum(wt * score) / sum(wt) AS exp, sum(wt * wage) / sum(wt) AS w, sum(wt) AS emp,
         sum(CASE WHEN coll THEN wt ELSE 0 END) / sum(wt) AS frac_col
  FROM facts GROUP BY area, yr)"""
