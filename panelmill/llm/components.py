"""Connected components of links by alternating large and small stars, a few narrow shuffles a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import staged


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of ``links`` (a, b). Loops and repeats do no harm."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"), "edges")
    before = None
    while True:
        large = staged(_large(edges), "edges")
        state = _state(large)
        if state == before or not state[0]:
            edges = large  # stars stay as they are
            break
        edges = staged(_small(large), "edges")
        before = _state(edges)
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component")).distinct()
