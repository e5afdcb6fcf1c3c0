"""Corpus pipeline: quality rules, near duplicates, decontamination, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; ``run`` applies them to ``documents``, each stage's
rows being written as Parquet in the shared folder and read again by the next one. All but the last return the columns of
``documents``, whatever they are, and leave ``n_chars`` as it came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import bpe, common, decontamination, minhash, quality_rules, secrets


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines common in their host are taken out of the kept ones."""
    return quality_rules.apply_rules(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (five-word shingles, similarity 0.8 or more).

    Rows that share the kept id and text stay once, different texts under one kept id stay all; rows with a null id stay all.
    """
    kept = minhash.near_duplicates(docs, size=5, percent=80).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    named = docs.join(kept.where("__id is not null"), docs["doc_id"] == kept["__id"], "left_semi")
    named = named.withColumn("__rk", common.row_key(F.col("text"))).dropDuplicates(["doc_id", "__rk"]).drop("__rk")
    return named.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontamination.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    return bpe.encode_documents(docs, *bpe.default_vocabulary())


STAGES = [
    ("quality rules", apply_quality_rules),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte-level bpe", encode_tokens),
]

#: Near duplicates and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
