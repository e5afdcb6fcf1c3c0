"""Benchmark decontamination with a distributed positional inverted index.

The index stores a posting (document, position, term) for every training token that is a term of the test set, plus one
posting per document that carries its number of words. It is written in one pass over the texts, without a shuffle,
as Parquet in the shared folder; all that follows reads the index, not the texts. Test terms are matched to tokens by a
join that Spark broadcasts only while the term table is under the session's threshold.

A phrase is found from its rarest terms: the posting lists of its two rarest terms are shifted by the terms' offsets and
intersected, which costs one shuffle of the postings of rare terms only: a table of hashed terms of at most ``FILTER_SIZE`` numbers
leaves out the others where they are read. Starts that both lists share ask for the phrase's
other terms at their shifted positions, and a start stays when all are there. Before that join the index is
reduced to documents with such a start, by a table of hashed ids that holds at most ``FILTER_SIZE`` numbers. Proximity
matches ask for terms within a distance of the rarest term instead of at fixed offsets.

All of it is DataFrame functions. A phrase all of whose terms are frequent still shuffles the postings of its rarest two by term, a hot one of
which Spark's skew handling splits.

Defined results: null and empty texts have no words. An item without words gives no window. A document id may repeat
and may be null: rows with equal id and text share a result, which each of them returns. Repeated items count by id. Empty tables
give no hits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import ascii_lower, read_table, row_key, staged, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same words before A-Z is lowered
WINDOW = 10
RAREST = 2
FILTER_SIZE = 1 << 20
DOC = ["doc_id", "rk"]


def words_of(text: Column) -> Column:
    """Words in their own case: lowering A-Z later gives the words of the lowered text."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(RAW_WORD), 0)


def phrase_windows(items: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, phrase): runs of ``size`` words; shorter items are one phrase."""
    words = F.regexp_extract_all(ascii_lower(text_or_empty(F.col(text))), F.lit(WORD), 0)
    df = items.select(F.col(item_id).cast("string").alias("item_id"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return df.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("phrase")).distinct()


@dataclass
class PositionalIndex:
    """Postings (doc_id, rk, pos, term) of the terms and (doc_id, rk, n_words) of all documents."""

    postings: DataFrame
    documents: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> PositionalIndex:
        """``terms`` has one column ``term`` of lowered words."""
        # The empty term stands for the end of a document: its position is the number of words.
        end = terms.sparkSession.sql("SELECT '' AS term")
        terms = terms.select("term").where("term <> ''").distinct().union(end)
        terms = staged(terms.select("term", F.lower("term").alias("key")), "index-terms")
        rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(text)).alias("rk"), F.concat(words_of(F.col(text)), F.array(F.lit(""))).alias("w"))
        tokens = rows.select("doc_id", "rk", F.posexplode("w").alias("pos", "token"))
        # The join key folds all letters; the exact comparison lowers only words that are not lower case already.
        same = (F.col("token") == F.col("term")) | (ascii_lower(F.col("token")) == F.col("term"))
        found = tokens.join(terms, (F.lower("token") == F.col("key")) & same).select("doc_id", "rk", "pos", "term")
        found = staged(found, "postings")
        ends = found.where("term = ''").select("doc_id", "rk", F.col("pos").cast("long").alias("n_words"))
        return cls(found.where("term <> ''"), ends)

    def counts(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))

    def ranked(self, terms: DataFrame, query: str) -> DataFrame:
        """Adds ``rank`` (1: rarest) to (query, off, term); queries with a term that never occurs are left out."""
        counted = terms.join(self.counts(), "term", "left")
        each = Window.partitionBy(query)
        counted = counted.withColumn("__absent", F.max(F.col("n").isNull()).over(each)).where(~F.col("__absent"))
        order = each.orderBy("n", "term", "off")
        return counted.withColumn("rank", F.row_number().over(order)).withColumn("size", F.count(F.lit(1)).over(each)).drop("__absent", "n")

    def phrases(self, phrases: DataFrame, rarest: int = RAREST) -> DataFrame:
        """(doc_id, rk, start, phrase, size) for every exact occurrence of a phrase (column ``phrase``, blank-separated)."""
        terms = phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
        ranked = staged(self.ranked(terms, "phrase"), "phrase-terms")
        seeds = self._of(ranked.where(F.col("rank") <= rarest))
        seeds = seeds.select(*DOC, (F.col("pos") - F.col("off")).alias("start"), "phrase", "size", "rank").where("start >= 0")
        # Equal rows have each posting several times, so the lists met are told apart by their bits.
        met = seeds.groupBy(*DOC, "start", "phrase", "size").agg(F.bit_or(F.expr("shiftleft(1L, rank - 1)")).alias("lists"))
        every = F.expr(f"shiftleft(1L, cast(least(size, {int(rarest)}) AS int)) - 1")
        met = staged(met.where(F.col("lists") == every).drop("lists"), "phrase-starts")
        rest = ranked.where(F.col("rank") > rarest).select("phrase", "off", "term")
        needs = met.join(rest, "phrase").select(*DOC, "start", "phrase", "size", (F.col("start") + F.col("off")).alias("pos"), "term")
        full = self._meet(needs, met).groupBy(*DOC, "start", "phrase", "size").agg(F.countDistinct("pos").alias("n"))
        long = full.where(F.col("n") == F.col("size") - rarest).drop("n")
        return met.where(F.col("size") <= rarest).unionByName(long)

    def _meet(self, needs: DataFrame, starts: DataFrame) -> DataFrame:
        """Rows of ``needs`` (a document, pos and term) whose posting exists."""
        ids = staged(starts.select(self._slot().alias("__slot")).distinct(), "phrase-documents")
        postings = self.postings.withColumn("__slot", self._slot()).join(F.broadcast(ids), "__slot", "left_semi").drop("__slot")
        p = postings.select(F.col("doc_id").alias("p_id"), F.col("rk").alias("p_rk"), F.col("pos").alias("p_pos"), F.col("term").alias("p_term"))
        on = needs.doc_id.eqNullSafe(p.p_id) & (needs.rk == p.p_rk) & (needs.pos == p.p_pos) & (needs.term == p.p_term)
        return needs.join(p, on, "left_semi")

    def _of(self, rare: DataFrame) -> DataFrame:
        """Postings of the terms of ``rare`` beside its columns; others are left out before the shuffle by hashed terms."""
        slot = F.pmod(F.xxhash64("term"), F.lit(FILTER_SIZE)).cast("int")
        slots = staged(rare.select(slot.alias("__slot")).distinct(), "rare-terms")
        few = self.postings.withColumn("__slot", slot).join(F.broadcast(slots), "__slot", "left_semi").drop("__slot")
        return few.join(rare, "term")

    @staticmethod
    def _slot() -> Column:
        # At most FILTER_SIZE values exist, whatever the number of documents.
        return F.pmod("rk", F.lit(FILTER_SIZE)).cast("int")

    def near(self, queries: DataFrame, distance: int) -> DataFrame:
        """(doc_id, rk, pos, query) where all terms of a query lie within ``distance`` words of its rarest term.

        ``queries`` has (query, term); equal terms of a query count once.
        """
        terms = queries.select("query", "term").distinct().withColumn("off", F.lit(0))
        ranked = staged(self.ranked(terms, "query"), "near-terms")
        seeds = self._of(ranked.where("rank = 1")).select(*DOC, F.col("pos").alias("at"), "query", "size").distinct()
        seeds = staged(seeds, "near-seeds")
        needs = seeds.join(ranked.where("rank > 1").select("query", "term"), "query")
        p = self.postings.select(F.col("doc_id").alias("p_id"), F.col("rk").alias("p_rk"), F.col("pos").alias("p_pos"), F.col("term").alias("p_term"))
        on = needs.doc_id.eqNullSafe(p.p_id) & (needs.rk == p.p_rk) & (needs.term == p.p_term) & (F.abs(p.p_pos - F.col("at")) <= distance)
        full = needs.join(p, on, "left_semi").groupBy(*DOC, "at", "query", "size").agg(F.countDistinct("term").alias("n"))
        full = full.where(F.col("n") == F.col("size") - 1)
        return seeds.where("size = 1").select(*DOC, "at", "query").unionByName(full.select(*DOC, "at", "query")).withColumnRenamed("at", "pos")


def covered_words(hits: DataFrame) -> DataFrame:
    """(doc_id, rk, n_hit): words inside the union of the spans (start, size) of each document."""
    spans = hits.groupBy(*DOC, "start").agg(F.max("size").alias("size"))
    before = Window.partitionBy(*DOC).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("size")).over(before), F.lit(0))
    fresh = F.greatest(F.col("start") + F.col("size") - F.greatest("start", reach), F.lit(0))
    return spans.select(*DOC, fresh.alias("fresh")).groupBy(*DOC).agg(F.sum("fresh").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, rk, n_words, n_hit, n_items, items (sorted ids), contaminated."""
    windows = staged(phrase_windows(items, size), "test-phrases")
    terms = windows.select(F.explode(F.split("phrase", " ")).alias("term"))
    index = PositionalIndex.build(docs, terms, doc_id, text)
    hits = staged(index.phrases(windows), "phrase-hits")
    words = covered_words(hits)
    found = hits.select(*DOC, "phrase").distinct().join(windows, "phrase").groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = words.join(found.select(F.col("doc_id").alias("f_id"), F.col("rk").alias("f_rk"), "items"), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("rk") == F.col("f_rk")))
    both = both.select(F.col("doc_id").alias("h_id"), F.col("rk").alias("h_rk"), "n_hit", "items")
    all_docs = index.documents
    df = all_docs.join(both, all_docs.doc_id.eqNullSafe(both.h_id) & (all_docs.rk == both.h_rk), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return df.select(*DOC, "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows without a hit, with all their columns."""
    bad = contamination(docs, items, size, doc_id, text).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__id"]) & (row_key(docs[text]).eqNullSafe(bad["__rk"])), "left_anti")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    df = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return df.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
