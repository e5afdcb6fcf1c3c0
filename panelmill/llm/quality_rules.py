"""Cross-document line frequency: lines many documents of a host share are removed, depleted documents rejected.

Every line is normalised (lower case of all letters, digits to 0, white space squeezed) and hashed. Per host and line hash
the distinct documents are counted. Copies of a document count once: a document counts by the hash of its set of lines, so a text
that was copied often does not make its own lines common, while different texts that share a line all count.
A line is common when more than ``max_docs`` documents of its host have it and more than ``max_share`` of them.
A document is depleted when removing common lines leaves less than ``min_left`` of its words.

All of it is built-in functions. One pass over the texts stores the counts and line hashes of each row; texts are not
shuffled. (host, copy, line) rows are combined before the shuffle, and the second level counts the copies of a line once, so
that a line which a third of all documents share is spread over its documents. Common lines are a table of few rows (each
takes ``max_docs`` documents); Spark broadcasts it only under the session's own threshold, else it splits the hot keys.

Defined results: a null text has no words and is rejected by the base rules, an empty one too. A null host is a
host of its own. Repeated rows give one result row each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import read_table, row_key, staged, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def normalised(line: Column) -> Column:
    """Lower case, digits to 0, runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def line_keys(text: Column) -> Column:
    """One struct (hash, words) for each line with a word, in order."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words_of(x)).alias("n")))


def repeated_words(words: Column, triples: Column, ordered: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; ``ordered`` holds (window, position) sorted."""
    m = F.size(ordered)
    pairs = F.zip_with(
        F.slice(ordered, F.lit(1), m - 1), F.slice(ordered, F.lit(2), m - 1),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])),
    )
    starts = F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def base_counts(docs: DataFrame, text: str) -> DataFrame:
    """Adds the counts of one text: words, characters in words, symbols, repeated lines, words in repeated windows."""
    t = text_or_empty(F.col(text))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    df = docs.withColumn("__words", words_of(t)).withColumn("__lines", lines)
    n = F.size("__words")
    df = df.withColumn("__tri", F.when(n >= 3, F.zip_with(
        F.zip_with(F.slice("__words", F.lit(1), n - 2), F.slice("__words", F.lit(2), n - 2), lambda a, b: F.concat(a, F.lit(" "), b)),
        F.slice("__words", F.lit(3), n - 2), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>")))
    some = F.size(F.array_distinct("__tri")) < F.size("__tri")
    df = df.withColumn("__ordered", F.when(some, F.array_sort(F.transform("__tri", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    df = df.withColumn("n_repeat_words", F.when(F.col("__ordered").isNotNull(), repeated_words(F.col("__words"), F.col("__tri"), F.col("__ordered"))).otherwise(F.lit(0)).cast("long"))
    return (
        df.withColumn("n_words", F.size("__words").cast("long"))
        .withColumn("word_chars", F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"))
        .withColumn("n_symbols", (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .drop("__words", "__lines", "__tri", "__ordered")
    )


def doc_lines(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Per row: id, key, host, base counts, the (hash, words) of each line and the hash of its set of lines (``copy``)."""
    df = docs.select(
        F.col(doc_id).alias("doc_id"), row_key(F.col(text)).alias("rk"), F.col(host).alias("host"), F.col(text).alias("text"))
    df = base_counts(df, "text").withColumn("keys", line_keys(text_or_empty(F.col("text"))))
    lines = F.array_sort(F.array_distinct("keys.h"))
    return df.withColumn("copy", F.when(F.size(lines) > 0, F.xxhash64(lines))).drop("text")


def common_lines(lines: DataFrame, max_docs: int = 100, max_share: float = 0.01) -> DataFrame:
    """(host, h): hashes of the common lines of each host, from ``doc_lines``."""
    # Rows (host, copy, line), then different documents counted; both levels combine before the shuffle.
    seen = lines.select("host", "copy", F.explode(F.array_distinct("keys.h")).alias("h")).distinct()
    frequent = seen.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs)
    total = lines.where("copy is not null").select(F.col("host").alias("total_host"), "copy").distinct()
    total = total.groupBy("total_host").agg(F.count(F.lit(1)).alias("docs"))
    over = frequent.join(total, F.col("host").eqNullSafe(F.col("total_host")))
    return over.where(F.col("n") > F.col("docs") * F.lit(max_share)).select("host", "h")


def verdicts(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = 100, max_share: float = 0.01, min_left: float = 0.2) -> DataFrame:
    """One row per row of ``docs``: doc_id, rk, base counts, ``n_left``, ``base_failed``, ``kept`` and ``gone`` (hashes removed)."""
    lines = staged(doc_lines(docs, doc_id, host, text), "doc-lines")
    common = staged(common_lines(lines, max_docs, max_share), "common-lines")
    each = lines.select("doc_id", "rk", "host", F.explode(F.array_distinct("keys.h")).alias("h"))
    on = each.host.eqNullSafe(common.host) & (each.h == common.h)
    gone = each.join(common, on, "left_semi").groupBy("doc_id", "rk").agg(F.collect_set("h").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("rk").alias("gone_rk"), "gone")
    df = lines.join(gone, lines.doc_id.eqNullSafe(gone.gone_id) & (lines.rk == gone.gone_rk), "left").drop("gone_id", "gone_rk")
    n_gone = F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + F.when(F.array_contains("gone", x["h"]), x["n"]).otherwise(0))
    df = df.withColumn("n_left", F.col("n_words") - F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n_gone))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        df.withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_left") >= F.col("n_words") * F.lit(min_left)))
        .drop("keys", "copy", "host")
    )


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The kept rows with all their columns, common lines taken out of the text."""
    v = verdicts(docs, doc_id, host, text, **limits).where("kept")
    v = v.select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk"), F.col("gone").alias("__gone")).dropDuplicates(["__id", "__rk"])
    df = docs.join(v, docs[doc_id].eqNullSafe(v["__id"]) & (row_key(docs[text]) == v["__rk"]))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: ~(F.array_contains("__gone", F.xxhash64(normalised(x))) & x.rlike(WORD)))
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))
    return df.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns])


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "kept",
    )
