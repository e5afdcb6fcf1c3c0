"""Secret scan: fixed patterns and a randomness test battery over strings without a known form.

Fixed patterns are found leftmost and non-overlapping per kind; matches below their length are dropped after matching.
Positions come from the pieces between matches, whose lengths add up to the starts.

The battery takes the longest runs of 20 or more characters of ``[A-Za-z0-9+/_-]`` with a letter and a digit. Each run's
encoding is inferred from its characters (hex, base 32, base 36, base 62, base 64), which gives its alphabet. Three tests
compare it with uniform random draws of that alphabet: chi-squared of the character counts (Wilson-Hilferty), runs above
and below the middle of the alphabet, and the serial correlation of neighbours. Fisher's sum gives one p-value: random
strings have a uniform one, words and numbers a small one.

False discoveries are controlled per length class (powers of two) over all candidates of the table: in a class the
strings with p of 0.5 or more give the number of random ones (twice as many); what lies above a threshold beyond
their uniform share counts as false. The class takes the smallest threshold whose false share is at most ``rate``. The
histogram behind it has a fixed number of bins (classes x 100), and its thresholds, one per class, enter the second pass over
the texts as literals, so no text is shuffled and no row is joined by its id.

Defined results: a null text is the empty text, without spans. Repeated rows each get a result. An empty table gives an
empty result. Spans count code points, end exclusive, sorted by start and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.common import read_table, text_or_empty

# The patterns of the known kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
BINS = 100
ORDERED = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"


def _spans(text: Column, pattern: str, kind: int, keep, extra: int | None = None) -> Column:
    """Structs (start, kind, end, hit) of the matches that ``keep`` accepts; a flat pass over pieces and matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    lengths = F.transform(hits, F.char_length)
    pieces = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), F.char_length)
    parts = F.arrays_zip(pieces.alias("gap"), lengths.alias("len"), hits.alias("hit"),
                         (F.regexp_extract_all(text, F.lit(pattern), extra) if extra else hits).alias("inner"))
    kind_of = "array<struct<start:int,kind:int,end:int,hit:string>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + x["len"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(keep(x), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    found = F.aggregate(parts, empty, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind_of))


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns by start, then kind."""
    short = r"[0-9a-f]{24,}"  # runs are maximal, so a run of 24 is a match of 24 or more
    found = F.concat(
        _spans(text, ASSIGN, 0, lambda x: F.char_length(x["inner"]) >= 6, 2),
        _spans(text, ACCESS, 1, lambda x: x["len"] >= 20),
        _spans(text, short, 2, lambda x: x["len"] >= 24),
    )
    return F.array_sort(found)


def upper_normal(z: Column) -> Column:
    """Upper tail of the normal law (Zelen and Severo's rational form, error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def encoding_of(v: Column) -> Column:
    return (
        F.when(v.rlike("^[0-9a-f]+$"), "hex").when(v.rlike("^[0-9A-F]+$"), "HEX")
        .when(v.rlike("^[A-Z2-7]+$"), "base32").when(v.rlike("^[0-9a-z]+$"), "base36").when(v.rlike("^[0-9A-Z]+$"), "BASE36")
        .when(v.rlike("^[0-9A-Za-z]+$"), "base62").otherwise("base64")
    )


def alphabet_size(encoding: Column) -> Column:
    return (F.when(encoding.isin("hex", "HEX"), 16.0).when(encoding == "base32", 32.0)
            .when(encoding.isin("base36", "BASE36"), 36.0).when(encoding == "base62", 62.0).otherwise(64.0))


def digits_of(v: Column, encoding: Column) -> Column:
    """Places of the characters in the alphabet; base 32 has its letters before its digits."""
    plain = F.when(encoding.isin("hex", "base36"), F.upper(v)).otherwise(F.translate(v, "-_", "+/"))
    places = F.transform(F.regexp_extract_all(plain, F.lit("."), 0), lambda c: F.instr(F.lit(ORDERED), c) - 1)
    return F.when(encoding == "base32", F.transform(places, lambda x: F.when(x >= 10, x - 10).otherwise(x + 24))).otherwise(places)


def _sums(digits: Column, k: Column) -> Column:
    """n, sum of squared counts, runs, digits in the upper half, sum, sum of squares, lagged products."""
    zero = F.lit(0.0)
    squares = F.aggregate(
        F.array_sort(digits), F.struct(F.lit(-1).alias("c"), zero.alias("m"), zero.alias("s")),
        lambda a, x: F.struct(
            x.alias("c"), F.when(x == a["c"], a["m"] + 1).otherwise(1.0).alias("m"),
            F.when(x == a["c"], a["s"] + 2 * a["m"] + 1).otherwise(a["s"] + 1).alias("s")),
        lambda a: a["s"])
    walk = F.aggregate(
        digits, F.struct(F.lit(-1).alias("last"), *[zero.alias(c) for c in ("runs", "high", "sum", "sum2", "cross")]),
        lambda a, x: F.struct(
            x.alias("last"),
            (a["runs"] + F.when((a["last"] < 0) | ((a["last"] >= k / 2) != (x >= k / 2)), 1.0).otherwise(0.0)).alias("runs"),
            (a["high"] + F.when(x >= k / 2, 1.0).otherwise(0.0)).alias("high"),
            (a["sum"] + x).alias("sum"), (a["sum2"] + x * x).alias("sum2"),
            (a["cross"] + F.when(a["last"] < 0, 0.0).otherwise((a["last"] * x).cast("double"))).alias("cross")))
    return F.struct(F.size(digits).cast("double").alias("n"), k.alias("k"), squares.alias("sq"), walk.alias("w"))


def _p_value(s: Column) -> Column:
    n, k, w = s["n"], s["k"], s["w"]
    free = k - 1
    chi = k * s["sq"] / n - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    mean_runs = 2 * (n - w["high"]) * w["high"] / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    z_runs = F.when(var_runs > 0, F.abs(w["runs"] - mean_runs) / F.sqrt(var_runs)).otherwise(9.0)
    mean = w["sum"] / n
    variance = w["sum2"] / n - mean * mean
    z_serial = F.when(variance > 0, F.abs((w["cross"] / (n - 1) - mean * mean) / variance) * F.sqrt(n)).otherwise(9.0)
    least = F.lit(1e-300)
    tails = [upper_normal(z_chi), 2 * upper_normal(z_runs), 2 * upper_normal(z_serial)]
    half = F.greatest(-sum(F.log(F.greatest(t, least)) for t in tails), F.lit(0.0))
    return F.least(F.exp(-half) * (1 + half + half * half / 2), F.lit(1.0))  # chi-squared, six degrees of freedom


def battery(v: Column) -> Column:
    """Fisher's p-value of the three tests: the chance that a random string of the encoding is as uneven as ``v``."""
    return let(encoding_of(v), lambda e: let(_sums(digits_of(v, e), alphabet_size(e)), _p_value))


def length_class(v: Column) -> Column:
    return F.floor(F.log2(F.char_length(v))).cast("int")


def thresholds(runs: DataFrame, rate: float, value: str = "hit") -> DataFrame:
    """(class, least_p): per length class the smallest p whose estimated false share is at most ``rate``."""
    v = F.col(value)
    bins = runs.select(length_class(v).alias("class"), F.least(F.floor(battery(v) * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts = bins.groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("class").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    upper = F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(Window.partitionBy("class"))
    above = counts.select("class", "bin", F.sum("n").over(down).alias("above"), (2 * upper).alias("random"))
    false_share = 1 - F.col("random") * (1 - F.col("bin") / F.lit(BINS)) / F.col("above")
    return above.where(false_share <= rate).groupBy("class").agg((F.min("bin") / F.lit(BINS)).alias("least_p"))


def candidates(text: Column) -> Column:
    return _spans(text, CANDIDATE, 3, lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]"))


def scan(docs: DataFrame, text: str = "text", rate: float = 0.05) -> DataFrame:
    """Adds ``base`` (spans of the fixed patterns) and ``spans`` (all), arrays of (start, kind, end, hit), to every row."""
    t = text_or_empty(F.col(text))
    runs = docs.select(F.explode(candidates(t)).alias("s")).select(F.col("s.hit").alias("hit"))
    # One number per length class, at most 31 rows.
    least = {r["class"]: r["least_p"] for r in thresholds(runs, rate).collect()}
    rows = docs.withColumn("base", base_spans(t))
    if not least:
        return rows.withColumn("spans", F.col("base"))
    limit = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair])

    def secret(s: Column) -> Column:
        apart = ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return apart & F.coalesce(battery(s["hit"]) >= limit[length_class(s["hit"])], F.lit(False))

    return rows.withColumn("spans", F.array_sort(F.concat("base", F.filter(candidates(t), secret))))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", rate: float = 0.05, mark: str = "<secret>") -> DataFrame:
    """The rows with every span, overlapping ones joined, replaced by ``mark``; other columns stay."""
    df = scan(docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(docs.columns)]), f"__{docs.columns.index(text)}", rate)
    t = F.col(f"__{docs.columns.index(text)}")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("spans", start, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["end"] <= a["at"], a["out"]).when((s["start"] < a["at"]) & (s["start"] >= 0), a["out"])
        .otherwise(F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.char_length(t))))
    cleaned = F.when(F.size("spans") > 0, done).otherwise(t)
    return df.select(*[(cleaned if c == text else F.col(f"__{i}")).alias(c) for i, c in enumerate(docs.columns)])


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    df = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return df.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
