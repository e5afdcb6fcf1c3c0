"""Quality and toxicity by a text classifier and hierarchical empirical Bayes over hosts and paths.

The classifier learns from at most ``SAMPLE`` labelled documents, those whose hashed ids are smallest. One half of them gives
weights of words and their runs of four and five characters (log odds of the document shares in either class, for the
``FEATURES`` parts whose shares differ most), the other half a logistic
fit of a few numbers per text: weight sums, length, symbols, repetition. A word of more than ``LONGEST`` characters counts as pieces
of that length, which overlap so that every run of its characters is in one. Both bounds are parameters; the rest covers all rows.

Every document's evidence is its logit. Grouped sums per path (n, sum, sum of squares of the probabilities) give path means;
paths add up to hosts and hosts to the table. Between-group variances come from these moments; a group's posterior is its mean
shrunk towards its parent's by the share of between-group variance, so a sparse site stays near the prior. A document's
posterior logit is its evidence plus what its path's posterior exceeds the table's mean by.

Rows joined to their path are narrow and salted, so a host with a third of all rows is dealt over ``SALT`` keys. Defined results: a
null text is empty; null hosts and paths are groups of their own; null ids stay. Labels of null are left out.
Without labels the classifier is undecided (0.5) and keeps all. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import read_table, staged
from panelmill.llm.shingles import words

SAMPLE = 20_000
FEATURES = 30_000
MEMO_WORDS = 500_000
LONGEST = 80
OVERLAP = 4  # one character less than the longest run
SALT = 32
SYMBOLS = bytes(sorted(b"#*$%&|<>{}[]\\^~@"))
NUMBERS = ["constant", "quality_sum", "toxic_sum", "toxic_top", "log_words", "symbols", "distinct"]


def pieces_of(text: bytes | None) -> Iterator[bytes | str]:
    """The words of a text; long ones as pieces, characters with the word's ends marked."""
    for word in words(text):
        w = word.decode("utf-8", "replace") if len(word) > LONGEST else ""
        if len(w) <= LONGEST:
            yield word
            continue
        w = "^" + w + "$"
        for at in range(0, len(w) - OVERLAP, LONGEST - OVERLAP):
            yield w[at:at + LONGEST]


def parts_of(word: bytes | str) -> set[str]:
    """A word, with its ends marked, or a piece of one, and its runs of four and five characters."""
    w = "^" + word.decode("utf-8", "replace") + "$" if isinstance(word, bytes) else word
    return {w, *(w[i:i + 4] for i in range(len(w) - 3)), *(w[i:i + 5] for i in range(len(w) - 4))}


class WordWeights(dict):
    """Summed weights of the known parts of a word: (quality, toxicity, largest toxicity), kept while there is room."""

    def __init__(self, weights: dict[str, tuple[float, float]]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes | str) -> tuple[float, float, float]:
        known = [self.weights[p] for p in parts_of(word) if p in self.weights]
        out = (sum(q for q, _ in known), sum(t for _, t in known), max((t for _, t in known), default=0.0)) if known else (0.0, 0.0, 0.0)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out
        return out


def text_numbers(text: bytes | None, weights: WordWeights) -> list[float]:
    """The numbers that the logistic fit sees, in the order of ``NUMBERS``."""
    found = list(pieces_of(text))
    if not found:
        return [1.0] + [0.0] * (len(NUMBERS) - 1)
    distinct = set(found)
    known = [x for x in map(weights.__getitem__, distinct) if x[2] or x[0] or x[1]]
    scale = len(distinct) ** 0.5
    toxic = heapq.nlargest(3, (x[2] for x in known))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return [1.0, sum(x[0] for x in known) / scale, sum(x[1] for x in known) / scale, sum(toxic) / 3, float(np.log1p(len(found))), symbols / len(text), len(distinct) / len(found)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; ``x`` holds few columns."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Classifier:
    """Word weights and the two logistic fits."""

    def __init__(self, weights: WordWeights, centre: np.ndarray, spread: np.ndarray, quality: np.ndarray, toxic: np.ndarray):
        self.weights, self.centre, self.spread, self.quality, self.toxic = weights, centre, spread, quality, toxic

    def logits(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([text_numbers(t, self.weights) for t in texts]).reshape(len(texts), len(NUMBERS))
        x = (x - self.centre) / self.spread
        return np.clip(x @ self.quality, -30, 30), np.clip(x @ self.toxic, -30, 30)

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Classifier:
        """``docs`` has (doc_id, text), ``labels`` (doc_id, quality, toxic)."""
        chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").dropDuplicates(["doc_id"])
        chosen = chosen.select("doc_id", "quality", "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
        chosen = staged(chosen, "labels")
        # At most ``sample`` rows of four numbers.
        rows = staged(docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "labelled")
        first = rows.where("h % 2 = 0")
        n, q, t = (int(x or 0) for x in first.agg(F.count(F.lit(1)), F.sum("quality"), F.sum("toxic")).first())

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, list[int]] = {}
            for batch in batches:
                for text, quality, toxic in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("quality").to_pylist(), batch.column("toxic").to_pylist()):
                    for part in set().union(*map(parts_of, set(pieces_of(text)))):
                        c = total.setdefault(part, [0, 0, 0])
                        c[0] += 1
                        c[1] += quality
                        c[2] += toxic
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array([c[k] for c in total.values()], pa.int64()) for k in range(3))], names=["w", "n", "q", "t"])

        counts = first.select("text", "quality", "toxic").mapInArrow(count, "w string, n long, q long, t long").groupBy("w").agg(*(F.sum(c).alias(c) for c in "nqt")).where("n > 1")
        odds = lambda k, part: F.log((F.col(k) + 0.5) / (part + 1.0)) - F.log((F.col("n") - F.col(k) + 0.5) / (n - part + 1.0))
        # How far a part's share of a class is from the class's own, in standard deviations.
        far = lambda k, part: F.abs(F.col(k) - F.col("n") * (part / max(n, 1))) / F.sqrt(F.col("n") * max(part * (n - part), 1) / max(n, 1) ** 2)
        weighed = counts.select("w", odds("q", q).alias("q"), odds("t", t).alias("t"), F.greatest(far("q", q), far("t", t)).alias("z"))
        kept = weighed.orderBy(F.desc("z"), "w").limit(features).collect()
        weights = WordWeights({r["w"]: (r["q"], r["t"]) for r in kept})

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = [text_numbers(text, weights) for text in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.float64()), batch.column("toxic").cast(pa.float64()), pa.array(x, pa.list_(pa.float64()))], names=["q", "t", "x"])

        second = rows.where("h % 2 <> 0").select("text", "quality", "toxic").mapInArrow(numbers, "q double, t double, x array<double>").toArrow()
        m, k = second.num_rows, len(NUMBERS)
        if not m:
            return cls(weights, np.zeros(k), np.ones(k), np.zeros(k), np.zeros(k))
        x = np.array(second.column("x").to_pylist())
        centre, spread = x.mean(axis=0), x.std(axis=0)
        centre[0], spread = 0.0, np.where(spread > 0, spread, 1.0)
        x = (x - centre) / spread
        return cls(weights, centre, spread, logistic(x, second.column("q").to_numpy()), logistic(x, second.column("t").to_numpy()))


def evidence(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, host, path, quality, toxic): the classifier's logits of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = shared.value.logits(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(q), pa.array(t)], names=["doc_id", "host", "path", "quality", "toxic"])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, "doc_id long, host string, path string, quality double, toxic double")


def _variance(groups: DataFrame, mean: str, parent: str) -> float:
    """Between-group variance by moments: weighted squares of group means about the parent's, less what the groups' own spread explains."""
    d = (F.col(mean) - F.col(parent)) ** 2
    n, squares, within, k = groups.agg(
        F.sum("n"), F.sum(F.col("n") * d), F.sum(F.col("n") * F.col("s2")), F.count(F.lit(1))).first()
    if not n:
        return 0.0
    return max((squares - k * within / n) / n, 0.0)


def posteriors(scored: DataFrame, column: str) -> DataFrame:
    """(host, path, shift): what a path adds to the logit of its documents."""
    p = 1 / (1 + F.exp(-F.col(column)))
    paths = staged(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss")), "path-sums")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    top = (s / n) if n else 0.5
    spread = F.greatest(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(1e-6))
    hosts = hosts.select("host", "n", (F.col("s") / F.col("n")).alias("m"), spread.alias("s2"), F.lit(top).alias("prior"))
    between = _variance(hosts, "m", "prior")
    weight = lambda b: F.lit(b) / (F.lit(b) + F.col("s2") / F.col("n"))
    hosts = hosts.select(F.col("host").alias("h"), (F.col("prior") + weight(between) * (F.col("m") - F.col("prior"))).alias("host_mean"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).select(
        "host", "path", "n", (F.col("s") / F.col("n")).alias("m"), spread.alias("s2"), "host_mean")
    inside = _variance(paths, "m", "host_mean")
    post = F.col("host_mean") + weight(inside) * (F.col("m") - F.col("host_mean"))
    post = F.least(F.greatest(post, F.lit(1e-4)), F.lit(1 - 1e-4))
    base = min(max(top, 1e-4), 1 - 1e-4)
    return paths.select("host", "path", (F.log(post / (1 - post)) - F.lit(float(np.log(base / (1 - base))))).alias("shift"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", sample: int = SAMPLE, features: int = FEATURES) -> DataFrame:
    """(doc_id, p_quality, p_toxic, kept) of each row; kept: quality likely, toxicity not."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    model = Classifier.fit(rows.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"), sample, features)
    scored = staged(evidence(rows, model), "evidence")
    q = posteriors(scored, "quality").select(F.col("host").alias("g_host"), F.col("path").alias("g_path"), F.col("shift").alias("shift_q"))
    t = posteriors(scored, "toxic").select(F.col("host").alias("t_host"), F.col("path").alias("t_path"), F.col("shift").alias("shift_t"))
    groups = q.join(t, F.col("g_host").eqNullSafe(F.col("t_host")) & F.col("g_path").eqNullSafe(F.col("t_path"))).drop("t_host", "t_path")
    groups = staged(groups, "path-posteriors").withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "quality"), F.lit(SALT)).cast("int"))
    both = salted.join(groups, F.col("host").eqNullSafe(F.col("g_host")) & F.col("path").eqNullSafe(F.col("g_path")) & (F.col("salt") == F.col("g_salt")))
    p = lambda a, b: 1 / (1 + F.exp(-(F.col(a) + F.col(b))))
    out = both.select("doc_id", p("quality", "shift_q").alias("p_quality"), p("toxic", "shift_t").alias("p_toxic"))
    return out.withColumn("kept", (F.col("p_quality") >= 0.5) & ((F.col("p_toxic") < 0.5) | ((F.col("p_toxic") == 0.5) & F.lit(not model.weights.weights))))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
