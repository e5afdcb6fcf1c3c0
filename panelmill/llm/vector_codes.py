"""Product codes of vectors, with Orchard's search for the nearest codebook entry.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts. Each part position has a codebook of few
entries. A round assigns every part to its nearest entry (squared distance, ties to the lower index) and moves each entry to the
floored mean of its parts. Everything is integer arithmetic, so the result does not depend on how rows are dealt.

Orchard's search keeps for every entry the list of all entries by distance from it. A part starts at some entry and reads that
entry's list; an entry not yet visited is measured and marked; a nearer one becomes the current entry and its list is read from
the start. The search ends at the first listed entry more than twice the current distance away: no entry beyond can be nearer,
nor as near. Parts of a batch move in lockstep, one list position a step; finished ones are taken out.

A round is one map-only pass and a sum of at most parts * entries * width numbers per task. Only the codebooks, whose size is fixed by
parameters, reach the driver and are sent to the tasks.

Defined results: a vector that is null or holds null or non-finite components is dropped, and so is one whose length is not the most
frequent one (``dims`` states it otherwise). Fewer kept vectors than entries give a smaller codebook; equal starting entries stay, and
the lower one takes the parts. Repeated rows and ids count each; a null id is kept and sorts last, equal ids sort by their vector. Labels
may be null. An empty table gives an empty result. A length that the number of parts does not divide, and components whose squared
distances do not fit 64 bits, are errors. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import read_table, staged
from panelmill.llm.vectors import common_size, matrix_of

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of one common label meet their label's sum in this many places.
SALTS = 32


class Orchard:
    """Nearest entry of a small integer table."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.lists, axis=1)

    def nearest(self, x: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, the lower index on ties."""
        n, size = len(x), len(self.entries)
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        current = np.full(n, start)
        best = ((x - self.entries[start]) ** 2).sum(axis=1)
        at = np.zeros(n, dtype=np.int64)
        visited = np.zeros((n, size), dtype=bool)
        visited[:, start] = True
        live = np.arange(n)
        while live.size:
            live = live[at[live] < size]
            live = live[self.apart[current[live], at[live]] <= 4 * best[live]]
            entry = self.lists[current[live], at[live]]
            at[live] += 1
            fresh = ~visited[live, entry]
            rows, entry = live[fresh], entry[fresh]
            visited[rows, entry] = True
            distance = ((x[rows] - self.entries[entry]) ** 2).sum(axis=1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (entry < current[rows]))
            rows = rows[better]
            current[rows], best[rows], at[rows] = entry[better], distance[better], 0
        return current, best


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``: integers after scaling."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def searches(self) -> list[Orchard]:
        return [Orchard(part) for part in self.entries]


def quantized(df: DataFrame, vec_id: str, vector: str, label: str | None, dims: int, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the usable rows, q being the scaled and floored components."""
    most = int(np.sqrt(2.0**61 / max(dims, 1))) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix_of(batch.column("v"), dims)
            x = np.floor(x * scale)
            if x.size and np.abs(x).max() > most:
                raise ValueError(f"a scaled component is beyond {most}: squared distances would not fit 64 bits")
            kept = batch.take(pa.array(rows))
            q = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * dims, pa.int32()), pa.array(x.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), q], names=["vec_id", "label", "q"])

    rows = df.select(F.col(vec_id).alias("vec_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q array<long>")


def starting_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids: [part, entry, position]."""
    first = [r["q"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(entries).collect()]
    width = len(first[0]) // parts if first else 1
    if first and width * parts != len(first[0]):
        raise ValueError(f"{len(first[0])} components cannot be cut into {parts} equal parts")
    return np.array(first, dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: all parts to their nearest entries, entries to the floored means of their parts."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = books.searches()
        sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            x = np.asarray(batch.column("q").flatten()).reshape(-1, parts, width)
            for p, search in enumerate(searches):
                entry, _ = search.nearest(x[:, p])
                np.add.at(sums[p], entry, np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], axis=1))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], names=["at", "v"])

    total = np.zeros((parts, entries, width + 1), dtype=np.int64)
    for row in rows.select("q").mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total.ravel()[row["at"]] = row["v"]
    count = total[:, :, width:]
    return Codebooks(np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books.entries))


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``quantized`` rows. Rounds that would change nothing any more are not run."""
    books = Codebooks(starting_entries(rows, parts, entries))
    for _ in range(rounds):
        last, books = books, moved(rows, books)
        if np.array_equal(last.entries, books.entries):
            break
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, codes, error): entry index of each part, and the squared distance summed over parts."""
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = books.searches()
        for batch in batches:
            x = np.asarray(batch.column("q").flatten()).reshape(-1, parts, width)
            found = [search.nearest(x[:, p]) for p, search in enumerate(searches)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * parts, pa.int32()), pa.array(codes.ravel()))
            error = pa.array(sum(d for _, d in found))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists, error], names=["vec_id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def decode(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): the entries that the codes name, unscaled."""
    table = (books.entries / scale).tolist()
    entries = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in part]) for part in table])
    return coded.select("vec_id", F.flatten(F.transform("codes", lambda c, p: entries[p][c])).alias("vector"))


def with_label_sums(coded: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` summed over equal labels beside each row, null labels together; a common label's rows meet it in many places."""
    totals = coded.groupBy(F.col("label").alias("__label")).agg(F.sum(value).alias(out))
    totals = totals.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)).cast("int"))
    met = F.col("label").eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__place"))
    return rows.join(totals, met).drop("__label", "__place", "__salt")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    dims = common_size(table, "embedding")
    rows = staged(quantized(table, "vec_id", "embedding", "label", dims), "quantized")
    books = fit_codebooks(rows)
    coded = with_label_sums(staged(encode(rows, books), "coded"), "error", "label_error")
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
