"""Nearest neighbours by learned partitions.

A bounded sample of the vectors gives a neighbour graph (largest inner products), made in blocks by the tasks. The graph is halved again
and again: a random walk kept inside each part spreads a value over its vertices, the part is cut at the value's middle, and
pairs of vertices of both halves change sides while that removes edges. All parts stay of equal size. A small network learns from the sample,
for each vector, the shares of its neighbours in the parts.

Every vector is then indexed under its most probable part; a query is sent to its most probable parts, as many as
held-out vectors of the sample need to find TARGET of their neighbours, and all vectors in them are measured exactly.

Equal vectors are one entry of the index, with the smallest ids that a result can need, so a vector that a third of all rows share is measured
once. Parts and their queries meet in blocks of bounded size. A query skips what is below its best ``k + 1`` of the
sample in these parts, which cannot be among its best of them.

Defined results: a vector that is null, zero, of another length than the most frequent one, or that holds null or non-finite components takes
no part, nor does a row with a null id. Rows with equal id and vector count once; different vectors under one id are different rows,
and a query's own rows are all those of its id. A query with fewer than ``k`` candidates gets all of them. Ties go to the smaller id.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.llm.common import read_table, staged
from panelmill.llm.vectors import common_size, matrix_of

#: Vectors that graph, partition and classifier are fitted on, and how many of them are held out to choose the number of parts probed.
FIT_ROWS, HELD_OUT = 16_384, 1_024
#: Edges of a vertex; sample vectors that a part has at least; share of neighbours that held-out vectors must find.
EDGES, PART_ROWS, TARGET = 10, 64, 0.97
#: Vectors of a part, and queries, that meet in one task.
BLOCK_ROWS = 8_192
#: Rows of one common query vector meet its neighbours in this many places.
SALTS = 16


def lists_of(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def usable(df: DataFrame, vec_id: str, vector: str, dims: int) -> DataFrame:
    """(vec_id, v) of the rows that take part, components as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix_of(batch.column("v"), dims)
            some = (x != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows[some])), lists_of(x[some])], names=["vec_id", "v"])

    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")).where("vec_id is not null")
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<double>").dropDuplicates()


def entries(vectors: DataFrame, ids: int) -> DataFrame:
    """(entry, v, ids): different vectors, each with its smallest ids; the limit is applied before rows are shuffled."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.withColumn("__k", place).where(F.col("__k") <= ids)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.monotonically_increasing_id())


def neighbour_graph(sample: DataFrame, matrix: np.ndarray, edges: int) -> np.ndarray:
    """Positions in ``matrix`` of the nearest other rows of each of its rows, nearest first; ``sample`` has the same rows as (at, v)."""
    shared = sample.sparkSession.sparkContext.broadcast(matrix)
    width = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = shared.value
        for batch in batches:
            at, x = np.asarray(batch.column("at")), rows_of(batch.column("v"), width)
            for k in range(0, len(at), 512):
                near = x[k:k + 512] @ whole.T
                near[np.arange(len(near)), at[k:k + 512]] = -np.inf
                found = np.argpartition(-near, edges - 1, axis=1)[:, :edges]
                found = np.take_along_axis(found, np.argsort(-np.take_along_axis(near, found, axis=1), axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at[k:k + 512]), lists_of(found)], names=["at", "near"])

    table = sample.mapInArrow(run, "at long, near array<long>").toArrow()
    out = np.empty((len(matrix), edges), dtype=np.int64)
    out[np.asarray(table.column("at"))] = rows_of(table.column("near").combine_chunks(), edges)
    return out


def rank_in(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Place of each element among those of its group, by ``keys``, the last of which counts most."""
    order = np.lexsort((*keys, group))
    sizes = np.bincount(group)
    out = np.empty(len(group), dtype=np.int64)
    out[order] = np.arange(len(group)) - (np.cumsum(sizes) - sizes)[group[order]]
    return out


def balanced_partition(near: np.ndarray, parts: int, seed: int = 1, walk: int = 60, rounds: int = 12) -> np.ndarray:
    """Part of each vertex; ``parts`` is a power of two, and sizes differ by one at each halving."""
    n, edges = near.shape
    rng = np.random.default_rng(seed)
    one, other = np.repeat(np.arange(n), edges), near.ravel()
    one, other = np.r_[one, other], np.r_[other, one]
    part = np.zeros(n, dtype=np.int64)
    for level in range(int(math.log2(parts))):
        count = 1 << level
        inside = part[one] == part[other]
        a, b = one[inside], other[inside]
        degree = np.bincount(a, minlength=n) + 1e-9
        mass = np.bincount(part, weights=degree, minlength=count)
        x = rng.standard_normal(n)
        for _ in range(walk):
            x = 0.5 * x + 0.5 * np.bincount(a, weights=x[b], minlength=n) / degree
            x -= (np.bincount(part, weights=x * degree, minlength=count) / mass)[part]
            x /= np.sqrt(np.bincount(part, weights=x * x, minlength=count) + 1e-300)[part]
        side = (rank_in(part, x) >= (np.bincount(part, minlength=count)[part] + 1) // 2).astype(np.int64)
        for _ in range(rounds):
            gain = np.bincount(a, weights=np.where(side[a] != side[b], 1.0, -1.0), minlength=n)
            place = rank_in(2 * part + side, -gain)
            best = np.full((count, 2, place.max() + 1), -np.inf)
            best[part, side, place] = gain
            pays = best.sum(axis=1) > 0
            # Half of the paying pairs at a time: the gain of each was taken with all others at rest.
            limit = (pays.sum(axis=1) + 1) // 2
            move = place < limit[part]
            if not move.any():
                break
            side = np.where(move, 1 - side, side)
        part = 2 * part + side
    return part


@dataclass(frozen=True)
class Router:
    """One hidden layer of rectified units, then a score for each part."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        scale = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.maximum((x / scale) @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the most probable first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def train_router(x: np.ndarray, shares: np.ndarray, hidden: int = 128, epochs: int = 25, batch: int = 256, rate: float = 2e-3, seed: int = 1) -> Router:
    """Cross-entropy against the shares of each row's neighbours in the parts, by Adam steps."""
    rng = np.random.default_rng(seed)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    dims, parts = x.shape[1], shares.shape[1]
    weights = [rng.standard_normal((dims, hidden)) * 3 * math.sqrt(2 / dims), np.zeros(hidden), rng.standard_normal((hidden, parts)) / math.sqrt(hidden), np.zeros(parts)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            rows = order[k:k + batch]
            inner = np.maximum(x[rows] @ weights[0] + weights[1], 0)
            z = inner @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            to_z = (p - shares[rows]) / len(rows)
            to_inner = (to_z @ weights[2].T) * (inner > 0)
            step += 1
            for w, g, m, v in zip(weights, (x[rows].T @ to_inner, to_inner.sum(axis=0), inner.T @ to_z, to_z.sum(axis=0)), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def parts_for(rows: int) -> int:
    """A power of two near a quarter of the root of the rows, so far as the sample can tell as many apart."""
    wanted = 1 << max(0, round(math.log2(max(math.sqrt(rows) / 4, 1))))
    return min(wanted, FIT_ROWS // PART_ROWS)


@dataclass(frozen=True)
class LearnedIndex:
    """``rows`` are (part, entry, v, ids); ``sample`` are the vectors it was fitted on, ``sample_part`` the parts they are indexed under."""

    rows: DataFrame
    router: Router | None
    parts: int
    probes: int
    sample: np.ndarray
    sample_part: np.ndarray
    ids: int

    @classmethod
    def build(cls, vectors: DataFrame, k: int, target: float = TARGET, fit_rows: int = FIT_ROWS) -> LearnedIndex:
        """Index of (vec_id, v) for searches of up to ``k`` neighbours."""
        found = staged(entries(vectors, k + 1), "entries")
        total = found.count()
        share = min(1.0, fit_rows / max(total, 1))
        drawn = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))
        sample = _matrix(found.where(drawn).select("v").toArrow())
        parts = parts_for(len(sample) if share == 1.0 else total)
        router, probes = None, 1
        if parts > 1:
            router, probes = cls._fitted(found.sparkSession, sample, parts, k, target)
        rows = staged(_homed(found, router), "index")
        again = rows.where(drawn).select("part", "v").toArrow()
        return cls(rows, router, parts, probes, _matrix(again), np.asarray(again.column("part")), k + 1)

    @staticmethod
    def _fitted(spark, sample: np.ndarray, parts: int, k: int, target: float) -> tuple[Router, int]:
        # The nearest edges make the graph; all of them are what held-out rows must find.
        frame = spark.createDataFrame(pa.Table.from_arrays([pa.array(np.arange(len(sample))), lists_of(sample)], names=["at", "v"]))
        near = neighbour_graph(frame.repartition(max(1, len(sample) // 1024)), sample, min(max(EDGES, k), len(sample) - 1))
        part = balanced_partition(near[:, :EDGES], parts)
        shares = np.zeros((len(sample), parts))
        np.add.at(shares, (np.repeat(np.arange(len(sample)), min(EDGES, near.shape[1])), part[near[:, :EDGES]].ravel()), 1)
        np.add.at(shares, (np.arange(len(sample)), part), 1)
        shares /= shares.sum(axis=1, keepdims=True)
        held = np.random.default_rng(2).permutation(len(sample))[:min(HELD_OUT, len(sample) // 4)]
        learn = np.setdiff1d(np.arange(len(sample)), held)
        router = train_router(sample[learn], shares[learn])
        home = router.order(sample)[:, 0]
        place = np.argsort(router.order(sample[held]), axis=1)
        needed = np.take_along_axis(place, home[near[held]], axis=1)
        recall = np.array([(needed < m).mean() for m in range(1, parts + 1)])
        return router, int(np.argmax(recall >= target)) + 1

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score) of each row of ``queries`` (vec_id, v): its ``k`` nearest found but for rows of its own id."""
        if k >= self.ids:
            raise ValueError(f"the index holds {self.ids - 1} neighbours")
        best = self._best(queries.select("v").dropDuplicates(), k + 1)
        best = best.withColumn("__place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("v", "__v")
        asked = queries.withColumn("__salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
        met = asked.join(best, (F.col("v") == F.col("__v")) & (F.col("__salt") == F.col("__place")))
        each = F.flatten(F.transform("best", lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("down"), i.alias("vec_id")))))
        others = F.filter(each, lambda e: e["vec_id"] != F.col("vec_id"))
        nearest = F.slice(F.array_sort(others), 1, k)
        out = met.select(F.col("vec_id").alias("query_id"), F.posexplode(nearest).alias("at", "e"))
        return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.down")).alias("score"))

    def _best(self, asked: DataFrame, wanted: int) -> DataFrame:
        """(v, best): the ``wanted`` best entries of each query vector, as (score, ids)."""
        sizes = {r["part"]: r["count"] for r in self.rows.groupBy("part").count().collect()}
        held = np.array([sizes.get(p, 0) for p in range(self.parts)])
        asked = staged(asked.withColumn("query", F.monotonically_increasing_id()), "asked")
        routed = staged(_routed(asked, self, held, wanted), "routed")
        loads = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
        blocks = lambda n: max(1, -(-n // BLOCK_ROWS))
        cuts = F.array(*[F.struct(F.lit(blocks(sizes.get(p, 0))).alias("rows"), F.lit(blocks(loads.get(p, 0))).alias("asked")) for p in range(self.parts)])
        mine = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        cut = cuts[F.col("part")]
        left = self.rows.withColumn("rb", mine("entry", cut["rows"])).withColumn("qb", every(cut["asked"]))
        right = routed.withColumn("qb", mine("query", cut["asked"])).withColumn("rb", every(cut["rows"]))
        keys = ["part", "rb", "qb"]
        id_kind = self.rows.schema["ids"].dataType
        schema = T.StructType().add("query", "long").add("first", id_kind.elementType).add("score", "double").add("ids", id_kind)
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_measured(wanted), schema)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))
        best = found.withColumn("__k", place).where(F.col("__k") <= wanted).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("best"))
        return asked.join(best, "query").select("v", "best")


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return rows_of(column, len(column[0]) if len(column) else 1)


def _homed(found: DataFrame, router: Router | None) -> DataFrame:
    """(part, entry, v, ids): every entry under its most probable part."""
    shared = found.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.zeros(batch.num_rows, dtype=np.int32)
            if shared.value is not None and batch.num_rows:
                part = shared.value.order(rows_of(batch.column("v"), shared.value.hidden.shape[0]))[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), *(batch.column(c) for c in ("entry", "v", "ids"))], names=["part", "entry", "v", "ids"])

    return found.mapInArrow(run, T.StructType([T.StructField("part", T.IntegerType()), *(found.schema[c] for c in ("entry", "v", "ids"))]))


def _routed(asked: DataFrame, index: LearnedIndex, held: np.ndarray, wanted: int) -> DataFrame:
    """(part, query, v, floor): each query under the parts it is sent to, at least so many that they hold ``wanted`` entries.

    ``floor`` is its ``wanted``-th best score in the sample's vectors of these parts, less what rounding may differ.
    """
    shared = asked.sparkSession.sparkContext.broadcast((index.router, index.probes, index.sample, index.sample_part, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, probes, sample, sample_part, held = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                x = rows_of(some.column("v"), sample.shape[1])
                order = router.order(x) if router is not None else np.zeros((len(x), 1), dtype=np.int64)
                enough = (np.cumsum(held[order], axis=1) < wanted).sum(axis=1) + 1
                row, place = np.nonzero(np.arange(order.shape[1]) < np.maximum(enough, probes)[:, None])
                floor = np.full(len(x), -np.inf)
                if len(sample) >= wanted:
                    sent = np.zeros(order.shape, dtype=bool)
                    sent[row, order[row, place]] = True
                    near = np.where(sent[:, sample_part], x @ sample.T, -np.inf)
                    floor = -np.partition(-near, wanted - 1, axis=1)[:, wanted - 1] - _slack(x, sample)
                taken = some.take(pa.array(row))
                columns = [pa.array(order[row, place].astype(np.int32)), taken.column("query"), taken.column("v"), pa.array(floor[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "query", "v", "floor"])

    return asked.mapInArrow(run, "part int, query long, v array<double>, floor double")


def _slack(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """More than two ways of summing an inner product can differ by."""
    longest = np.sqrt((rows * rows).sum(axis=1).max()) if len(rows) else 0.0
    return 1e-12 * np.sqrt((x * x).sum(axis=1)) * longest


def _measured(wanted: int):
    """Best entries of one block for each of its queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "first", "score", "ids"]
        left, right = left.combine_chunks(), right.combine_chunks()
        of_ids = left.schema.field("ids").type
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], of_ids.value_type), pa.array([], pa.float64()), pa.array([], of_ids)], names=names)
        width = len(left.column("v")[0])
        rows, asked = rows_of(left.column("v").combine_chunks(), width), rows_of(right.column("v").combine_chunks(), width)
        lists = left.column("ids").combine_chunks()
        first = lists.flatten().take(pa.array(np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64)) - np.asarray(lists.value_lengths())))
        rank = pd.Series(first.to_pandas()).rank(method="first").to_numpy()
        floor = np.asarray(right.column("floor"))
        take_q, take_r, scores = [], [], []
        for k in range(0, len(asked), 256):
            x = asked[k:k + 256]
            near = x @ rows.T
            least = np.maximum(floor[k:k + 256], -np.inf)
            if rows.shape[0] > wanted:
                least = np.maximum(least, -np.partition(-near, wanted - 1, axis=1)[:, wanted - 1] - _slack(x, rows))
            q, r = np.nonzero(near >= least[:, None])
            score = (x[q] * rows[r]).sum(axis=1)
            order = np.lexsort((rank[r], -score, q))
            q, r, score = q[order], r[order], score[order]
            begin = np.searchsorted(q, q)
            kept = np.arange(len(q)) - begin < wanted
            take_q.append(q[kept] + k)
            take_r.append(r[kept])
            scores.append(score[kept])
        q, r = pa.array(np.concatenate(take_q)), pa.array(np.concatenate(take_r))
        return pa.table([right.column("query").take(q), first.take(r), pa.array(np.concatenate(scores)), lists.take(r)], names=names)

    return run


def query_rows(vectors: DataFrame, every: int) -> DataFrame:
    return vectors.where(F.col("vec_id") % every == 0)


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    vectors = staged(usable(table, "vec_id", "embedding", common_size(table, "embedding")), "vectors")
    index = LearnedIndex.build(vectors, 20)
    return index.search(query_rows(vectors, 20), 20)
