"""Near duplicates by a signature-coordinate inverted join.

Every distinct shingle set is a class (copies are counted, not compared). A class has 128 MinHash coordinates. It is
posted under (coordinate, value) pairs of its first 64 coordinates. Two sets of similarity 0.8 agree on 51 of them on
average and on less than 36 with odds of about 1e-6, so two linked classes share a pair among the 64 - 36 + 1 = 29
rarest pairs of either: only this prefix is posted. Rarity comes from counts of hashed pairs (a table of
fixed size), so values that very many documents share come last and are hardly ever posted.

Within a posting list not all pairs are made. First each class meets one centre, the class with most copies; links
join classes into components. Then each class outside a list's largest component meets random members of that
component, other ones on each list. At last classes still apart meet every class of other components on their lists, pairs within a component
being skipped. On longer lists a class's room goes before: shingles that no other class of these lists has cannot be shared, and
a pair whose room is below what a link needs is never made; this is exact, so no link between components is lost. A pair is confirmed if its 128 coordinates agree on 80 or more (odds of loss
about 1e-6 at 0.8) and then on the full shingle sets, which a second pass over the texts makes for the classes in question.

Defined results: null and empty texts and texts without words have an empty set, are linked with nothing and kept. Texts with
fewer words than a shingle have the whole sequence as one. Rows that share an id are one node. A row with a null id has a null component and is
kept. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import read_table
from panelmill.llm.common import staged_in_short_batches as staged
from panelmill.llm.components import components
from panelmill.llm.shingles import mixed, shingle_set

COORDINATES = 128
POSTED = 64
LEAST_POSTED = 36
LEAST_EQUAL = 80
SKETCH = 1_048_583  # buckets of the pair counts
MARKS = 1 << 22  # bits of the filter of classes whose sets are fetched
SHORT_LIST = 8  # lists up to this length are compared outright
RANDOM_MEMBERS = 3  # of a list's largest component, met by the classes outside it
PLACE_WORDS = 32  # longs, whose bits are the places that a set's shingles fall on
LIKELIEST = 8  # of a class's candidates among them, confirmed on full sets

_rng = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The MinHash coordinates of a set that is not empty."""
    low = None
    for i in range(0, len(shingles), 1024):
        part = np.multiply.outer(FACTORS, shingles[i:i + 1024])
        part += SHIFTS[:, None]
        found = part.min(axis=1)
        low = found if low is None else np.minimum(low, found)
    return mixed(low)


def class_key(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, cid, posted, sig): class key and signature; null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, posted, sigs = [], [], [], []
            for text in _texts(batch):
                s = shingle_set(text, size)
                counts.append(len(s))
                if len(s):
                    low = minima(s)
                    keys.append(class_key(s))
                    posted.append(low[:POSTED].astype(np.uint32).view(np.int32))
                    sigs.append((low >> np.uint64(40)).astype(np.uint8).tobytes())
                else:
                    keys.append(None)
                    posted.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.int64()), pa.array(posted, pa.list_(pa.int32())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "cid", "posted", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cid long, posted array<int>, sig binary")


def prefix_postings(classes: DataFrame) -> DataFrame:
    """(elem, cid, rep, copies): each class under its rarest (coordinate, value) pairs."""
    elems = classes.select(F.posexplode("posted").alias("c", "v"))
    elem = F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    counts = elems.select(F.pmod(elem, F.lit(SKETCH)).cast("int").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    table = counts.toArrow()  # at most SKETCH rows
    sketch = np.zeros(SKETCH, np.int64)
    sketch[table.column("b").to_numpy()] = table.column("n").to_numpy()
    shared = classes.sparkSession.sparkContext.broadcast(sketch)
    take = POSTED - LEAST_POSTED + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = shared.value
        places = np.arange(POSTED, dtype=np.int64) << 32
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            values = batch.column("posted").flatten().to_numpy().view(np.uint32).reshape(m, POSTED).astype(np.int64)
            elems = values | places
            order = np.lexsort((elems, counted[elems % SKETCH]), axis=1)[:, :take]
            out = np.take_along_axis(elems, order, axis=1).ravel()
            rows = np.repeat(np.arange(m), take)
            rest = [batch.column(c).take(pa.array(rows)) for c in ("cid", "rep", "copies")]
            yield pa.RecordBatch.from_arrays([pa.array(out), *rest], names=["elem", "cid", "rep", "copies"])

    return classes.select("cid", "rep", "copies", "posted").mapInArrow(run, "elem long, cid long, rep long, copies long")


def agreeing(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose sizes and coordinates allow a link, with the number of equal coordinates."""
    a = classes.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    b = classes.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    met = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, COORDINATES) for c in ("sig_a", "sig_b"))
            equal = (x == y).sum(axis=1)
            keep = equal >= LEAST_EQUAL
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(equal[keep].astype(np.int32))], names=["a", "b", "equal"])

    return met.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, equal int")


class ShingleSets:
    """Full shingle sets of classes, made by a pass over the texts when first asked for."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int):
        self.docs, self.classes, self.size = docs, classes, size
        self.known: DataFrame | None = None

    def of(self, ends: DataFrame) -> DataFrame | None:
        """(cid, shingles) of the classes ``ends`` (cid, distinct), among others."""
        if self.known is not None:
            ends = ends.join(self.known.select("cid"), "cid", "left_anti")
        wanted = staged(self.classes.select("cid", "rep").join(ends, "cid", "left_semi"), "wanted-classes")
        marks = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(MARKS)).cast("int").alias("m")).distinct().toArrow()  # at most MARKS rows
        if marks.num_rows:
            found = staged(self._fetch(marks.column("m").to_numpy()).join(wanted.select("cid"), "cid", "left_semi").dropDuplicates(["cid"]), "shingle-sets")
            self.known = found if self.known is None else self.known.unionByName(found)
        return self.known

    def room(self, ends: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
        """(cid, n, room): how many shingles a class shares at most with any other of ``ends``; only classes that this lets have a link."""
        known = self.of(ends)
        sized = classes.select("cid", "n").join(ends, "cid", "left_semi")
        if known is None:
            return sized.withColumn("room", F.col("n"))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, raw in zip(batch.column("cid").to_pylist(), batch.column("shingles").to_pylist()):
                    s = np.frombuffer(raw, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), key))], names=["s", "cid"])

        each = known.join(ends, "cid", "left_semi").mapInArrow(spread, "s long, cid long")
        alone = each.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("cid").alias("cid")).where("k = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("own"))
        left = sized.join(alone, "cid", "left").select("cid", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("room"))
        return left.where(F.col("room") * 100 >= F.col("n") * percent)

    def places(self, ends: DataFrame) -> DataFrame:
        """(cid, p0, p1, ...): the places that the shingles of a class fall on, as bits."""
        names = [f"p{k}" for k in range(PLACE_WORDS)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.zeros((batch.num_rows, 64 * PLACE_WORDS), bool)
                for row, raw in enumerate(batch.column("shingles").to_pylist()):
                    bits[row, mixed(np.frombuffer(raw, np.uint64)) % np.uint64(64 * PLACE_WORDS)] = True
                longs = np.packbits(bits, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("cid"), *(pa.array(longs[:, k]) for k in range(PLACE_WORDS))], names=["cid", *names])

        return self.of(ends).join(ends, "cid", "left_semi").mapInArrow(run, ", ".join(["cid long", *(f"{c} long" for c in names)]))

    def _fetch(self, marks: np.ndarray) -> DataFrame:
        bits = np.zeros(MARKS, bool)
        bits[marks] = True
        shared = self.docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
        size = self.size
        rows = self.docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).cast("int").alias("m"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = np.unpackbits(shared.value).astype(bool)
            for batch in batches:
                keys, sets = [], []
                batch = batch.filter(pa.array(wanted[batch.column("m").to_numpy()]))
                for text in _texts(batch):
                    s = shingle_set(text, size)
                    if len(s):
                        keys.append(class_key(s))
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "shingles"])

        return rows.where("doc_id is not null").mapInArrow(run, "cid long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * common >= percent * union on the full sets."""
    a = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                union = len(np.unique(both))
                keep.append(100 * (len(both) - union) >= percent * union)
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def linked(shared: DataFrame, classes: DataFrame, sets: ShingleSets, percent: int) -> DataFrame:
    """(node, component) of the classes that have a link."""
    comps = shared.sparkSession.createDataFrame([], "node long, component long")
    share = percent / 100

    def settle(pairs: DataFrame, best: int | None = None) -> None:
        nonlocal comps
        near = staged(agreeing(pairs, classes, share), "agreeing")
        if best:
            # Of many candidates of a class the likeliest; the others stay for later rounds.
            near = staged(near.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("equal", "b")), asc=False), 1, best).alias("s")).select("a", F.explode("s.b").alias("b")), "agreeing")
        known = sets.of(near.select(F.col("a").alias("cid")).union(near.select(F.col("b").alias("cid"))).distinct())
        if known is None:
            return
        found = staged(confirmed(near, known, percent), "links")
        # What is known already enters as stars.
        before = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comps = staged(components(found.unionByName(before)), "components")

    def placed() -> DataFrame:
        return shared.join(comps, shared.cid == comps.node, "left").select("elem", "cid", F.coalesce("component", "cid").alias("comp"))

    centre = shared.groupBy("elem").agg(F.max_by("cid", F.struct("copies", -F.col("rep"))).alias("b"))
    settle(shared.join(centre, "elem").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct())
    rows = staged(placed(), "placed")
    picks = F.array(*[F.min_by("cid", F.xxhash64("cid", "elem", F.lit(seed))) for seed in range(RANDOM_MEMBERS)])
    sizes = rows.groupBy("elem", "comp").agg(F.count(F.lit(1)).alias("n"), picks.alias("picks"))
    top = sizes.groupBy("elem").agg(F.max_by(F.struct("comp", "picks", "n"), F.struct("n", "comp")).alias("t"), F.count(F.lit(1)).alias("comps"))
    top = top.where("comps > 1 and t.n > 2").select("elem", F.col("t.comp").alias("top"), F.explode(F.array_distinct("t.picks")).alias("b"))
    settle(rows.join(top, "elem").where("comp <> top").select(F.col("cid").alias("a"), "b").distinct(), best=LIKELIEST)
    rows = staged(placed(), "placed")
    sizes = rows.groupBy("elem", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("elem").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size"))
    rows = staged(rows.join(top.where("comps > 1").select("elem", "top", "size"), "elem"), "apart")
    short = rows.where(F.col("size") <= SHORT_LIST).select("elem", "cid", "comp", "top", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("room"))
    long = rows.where(F.col("size") > SHORT_LIST).drop("size")
    ends = long.select("cid").distinct()
    room = staged(sets.room(ends, classes, percent), "class-room")
    if room.isEmpty():
        rows = short
    else:
        room = staged(room.join(sets.places(room.select("cid")), "cid"), "class-room")
        rows = short.unionByName(long.drop("n", "room").join(room, "cid"), allowMissingColumns=True)
    met = [c for c in rows.columns if c in ("cid", "comp", "n", "room") or c[0] == "p"]
    minor = rows.where("comp <> top").select("elem", *(F.col(c).alias(f"{c}_a") for c in met))
    others = rows.select("elem", "top", *(F.col(c).alias(f"{c}_b") for c in met))
    apart = [" + ".join(f"bit_count({c}_{x} & ~{c}_{y})" for c in met if c[0] == "p") or "0" for x, y in ("ab", "ba")]
    shared_most = f"least(room_a, room_b, n_a - ({apart[0]}), n_b - ({apart[1]}))"
    fits = f"n_a is null or ({100 + percent} * least(room_a, room_b) >= {percent} * (n_a + n_b) and {100 + percent} * {shared_most} >= {percent} * (n_a + n_b))"
    pairs = minor.join(others, "elem").where(f"comp_a <> comp_b and (comp_b = top or cid_a < cid_b) and ({fits})")
    settle(pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct())
    return comps


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; ids are longs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prof = staged(profiles(rows, size), "profiles")
    some = prof.where("cid is not null and doc_id is not null")
    classes = staged(some.groupBy("cid").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"),
        F.first("posted").alias("posted"), F.first("sig").alias("sig")), "classes")
    postings = staged(prefix_postings(classes), "signature-postings")
    lists = postings.groupBy("elem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("elem")
    shared = staged(postings.join(lists, "elem"), "shared-postings")
    comps = linked(shared, classes, ShingleSets(rows, classes, size), percent)
    # Rows that share an id join their classes, too.
    ids = some.select("doc_id", "cid").distinct().groupBy("doc_id").agg(F.min("cid").alias("a"), F.collect_set("cid").alias("cs")).where(F.size("cs") > 1)
    same = staged(ids.select("a", F.explode("cs").alias("b")).where("a <> b"), "shared-ids")
    if not same.isEmpty():
        comps = staged(components(same.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")
    placed = classes.join(comps, classes.cid == comps.node, "left").select("cid", "rep", F.coalesce("component", "cid").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_class = staged(placed.join(least, "comp").select(F.col("cid").alias("class"), "component_id"), "class-components")
    out = prof.join(of_class, prof.cid == of_class["class"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=4)
