"""Exact substring removal by suffix arrays: bytes of a string of ``length`` that also starts earlier are removed.

Equal strings are brought together by content, so no array of the whole corpus is needed. Of each string's 32-byte
grams the one with the smallest hash is its anchor: equal strings have equal anchors at equal distance. The strings of one
anchor start side by side, so the anchor and the bytes around it (its context) stand for all of them. Steps:

1. Scan the texts once. Of equal contexts in one batch of contexts all but the earliest occurrence repeat it wholly, which needs no more
   looking up; the earliest ones go, packed and without their bytes, to the share of their anchor.
2. A share drops anchors that occur once. Of equal contexts all but the earliest occurrence repeat it wholly.
3. Anchors with several different contexts: bytes are taken from the texts of the earliest occurrences. Shards of such contexts, dealt by anchor, get a suffix array by induced sorting
   and permuted common prefixes; neighbours that share ``length`` bytes are equal strings, of which all but the earliest
   are removed. An anchor with more contexts than a shard should hold is split by the strings themselves: their
   hashes are grouped with partial aggregation, which gives the same answer for any number of contexts.
4. Ranges are joined to their documents and merged.

Order is (document id, start); null ids come last. Defined results: a null text is empty. Rows with equal id and text
tie, so neither removes the other. Texts shorter than ``length`` keep all. An empty table gives an empty result. Long texts
are scanned in pieces, so memory does not grow with a text's length in steps 1 to 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import checked_partitions, discard, read_table, row_key, staged, total_bytes
from panelmill.llm.shingles import MIX, mixed, numbers, planes
from panelmill.llm.suffixes import common_prefixes, suffix_array

LENGTH = 100
GRAM = 32
SHORT_GRAM = 16  # for strings shorter than two grams
PIECE = 2 << 20  # bytes scanned at once
FLUSH = 500_000  # contexts that a task deals at once
CONTEXTS_PER_TASK = 500_000
SHARD_BYTES = 2 << 20
CONTEXTS_PER_ANCHOR = 2_000
FILTER_SIZE = 1 << 20
LAST = (1 << 63) - 1  # place of a null id


def _pieces(texts: list[bytes | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about ``PIECE`` bytes; long texts overlap so that each string is whole in one piece."""
    out, total = [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, PIECE):
            part = text[at:at + PIECE + length - 1]
            out.append((row, at, part))
            total += len(part)
            if total >= PIECE:
                yield out
                out, total = [], 0
    if out:
        yield out


def anchors(buffer: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, number of starts) for runs of strings with one anchor; strings do not cross ``ends``."""
    none = np.zeros(0, np.int64)
    if len(buffer) < length:
        return none.astype(np.uint64), none, none
    h = buffer.astype(np.uint64) + np.uint64(1)
    gram = GRAM if length >= 2 * GRAM else SHORT_GRAM
    step, factor = 1, MIX
    while step < gram:
        h = h[:-step] * factor + h[step:]
        factor = np.uint64((int(factor) ** 2 + 2) & ((1 << 64) - 1))
        step *= 2
    h = mixed(h)
    pos = np.uint64((1 << 28) - 1)
    key = (h & ~pos) | np.arange(len(h), dtype=np.uint64)
    width = length - gram + 1
    low, have = key, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
    valid = np.ones(len(low), bool)
    for end in ends[:-1]:
        valid[max(int(end) - length + 1, 0):int(end)] = False
    at = (low & pos).astype(np.int64)
    fresh = np.empty(len(at), bool)
    fresh[0] = True
    fresh[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    starts = np.flatnonzero(fresh)
    counts = np.diff(np.concatenate((starts, [len(at)])))
    good = valid[starts]
    starts, counts = starts[good], counts[good]
    return h[at[starts]], starts, counts


def _scanned(texts: list[bytes | None], length: int):
    """Per group of pieces: its buffer, anchors, starts, counts, and the row and offset of each start."""
    for pieces in _pieces(texts, length):
        buffer = b"".join(p[2] for p in pieces)
        ends = np.cumsum([len(p[2]) for p in pieces])
        v, starts, counts = anchors(np.frombuffer(buffer, np.uint8), ends, length)
        piece = np.searchsorted(ends, starts, side="right")
        rows = np.array([p[0] for p in pieces])[piece]
        shift = np.array([p[1] for p in pieces])[piece] - (ends - [len(p[2]) for p in pieces])[piece]
        yield buffer, v, starts, counts, rows, starts + shift


def _flushes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[np.ndarray]]:
    """(anchor, context, place of the document, rk, start, starts) of about ``FLUSH`` contexts at a time, in order."""
    held: list[tuple] = []
    total = 0
    for batch in batches:
        doc, rk = pc.fill_null(batch.column("doc_id"), LAST).to_numpy(), batch.column("rk").to_numpy()
        for buffer, v, starts, counts, at, offset in _scanned(batch.column("text").cast(pa.binary()).to_pylist(), length):
            hashes = (xxhash.xxh3_64_intdigest(buffer[s:e]) for s, e in zip(starts.tolist(), (starts + counts + (length - 1)).tolist()))
            held.append((v, np.fromiter(hashes, np.uint64, len(v)), doc[at], rk[at], offset.astype(np.int32), counts.astype(np.int32)))
            total += len(v)
            if total >= FLUSH:
                yield [np.concatenate(z) for z in zip(*held)]
                held, total = [], 0
    if total:
        yield [np.concatenate(z) for z in zip(*held)]


def later_ones(ctx: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of contexts in the order of their hashes, which of these have an equal context at an earlier place)."""
    order = np.lexsort((start, doc, ctx))
    ctx, doc, start = ctx[order], doc[order], start[order]
    heads = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))[:len(ctx)])
    first = np.repeat(heads, np.diff(np.append(heads, len(ctx))))
    return order, (doc != doc[first]) | (start != start[first])


KINDS = {"vs": np.uint64, "ctxs": np.uint64, "docs": np.int64, "rks": np.int64, "sizes": np.int32, "los": np.int32, "starts": np.int32}


def _packed(share: int, v: np.ndarray, ctx: np.ndarray, doc: np.ndarray, rk: np.ndarray, lo: np.ndarray, starts: np.ndarray) -> tuple:
    """A row of contexts, or of ranges that need no anchor; a document that has several in a row is there once."""
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (rk[1:] != rk[:-1]))))
    return (share, *map(planes, (v, ctx, doc[new], rk[new], np.diff(np.append(new, len(doc))).astype(np.int32), lo, starts)))


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    v, ctx, doc, rk, sizes, lo, starts = (np.concatenate([numbers(raw, kind) for raw in table.column(c).to_pylist()]) for c, kind in KINDS.items())
    return [v, ctx, np.repeat(doc, sizes), np.repeat(rk, sizes), lo, starts]


def contexts(rows: DataFrame, length: int) -> DataFrame:
    """(doc, rk, lo, hi, v, ctx, kinds, others): ranges that occur earlier, with null ``v``, and contexts whose anchor has ``kinds`` different ones.

    The latter are there once each, at the earliest place; texts with equal ids that have it at this place as well are ``others``.
    """
    gram = GRAM if length >= 2 * GRAM else SHORT_GRAM
    shares = checked_partitions(2 * total_bytes(rows) // (length - gram + 2), CONTEXTS_PER_TASK)
    none = np.zeros(0, np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, ctx, doc, rk, start, starts in _flushes(batches, length):
            order, later = later_ones(ctx, doc, start)
            gone, left = np.sort(order[later]), np.sort(order[~later])
            out: list[tuple] = []
            if len(gone):
                # Ranges of one text that touch are one.
                d, r, lo, hi = doc[gone], rk[gone], start[gone], start[gone] + starts[gone]
                new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (lo[1:] != hi[:-1]))))
                hi = hi[np.append(new[1:], len(lo)) - 1]
                out.append(_packed(int(d[0] % shares), none, none, d[new], r[new], lo[new], hi - lo[new]))
            share = ((v[left] & np.uint64(0xFFFFFFFF)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(share, kind="stable")
            left, share = left[order], share[order]
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(left)]
            out += [_packed(int(share[a]), *(z[left[a:b]] for z in (v, ctx, doc, rk, start, starts))) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k else pa.int32()) for k in range(len(KINDS) + 1)], names=["share", *KINDS])

    def resolve(table: pa.Table) -> pa.Table:
        bare = pc.equal(pc.binary_length(table.column("vs")), 0)
        ranges = table.filter(bare)
        v, ctx, doc, rk, lo, starts = _unpacked(table.filter(pc.invert(bare))) if len(ranges) < len(table) else [none, none, *[np.zeros(0, np.int64)] * 4]
        # Anchors that occur once are left out.
        order = np.argsort(v, kind="stable")
        same = v[order[1:]] == v[order[:-1]]
        some = order[np.concatenate((same, [False]))[:len(v)] | np.concatenate(([False], same))[:len(v)]]
        v, ctx, doc, rk, lo, starts = (z[some] for z in (v, ctx, doc, rk, lo, starts))
        order, later = later_ones(ctx, doc, lo)
        v, ctx, doc, rk, lo, starts = (z[order] for z in (v, ctx, doc, rk, lo, starts))
        fresh = np.concatenate(([True], ctx[1:] != ctx[:-1]))[:len(ctx)]
        heads = np.flatnonzero(fresh)
        _, which, kinds = np.unique(v[heads], return_inverse=True, return_counts=True)
        several = np.zeros(len(v), np.int64)
        several[heads] = kinds[which]
        held = heads[several[heads] > 1]
        others: dict[int, set] = {}
        for k in np.flatnonzero(~fresh & ~later).tolist():  # texts with one id, of which neither removes the other
            head = int(heads[np.searchsorted(heads, k, side="right") - 1])
            if several[head] > 1 and rk[k] != rk[head]:
                others.setdefault(head, set()).add(int(rk[k]))
        parts = [(doc[later], rk[later], lo[later], lo[later] + starts[later])]
        if len(ranges):
            _, _, d, r, a, n = _unpacked(ranges)
            parts.append((d, r, a, a + n))
        parts.append((doc[held], rk[held], lo[held], lo[held] + starts[held]))
        d, r, a, b = (np.concatenate(z) for z in zip(*parts))
        nothing = len(d) - len(held)
        more = [sorted(others[k]) if k in others else None for k in held.tolist()]
        after = lambda values, kind: pa.concat_arrays([pa.nulls(nothing, kind), pa.array(values, kind)])
        return pa.table({
            "doc": pa.array(d.astype(np.int64)), "rk": pa.array(r.astype(np.int64)), "lo": pa.array(a.astype(np.int32)), "hi": pa.array((b + (length - 1)).astype(np.int32)),
            "v": after(v[held].view(np.int64), pa.int64()), "ctx": after(ctx[held].view(np.int64), pa.int64()), "kinds": after(several[held].astype(np.int32), pa.int32()), "others": after(more, pa.list_(pa.int64()))})

    dealt = rows.mapInArrow(deal, "share int, " + ", ".join(f"{c} binary" for c in KINDS))
    return dealt.groupBy("share").applyInArrow(resolve, "doc long, rk long, lo int, hi int, v long, ctx long, kinds int, others array<long>")


def with_bytes(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` contexts with the bytes of their text; rows that come twice give theirs twice."""
    place = F.coalesce("doc_id", F.lit(LAST)).alias("doc")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_SIZE)).cast("int").alias("slot")
    slots = staged(wanted.select(slot("rk")).distinct(), "wanted-slots")  # at most FILTER_SIZE rows
    texts = rows.select(place, "rk", "text", slot("rk")).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    asked = wanted.groupBy("doc", "rk").agg(F.collect_list(F.struct("v", "ctx", "lo", "hi", "kinds", "others")).alias("asked"))
    kinds = {"doc": pa.int64(), "rk": pa.int64(), "others": pa.list_(pa.int64()), "v": pa.int64(), "ctx": pa.int64(), "start": pa.int32(), "starts": pa.int32(), "kinds": pa.int32(), "bytes": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, rk, text, asked in zip(batch.column("doc").to_pylist(), batch.column("rk").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist()):
                out += [(doc, rk, x["others"], x["v"], x["ctx"], x["lo"], x["hi"] - x["lo"] - (length - 1), x["kinds"], text[x["lo"]:x["hi"]]) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return texts.join(asked, ["doc", "rk"]).select("doc", "rk", "text", "asked").mapInArrow(run, "doc long, rk long, others array<long>, v long, ctx long, start int, starts int, kinds int, bytes binary")


def shard_repeats(length: int):
    """A function of one shard's contexts: (doc, rk, others, lo, hi) ranges of bytes whose strings start earlier elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.unique(table.column("ctx").to_numpy(), return_index=True)[1]))  # rows that come twice
        parts = table.column("bytes").to_pylist()
        sizes = np.array([len(p) for p in parts])
        text = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8).astype(np.int16) + 2
        ends = np.cumsum(sizes + 1)
        text[ends - 1] = 1
        t = np.concatenate((text, np.zeros(1, np.int16)))
        order = suffix_array(t, 258, length)
        owner = np.repeat(np.arange(len(parts)), sizes + 1)
        inside = np.arange(len(text)) - np.repeat(ends - sizes - 1, sizes + 1)
        counts = table.column("starts").to_numpy()
        is_start = inside < counts[owner]
        shared = common_prefixes(t, order, length, np.flatnonzero(is_start))
        # Strings in suffix order; a new class begins where fewer than ``length`` bytes are shared.
        order = order[order < len(text)]
        order = order[is_start[order]]
        place = np.lexsort((table.column("start").to_numpy()[owner] + inside, table.column("doc").to_numpy()[owner]))
        # Equal (doc, start) get equal ranks.
        doc, at = table.column("doc").to_numpy()[owner][place], (table.column("start").to_numpy()[owner] + inside)[place]
        rank = np.empty(len(text), np.int64)
        rank[place] = np.concatenate(([0], np.cumsum((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))))
        heads = np.flatnonzero(np.concatenate(([True], shared[order[1:]] < length)))
        least = np.minimum.reduceat(rank[order], heads)
        number = np.repeat(np.arange(len(heads)), np.diff(np.concatenate((heads, [len(order)]))))
        gone = np.zeros(len(text) + 1, bool)
        gone[order] = rank[order] > least[number]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)))
        lo, hi = edges[::2], edges[1::2]
        of, begin = pa.array(owner[lo]), table.column("start").to_numpy()[owner[lo]] + inside[lo]
        return pa.table({c: table.column(c).take(of) for c in ("doc", "rk", "others")} | {"lo": pa.array(begin.astype(np.int32)), "hi": pa.array((begin + hi - lo + length - 1).astype(np.int32))})

    return run


def split_repeats(hot: DataFrame, length: int) -> DataFrame:
    """The same ranges for contexts of very frequent anchors, by grouping the strings' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc": pa.int64(), "rk": pa.int64(), "others": pa.list_(pa.int64()), "at": pa.int32(), "h1": pa.int64(), "h2": pa.int64()}
        for batch in batches:
            rows = {c: [] for c in kinds}
            for doc, rk, others, start, n, part in zip(*(batch.column(c).to_pylist() for c in ("doc", "rk", "others", "start", "starts", "bytes"))):
                for k in range(n):
                    d = xxhash.xxh3_128_intdigest(part[k:k + length])
                    for c, x in zip(kinds, (doc, rk, others, start + k, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63))):
                        rows[c].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in kinds.items()], names=list(kinds))

    strings = staged(hot.mapInArrow(run, "doc long, rk long, others array<long>, at int, h1 long, h2 long"), "anchor-strings")
    first = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = strings.join(first, ["h1", "h2"]).where(F.struct("doc", "at") > F.col("first"))
    return later.select("doc", "rk", "others", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))


def placed_ranges(rows: DataFrame, length: int, per_anchor: int) -> DataFrame:
    """(doc, rk, ranges), staged: per row the byte ranges (lo, hi) to remove, which may overlap; ``doc`` is the id or ``LAST``."""
    found = staged(contexts(rows, length), "contexts")
    several = staged(with_bytes(rows, found.where("v is not null"), length), "several-contexts")
    usual = several.where(F.col("kinds") <= per_anchor)
    total = usual.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = checked_partitions(total, SHARD_BYTES)
    dealt = usual.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)))
    ranges = dealt.groupBy("shard").applyInArrow(shard_repeats(length), "doc long, rk long, others array<long>, lo int, hi int")
    ranges = ranges.unionByName(split_repeats(several.where(F.col("kinds") > per_anchor), length))
    ranges = staged(ranges.select("doc", F.explode(F.concat(F.array("rk"), F.coalesce("others", F.array().cast("array<long>")))).alias("rk"), "lo", "hi"), "context-ranges")
    discard(several)
    spans = found.where("v is null").select("doc", "rk", "lo", "hi").unionByName(ranges)
    spans = staged(spans.groupBy("doc", "rk").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "removed-ranges")
    discard(found, ranges)
    return spans


def removed_ranges(rows: DataFrame, length: int = LENGTH, per_anchor: int = CONTEXTS_PER_ANCHOR) -> DataFrame:
    """(doc_id, rk, lo, hi): byte ranges to remove, which may overlap; ``rows`` has doc_id, rk and text."""
    spans = placed_ranges(rows, length, per_anchor).withColumn("r", F.explode("ranges"))
    return spans.select(F.nullif("doc", F.lit(LAST)).alias("doc_id"), "rk", "r.lo", "r.hi")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def dedup_substrings(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans) and the remaining bytes, or their SHA-256 with ``digests``, of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(text)).alias("rk"), F.col(text).alias("text"))
    spans = placed_ranges(rows, length, CONTEXTS_PER_ANCHOR)
    place = F.coalesce("doc_id", F.lit(LAST)).alias("doc")
    both = rows.select(place, "doc_id", "rk", "text").join(spans, ["doc", "rk"], "left").select("doc_id", "text", "ranges")
    last = "kept_sha256" if digests else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, counts, kept = [], [], [], []
            for raw, ranges in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("ranges").to_pylist()):
                raw = raw or b""
                gone = merged([(r["lo"], r["hi"]) for r in ranges or []])
                parts, at = [], 0
                for lo, hi in gone:
                    parts.append(raw[at:lo])
                    at = hi
                left = b"".join([*parts, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                counts.append(len(gone))
                kept.append(hashlib.sha256(left).hexdigest() if digests else left)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.string() if digests else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", last])

    return both.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last} {'string' if digests else 'binary'}")


def op4_substring_removal(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"), digests=True)
