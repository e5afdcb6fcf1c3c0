"""Bigram scores from a log-frequency Bloom filter.

A count c is stored as its level 1 + floor(2 log2 c): the key is entered once per level up to that one, each time under
other hash functions, so a probe climbs from level 1 until a level is missing. All probes of a key fall in one segment of the
filter. The filter has ``BITS_PER_TOKEN`` bits for each training token at every size, so fill and false positive rate stay as
they are. No task holds more than one segment: keys are entered and probed where their segment is.

One pass over the texts stores blocks: the distinct words of some documents with their training counts, and all tokens as
numbers of these words. The rest works on blocks:

1. Words of all blocks meet by hash; their exact counts c, the total N and the distinct number V go back to the blocks.
2. Keys of words and word pairs with their training counts in a block, sorted and packed, meet by hash range; each range sums its
   counts, sets its segment of the filter and returns to each block the levels its keys climb to, held-out texts' keys too. The
   number of ranges follows the input, so a range stays small.
3. With the exact counts, each block gives the base score; with the levels, the model's: p(w | h) is the mix of
   the pair share c(h w) / c(h) with weight ``mix`` and of the smoothed word share (c(w) + 1) / (N + V + 1), all
   counts read from the filter, N being the sum of what it returns for the words.

A text's first word follows the end token. Defined results: a null or empty text has only its end token. A null id trains as the empty
string. Repeated rows count each. Without training documents N and V are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import checked_partitions, read_table, staged, text_or_empty, total_bytes
from panelmill.llm.shingles import MIX, mixed, word_hashes, words

END = b"\n"  # no word holds it
BLOCK_BYTES = 8 << 20
BYTES_PER_RANGE = 8 << 20
BITS_PER_TOKEN = 12
PROBES = 4
MIXTURE = 0.4
KEY_BITS = 44
LEVELS = 128

#: The count a level stands for: the mean of the counts that have it.
LEVEL_COUNTS = np.array([0.0] + [
    float(np.mean(np.arange(np.ceil(2 ** ((q - 1) / 2)), np.ceil(2 ** (q / 2))))) if q < 40 and np.ceil(2 ** ((q - 1) / 2)) < np.ceil(2 ** (q / 2)) else 2 ** ((q - 0.5) / 2)
    for q in range(1, LEVELS)])


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(counts) + 1e-9).astype(np.int64)


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, one plane per byte, so that the empty high bytes cost nothing."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _word_parts(found: list[bytes], ranges: int) -> list[tuple[int, np.ndarray]]:
    """(part, places) of a block's words: words meet by hash, in the block's order inside a part."""
    part = (word_hashes(found) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
    return [(int(part[g[0]]), g) for g in groups]


def token_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, held, sizes, tokens, words, counts): rows of some documents, their tokens as numbers of their words."""
    kind = "block long, ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary, counts binary, trained long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0

        def block(rows: list[tuple[int, bool, list[bytes]]]) -> pa.RecordBatch:
            number: dict[bytes, int] = defaultdict(lambda: len(number))
            parts = [np.fromiter(map(number.__getitem__, found), np.uint32, len(found)) for _, _, found in rows]
            tokens = np.concatenate(parts)
            train = np.repeat([not held for _, held, _ in rows], [len(p) for p in parts])
            counts = np.bincount(tokens[train], minlength=len(number)).astype(np.uint32)
            return pa.RecordBatch.from_pylist([{
                "block": task << 32 | serial, "ids": [r[0] for r in rows], "held": [r[1] for r in rows], "sizes": [len(p) for p in parts],
                "tokens": _pack(tokens), "words": zstandard.ZstdCompressor(level=1).compress(b" ".join(number)), "counts": _pack(counts), "trained": int(train.sum())}],
                schema=pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("trained", pa.int64())]))

        rows, total = [], 0
        for batch in batches:
            for key, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                found = words(text)
                found.append(END)
                rows.append((key, held, found))
                total += len(text or b"") + 64
                if total >= BLOCK_BYTES:
                    yield block(rows)
                    rows, total, serial = [], 0, serial + 1
        if rows:
            yield block(rows)

    crc = F.crc32(text_or_empty(F.col("doc_id").cast("string")).cast("binary"))
    return docs.select("doc_id", "text", (crc % 7 == 2).alias("held")).mapInArrow(run, kind)


def _words(batch, i: int) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(batch.column("words")[i].as_py()).split(b" ")


def exact_counts(blocks: DataFrame, ranges: int) -> DataFrame:
    """(block, part, counts, n, v, q): exact counts of a block's words by part, and each part's totals once (block null)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _words(batch, i)
                counts = _unpack(batch.column("counts")[i].as_py(), np.uint32)
                groups = _word_parts(found, ranges)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("block")[i].as_py()] * len(groups), pa.int64()), pa.array([p for p, _ in groups], pa.int32()),
                    pa.array([zstandard.ZstdCompressor(level=1).compress(b" ".join([found[k] for k in g])) for _, g in groups], pa.binary()),
                    pa.array([_pack(counts[g]) for _, g in groups], pa.binary())], names=["block", "part", "words", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = defaultdict(int)
        plain = zstandard.ZstdDecompressor()
        rows = [(b, p, plain.decompress(w).split(b" "), c) for b, p, w, c in zip(*(table.column(c).to_pylist() for c in ("block", "part", "words", "counts")))]
        for _, _, found, counts in rows:
            for w, c in zip(found, _unpack(counts, np.uint32).tolist()):
                total[w] += c
        seen = np.array([c for c in total.values() if c], np.int64)
        out = [(b, p, _pack(np.fromiter(map(total.__getitem__, found), np.int64)), None, None, None) for b, p, found, _ in rows]
        out.append((None, None, None, int(seen.sum()), len(seen), float(LEVEL_COUNTS[levels(seen)].sum()) if len(seen) else 0.0))
        return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate((
            ("block", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("q", pa.float64())))})

    dealt = blocks.select("block", "words", "counts").mapInArrow(deal, "block long, part int, words binary, counts binary")
    return dealt.groupBy("part").applyInArrow(add, "block long, part int, counts binary, n long, v long, q double")


def pair_keys(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(before * MIX + hashes) >> np.uint64(64 - KEY_BITS)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes + MIX) >> np.uint64(64 - KEY_BITS)


def _before(tokens: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The token before each; the end token before the first of a document."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = end
    return out


def _positions(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Bits of a key in its segment at a level, one per hash function."""
    h = mixed(keys * np.uint64(LEVELS) + np.uint64(level))
    step = mixed(h) | np.uint64(1)
    for _ in range(PROBES):
        yield (h % np.uint64(bits)).astype(np.int64)
        h = h + step


def segment_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of the key space; ``ranges`` is a power of two."""
    return (keys >> np.uint64(KEY_BITS - int(ranges).bit_length() + 1)).astype(np.int64)


def block_keys(hashes: np.ndarray, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Keys of a block's tokens: those of their pairs, then those of its words."""
    return np.concatenate((pair_keys(hashes[tokens], hashes[before]), word_keys(hashes)))


def filter_levels(blocks: DataFrame, ranges: int, bits: int) -> DataFrame:
    """(block, part, levels): levels that the sorted keys of a block climb to in a segment of ``bits`` bits of the filter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _words(batch, i)
                tokens = _unpack(batch.column("tokens")[i].as_py(), np.uint32)
                sizes = np.array(batch.column("sizes")[i].as_py())
                train = np.repeat(~np.array(batch.column("held")[i].as_py()), sizes)
                before = _before(tokens, sizes, found.index(END))
                keys, back = np.unique(block_keys(word_hashes(found), tokens, before), return_inverse=True)
                counts = np.bincount(back[:len(tokens)][train], minlength=len(keys)) + np.bincount(back[len(tokens):][tokens[train]], minlength=len(keys))
                part = segment_of(keys, ranges)
                cuts = np.flatnonzero(np.diff(part)) + 1
                edges = [0, *cuts.tolist(), len(keys)]
                rows = []
                for lo, hi in zip(edges, edges[1:]):
                    if hi > lo:
                        other = np.flatnonzero(counts[lo:hi] != 1).astype(np.uint32)
                        rows.append((batch.column("block")[i].as_py(), int(part[lo]), _pack_sorted(keys[lo:hi]), _pack(other), _pack(counts[lo:hi][other].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                    names=["block", "part", "keys", "other", "counts"])

    def fill(table: pa.Table) -> pa.Table:
        each, counts = [], []
        for raw, other, many in zip(*(table.column(c).to_pylist() for c in ("keys", "other", "counts"))):
            part = _unpack_sorted(raw)
            c = np.ones(len(part), np.int64)
            c[_unpack(other, np.uint32)] = _unpack(many, np.uint32)
            each.append(part)
            counts.append(c)
        keys, back = np.unique(np.concatenate(each), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, np.concatenate(counts))
        found = filter_climb(segment_bits(keys[total > 0], levels(total[total > 0]), bits), keys).astype(np.uint8)[back]
        ends = np.cumsum([len(k) for k in each])
        return pa.table({
            "block": table.column("block"), "part": table.column("part"),
            "levels": pa.array([_pack(found[hi - len(k):hi]) for k, hi in zip(each, ends)], pa.binary())})

    packed = blocks.select("block", "held", "sizes", "tokens", "words").mapInArrow(count, "block long, part int, keys binary, other binary, counts binary")
    return packed.groupBy("part").applyInArrow(fill, "block long, part int, levels binary")


def segment_bits(keys: np.ndarray, top: np.ndarray, bits: int) -> np.ndarray:
    """A segment that holds distinct keys up to their levels, packed in bytes, as the one row of an array."""
    segment = np.zeros(bits, bool)
    for level in range(1, int(top.max(initial=0)) + 1):
        keys, top = keys[top >= level], top[top >= level]
        for at in _positions(keys, level, bits):
            segment[at] = True
    return np.packbits(segment, bitorder="little").reshape(1, -1)


def filter_climb(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels that the filter returns: a key climbs while all its bits of the next level are set."""
    ranges, width = bloom.shape
    flat, bits = bloom.ravel(), width * 8
    level = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    base = segment_of(keys, ranges) * width if ranges > 1 else np.zeros(len(keys), np.int64)
    for q in range(1, LEVELS):
        alive = np.ones(len(live), bool)
        for at in _positions(keys[live], q, bits):
            alive &= (flat[base[live] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        live = live[alive]
        level[live] = q
        if not len(live):
            break
    return level


def filter_counts(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts that the filter returns."""
    return LEVEL_COUNTS[filter_climb(bloom, keys)]


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mix: float = MIXTURE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = staged(token_blocks(rows), "token-blocks")
    size = total_bytes(rows)
    parts = checked_partitions(size, BYTES_PER_RANGE)
    exact = staged(exact_counts(blocks, parts), "word-counts")
    n, v, q = exact.where("block is null").agg(F.sum("n"), F.sum("v"), F.sum("q")).first()
    n, v, q = int(n or 0), int(v or 0), float(q or 0.0)
    ranges = 1 << (parts - 1).bit_length()
    bits = max(64, BITS_PER_TOKEN * n // ranges // 8 * 8)
    climbed = filter_levels(blocks, ranges, bits)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        part, counted, level = (right.column(c).to_pylist() for c in ("part", "counts", "levels"))
        # The levels of the block's sorted keys: segments are ranges of keys, in order.
        seen = np.concatenate([_unpack(z, np.uint8) for _, z in sorted((p, z) for p, z in zip(part, level) if z is not None)]) if left.num_rows else None
        for i in range(left.num_rows):
            found = _words(left, i)
            hashes = word_hashes(found)
            tokens = _unpack(left.column("tokens")[i].as_py(), np.uint32)
            sizes = np.array(left.column("sizes")[i].as_py())
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            counts = np.zeros(len(found), np.int64)
            places = dict(_word_parts(found, parts))
            for k, c in zip(part, counted):
                if c is not None:
                    counts[places[k]] = _unpack(c, np.int64)
            base = np.add.reduceat((np.log10(counts + 1.0) - np.log10(n + v + 1.0))[tokens], starts)
            known = np.add.reduceat((counts > 0)[tokens].astype(np.int64), starts)
            before = _before(tokens, sizes, found.index(END))
            read = LEVEL_COUNTS[seen][np.unique(block_keys(hashes, tokens, before), return_inverse=True)[1]]
            pair, single = read[:len(tokens)], read[len(tokens):]
            context = np.maximum(single[before], pair)
            share = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
            plain = ((single + 1) / (q + v + 1))[tokens]
            model = np.add.reduceat(np.log10(np.where(context > 0, mix * share + (1 - mix) * plain, plain)), starts)
            out.append(pa.table({
                "doc_id": left.column("ids")[i].values, "held_out": left.column("held")[i].values, "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(sizes), n)), "base_score": pa.array(base), "score": pa.array(model)}))
        return pa.concat_tables(out)

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    parts_of = exact.where("block is not null").select("block", "part", "counts", F.lit(None).cast("binary").alias("levels"))
    parts_of = parts_of.unionByName(climbed.select("block", "part", F.lit(None).cast("binary").alias("counts"), "levels"))
    return blocks.select("block", "ids", "held", "sizes", "tokens", "words").groupBy("block").cogroup(parts_of.groupBy("block")).applyInArrow(run, kind)


def op7_lm_scores(spark, sf_dir: str) -> DataFrame:
    return scores(read_table(spark, sf_dir, "documents"))
