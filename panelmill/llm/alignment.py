"""Alignment of the tokens of two vocabularies over the same bytes.

Both token sequences of a text cover the same bytes. Where a token of A and a token of B end at the same byte, the text can be cut for
both: the tokens between two cuts are a group, and the two tokens that end together are a link.

The merge runs in lockstep. Texts of a batch are cut at every few hundred bytes into lanes, so that long and short texts give lanes of about
one length; one NumPy state vector holds the A and B pointer of every lane. A step compares the two ends of all lanes, emits a link and a
cut where they agree, moves the pointer that lies behind (both on a cut), and takes finished lanes out.

Two tokens that end together hold the same last bytes, so the shorter is a suffix of the longer. The pairs that can ever be linked
therefore follow from the vocabularies alone (``linkable_pairs``), and corpus-wide link counts are one number for each: a table whose
size does not grow with the corpus, summed per task first and sent to all tasks.

Texts are encoded where they are read, a bounded number of bytes at a time. The only shuffle is that of the counts.

Defined results: a text that is null, empty, or whose tokens of either vocabulary do not give back its bytes has no tokens, no
groups and no links. Special tokens' strings are plain text. Repeated rows each get a result, and each counts. A null id is passed on. An empty
table gives an empty result; the length of a text is not bounded. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import read_table, staged

#: Bytes of text merged at once, and bytes of a lane.
BATCH_BYTES = 1 << 18
LANE_BYTES = 1 << 9
#: A and B ids of a pair as one number.
SHIFT = 20
BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


class Tokens:
    """A vocabulary's encoder and the bytes of each of its ids."""

    def __init__(self, encode, table: Sequence[bytes]):
        self.encode, self.table = encode, list(table)
        self.sizes = np.array([len(t) for t in self.table], dtype=np.int64)
        digits = [str(i).encode() for i in range(len(self.table))]
        width = max(map(len, digits)) + 1
        self.digits = np.array([np.frombuffer(d.ljust(width, b"."), np.uint8) for d in digits])
        self.shown = np.array([len(d) for d in digits])

    def bytes_of(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def byte_level_alphabet() -> dict[str, int]:
    """Character of each byte: printable Latin-1 characters stand for themselves, the others for 256 and up in their order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(others)}}


def byte_level_tokens(path: str) -> Tokens:
    """Byte-level BPE of a tokenizer file, its ids being the ranks of its merges, for a text with a space before it."""
    import public_tokenizers

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    of = byte_level_alphabet()
    ranks = {bytes(of[c] for c in token): rank for token, rank in vocabulary.items()}
    coder = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return Tokens(lambda texts: [coder.encode_ordinary(" " + t) for t in texts], table)


def piece_tokens(path: str) -> Tokens:
    """Pieces of a sentencepiece model, which puts a space before a text by itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    raw = [BYTE_PIECE.fullmatch(p) for p in pieces]
    table = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for p, m in zip(pieces, raw)]
    return Tokens(lambda texts: model.encode(texts, num_threads=1), table)


@functools.lru_cache(maxsize=4)
def vocabularies(path_a: str, path_b: str) -> tuple[Tokens, Tokens]:
    """One pair per worker process."""
    return byte_level_tokens(path_a), piece_tokens(path_b)


@functools.lru_cache(maxsize=4)
def linkable_pairs(path_a: str, path_b: str) -> np.ndarray:
    """Sorted keys of all pairs of ids of which one's bytes end with the other's: the only ones that can end together."""
    a, b = vocabularies(path_a, path_b)
    keys = set()
    for longer, shorter, key in ((a.table, b.table, lambda x, y: x << SHIFT | y), (b.table, a.table, lambda x, y: y << SHIFT | x)):
        ids: dict[bytes, list[int]] = {}
        for i, token in enumerate(shorter):
            ids.setdefault(token, []).append(i)
        for i, token in enumerate(longer):
            for k in range(len(token)):
                keys.update(key(i, j) for j in ids.get(token[k:], ()))
    return np.array(sorted(keys), dtype=np.int64)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the A and B tokens that end together, in order.

    Ends rise over the whole batch. ``limits`` are the byte offsets where lanes end; a lane has the tokens that end in it.
    """
    stop_a, stop_b = np.searchsorted(ends_a, limits, "right"), np.searchsorted(ends_b, limits, "right")
    i, j = np.r_[0, stop_a][:-1], np.r_[0, stop_b][:-1]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        live = (i < stop_a) & (j < stop_b)
        if not live.all():
            i, j, stop_a, stop_b = i[live], j[live], stop_a[live], stop_b[live]
        if not i.size:
            break
        a, b = ends_a[i], ends_b[j]
        cut = a == b
        links.append((i[cut], j[cut]))
        i, j = i + (a <= b), j + (b <= a)
    if not links:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at_a, at_b = np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links])
    order = np.argsort(at_a)
    return at_a[order], at_b[order]


@dataclass
class Aligned:
    """Tokens of a batch of texts one after the other; ``text_a[k]`` to ``text_a[k + 1]`` are the A tokens of text ``k``."""

    a: np.ndarray
    b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    text_link: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    def group_strings(self, va: Tokens, vb: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """``a,a|b;a|b,b`` of all texts as bytes one after the other, and where each text starts; each has one more byte at its end."""
        n_a, n_b = np.diff(self.link_a, prepend=-1), np.diff(self.link_b, prepend=-1)
        # A group's A tokens come behind the B tokens of all groups before it, its B tokens behind its own A tokens.
        to_a = np.arange(len(self.a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
        to_b = np.arange(len(self.b)) + np.repeat(np.cumsum(n_a), n_b)
        total = len(self.a) + len(self.b)
        width = max(va.digits.shape[1], vb.digits.shape[1])
        letters, sizes, mark = np.zeros((total, width), np.uint8), np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
        letters[to_a, :va.digits.shape[1]], letters[to_b, :vb.digits.shape[1]] = va.digits[self.a], vb.digits[self.b]
        sizes[to_a], sizes[to_b] = va.shown[self.a], vb.shown[self.b]
        mark[to_a[self.link_a]], mark[to_b[self.link_b]] = ord("|"), ord(";")
        letters[np.arange(total), sizes] = mark
        flat = letters[np.arange(width) <= sizes[:, None]]
        starts = np.r_[0, np.cumsum(sizes + 1)][self.text_a + self.text_b]
        return flat, starts


def align_texts(texts: Sequence[str], va: Tokens, vb: Tokens) -> Aligned:
    """A text whose tokens do not give back a space and its bytes has none."""
    all_a, all_b = va.encode(texts), vb.encode(texts)
    lengths = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        raw = (" " + text).encode("utf-8", "surrogatepass")
        if text and va.bytes_of(all_a[k]) == raw and vb.bytes_of(all_b[k]) == raw:
            lengths[k] = len(raw)
        else:
            all_a[k] = all_b[k] = []
    a = np.fromiter(chain.from_iterable(all_a), dtype=np.int64, count=sum(map(len, all_a)))
    b = np.fromiter(chain.from_iterable(all_b), dtype=np.int64, count=sum(map(len, all_b)))
    text_a, text_b = (np.r_[0, np.cumsum([len(ids) for ids in found])].astype(np.int64) for found in (all_a, all_b))
    ends = np.cumsum(lengths)
    lanes = -(-lengths // LANE_BYTES)
    first = np.repeat(ends - lengths, lanes)
    limits = first + (np.arange(len(first)) - np.repeat(np.cumsum(lanes) - lanes, lanes) + 1) * LANE_BYTES
    limits = np.minimum(limits, np.repeat(ends, lanes))
    link_a, link_b = lockstep(np.cumsum(va.sizes[a]), np.cumsum(vb.sizes[b]), limits)
    return Aligned(a, b, text_a, text_b, np.searchsorted(link_a, text_a), link_a, link_b)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of texts of at most BATCH_BYTES together, or of one text."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64).tolist()
    start, size = 0, 0
    for k, more in enumerate(sizes):
        if k > start and size + more > BATCH_BYTES:
            yield start, k - start
            start, size = k, 0
        size += more
    if start < len(sizes):
        yield start, len(sizes) - start


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str, columns, fields: str) -> DataFrame:
    """(doc_id, what ``columns(aligned, va, vb)`` gives for each chunk of texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = vocabularies(path_a, path_b)
        for batch in batches:
            for start, n in chunks(batch.column("text")):
                texts = [t or "" for t in batch.column("text").slice(start, n).to_pylist()]
                arrays = columns(align_texts(texts, va, vb), va, vb)
                ids = batch.column("doc_id").slice(start, n)
                yield pa.RecordBatch.from_arrays([ids, *arrays.values()], names=["doc_id", *arrays])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}")


def align_documents(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b, link_a, link_b): ids of both vocabularies, and the positions in them of the tokens that end together.

    Group ``k`` of a document is what follows link ``k - 1``, link ``k`` included.
    """

    def columns(found: Aligned, va: Tokens, vb: Tokens) -> dict[str, pa.Array]:
        of = np.diff(found.text_link)
        at_a = found.link_a - np.repeat(found.text_a[:-1], of)
        at_b = found.link_b - np.repeat(found.text_b[:-1], of)
        return {
            "a": _lists(found.a, found.text_a, pa.int32()), "b": _lists(found.b, found.text_b, pa.int32()),
            "link_a": _lists(at_a, found.text_link, pa.int32()), "link_b": _lists(at_b, found.text_link, pa.int32()),
        }

    return _aligned(docs, path_a, path_b, doc_id, text, columns, "a array<int>, b array<int>, link_a array<int>, link_b array<int>")


def link_digests(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs), ``pairs`` being the place of each link in ``linkable_pairs``."""

    def columns(found: Aligned, va: Tokens, vb: Tokens) -> dict[str, pa.Array]:
        keys = linkable_pairs(path_a, path_b)
        pairs = np.searchsorted(keys, found.a[found.link_a] << SHIFT | found.b[found.link_b])
        flat, starts = found.group_strings(va, vb)
        whole = memoryview(flat)
        digests = [hashlib.sha256(whole[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]
        links = pa.array(np.diff(found.text_link))
        return {
            "n_a": pa.array(np.diff(found.text_a)), "n_b": pa.array(np.diff(found.text_b)), "n_groups": links, "n_links": links,
            "groups_sha256": pa.array(digests, pa.string()), "pairs": _lists(pairs, found.text_link, pa.int32()),
        }

    return _aligned(docs, path_a, path_b, doc_id, text, columns, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>")


def pair_counts(linked: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, pair, n): how many links of ``link_digests`` hold each pair of ids; pairs never linked are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = linkable_pairs(path_a, path_b)
        counts = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            counts += np.bincount(np.asarray(batch.column("pairs").flatten()), minlength=len(keys))
        at = np.flatnonzero(counts)
        a, b = keys[at] >> SHIFT, keys[at] & ((1 << SHIFT) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, at, counts[at])], names=["a", "b", "pair", "n"])

    parts = linked.select("pairs").mapInArrow(run, "a long, b long, pair long, n long")
    return parts.groupBy("a", "b", "pair").agg(F.sum("n").alias("n"))


def score_links(linked: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``linked`` with n_best and count_sum in place of its pairs.

    n_best are the links whose pair has the highest count of its B id, count_sum sums the counts over all links.
    """
    size = len(linkable_pairs(path_a, path_b))
    table = pair_counts(linked, path_a, path_b)
    best = table.groupBy("b").agg(F.max("n").alias("most"))
    table = table.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")).toArrow()
    # One number and one flag for each pair that the vocabularies allow: bounded by them, not by the corpus.
    counts, flags = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    at = np.asarray(table.column("pair"))
    counts[at], flags[at] = np.asarray(table.column("n")), np.asarray(table.column("best").cast(pa.int64()))
    shared = linked.sparkSession.sparkContext.broadcast((counts, flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, flags = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, of = np.asarray(lists.flatten()), np.asarray(lists.value_lengths(), dtype=np.int64)
            ends = np.cumsum(of)
            sums = [np.r_[0, np.cumsum(x[pairs])] for x in (flags, counts)]
            out = [pa.array(s[ends] - s[ends - of]) for s in sums]
            kept = [batch.column(c) for c in batch.schema.names if c != "pairs"]
            yield pa.RecordBatch.from_arrays([*kept, *out], names=[*(c for c in batch.schema.names if c != "pairs"), "n_best", "count_sum"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in linked.schema.fields if f.name != "pairs")
    return linked.mapInArrow(run, f"{fields}, n_best long, count_sum long")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    paths = default_paths()
    return score_links(staged(link_digests(read_table(spark, sf_dir, "documents"), *paths), "links"), *paths)
