"""Byte-level BPE by backtracking over longest matches.

Tokens are bytes, mapped one to one to Latin-1 characters, so that a pyahocorasick automaton can find all tokens of a
piece in one scan. Encoding walks left to right: it takes the longest token at the position that is compatible with the
token before it; when none is left, it steps back over the last token and tries that one's next shorter prefix. A bit
per position remembers ends that led nowhere, so that each is tried once and the work is linear in the piece. Two adjacent
tokens are compatible when merging their bytes alone would give just these two; the answer is memoised per pair. The
result is the very sequence which the rank-ordered merges give.

A text is cut by the vocabulary's pattern first; each piece is encoded alone. Frequent pieces are kept in a bounded
memo per worker. Documents are encoded where they are read: no shuffle, one batch in memory at a time.

Defined results: a null text is the empty text (no ids, no bytes). Any text decodes to its UTF-8 bytes. Repeated rows
each get a result. An empty table gives an empty result. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import read_table

MEMO_PIECES = 400_000
MEMO_PIECE_BYTES = 48


class _Memo(dict):
    """Pieces seen, with their ids; emptied when full. Long pieces are not kept."""

    def __init__(self, bpe: BytePairEncoder):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass")
        found = tuple(self.bpe.encode_piece(raw))
        if len(raw) <= MEMO_PIECE_BYTES:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[text] = found
        return found


class BytePairEncoder:
    """Encoder and decoder for ranks given as one ``base64 rank`` pair a line."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, ranks.splitlines()))
        self.tokens = {rank: token for rank, token in pairs}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        ids = {token: rank for rank, token in pairs}
        for rank, token in pairs:
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.length = {rank: len(token) for rank, token in pairs}
        # The next shorter token that starts each token.
        self.shorter = {}
        for rank, token in pairs:
            self.shorter[rank] = next((ids[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ids), None)
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank, token in pairs:
            self.halves[rank] = self._halves(rank, token, ids)
        self.fits.clear()
        self.memo = _Memo(self)
        self.digits = {rank: str(rank) for rank, _ in pairs}

    def _halves(self, rank: int, token: bytes, ids: dict[bytes, int]) -> tuple[int, int]:
        """The two tokens whose merge made this one; the token itself twice for single bytes."""
        left = self.shorter[rank]
        while left is not None:
            right = ids.get(token[self.length[left]:])
            if right is not None and left < rank and right < rank and self._compatible(left, right):
                self.merged[left, right] = rank
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merges leave ``left`` and ``right`` side by side: undo merges at the seam, latest first, and look for an earlier one across it."""
        limit = 1 << 60
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                limit, inner = left, self.halves[left][1]
                if inner == left:
                    limit, inner = right + 1, self.halves[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                limit, inner = right + 1, self.halves[right][0]
                if inner == right:
                    limit, inner = left, self.halves[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def compatible(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= MEMO_PIECES:
                self.fits.clear()
            known = self.fits[left, right] = self._compatible(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest: list[int | None] = [None] * n
        reach = [0] * n
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > reach[start]:
                longest[start], reach[start] = rank, size
        out: list[int] = []
        open_end = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0] if n else None
        while at < n:
            last = out[-1] if out else None
            while token is not None:
                end = at + self.length[token]
                if open_end[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    at, token = end, longest[end] if end < n else None
                    break
                token = self.shorter[token]
            else:
                if last is None:
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_end[at] = 0
                out.pop()
                at -= self.length[last]
                token = self.shorter[last]
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(ranks: bytes, pattern: str) -> BytePairEncoder:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(ranks, pattern)
    return _ENCODERS[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def default_vocabulary() -> tuple[bytes, str]:
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) or, with ``digests``, (doc_id, n_tokens, ids_sha256, decoded_sha256) of each row.

    The vocabulary is broadcast: its size is that of the given file, not of the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(*shared.value)
        tail = ["ids_sha256", "decoded_sha256"] if digests else ["ids"]
        for batch in batches:
            counts, first, second = [], [], []
            for value in batch.column("text"):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids))
                if digests:
                    first.append(hashlib.sha256(" ".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                    second.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                else:
                    first.append(ids)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64())]
            columns += [pa.array(first, pa.string()), pa.array(second, pa.string())] if digests else [pa.array(first, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *tail])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, {tail}")


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(*shared.value)
        for batch in batches:
            texts = [bpe.decode(value.as_py() or []).decode("utf-8", "replace") for value in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    ranks, pattern = default_vocabulary()
    return encode_documents(read_table(spark, sf_dir, "documents"), ranks, pattern, digests=True)
