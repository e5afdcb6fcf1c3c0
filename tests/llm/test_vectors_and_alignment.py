"""Vector codes, token alignment and the learned neighbour index against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from panelmill.llm import alignment, learned_index, vector_codes
from panelmill.llm.queries import QUERIES

import brute

DOCUMENTS = brute.rough_documents()
KEY = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
EMBEDDING_SCHEMA = "vec_id long, embedding array<float>, label int, q string, error string, part string, code string"


def rough_vectors(n: int = 400, dims: int = 16, seed: int = 3) -> list[tuple]:
    """Clusters, a common vector, near copies, ties, and rows that cannot take part."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    x = np.round(centres[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, dims)), 3).astype(np.float32)
    x[50:150] = x[7]
    x[150:160] = x[8] + np.float32(0.001)
    rows = [(i, [float(v) for v in x[i]], None if i % 7 == 0 else i % 3, "x", "x", "x", "x") for i in range(n)]
    odd = [None, [], [0.0] * dims, [1.0] * (dims - 1), [None, *[1.0] * (dims - 1)], [math.nan, *[1.0] * (dims - 1)], [math.inf, *[1.0] * (dims - 1)]]
    rows += [(1000 + i, v, 1, "x", "x", "x", "x") for i, v in enumerate(odd)]
    rows += [rows[40], rows[40], (None, rows[3][1], None, "x", "x", "x", "x")]
    return rows


VECTORS = rough_vectors()


def usable(row, zero: bool = True) -> bool:
    v = row[1]
    return v is not None and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and (zero or any(v))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(VECTORS, EMBEDDING_SCHEMA).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame(DOCUMENTS, brute.DOCUMENT_SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], EMBEDDING_SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], brute.DOCUMENT_SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_token_alignment", "op13_neighbours"])
def test_empty_tables_give_empty_results(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


# Vector codes ---------------------------------------------------------------------------------------------------


def product_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if usable(r)), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(4096 * c) for c in r[1]]))
    x = np.array([[math.floor(4096 * c) for c in r[1]] for r in kept], dtype=object).reshape(len(kept), parts, -1)
    books = [[x[i, p] for i in range(min(entries, len(kept)))] for p in range(parts)]
    for step in range(rounds + 1):
        codes, errors = [], []
        for row in x:
            far = [[int(((row[p] - e) ** 2).sum()) for e in books[p]] for p in range(parts)]
            codes.append([d.index(min(d)) for d in far])
            errors.append(sum(map(min, far)))
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [row[p] for row, c in zip(x, codes) if c[p] == e]
                    if mine:
                        books[p][e] = np.array([int(s) // len(mine) for s in sum(mine)], dtype=object)
    sums = Counter()
    for r, e in zip(kept, errors):
        sums[r[2]] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in code), e, sums[r[2]], digest) for r, code, e in zip(kept, codes, errors)]


def test_orchard_finds_the_nearest_entry():
    rng = np.random.default_rng(0)
    for _ in range(200):
        k, w = int(rng.integers(1, 40)), int(rng.integers(1, 5))
        table, x = rng.integers(-4, 5, (k, w)), rng.integers(-6, 7, (60, w))
        far = ((x[:, None] - table[None]) ** 2).sum(axis=2)
        entry, distance = vector_codes.Orchard(table).nearest(x, int(rng.integers(0, k)))
        assert (entry == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_orchard_measures_few_entries():
    rng = np.random.default_rng(1)
    table = rng.integers(-1000, 1000, (256, 2))
    search = vector_codes.Orchard(table)
    touched = np.zeros(1)
    real = search.entries
    class Counted(np.ndarray):
        def __getitem__(self, at):
            touched[0] += np.size(at) if isinstance(at, np.ndarray) else 0
            return np.asarray(self).__getitem__(at)
    search.entries = real.view(Counted)
    search.nearest(rng.integers(-1000, 1000, (500, 2)))
    assert touched[0] < 0.3 * 500 * 256


def test_vector_codes(spark, folder):
    got = sorted((tuple(r) for r in QUERIES["op11_vector_codes"](spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=KEY)
    assert got == sorted(product_codes(VECTORS), key=KEY)


def test_few_vectors_give_small_codebooks(spark, tmp_path):
    rows = VECTORS[:5] + VECTORS[:1]
    spark.createDataFrame(rows, EMBEDDING_SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()), key=KEY)
    assert got == sorted(product_codes(rows), key=KEY) and all(r[2] == 0 for r in got)


def test_decoded_vectors_are_near(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = vector_codes.quantized(table, "vec_id", "embedding", "label", 16)
    books = vector_codes.fit_codebooks(rows)
    coded = vector_codes.encode(rows, books)
    error = {r.vec_id: r.error for r in coded.collect()}
    for r in vector_codes.decode(coded, books).collect():
        if r.vec_id is not None and r.vec_id < 400:
            x = np.floor(np.array(VECTORS[r.vec_id][1]) * 4096)
            assert round(float(((x - np.array(r.vector) * 4096) ** 2).sum())) == error[r.vec_id]


def test_components_too_large_are_refused(spark):
    rows = spark.createDataFrame([(1, [1e30] * 8, 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.quantized(rows, "vec_id", "embedding", "label", 8).collect()


# Alignment --------------------------------------------------------------------------------------------------------


def aligned(texts):
    """Per text: (n_a, n_b, groups, links, digest, link pairs), by the libraries and plain loops."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_file, b_file = alignment.default_paths()
    coder = Tokenizer.from_file(a_file)
    coder.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=b_file)
    of = alignment.byte_level_alphabet()
    assert public_tokenizers.path("byte_bpe_50k.json") == a_file
    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = coder.encode(" " + (text or ""), add_special_tokens=False).ids
        b = model.encode(text or "")
        bytes_a = [bytes(of[c] for c in coder.id_to_token(i)) for i in a]
        pieces = [model.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            out.append((0, 0, 0, 0, "", []))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in bytes_a]).tolist(), np.cumsum([len(t) for t in bytes_b]).tolist()
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(cut) + 1, ends_b.index(cut) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        where = {e: k for k, e in enumerate(ends_b)}
        links = [(a[k], b[where[e]]) for k, e in enumerate(ends_a) if e in where]
        out.append((len(a), len(b), len(groups), len(links), brute.digest(";".join(groups)), links))
    return out


ODD_TEXTS = ["<|endoftext|> and <s> </s>", "▁marked▁", "a\0b", "   leading and trailing   ", "\n\n\n", "あい \U0001F600\U0001F680", "ﬁ ǆ Å", " ", "x" * 5000, "word " * 60_000]


def test_token_alignment(spark, folder, tmp_path):
    rows = DOCUMENTS + [(500 + i, t, *DOCUMENTS[1][2:]) for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, brute.DOCUMENT_SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = aligned([r[1] for r in rows])
    counts = Counter(link for f in found for link in f[5])
    most = Counter()
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    want = [(r[0], *f[:5], sum(counts[x] == most[x[1]] for x in f[5]), sum(counts[x] for x in f[5])) for r, f in zip(rows, found)]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = [tuple(r) for r in QUERIES["op12_token_alignment"](spark, str(tmp_path)).select(*names).collect()]
    assert sorted(got, key=KEY) == sorted(want, key=KEY)
    assert any(f[0] == 0 and t for f, t in zip(found, [r[1] for r in rows]))


def test_lockstep_takes_every_common_end():
    rng = random.Random(4)
    for _ in range(200):
        total = rng.randint(1, 300)
        ends = [np.array(sorted({*rng.sample(range(1, total + 1), rng.randint(0, total - 1)), total})) for _ in range(2)]
        step = rng.choice([3, 50, 1000])
        limits = np.array([*range(step, total, step), total])
        i, j = alignment.lockstep(*ends, limits)
        common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert ends[0][i].tolist() == common and ends[1][j].tolist() == common


def test_aligned_documents_keep_ids_and_links(spark):
    docs = spark.createDataFrame([(1, "Straße and naïve words"), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align_documents(docs, *alignment.default_paths()).collect()}
    va, vb = alignment.vocabularies(*alignment.default_paths())
    one = rows[1]
    assert va.bytes_of(one.a) == vb.bytes_of(one.b) == " Straße and naïve words".encode()
    for i, j in zip(one.link_a, one.link_b):
        assert va.bytes_of(one.a[:i + 1]) == vb.bytes_of(one.b[:j + 1])
    assert (one.link_a[-1], one.link_b[-1]) == (len(one.a) - 1, len(one.b) - 1)
    assert all(list(rows[k][c]) == [] for k in (2, 3) for c in ("a", "b", "link_a", "link_b"))


def test_every_linkable_pair_shares_its_last_bytes():
    paths = alignment.default_paths()
    va, vb = alignment.vocabularies(*paths)
    keys = alignment.linkable_pairs(*paths)
    rng = np.random.default_rng(5)
    for key in rng.choice(keys, 2000).tolist():
        a, b = va.table[key >> alignment.SHIFT], vb.table[key & ((1 << alignment.SHIFT) - 1)]
        assert a.endswith(b) or b.endswith(a)
    known = set(keys.tolist())
    for a, b in zip(rng.integers(0, len(va.table), 200_000).tolist(), rng.integers(0, len(vb.table), 200_000).tolist()):
        if va.table[a].endswith(vb.table[b]) or vb.table[b].endswith(va.table[a]):
            assert a << alignment.SHIFT | b in known


# Neighbours ---------------------------------------------------------------------------------------------------------


def nearest(rows, k=20, every=20):
    kept = {(r[0], tuple(np.float32(c) for c in r[1])) for r in rows if r[0] is not None and usable(r, zero=False)}
    out = {}
    for i, v in kept:
        if i % every == 0:
            score = lambda w: sum(float(a) * float(b) for a, b in zip(v, w))
            out[i] = sorted((-score(w), j) for j, w in kept if j != i)[:k]
    return out


def test_neighbours_are_nearly_all_found(spark, folder):
    want = nearest(VECTORS)
    rows = QUERIES["op13_neighbours"](spark, folder).collect()
    got = {q: sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q) for q in {r.query_id for r in rows}}
    assert set(got) == set(want)
    found = total = 0
    for q, best in want.items():
        assert [r[0] for r in got[q]] == list(range(1, len(best) + 1))
        order = [(-round(s, 9), i) for _, i, s in got[q]]
        assert order == sorted(order) and q not in {i for _, i, _ in got[q]}
        scores = {i: -s for s, i in best}
        assert all(abs(scores.get(i, s) - s) < 1e-12 for _, i, s in got[q])
        total += len(best)
        found += len({i for _, i, _ in got[q]} & set(scores))
    assert found >= 0.9 * total


def test_few_rows_give_all_candidates(spark, tmp_path):
    rows = [*VECTORS[:6], VECTORS[20], VECTORS[20], VECTORS[403]]
    spark.createDataFrame(rows, EMBEDDING_SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(r.query_id for r in QUERIES["op13_neighbours"](spark, str(tmp_path)).collect())
    assert got == {0: 6, 20: 6}


def test_blocks_and_parts_do_not_change_the_best(spark, folder, monkeypatch):
    monkeypatch.setattr(learned_index, "BLOCK_ROWS", 30)
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    vectors = learned_index.usable(table, "vec_id", "embedding", 16).cache()
    index = learned_index.LearnedIndex.build(vectors, 20, target=1.0)
    assert index.parts > 1
    got = {}
    for r in index.search(learned_index.query_rows(vectors, 20), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = nearest(VECTORS)
    same = sum([i for _, i in sorted(got[q])] == [i for _, i in best] for q, best in want.items())
    assert same >= 0.9 * len(want)


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((8, 12)) * 3, 50, axis=0) + 0.3 * rng.standard_normal((400, 12))
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    near = np.argsort(-score, axis=1)[:, :10]
    part = learned_index.balanced_partition(near, 8)
    assert set(np.bincount(part, minlength=8)) == {50}
    assert (part[:, None] == part[near]).mean() > 0.8
