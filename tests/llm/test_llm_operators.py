"""Every operator on rough tables against brute force, on empty tables, and its own laws."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelmill.llm import bpe, common, decontamination, language_model, minhash, passages, quality_classifier, quality_rules, secrets, sharding, substring_dedup, suffixes
from panelmill.llm.queries import QUERIES

import brute

ROWS = brute.rough_documents()
KEY = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)


def tables(spark, folder, rows):
    spark.createDataFrame(rows, brute.DOCUMENT_SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(brute.BENCHMARK if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(r[0], int(i % 3 > 0), int(i % 4 == 0)) for i, r in enumerate(rows)] + ([(3, None, 1)] if rows else [])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(i, [float(i), 1.0, -1.0, 2.0, 0.5, 0.0, 3.0, 1.0], None) for i in range(len(rows))]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def rough(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("rough"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [])


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=KEY)


def want(values):
    return sorted(((r[0], *v) for r, v in zip(ROWS, values)), key=KEY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_contamination(spark, rough):
    df = QUERIES["op1_decontamination"](spark, rough)
    values = [brute.contamination(r[1], brute.BENCHMARK) for r in ROWS]
    assert got(df, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want(values)
    assert any(v[4] for v in values)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green x blue"), (2, "red x x x x x x x green blue"), (3, "blue green red"), (4, None)], "doc_id long, text string")
    query = spark.createDataFrame([("q", w) for w in ("red", "green", "blue", "red")], "query string, term string")
    index = decontamination.PositionalIndex.build(docs, query.select("term"))
    assert {(r.doc_id, r.query) for r in index.near(query, 5).collect()} == {(1, "q"), (3, "q")}


def test_quality_rules(spark, rough):
    df = QUERIES["op3_quality_rules"](spark, rough)
    values = [brute.rule_counts(r[1]) for r in ROWS]
    assert got(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want(values)
    assert df.where("base_failed and kept").count() == 0


def test_common_lines_deplete_documents(spark):
    rng = random.Random(1)
    menu = " ".join(f"menu{i}" for i in range(60))
    rows = [(i, menu + "\n" + brute.sentence(rng, 60).replace("\n", " "), "h") for i in range(12)]
    rows += [(90, menu + " \n" + menu.upper() + "\nown words here", "h"), (91, menu + "\n" + brute.sentence(rng, 60), "other")]
    # A text with many copies does not make its own lines common.
    copied = brute.sentence(rng, 80)
    rows += [(200 + i, copied, "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    v = {r.doc_id: r for r in quality_rules.verdicts(docs, max_docs=5, max_share=0.1).collect()}
    assert not v[90].kept and v[90].n_left == 3
    assert v[91].kept and len(v[91].gone or []) == 0
    assert all(v[i].kept and v[i].n_left < v[i].n_words for i in range(12))
    assert all(v[200 + i].kept and v[200 + i].n_left == v[200 + i].n_words for i in range(30))
    kept = {r.doc_id: r.text for r in quality_rules.apply_rules(docs, max_docs=5, max_share=0.1).collect()}
    assert 90 not in kept and kept[3] == rows[3][1].split("\n", 1)[1] and kept[200] == copied


def test_common_lines_count_every_different_document(spark):
    # One shared line and one own line each; for about half of them the shared line's hash is the smaller one.
    rows = [(k * 100 + i, f"shared line {k}\nown line {k} of {'abcdefghij'[i // 10]} {'abcdefghij'[i % 10]}", f"h{k}") for k in range(20) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    common = quality_rules.common_lines(quality_rules.doc_lines(docs), max_docs=10, max_share=0.1)
    assert {r.host for r in common.collect()} == {f"h{k}" for k in range(20)} and common.count() == 20


def test_substring_removal(spark, rough):
    df = QUERIES["op4_substring_removal"](spark, rough)
    values = brute.substring_removal([r[:2] for r in ROWS])
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want(values)
    assert sum(v[1] for v in values) > 1000


def test_only_contexts_that_tell_apart_are_kept(spark):
    rng = random.Random(83)
    word = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    page, part = word(60), word(30)
    docs = [(i, word(60)) for i in range(30)] + [(i, page) for i in range(30, 36)]
    rows = lambda d: spark.createDataFrame(d, "doc_id long, text string").withColumn("rk", common.row_key(F.col("text")))
    # Texts met once leave nothing, and copies leave the ranges they lose, neither anchors nor bytes.
    found = substring_dedup.contexts(rows(docs), 100).collect()
    assert {(r.doc, r.lo, r.hi) for r in found if r.hi - r.lo == len(page)} <= {(i, 0, len(page)) for i in range(31, 36)}
    assert {r.doc for r in found} == set(range(31, 36)) and all(r.v is None for r in found)
    # Different texts under one id tie where they are equal.
    docs += [(40, part + word(20)), (40, part + word(9)), (40, part + word(9)), (41, word(3) + part + word(4)), (None, part), (None, part)]
    values = brute.substring_removal(docs)
    got = substring_dedup.dedup_substrings(rows(docs).drop("rk"), digests=True).collect()
    assert sorted(map(str, got)) == sorted(map(str, (type(r)(doc_id=i, n_bytes=v[0], n_removed=v[1], n_spans=v[2], kept_sha256=v[3]) for r, (i, _), v in zip(got, docs, values))))


def test_frequent_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CONTEXTS_PER_ANCHOR", 1)
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("rk"), "text")
    spans = substring_dedup.removed_ranges(rows, per_anchor=1).groupBy("doc_id", "rk").agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    removed = Counter()
    for r in spans.collect():
        removed[r.doc_id] += sum(hi - lo for lo, hi in substring_dedup.merged([(x.lo, x.hi) for x in r.r]))
    values = brute.substring_removal([r[:2] for r in ROWS])
    unique = {r[0]: v[1] for r, v in zip(ROWS, values) if r[0] is not None}
    assert {k: v for k, v in removed.items() if k is not None} == {k: v for k, v in unique.items() if v}


@pytest.mark.parametrize("few", [0, 1024])
def test_suffix_arrays(monkeypatch, few):
    monkeypatch.setattr(suffixes, "RECURSIVE_NAMES", few)
    rng = random.Random(few)
    for _ in range(300):
        top = rng.choice([1, 2, 3, 200])
        t = [rng.randint(1, top) for _ in range(rng.randint(1, 50))] + [0]
        order = sorted(range(len(t)), key=lambda i: t[i:])
        a = np.array(t, np.int16)
        assert suffixes.suffix_array(a, top + 1).tolist() == order
        shared = suffixes.common_prefixes(a, np.array(order), 9)
        for x, y in zip(order, order[1:]):
            k = 0
            while k < 9 and max(x, y) + k < len(t) and t[x + k] == t[y + k]:
                k += 1
            assert shared[y] == k


def test_secrets(spark, rough):
    df = QUERIES["op5_secrets"](spark, rough)
    values = [brute.base_secrets(r[1]) for r in ROWS]
    assert got(df, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want(values)
    for r in df.collect():
        assert all(x.count(":") == 2 for x in filter(None, r.spans.split(",")))


def test_random_strings_are_told_from_words(spark):
    rng = random.Random(4)
    symbols = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(rng.choice(symbols) for _ in range(40)) for _ in range(60)]
    keys = [k for k in keys if any(c.isdigit() for c in k)]
    words = ["section12section12section12section1234567", "aaaaaaaaaabbbbbbbbbbccccccccccdddddddddd12", "1111111111111111111111111111111111111111a"] * 4
    docs = spark.createDataFrame([(i, f"see {k} é there", "z") for i, k in enumerate(keys + words)], "doc_id long, text string, spans string").select("doc_id", "text")
    found = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    hits = [any(s.kind == 3 and s.hit == k for s in found[i]) for i, k in enumerate(keys)]
    assert sum(hits) >= 0.8 * len(keys)
    assert not any(s.kind == 3 for i in range(len(words)) for s in found[len(keys) + i])
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert masked[hits.index(True)] == "see <secret> é there"


def test_bpe_equals_the_merges(spark, rough):
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    ranks, pattern = bpe.default_vocabulary()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    values = []
    for r in ROWS:
        ids = plain.encode_ordinary(r[1] or "")
        values.append((len(ids), brute.digest(" ".join(map(str, ids))), brute.digest(r[1] or "")))
    assert got(QUERIES["op6_bpe"](spark, rough), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want(values)
    docs = spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string")
    back = bpe.decode_documents(bpe.encode_documents(docs, ranks, pattern), ranks, pattern)
    assert got(back, "doc_id", "text") == want([(r[1] or "",) for r in ROWS])


def test_bpe_on_odd_strings():
    tiktoken = pytest.importorskip("tiktoken")
    import base64
    ranks, pattern = bpe.default_vocabulary()
    own = bpe.BytePairEncoder(ranks, pattern)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "1", "'s", "!", "中", "\U0001F600", "́", "​", "ing", "\r\n", "'LL", "\x00", "²"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        assert own.encode(s) == plain.encode_ordinary(s)
    for s in ("a" * 3000, " " * 3000, "ab" * 2000, "=" * 999):
        assert own.encode(s) == plain.encode_ordinary(s)


def test_language_model(spark, rough):
    rows = QUERIES["op7_lm_scores"](spark, rough).collect()
    values = brute.lm_base([r[:2] for r in ROWS])
    exact = sorted(((r[0], *v[:4]) for r, v in zip(ROWS, values)), key=KEY)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows), key=KEY) == exact
    assert sorted(round(r.base_score, 6) for r in rows) == pytest.approx(sorted(round(v[4], 6) for v in values), rel=1e-9, abs=2e-6)
    train = [r for r in rows if not r.held_out]
    assert sum(r.score for r in train) > sum(r.base_score for r in train)
    assert all(r.score < 0 for r in rows)


def test_filter_counts():
    keys = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
    counts = np.where(np.arange(4000) % 10 == 0, 37, 1)
    bits = 1 << 17
    segment = np.zeros(bits, bool)
    for q in range(1, int(language_model.levels(counts).max()) + 1):
        for at in language_model._positions(keys[language_model.levels(counts) >= q], q, bits):
            segment[at] = True
    bloom = np.packbits(segment, bitorder="little").reshape(1, -1)
    read = language_model.filter_counts(bloom, keys)
    assert (read >= 1).all() and abs(np.median(read[counts == 37]) / 37 - 1) < 0.25 and np.mean(read[counts == 1] == 1) > 0.9
    assert np.mean(language_model.filter_counts(bloom, keys + np.uint64(12345)) > 0) < 0.05


def test_filter_grows_with_the_input(spark, monkeypatch):
    # Bits for each training token at every size, seen by a session that has tables of 8 million and of 5 billion tokens.
    seen = []
    monkeypatch.setattr(language_model, "filter_levels", lambda blocks, ranges, bits: seen.append(ranges * bits) or blocks.selectExpr("block", "0 as part", "words as levels"))
    monkeypatch.setattr(language_model, "exact_counts", lambda blocks, ranges: blocks.sparkSession.createDataFrame([(None, None, None, n, 10, 1.0)], "block long, part int, counts binary, n long, v long, q double"))
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    for n in (8_000_000, 5_000_000_000):
        language_model.scores(docs)
    assert seen == [12 * 8_000_000, 12 * 5_000_000_000]


def test_filter_levels_of_segments(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BYTES_PER_RANGE", 500)
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 3000)
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, brute.sentence(rng, 200)) for i in range(60)], "doc_id long, text string").repartition(3)
    blocks = language_model.token_blocks(docs).localCheckpoint()
    n = sum(r.trained for r in blocks.select("trained").collect())
    ranges, bits = 64, 12 * n // 64 // 8 * 8
    levels = {}
    for r in language_model.filter_levels(blocks, ranges, bits).collect():
        levels.setdefault(r.block, {})[r.part] = language_model._unpack(r.levels, np.uint8)
    total, right = Counter(), 0
    each = {}
    for r in blocks.collect():
        found = language_model.zstandard.ZstdDecompressor().decompress(r.words).split(b" ")
        hashes, tokens, sizes = language_model.word_hashes(found), language_model._unpack(r.tokens, np.uint32), np.array(r.sizes)
        before = language_model._before(tokens, sizes, found.index(language_model.END))
        train = np.repeat(~np.array(r.held), sizes)
        total.update(language_model.pair_keys(hashes[tokens[train]], hashes[before[train]]).tolist())
        total.update(language_model.word_keys(hashes[tokens[train]]).tolist())
        each[r.block] = np.unique(language_model.block_keys(hashes, tokens, before))
    keys = np.concatenate(list(each.values()))
    read = np.concatenate([np.concatenate([levels[b][p] for p in sorted(levels[b])]) for b in each])
    want = np.array([language_model.levels(np.array([total[k]]))[0] if total[k] else 0 for k in keys.tolist()])
    assert len(read) == len(want) and (read >= want).all() and np.mean(read == want) > 0.95 and len(levels) > 3


def test_sharding(spark, rough):
    rows = QUERIES["op8_sharding"](spark, rough).collect()
    values = [(len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=KEY) == want(values)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))


@pytest.mark.parametrize("leaf, fan_in", [(50, 2), (10_000, 256)])
def test_shards_are_near_equal_at_any_depth(spark, leaf, fan_in):
    rng = random.Random(7)
    rows = [(i, "x" * int(10 ** rng.uniform(1, 3.2)) + str(rng.randint(0, 250))) for i in range(600)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8, groups_per_leaf=leaf, fan_in=fan_in).collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert len(out) == 600 and len(sizes) == 8
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8
    place = {r.doc_id: r.shard for r in out}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, set()).add(place[i])
    assert all(len(s) == 1 for s in groups.values())


def test_near_duplicates(spark, rough):
    df = QUERIES["op10_near_dedup"](spark, rough)
    values = brute.components([r[:2] for r in ROWS], 4)
    assert got(df, "doc_id", "n_shingles", "component_id") == want(values)
    assert got(df, "doc_id", "kept") == want([(r[0] is None or r[0] == v[1],) for r, v in zip(ROWS, values)])


def test_near_duplicates_in_a_large_group(spark):
    rng = random.Random(9)
    base = brute.sentence(rng, 120).split()
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"edit{rng.randint(0, 9999)}" for w in base)) for i in range(160)]
    rows += [(1000 + i, brute.sentence(rng, 80)) for i in range(40)]
    df = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4)
    expected = sorted(((r[0], *v) for r, v in zip(rows, brute.components(rows, 4))), key=KEY)
    assert got(df, "doc_id", "n_shingles", "component_id") == expected


def test_near_copies_below_the_threshold_are_not_paired(spark, monkeypatch):
    """Copies of one text with four or five words changed share most shingles, but few pairs of them are linked."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(10, 190), 4 + i % 2):
            words[k] = f"c{i}x{k}"
        texts.append(" ".join(words))
    made, agreeing = [], minhash.agreeing

    def counted(pairs, classes, share):
        made.append(pairs.count())
        return agreeing(pairs, classes, share)

    monkeypatch.setattr(minhash, "agreeing", counted)
    monkeypatch.setattr(minhash, "SHORT_LIST", 1)
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=4).collect()
    sets = [{tuple(t.split()[k:k + 4]) for k in range(197)} for t in texts]
    component = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = component[a], component[b]
                component = [min(x, y) if c in (x, y) else c for c in component]
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(component))
    assert made[-1] < 100, made


def test_short_batches(spark):
    before = spark.conf.get(common.BATCH_ROWS)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches)
    rows = common.staged_in_short_batches(spark.range(2_500, numPartitions=1).mapInArrow(sizes, "n long"))
    assert sorted(r["n"] for r in rows.collect()) == [500, 1000, 1000]
    assert spark.conf.get(common.BATCH_ROWS) == before


def test_passages(spark, rough):
    rows = QUERIES["op9_fuzzy_passages"](spark, rough).collect()
    words = {r[0]: (r[1] or "").encode().lower().split() for r in ROWS}
    runs = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k:k + 50]), set()).add(i)
    shared = {i for s in runs.values() if len(s - {None}) > 1 for i in s if i is not None}
    assert shared and shared <= {x for r in rows for x in (r.doc_id, r.other_id)}
    for r in rows:
        assert r.doc_id != r.other_id and r.end - r.start >= 50 and r.share >= 0.8


def test_passages_are_found_in_short_batches(spark, monkeypatch):
    seen, stage = [], common.session.staged
    monkeypatch.setattr(common.session, "staged", lambda df, label="stage": seen.append(spark.conf.get(common.BATCH_ROWS)) or stage(df, label))
    text = " ".join(f"w{k}" for k in range(60))
    (r,) = passages.repeated_passages(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
    assert (r["doc_id"], r["other_id"], r["start"], r["end"]) == (2, 1, 0, 60)
    assert set(seen) == {str(common.SHORT_BATCH)}


def test_passages_with_edits(spark):
    rng = random.Random(12)
    passage = brute.sentence(rng, 90).split()
    edited = [w for i, w in enumerate(passage) if i not in (20, 41)]
    edited[30] = "changed"
    edited[60:60] = ["two", "more"]
    docs = spark.createDataFrame([(1, brute.sentence(rng, 40) + " " + " ".join(passage) + " " + brute.sentence(rng, 30)), (2, brute.sentence(rng, 25) + " " + " ".join(edited) + " " + brute.sentence(rng, 50)), (3, brute.sentence(rng, 200))], "doc_id long, text string")
    (r,) = passages.repeated_passages(docs).collect()
    assert (r.doc_id, r.other_id) == (2, 1) and r.end - r.start >= 80 and r.share >= 0.9


def test_passages_at_different_offsets(spark):
    rng = random.Random(21)
    one, two, three = (brute.sentence(rng, 100).split() for _ in range(3))
    other = lambda n: brute.sentence(rng, n).split()
    docs = [one + other(200) + two + other(30) + three, one + other(400) + two + other(3) + three]
    rows = passages.repeated_passages(spark.createDataFrame([(i + 1, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    for start, other_start in ((0, 0), (500, 300), (603, 430)):
        assert any(r.start <= start + 5 and r.end >= start + 95 and r.other_start <= other_start + 5 and r.other_end >= other_start + 95 for r in rows)


@pytest.mark.parametrize("few", [9, 1])
def test_passages_whose_parts_came_first_elsewhere(spark, monkeypatch, few):
    monkeypatch.setattr(passages, "FEW", few)
    rng = random.Random(31)
    word = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage = word(75)
    docs = [word(30) + passage[:49] + word(30), word(20) + passage[27:] + word(30), word(10) + passage + word(40), word(50) + passage + word(10)]
    # Parts that lie between the two texts with the whole passage.
    docs[3:3] = [word(5) + passage[:40] + word(9), word(5) + passage[35:] + word(9)]
    rows = passages.repeated_passages(spark.createDataFrame([(i + 1, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")).collect()
    assert any((r.doc_id, r.other_id) == (6, 3) and r.start <= 50 and r.end >= 125 for r in rows)


def test_frequent_seeds_are_salted(spark, monkeypatch):
    monkeypatch.setattr(passages, "OCCURRENCES_PER_SALT", 5)
    rng = random.Random(32)
    passage = brute.sentence(rng, 80)
    docs = spark.createDataFrame([(i, brute.sentence(rng, 30) + passage + brute.sentence(rng, 30)) for i in range(60)], "doc_id long, text string")
    rows = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in rows if r.other_id == 0} == set(range(1, 60))


@pytest.mark.parametrize("hot", [2_000, 3])
def test_passages_of_frequent_seeds_only(spark, monkeypatch, hot):
    monkeypatch.setattr(passages, "OCCURRENCES_PER_SALT", hot)
    rng = random.Random(71)
    word = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage = word(60)
    copy = [f"edit{k}" if k % 7 == 5 else w for k, w in enumerate(passage)]
    parts = [*range(1, 25), *range(101, 113)]
    docs = [(i, word(30) + (passage[:40] if i % 2 else passage[20:]) + word(20)) for i in parts]
    docs += [(100, word(30) + passage + word(20)), (130, word(30) + copy + word(20))]
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    (r,) = [r for r in rows if (r.doc_id, r.other_id) == (130, 100)]
    assert r.start >= 25 and r.end <= 95 and r.share >= 0.8 and r.class_id == 100
    assert {x for r in rows for x in (r.doc_id, r.other_id)} == {100, 130}


def test_all_pairs_of_texts_with_one_passage_are_listed(spark):
    rng = random.Random(81)
    word = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage, page = word(60), word(900)
    # More texts than seeds are matched in all pairs at once; every copy of the page has other words replaced.
    docs = [(i, word(rng.randint(5, 40)) + passage + word(rng.randint(5, 40))) for i in range(14)]
    docs += [(i, word(rng.randint(1, 9)) + [w if rng.random() > 0.02 else f"edit{i}" for w in page]) for i in range(20, 34)]
    rows = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    pairs = {(j, i) for k in (0, 20) for i in range(k, k + 14) for j in range(i + 1, k + 14)}
    assert {(r.doc_id, r.other_id) for r in rows} == pairs and len(rows) == len(pairs)
    for r in rows:
        assert r.end - r.start >= (60 if r.doc_id < 20 else 850) and r.class_id == (0 if r.doc_id < 20 else 20)


def test_whole_texts_that_repeat_themselves_are_compared_in_cells(monkeypatch):
    rng = np.random.default_rng(82)
    a = np.concatenate((rng.integers(0, 1 << 32, 700), np.full(600, 7))).astype(np.uint32)
    b = np.concatenate((rng.integers(0, 1 << 32, 100), a[:1000])).astype(np.uint32)
    at_once = passages._whole(passages.Seeds(a), passages.Seeds(b), 50, 0.8)
    assert max((e - s, s, o) for s, e, o, *_ in at_once)[0] >= 1000
    monkeypatch.setattr(passages, "MATCHES_AT_ONCE", 100)
    covered = {k for s, e, *_ in passages._whole(passages.Seeds(a), passages.Seeds(b), 50, 0.8) for k in range(s, e)}
    assert covered >= set(range(1000))


def test_ranges_that_may_agree():
    rng = np.random.default_rng(8)
    for _ in range(400):
        size = int(rng.integers(50, 130))
        a = rng.integers(0, 1 << 32, size, dtype=np.uint32)
        edits = rng.permutation(size)[:size // 5]
        if rng.random() < 0.5:  # all edits side by side
            edits = np.arange(size // 5) + rng.integers(0, size - size // 5)
        b = a.copy()
        b[edits] = rng.integers(0, 1 << 32, len(edits), dtype=np.uint32)
        assert passages.may_agree(a, b, 50, 0.8)
    assert not passages.may_agree(a, np.concatenate((a[:30], b[:0], rng.integers(0, 1 << 32, 90, dtype=np.uint32))), 50, 0.8)


def test_words_in_common_are_counted_as_often_as_both_have_them():
    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = (rng.integers(0, rng.integers(2, 40), size).astype(np.uint32) for size in (rng.integers(1, 60), rng.integers(1, 30)))
        size, held = int(rng.integers(1, len(a) + 1)), Counter(b.tolist())
        most = max((Counter(a[i:i + size].tolist()) & held).total() for i in range(len(a) - size + 1))
        assert list(passages.most_in_common(a, b, [size])) == [most]
    # 60 equal words against 35 of them.
    assert not passages.may_agree(np.full(60, 7, np.uint32), np.concatenate((np.full(35, 7), np.arange(100, 130))).astype(np.uint32), 50, 0.8)


def test_chains_left_out_have_no_passage():
    rng = np.random.default_rng(10)
    kept = 0
    for _ in range(25):
        a, b = (np.repeat(rng.integers(0, 9, 10), rng.integers(1, 20, 10)).astype(np.uint32) for _ in range(2))
        if rng.random() < 0.5:
            b = np.where(rng.random(len(a)) < 0.2, rng.integers(0, 9, len(a)), a).astype(np.uint32)
        p, q = (passages.window_hashes(z.astype(np.uint64), passages.SEED) for z in (a, b))
        x, y = np.nonzero(p[:, None] == q)
        if not len(x):
            continue
        runs = passages.fragments(x, y)
        found = [(runs[c][:, [0, 2]].ravel(), runs[c][:, [1, 3]].ravel()) for c in passages.chains(runs)]
        may = passages.chains_that_may_agree(a, b, found, 50, 0.8)
        meets = np.array([bool(passages.aligned(a, b, xs, ys, 50, 0.8)) for xs, ys in found])
        assert (may | ~meets).all() and (not meets.any() or passages.may_agree(a, b, 50, 0.8))
        # Where all matches of a chain are on one diagonal, nothing is aligned in vain.
        assert all(m == n for m, n, (xs, ys) in zip(may, meets, found) if (ys - xs == ys[0] - xs[0]).all())
        kept += meets.sum()
    assert kept


def test_texts_of_repeated_words_give_one_row_of_chains_a_cell(spark, monkeypatch):
    rng = random.Random(73)
    docs = [(i, " ".join(w for _ in range(30) for w in [f"s{rng.randrange(40)}"] * rng.randint(8, 40))) for i in range(24)]
    seen, stage = [], passages.staged

    def keep(df, label):
        out = stage(df, label)
        if label == "chains":
            seen.extend((r.doc_id, r.other_id, r.xs[0] // 256, r.ys[0] // 256) for r in out.collect())
        return out

    monkeypatch.setattr(passages, "staged", keep)
    found = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert seen and len(seen) == len(set(seen))
    texts = {i: t.split() for i, t in docs}
    for r in found:
        assert min(r.end - r.start, r.other_end - r.other_start) >= 50 and r.share >= 0.8
        assert texts[r.doc_id][r.start] == texts[r.other_id][r.other_start]


def test_classes_join_all_texts_that_share_a_passage(spark):
    rng = random.Random(72)
    stock = [[f"s{rng.randint(0, 10**9)}" for _ in range(12)] for _ in range(6)]
    word = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    # All texts have stock lines, all seeds of which are frequent; those with four or more of them in one order share a passage.
    docs, orders = [], [(0, 1, 2, 3, 4), (5, 4, 3, 2, 1, 0), (2, 0, 4, 1, 3, 5)]
    for i in range(90):
        own = orders[i % 3] if i % 5 == 0 else [rng.randrange(6)]
        text = word(15) + sum((stock[k] + (word(1) if i % 2 else []) for k in own), []) + word(25)
        docs.append((i, " ".join(text)))
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    classes = {x: r.class_id for r in rows for x in (r.doc_id, r.other_id)}
    assert classes == {i: {0: 0, 1: 10, 2: 5}[i % 3] for i in range(0, 90, 5)}


@pytest.mark.parametrize("length, every", [(60, 6), (60, 7), (60, 8), (100, 6), (100, 7)])
def test_passages_with_spread_edits(spark, length, every):
    rng = random.Random(length + every)
    word = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    docs = []
    for i in range(40):
        passage = word(length)
        edited = [f"edit{i}x{k}" if k % every == every - 1 else w for k, w in enumerate(passage)]
        docs += [(2 * i, " ".join(word(30) + passage + word(20))), (2 * i + 1, " ".join(word(10) + edited + word(40)))]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(2 * i + 1, 2 * i) for i in range(40)}


def test_chains_against_all_predecessors():
    rng = np.random.default_rng(5)
    for _ in range(30):
        x, y = rng.integers(0, 150, 80), rng.integers(0, 150, 80)
        places = np.unique(np.stack((x, y), axis=1), axis=0)
        runs = passages.fragments(places[:, 0], places[:, 1])
        assert (runs[:, 2] - runs[:, 0] + 1).sum() == len(places)
        g, worth = passages.GAP, []
        for x, y, last, _ in runs.tolist():
            before = [worth[k] - passages.GAP_COST * (x - p + y - q) / 2 for k, (_, _, p, q) in enumerate(runs[:len(worth)].tolist()) if p < x and q < y and x // g - p // g < 2 and y // g - q // g < 2]
            worth.append(last - x + 1 + max(max(before, default=0.0), 0.0))
        found = passages.chains(runs)
        assert sorted(k for c in found for k in c) == list(range(len(runs)))
        best = runs[found[0]]
        gaps = (best[1:, :2] - best[:-1, 2:]).sum() * passages.GAP_COST / 2
        assert (best[1:, :2] > best[:-1, 2:]).all()
        assert np.isclose((best[:, 2] - best[:, 0] + 1).sum() - gaps, max(worth))


def test_longest_stretch_against_all_ranges():
    rng = np.random.default_rng(6)
    for share in (0.5, 0.8, 1.0):
        for _ in range(200):
            equal = rng.uniform(size=rng.integers(1, 60)) < rng.choice([0.3, 0.7, 0.9])
            ranges = [j - i for i in range(len(equal)) for j in range(i + 1, len(equal) + 1) if equal[i] and equal[j - 1] and equal[i:j].sum() >= share * (j - i) - 1e-9]
            i, j = passages.longest_stretch(equal, share)
            assert j - i == max(ranges, default=0)
            assert j == i or (equal[i] and equal[j - 1] and equal[i:j].mean() >= share - 1e-9)


@pytest.mark.parametrize("length, rate", [(50, 0.1), (50, 0.15), (60, 0.15), (75, 0.18), (100, 0.2)])
def test_recall_of_edited_passages(spark, length, rate):
    rng = random.Random(int(length * 100 * rate))
    word = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    docs, meant = [], set()
    while len(meant) < 60:
        passage = word(length)
        edits = [rng.random() < rate for _ in passage]
        # The edited ends are no part of a passage, so both lie on equal words.
        if edits[0] or edits[-1] or sum(edits) > 0.2 * length:
            continue
        edited = [word(1)[0] if e else w for w, e in zip(passage, edits)]
        i = len(docs)
        docs += [(i, " ".join(word(30) + passage + word(20))), (i + 1, " ".join(word(10) + edited + word(40)))]
        meant.add((i + 1, i))
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.other_id) for r in rows if min(r.end - r.start, r.other_end - r.other_start) >= 50 and r.share >= 0.8}
    assert found <= meant and len(found) >= 0.9 * len(meant)


def test_a_bad_middle_leaves_both_passages(spark):
    rng = random.Random(51)
    one, two = brute.sentence(rng, 60).split(), brute.sentence(rng, 70).split()
    docs = [(i, " ".join(one + brute.sentence(rng, 36).split() + two)) for i in (1, 2)]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all((r.doc_id, r.other_id) == (2, 1) for r in rows)
    covered = {k for r in rows for k in range(r.start, r.end)}
    assert {*range(5, 55), *range(101, 161)} <= covered


def test_chains_of_one_document_are_spread(spark, monkeypatch):
    monkeypatch.setattr(passages, "CHAINS_PER_SALT", 10)
    rng = random.Random(41)
    text = brute.sentence(rng, 700)
    docs = spark.createDataFrame([(i, text) for i in range(100)], "doc_id long, text string")
    wanted = spark.createDataFrame([(i, i % 2, 0, 200, 530) for i in range(100)], "chain long, side int, doc_id long, lo int, hi int")
    rows = passages.word_ranges(docs.where("doc_id = 0"), wanted)
    assert "collect_list" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = {}
    for r in rows.collect():
        found.setdefault(r.chain, []).append(r.asDict())
    h = (passages.word_hashes(passages.words(text.encode())) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    assert len(found) == 100 and all(passages.range_words(p, c % 2).tolist() == h[200:530].tolist() for c, p in found.items())
    out = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in out if r.other_id == 0 and (r.start, r.end, r.other_start, r.other_end, r.share) == (0, 700, 0, 700, 1.0)} == set(range(1, 100))


def test_quality_classifier(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic, poor = i % 5 == 0, i % 7 == 0
        text = brute.sentence(rng, 60) + (" vilest scoundrel rascal " if toxic else "") + (" @@@ ### $$$" * 12 if poor else "")
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 9}"))
        if i < 300:
            labels.append((i, int(not poor), int(toxic)))
    rows += [(None, None, None, None), (7, "", "en", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.doc_id is not None and r.doc_id >= 300]
    right = [r.kept == (r.doc_id % 5 != 0 and r.doc_id % 7 != 0) for r in held]
    assert np.mean(right) >= 0.95


def test_long_words_count_whole(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("aeiourstlmn") for _ in range(n))
    word = "x" + letters(1000)
    pieces = list(quality_classifier.pieces_of(word.encode()))
    runs = set().union(*map(quality_classifier.parts_of, pieces))
    assert {f"^{word}$"[i:i + k] for k in (4, 5) for i in range(1003 - k)} <= runs and max(map(len, pieces)) <= 80
    assert list(quality_classifier.pieces_of(b"Two words")) == [b"two", b"words"]
    # Texts without blanks, toxic only far behind the first 80 characters.
    rows = [(i, "\u00a0".join(letters(9) for _ in range(30)) + ("\u00a0vilest\u00a0scoundrel\u00a0" if i % 4 == 0 else "\u00a0") + letters(9), "en", "s") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.p_toxic for r in quality_classifier.classify(docs, labels).collect()}
    assert np.mean([(out[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)]) >= 0.95


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [(i, "big", "a", 3.0 if i % 2 else 1.0, 0.0) for i in range(200)] + [(900 + i, "bad", "a", -3.0, 0.0) for i in range(200)] + [(2000, "one", "a", -3.0, 0.0)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, quality double, toxic double")
    shift = {r.host: r["shift"] for r in quality_classifier.posteriors(scored, "quality").collect()}
    assert shift["bad"] < shift["one"] < shift["big"] and shift["bad"] < -1


def test_pipeline_stages_on_rough_rows(spark, rough):
    import corpus_pipeline
    docs = spark.read.parquet(f"{rough}/documents.parquet")
    limits = {name: stage for name, stage in corpus_pipeline.STAGES}
    kept = limits["quality rules"](spark, docs, rough)
    assert kept.columns == docs.columns
    assert got(kept, "doc_id") == sorted(((r[0],) for r in ROWS if not brute.rule_counts(r[1])[5]), key=KEY)
    single = limits["near duplicates"](spark, docs, rough)
    values = brute.components([r[:2] for r in ROWS], 5)
    ids = sorted({r[0] for r, v in zip(ROWS, values) if r[0] is not None and r[0] == v[1]}) + [None, None]
    assert single.columns == docs.columns and got(single, "doc_id") == sorted([(i,) for i in ids], key=KEY)
    clean = limits["decontamination"](spark, docs, rough)
    assert clean.columns == docs.columns
    assert got(clean, "doc_id") == sorted(((r[0],) for r in ROWS if not brute.contamination(r[1], brute.BENCHMARK)[4]), key=KEY)
    masked = limits["secrets"](spark, docs, rough)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    assert masked.where("text like '%abcDEF123%'").count() == 0
    assert got(masked.where("doc_id between 9 and 22"), "doc_id", "text") == sorted(((r[0], r[1]) for r in ROWS if r[0] is not None and 9 <= r[0] <= 22), key=KEY)


def test_different_texts_under_one_id_stay(spark):
    import corpus_pipeline
    rng = random.Random(15)
    one, two, three = (brute.sentence(rng, 60) for _ in range(3))
    docs = spark.createDataFrame([(1, one), (1, two), (1, one), (2, three), (None, one)], "doc_id long, text string")
    assert got(corpus_pipeline.drop_near_duplicates(spark, docs, ""), "doc_id", "text") == sorted([(1, one), (1, two), (2, three), (None, one)], key=KEY)


def test_pipeline_runs(spark, rough):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, rough)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert all(r.n_tokens == len(r.ids) for r in out.collect()) and out.count() > 10
