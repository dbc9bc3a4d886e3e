"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import math
import os
import pickle
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from meridio.llm import bucket_topk, histogram_shards, pca_dedup, pitman_yor, queries, simhash_dedup, subsequence_toxicity, subword_quality, temperature_mix, vector_packing, warc_dictionary
from tests.oracle import SF, check, connection

DOCS = "doc_id long, text string, source string, score double, shard int, word string"  # columns whose names clash with results
BIG = 2**53
LONG = " ".join(f"w{i % 997}" for i in range(20000))


def docs_of(spark, empty=False):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["ab", "Cd", "éf", "gh", "ij", "kl"], 40)) for _ in range(30)]
    near = [b.replace("ab", "ab", 1) + " zz" for b in base[:8]]
    texts = [None, "", "one", "one two", "  ", " x\ty", LONG, *base, *base[:10], *near, *["copy of a text that many share"] * 40]
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", 0.5, 9, "clash") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "no id", "s1", 0.1, 1, "x")]
    return spark.createDataFrame([] if empty else rows, DOCS)


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    docs = docs_of(spark)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = components(list(fp), [(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3])
    got = simhash_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fp & (2**64 - 1), r.component_id) == (fp[r.doc_id], want[r.doc_id])


def test_simhash_cells_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centre = int(rng.integers(2**62))
    fps = {i: (centre ^ (1 << int(rng.integers(63)))) ^ ((1 << int(rng.integers(63))) if i % 3 else 0) for i in range(120)}
    fps |= {1000 + i: int(rng.integers(2**62)) for i in range(50)}
    df = spark.createDataFrame(list(fps.items()), "doc_id long, fp long")
    want = components(list(fps), [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 3])
    assert {r.doc_id: r.component_id for r in simhash_dedup.components(df).collect()} == want


def test_thresholds_add_up():
    tables = [np.array([[5.0], [50.0], [500.0]]), np.array([[900.0], [950.0], [990.0]]), np.array([[1.0], [2.0], [90.0]]), np.array([[3.0], [30.0], [300.0]])]
    t = simhash_dedup.thresholds([np.zeros(1, int)] * 4, tables, 3)[:, 0].tolist()
    assert sum(t) == 0 and t == [0, -1, 1, 0]


VECTORS = [[1.0, 0.0, 0.2], [1.0, 0.0, 0.2], [2.0, 0.0, 0.4], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0], None, [float("nan"), 1.0, 1.0], [1.0, None, 1.0], [1.0, 0.05, 0.2], [1.0], [-1.0, 0.0, -0.2], [float("inf"), 1.0, 1.0]]


def vectors_of(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v, 0) for i, v in enumerate(VECTORS)] + [(100 + i, (rng.normal(size=3) / 2).tolist(), 1) for i in range(200)] + [(500 + i, [0.5, 0.5, 0.1], 2) for i in range(60)]
    return spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>, label int")


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_pca_dedup_against_all_pairs(spark):
    df = vectors_of(spark)
    rows = {r.vec_id: r.embedding for r in df.collect()}
    ok = {i: np.array(v) for i, v in rows.items() if good(v) and any(v)}
    pairs = [(a, b) for a in ok for b in ok if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9]
    want, n = components(list(rows), pairs), Counter(a for a, _ in pairs)
    for tile in (64, 7):
        got = {r.vec_id: r for r in pca_dedup.near_duplicates(df, tile=tile).collect()}
        assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in rows}


def test_pca_dedup_of_a_dense_group_and_ties(spark):
    """Many near copies, some equal on the leading axes, and ids over 2^53 beside a null one."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=6)
    rows = [(BIG + 1 + 2 * i, (base + rng.normal(size=6) * (0.02 if i < 150 else 3)).tolist()) for i in range(300)] + [(BIG + 2001, base.tolist()), (None, base.tolist())]
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if i is not None}
    pairs = [(a, b) for a in v for b in v if a != b and v[a] @ v[b] >= 0.9]
    want, n = components(list(v), pairs), Counter(a for a, _ in pairs)
    got = {r.vec_id: r for r in pca_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=16).collect()}
    assert not got[None].kept and got.pop(None).n_links == 0
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (n[i], want[i]) for i in v}


def plain_topk(rows):
    """By integers of any size."""
    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows.items() if good(v)}
    want = {}
    for q in (i for i in ok if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=False)), i) for i, v in ok.items() if i != q)[:20]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    return want


@pytest.mark.parametrize("bucket,block", [(4096, 4096), (32, 3)])
def test_topk_against_all_products(spark, bucket, block):
    df = vectors_of(spark)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in bucket_topk.top_k(df, bucket=bucket, block=block).collect()}
    assert got == plain_topk({r.vec_id: r.embedding for r in df.collect()})


@pytest.mark.parametrize("size", [2.0**23, 2.0**24.4, 2.0**26])
def test_topk_of_scores_beyond_doubles(spark, size):
    """Scores near 2^60 and over, of vectors near to each other, and ids over 2^53."""
    rng = np.random.default_rng(8)
    rows = {(2**53 // 20 + i) * 20 + i % 5: (size + rng.normal(size=4) * 3).tolist() for i in range(200)}
    df = spark.createDataFrame([*rows.items(), (None, [1.0] * 4)], "vec_id long, embedding array<double>")
    if size == 2.0**26:  # 64-bit scores would wrap
        with pytest.raises(Exception, match="over 64 bits"):
            bucket_topk.top_k(df, bucket=64).collect()
    else:
        assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in bucket_topk.top_k(df, bucket=64).collect()} == plain_topk(rows)


def test_coordinate_pruning_is_exact():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(500, 8)) * 64).astype(np.int64)
    q = v[:20] + rng.integers(-2, 3, (20, 8))
    ids, qn = np.arange(500), np.sqrt((q.astype(float) ** 2).sum(1))
    norms = np.sqrt((v.astype(float) ** 2).sum(1))
    keep = norms <= np.quantile(norms, 0.9)
    scores = q @ v[keep].T
    bounds = np.sort(scores, 1)[:, -2]
    got = bucket_topk.search((np.arange(1000, 1020), q, qn), bounds, ids[keep], v[keep], 2)
    for i in range(20):
        order = np.lexsort((ids[keep], -scores[i]))[:2]
        mine = got[0] == 1000 + i
        assert got[1][mine].tolist() == ids[keep][order].tolist()


@pytest.mark.parametrize("sign", [-1, 1])
def test_coordinate_pruning_keeps_a_dominant_axis(sign):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(600, 8)) * 3
    v[:, 0] += sign * 100
    v = np.floor(v).astype(np.int64)
    ids, q = np.arange(600), v[:20]
    scores = q @ v.T
    scores[np.arange(20), np.arange(20)] = -(2**62)
    bounds = np.sort(scores, 1)[:, -20]
    got = bucket_topk.search((ids[:20], q, np.sqrt((q.astype(float) ** 2).sum(1))), bounds, ids, v, 20)
    for i in range(20):
        assert got[1][got[0] == i].tolist() == ids[np.lexsort((ids, -scores[i]))[:20]].tolist()


@pytest.mark.parametrize("range_bytes", [1 << 25, 300])
def test_shards(spark, range_bytes):
    docs = docs_of(spark)
    rows = histogram_shards.shard(docs, 5, range_bytes).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r.size == len((r.text or "").encode()) + 8 and r.shard == (1 if r.doc_id is None else 9)  # shard is a column of docs
        by.setdefault(r.shard_, []).append(r)
    assert set(by) <= set(range(5)) and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    # against the plain way: sort all keys, and cut where the bytes so far come nearest to each share
    texts = [(i, "x" * (i % 50) if i % 3 else "a text of a third of all rows") for i in range(3000)]
    small = histogram_shards.shard(spark.createDataFrame(texts, "doc_id long, text string"), 4, range_bytes).collect()
    sizes = Counter()
    for r in small:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * max(sizes.values())
    key = {i: (xxhash.xxh64(t.encode(), seed=42).intdigest(), i) for i, t in texts}
    key = {i: (h - 2**64 if h >= 2**63 else h, i) for i, (h, _) in key.items()}
    assert [r.doc_id for r in sorted(small, key=lambda r: (r.shard, r.slot))] == sorted(key, key=key.get)


def test_mixture(spark):
    rows = [(i if i % 4 else None, f"{i} " + "w " * (i % 9), "big" if i % 10 else "rare", "own") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_block string")
    got = temperature_mix.mix(docs, 0.99, 3.0, block_tokens=300).collect()
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.mix_tokens
        assert r.mix_block == "own" and r.mix_tokens == len(r.text.split())
    weight = {r.source: r.mix_weight for r in got}
    total = sum(tokens.values())
    assert all(abs(tokens[s] / total - w) < 0.01 for s, w in weight.items())
    assert {r.text for r in got} == {t for _, t, _, _ in rows} and max(r.mix_epoch for r in got) <= 3
    assert len({(r.text, r.mix_epoch) for r in got}) == len(got) and all(0 <= r.mix_at <= 1 for r in got)
    # the plain way: an epoch's blocks in the order of mix_at, whole but for the last, which ends where the budget does
    share = {r.source: r.mix_weight * sum(tokens.values()) for r in got}
    for source in share:
        size = Counter()
        for _, t, s, _ in rows:
            if s == source:
                size["all"] += len(t.split())
        by_block = Counter()
        for r in got:
            if r.source == source:
                by_block[r.mix_epoch, r.mix_block_] += r.mix_tokens
        whole = {b: max(n for (_, x), n in by_block.items() if x == b) for _, b in by_block}
        assert sum(whole.values()) == size["all"] and sum(n < whole[b] for (_, b), n in by_block.items()) <= 1
        assert abs(tokens[source] - share[source]) <= 10
    sizes = {"a": 900, "b": 90, "c": 10}
    x = temperature_mix.solve(sizes, 0.9 * np.log(3), None, None)
    assert abs(temperature_mix.entropy(temperature_mix.weights_at(sizes, x)) - 0.9 * np.log(3)) < 1e-6
    assert temperature_mix.repeats(sizes, temperature_mix.weights_at(sizes, temperature_mix.solve(sizes, np.log(3), 2.0, None)), None) <= 2.0 + 1e-6
    assert temperature_mix.mix(docs_of(spark)).select("doc_id").distinct().count() == docs_of(spark).select("doc_id").distinct().count()


def test_warc_round_trip(spark):
    import hashlib

    html = "<p>" + "text " * 50
    pages = [(1, "http://a/1", "short"), (2, "http://a/2", "short"), (5, None, html), (3, "http://a/3\r\nX: y", html), (9, "u", html), (4, "u", None), (6, "u", ""), (7, "u", "é" * 200), (8, "u", LONG * 3), (None, "u", "no id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder, files = warc_dictionary.write_archives(df)
    got = {r.page_id: r for r in warc_dictionary.read_archives(folder, files).collect()}
    for i, _, text in pages:
        data = (text or "").encode()
        first = 3 if text == html else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
        assert bytes(r.payload) == (data if first == i else b"")


def test_warc_ids_beyond_doubles(spark):
    html = "<p>" + "same " * 50
    pages = [(BIG + 1, "u", html), (BIG + 3, "u", html), (None, "u", html), (None, "u", "short"), (BIG + 5, "u", "short"), (BIG + 7, None, None)]
    got = warc_dictionary.archive_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr) == sorted(
        [(BIG + 1, "response", None), (BIG + 3, "revisit", BIG + 1), (None, "response", None), (None, "response", None), (BIG + 5, "response", None), (BIG + 7, "response", None)], key=repr
    )
    assert len(warc_dictionary.dictionary_sample(spark.createDataFrame([(i % 500, "x" * 50, None) for i in range(3000)], "page_id long, html string, url string"))) == 400


def test_packing_of_many_groups_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(vector_packing, "GROUP", 7)
    rows = [(BIG + 1 if i % 3 else None, "same text " * (i % 4)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = vector_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 1024
    assert len(bins) == -(-sum(r.length for r in got) // 1024)


def test_packing(spark):
    docs = docs_of(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = vector_packing.pack_documents(docs, path).collect()
    bins, by_doc = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for x in bins.values():
        at = 0
        for r in sorted(x, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for d in docs.dropDuplicates(["doc_id"]).collect():
        n = len(t.encode(d.text or "", add_special_tokens=False).ids) + 1
        assert sorted({(r.piece, r.start, r.length) for r in by_doc[d.doc_id]}) == [(i, s, k) for i, (s, k) in enumerate(vector_packing.cuts(n))]
    least = -(-sum(r.length for r in rows) // 1024)
    assert len(bins) <= least + 2


def test_packed_ids_are_those_of_the_files_own_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = [" " * 1_000_001, "a" + "\t\n " * 400_000 + "b", "\u3000" * 1_000_001, "a" * 1_200_000, "x<|endoftext|> y  ", "I'm  here\n\n 12 !? é漢字\U0001f600", "A\u0301 \x00"]
    texts = {r.doc_id: r.text for r in docs_of(spark).collect() if r.doc_id is not None} | {1000 + i: x for i, x in enumerate(odd)}
    sample = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300).collect()
    texts |= {2000 + i: r.text for i, r in enumerate(sample)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(8)
    got = {}
    for r in vector_packing.pack_documents(docs, path).collect():
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        got.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4")
    for i, text in texts.items():
        want = [*t.encode(text or "", add_special_tokens=False).ids, vector_packing.END]
        assert np.array_equal(np.concatenate([got[i][s] for s in sorted(got[i])]), want), i


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    counts = {700: 5, 300: 40, 120: 300, 7: 1000}
    n, ranges = vector_packing.plan(counts, (1024, 6, 600_000), rule)
    load = {}
    for length, _, k, start, offset in ranges:
        for b in range(start, start + k):
            t, d, c = load.get(b, (0, 0, 0))
            assert t == offset
            load[b] = (t + length, d + 1, c + length * length)
    assert len(load) == n and all(t <= 1024 and d <= 6 and c <= 600_000 for t, d, c in load.values())
    assert Counter({k: sum(r[2] for r in ranges if r[0] == k) for k in counts}) == Counter(counts)


def test_pitman_yor_base_and_sums(spark):
    docs = docs_of(spark)
    got = pitman_yor.score_documents(docs).collect()
    assert len(got) == docs.count()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    train = Counter()
    for d in docs.collect():
        if not held(d.doc_id):
            train.update([*pitman_yor.tokens(d.text), b""])
    n, v = sum(train.values()), len(train)
    texts = {d.doc_id: d.text for d in docs.collect()}
    for r in got:
        words = [*pitman_yor.tokens(texts[r.doc_id]), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(w in train for w in words), n)
        assert r.base_score == pytest.approx(sum(np.log10((train[w] + 1) / (n + v + 1)) for w in words))
        assert r.score <= 1e-9


def test_pitman_yor_probabilities_add_up_and_rare_tokens_agree(spark, monkeypatch):
    docs = docs_of(spark)
    model = pitman_yor.train(docs)
    _, _, logs = pitman_yor.head_of(model)
    total = (10**logs).sum(0) + 10 ** model.unknown_log()
    assert np.allclose(total, 1, atol=1e-6)
    whole = {(r.doc_id, round(r.score, 6)) for r in pitman_yor.score(docs, model).collect()}
    monkeypatch.setattr(pitman_yor, "HEAD", 3)  # nearly all tokens take the joined way
    assert {(r.doc_id, round(r.score, 6)) for r in pitman_yor.score(docs, model).collect()} == whole


def test_pitman_yor_scores_against_the_seatings(spark, monkeypatch):
    """Every score against the averaged predictive probabilities of the sampled seatings, written out plainly; ids over 2^53 beside a null."""
    states = []
    sweep = pitman_yor.sweep

    def recorded(state, total, seed, sample):
        after = sweep(state, total, seed, sample).persist()
        states.append([(bytes(r.word), np.frombuffer(r.cells, pitman_yor.CELL), r.t0) for r in after.where("word is not null").collect()])
        return after

    monkeypatch.setattr(pitman_yor, "sweep", recorded)
    monkeypatch.setattr(pitman_yor, "HEAD", 4)
    rng = np.random.default_rng(12)
    words = ["the", "cat,", "sat", "9", "mat.", "é"]
    rows = [(BIG + 1 + 2 * i, " ".join(rng.choice(words, 12, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.1]))) for i in range(60)] + [(None, "the new cat"), (BIG + 501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pitman_yor.train(docs)
    assert len(states) == pitman_yor.BURN + pitman_yor.SAMPLES
    d, s, d0, s0 = pitman_yor.DISCOUNT, pitman_yor.STRENGTH, pitman_yor.ROOT_DISCOUNT, pitman_yor.ROOT_STRENGTH
    each = []
    for state in states[pitman_yor.BURN :]:
        c, t, c0, t0 = {}, {}, Counter(), {}
        for w, cells, top in state:
            t0[w] = int(top)
            for k, n, tables, _ in cells.tolist():
                c[w, k], t[w, k] = n, tables
                assert 1 <= tables <= n
                c0[w] += tables
            assert 1 <= t0[w] <= c0[w]
        ck, tk = Counter(), Counter()
        for (_, k), n in c.items():
            ck[k] += n
        for (_, k), n in t.items():
            tk[k] += n
        n0, m0 = sum(c0.values()), sum(t0.values())

        def p(w, k, c=c, t=t, c0=c0, t0=t0, ck=ck, tk=tk, n0=n0, m0=m0):
            root = max(c0[w] - d0 * t0.get(w, 0), 0) / (s0 + n0) + (s0 + d0 * m0) / (s0 + n0) / (len(t0) + 1)
            return max(c.get((w, k), 0) - d * t.get((w, k), 0), 0) / (s + ck[k]) + (s + d * tk[k]) / (s + ck[k]) * root

        each.append(p)
    want = {i: sum(math.log10(np.mean([p(w, k) for p in each])) for w, k in zip([*pitman_yor.tokens(t), b""], pitman_yor.contexts(pitman_yor.tokens(t)), strict=True)) for i, t in rows}
    got = {r.doc_id: r.score for r in pitman_yor.score(docs, model).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_pitman_yor_rows_on_the_way_hold_codes(spark, monkeypatch):
    """Rows that wait for the model hold no text, pairs are told apart by their codes, and tables that are done with are gone."""
    kinds, paths, written = {}, {}, pitman_yor.written_in_slices

    def recorded(df, name, *by):
        kinds[name], out = {kind for _, kind in df.dtypes}, written(df, name, *by)
        paths[name] = out[1]
        return out

    monkeypatch.setattr(pitman_yor, "written_in_slices", recorded)
    docs = spark.createDataFrame([(i, f"a b c{i % 3} \u00e9{i % 9}") for i in range(40)], "doc_id long, text string")
    model = pitman_yor.train(docs)
    scored = lambda: sorted((r.doc_id, r.n_known, round(r.score, 9)) for r in pitman_yor.score(docs, model).collect())
    whole = scored()
    assert len(whole) == 40 and not {"binary", "string"} & kinds["scores"]
    assert not os.path.exists(paths["cells"].removeprefix("file://") + "/many=true")
    monkeypatch.setattr(pitman_yor, "mixed", lambda u, w: u * 0)
    assert scored() == whole


def test_pitman_yor_contexts_are_whole_words(spark):
    """Words that end alike have restaurants of their own: what followed each of them in training is likelier after it."""
    words = [b"a" * i + b"t" for i in range(200)]
    assert len(set(pitman_yor.contexts(words))) == len(words) + 1
    texts = ["cat purrs"] * 40 + ["bat flies"] * 40 + ["rat"] * 10
    model = pitman_yor.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    asked = ["cat purrs", "cat flies", "bat flies", "bat purrs", "rat purrs", "hat purrs"]
    got = {r.doc_id: r.score for r in pitman_yor.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert got[0] > got[1] + 1 and got[2] > got[3] + 1 and got[0] > got[4] + 1


def test_pitman_yor_scores_against_the_seatings_in_parts(spark, monkeypatch):
    """The same with several parts, slices, shards and blocks, where contexts of frequent words lie in more than one part."""
    for name, n in (("PART_BYTES", 700), ("BLOCK", 60), ("SLICES", 2)):
        monkeypatch.setattr(pitman_yor, name, n)
    test_pitman_yor_scores_against_the_seatings(spark, monkeypatch)


def test_pitman_yor_moves_blocks_not_pairs(spark, monkeypatch):
    """Rows on the way are arrays of many pairs: far fewer than there are pairs. A context that all share fills no part."""
    rows, written = [], pitman_yor.written_in_slices

    def recorded(df, name, *by):
        out = written(df, name, *by)
        rows.append(out[0].count())
        return out

    monkeypatch.setattr(pitman_yor, "HOT_SHARE", 20, raising=False)
    monkeypatch.setattr(pitman_yor, "written_in_slices", recorded)
    docs = spark.createDataFrame([(i, " ".join(f"the x{i}y{j}" for j in range(100))) for i in range(40)], "doc_id long, text string")
    assert pitman_yor.score(docs, pitman_yor.train(docs)).count() == 40
    assert sum(rows) < 400  # of 8,000 pairs
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 10_000)
    deal = pitman_yor.Deal(docs)
    pairs, _ = pitman_yor.pairs_of(docs.selectExpr("*", "true as counted"), deal, "pairs")
    shares = Counter()
    for r in pairs.where("slice >= 0").collect():
        u, n = pickle.loads(r.data)[:2]
        shares[r.p] += int(n[u == pitman_yor.context(b"the")].sum())
    assert deal.parts == 5 and sum(shares.values()) == 4000 and max(shares.values()) < 1500


def test_seating_against_one_customer_after_the_other():
    """The mean number of tables, of customers who come in groups, against customers who come one by one."""
    rng = np.random.default_rng(13)
    n, base, d = 400, 3.0, 0.75
    plain = []
    for _ in range(400):
        t = 1
        for seated in range(1, n):
            t += rng.random() < base / (seated - d * t + base)
        plain.append(t)
    got = pitman_yor.seat(np.full(400, n), np.full(400, base), d, rng)
    assert abs(got.mean() - np.mean(plain)) < 4 * np.std(plain) / math.sqrt(400) + 0.02 * np.mean(plain)
    assert pitman_yor.seat(np.array([0, 1, 2]), np.full(3, 1e9), d, rng).tolist() == [0, 1, 2]


def test_pitman_yor_lowers_held_out_perplexity(spark):
    got = pitman_yor.score_documents(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").collect()
    n = sum(r.n_tokens for r in got)
    base, model = (10 ** (-sum(r[c] for r in got) / n) for c in ("base_score", "score"))
    assert model < 0.9 * base


@pytest.mark.parametrize("name,label,threshold", [("op1_subword_quality", "quality", 0.3), ("op6_subsequence_toxicity", "toxic", 0.5)])
def test_classifiers_on_held_out_rows(spark, name, label, threshold):
    sf = SF.replace("sf0.01", "sf0.1")
    got = {r.doc_id: r for r in queries.queries()[name](spark, sf).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [got[i].predicted == labels[i] for i in held]
    assert np.mean(right) > 0.97
    assert all(got[i].held_out for i in held) and all(0 <= r.score <= 1 for r in got.values())


def test_scores_of_odd_texts(spark):
    docs = docs_of(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7, 40)], "doc_id long, quality int, toxic int")
    for module in (subword_quality, subsequence_toxicity):
        for table in (labels, labels.limit(0)):
            scored = module.score_documents(docs, module.train(docs, table)).collect()  # docs has a column score of its own
            assert len(scored) == docs.count() and all(r.score == (0.1 if r.doc_id is None else 0.5) and 0 <= r.score_ <= 1 for r in scored)


def test_classifiers_are_fitted_by_a_worker(spark, monkeypatch):
    """Neither the sample nor the fit's working memory is the driver's; each document is taken once, in order."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in [*range(9, -1, -1), 3]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(subword_quality, "fit", lambda rows, prior: (os.getpid(), [y for *_, y in rows]))
    monkeypatch.setattr(subsequence_toxicity, "fit", lambda bags: subsequence_toxicity.Machine(os.getpid(), [y for _, y in bags], 0, 1, 0))
    machine = subsequence_toxicity.train(docs, labels)
    for pid, y in (subword_quality.train(docs, labels), (machine.landmarks, machine.weight)):
        assert pid != os.getpid()
        assert y == [i % 2 for i in range(10) if zlib.crc32(str(i).encode()) % 5]


def test_quality_reads_on_over_cuts(monkeypatch):
    texts = [None, "", " ", "a", "ab  cd", "\nx y\tz z z", "a" * 300, LONG[:3000], "é漢 " * 50]
    whole = [subword_quality.sparse(t) for t in texts]
    for size in (1, 2, 5, 64):
        monkeypatch.setattr(subword_quality, "PIECE", size)
        for (ids, weight), t in zip(whole, texts, strict=True):
            got = subword_quality.sparse(t)
            assert np.array_equal(got[0], ids) and np.allclose(got[1], weight)


def test_quality_scores_are_the_softmax_of_averaged_vectors():
    """The number looked up for each feature against the model written out: average the vectors, then softmax."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["good", "fine", "text"] if i % 2 else ["junk", "spam", "x9"], 12)) for i in range(60)]
    table, bias = subword_quality.fit([(*subword_quality.sparse(t), i % 2) for i, t in enumerate(texts)], 0.5, updates=600)
    for t in texts[:10]:
        ids, weight = subword_quality.sparse(t)
        z = np.array([0.0, weight.astype(float) @ table[ids] + bias])
        assert subword_quality.score(t, table, bias) == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), rel=1e-4)
    assert all((subword_quality.score(t, table, bias) > 0.5) == i % 2 for i, t in enumerate(texts))


def test_kernel_against_all_subsequences():
    """Kernel values against a plain enumeration of subsequences of three characters."""

    def plain(a, b):
        def weights(s):
            out = Counter()
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, len(s)):
                        out[s[i] + s[j] + s[k]] += subsequence_toxicity.DECAY ** (k - i + 1)
            return out

        x, y = weights(a), weights(b)
        near = sum(x[s] * y[s] for s in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return math.exp(subsequence_toxicity.SHARP * (near - 1)) if near >= subsequence_toxicity.FLOOR else 0.0

    words = ["^idiot$", "^idxiot$", "^aaaa$", "^abcabc$", "^fool$", "^foolish$", "^xaby$"]
    m = subsequence_toxicity.Machine(words, np.zeros(len(words)), 0.0, 1.0, 0.0).prepare()
    got = m.features(words)
    assert np.allclose(got, [[plain(a, b) for b in words] for a in words], atol=1e-5)


def test_spelled_out_words_within_a_run(monkeypatch):
    m = subsequence_toxicity.Machine(["^idiot$"], np.ones(1), 0.0, 1.0, 0.0)
    of = lambda t: max(subsequence_toxicity.Scorer(m).memo_of(t))
    for text in ("y o u i d i o t g o a w a y", "you are a n i d i o t n o w ok", "x " * 30_000 + "i d i o t " + "y " * 500):
        assert of(text) == pytest.approx(1, abs=1e-5)
    monkeypatch.setattr(subsequence_toxicity, "RUN_PIECE", 14)
    assert of("a b " * 20 + "i d i o t " + "c d " * 9) == pytest.approx(1, abs=1e-5)


def test_kernel_tolerates_gaps():
    m = subsequence_toxicity.Machine(["^idiot$"], np.ones(1), 0.0, 1.0, 0.0).prepare()
    near = m.margins([w for t in ("idiot", "idxiot", "i-d-i-o-t", "table") for w in subsequence_toxicity.windows(t)[-1:]])
    assert near[0] == pytest.approx(1, abs=1e-5) and near[1] > 0.2 and near[2] > 0.9 and near[3] == 0


def test_empty_tables(spark):
    docs = docs_of(spark, empty=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = [
        subword_quality.score_documents(docs, subword_quality.train(docs, labels)),
        subsequence_toxicity.score_documents(docs, subsequence_toxicity.train(docs, labels)),
        simhash_dedup.near_duplicates(docs), histogram_shards.shard(docs), pitman_yor.score_documents(docs), temperature_mix.mix(docs),
        vector_packing.pack_documents(docs, path), bucket_topk.top_k(vectors), pca_dedup.near_duplicates(vectors), warc_dictionary.archive_round_trip(pages),
    ]
    assert [f.count() for f in found] == [0] * len(found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    check(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connection())


def test_pipeline(spark):
    import corpus_pipeline

    sf = SF.replace("sf0.01", "sf0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    bad = [i for i in labels if labels[i].toxic or not labels[i].quality]
    assert sum(i in ids for i in bad) <= 0.03 * len(bad)
    mixed = corpus_pipeline.mixing(spark, kept, sf)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == ids


def plain_shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_links(texts):
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    return [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def edited_docs(spark):
    rng = np.random.default_rng(6)
    word = lambda n: [f"v{x}" for x in rng.integers(0, 400, n)]
    texts = {r.doc_id: r.text for r in docs_of(spark).collect() if r.doc_id is not None}
    passage = word(30)
    for k in range(60):  # near copies with up to 4 words replaced, of bases that share a passage
        base = passage + word(int(rng.integers(20, 250)))
        for j in range(3):
            t = list(base)
            for at in rng.integers(0, len(t), int(rng.integers(0, 5))):
                t[at] = f"x{rng.integers(1000)}"
            texts[1000 + 10 * k + j] = " ".join(t)
    base = word(150)
    texts[3000] = " ".join(base)
    for k in range(1, 80):  # one large group: copies that are near to the base and mostly not to each other
        t = list(base)
        for at in rng.integers(0, 150, 2):
            t[at] = f"y{rng.integers(1000)}"
        texts[3000 + k] = " ".join(t)
    return texts


@pytest.mark.parametrize("first,rounds", [(2, 2), (1, 0)])
def test_pipeline_near_duplicates_against_all_pairs(spark, monkeypatch, first, rounds):
    import corpus_pipeline

    from meridio.llm import similar_sets

    monkeypatch.setattr(similar_sets, "FIRST", first)
    monkeypatch.setattr(similar_sets, "ROUNDS", rounds)
    texts = edited_docs(spark)
    links = plain_links(texts)
    assert sum(texts[a] != texts[b] for a, b in links) > 100
    want = set(components(list(texts), links).values())
    docs = spark.createDataFrame([*((i, t, "own") for i, t in texts.items()), (20, texts[20], "own"), (None, "no id", "own")], "doc_id long, text string, nth string")
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    kept = [r.doc_id for r in found.collect()]
    assert sorted(i for i in kept if i is not None) == sorted(want) and kept.count(None) == 1
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_bitmaps_differ_in_no_more_bits_than_sets_in_members(spark):
    from pyspark.sql import functions as F

    from meridio.llm import similar_sets

    rng = np.random.default_rng(14)
    rows, apart = [], []
    for n in (1, 3, 31, 32, 33, 40, 60, 64, 65, 300, 1000):
        for cut in (0, 0.02, 0.1, 0.2, 0.5):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.r_[a[int(cut * len(a)) :], rng.integers(0, 2**63, int(cut * n), dtype=np.uint64), rng.integers(0, 2**63, n // 6, dtype=np.uint64)])
            apart.append((len(np.setxor1d(a, b)), similar_sets.similar(a, b)))
            rows.append((len(rows), (len(a), similar_sets.bitmap(a).tolist()), (len(b), similar_sets.bitmap(b).tolist())))
    df = spark.createDataFrame(rows, "i int, x struct<n: int, bits: array<long>>, y struct<n: int, bits: array<long>>")
    like = df.where("5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)")
    got = like.select("i", F.expr(similar_sets.difference("x", "y")).alias("d"), F.expr(similar_sets.may_be_similar("x", "y")).alias("ok")).collect()
    assert len(got) > 20 and all(r.d <= apart[r.i][0] and (r.d - apart[r.i][0]) % 2 == 0 and (r.ok or not apart[r.i][1]) for r in got)
