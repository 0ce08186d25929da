from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeworks.llm import components as C
from gaugeworks.llm import simhash
from gaugeworks.llm.components import components
from gaugeworks.llm.words import word_pieces, xxh64

WORD = re.compile(r"[^\x20\x09-\x0D]+")
R = random.Random(5)
TEXTS = ["", None, "a", "a b", " x\ty\x0bz ", "The And\u00c9 OF " * 40, "w" * 100 + " q " + "v" * 50, "a\u00a0b c"] + [" ".join(R.choice("abcdefg") * R.randint(1, 14) for _ in range(R.randint(0, 120))) for _ in range(60)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def shingles(t, k):
    w = WORD.findall(lower(t))
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []


def fingerprint(t, k=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(t, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("budget", [1, 200, 1 << 20])
def test_words_and_hashes(budget):
    got = [[] for _ in TEXTS]
    for at, _, w in word_pieces(pa.array(TEXTS, pa.string()), budget=budget):
        for i, (n, first) in enumerate(zip(w.count, w.first, strict=False)):
            got[at + i] = [bytes(w.buf[w.start[first + j] : w.end[first + j]]).decode() for j in range(n)]
        assert w.hashes(7).tolist() == [xxhash.xxh64_intdigest(bytes(w.buf[a:b]), 7) for a, b in zip(w.start, w.end, strict=True)]
    assert got == [WORD.findall(t or "") for t in TEXTS]


def test_xxh64_lengths():
    buf = np.frombuffer(bytes(R.randrange(256) for _ in range(200)), np.uint8)
    start = np.array([R.randrange(100) for _ in range(150)])
    end = start + np.arange(150) % 70
    assert xxh64(buf, start, end, 42).tolist() == [xxhash.xxh64_intdigest(bytes(buf[a:b]), 42) for a, b in zip(start, end, strict=True)]


def test_fingerprints():
    assert [int(x) for x in simhash.fingerprint_batch(pa.array(TEXTS, pa.string()), 3)] == [fingerprint(t) for t in TEXTS]


@pytest.mark.parametrize("local", [1 << 19, 1, 40])
def test_components(spark, monkeypatch, local):
    """Also where a task takes so few edges that joins have to do it."""
    monkeypatch.setattr(C, "LOCAL_EDGES", local)
    edges = [(R.randrange(120), R.randrange(120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(340, lambda i, j: (i, j) in set(edges) or (j, i) in set(edges))
    assert got == {n: want[n] for n in {x for a, b in edges if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_all_pairs(spark, data, documents):
    near = [" ".join(f"w{j + 1000 * (j == i)}" for j in range(400)) for i in range(60)]  # one word changed in each
    texts = TEXTS + near + near[:3] + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(80).collect()]
    fp = [fingerprint(t) for t in texts]
    want = classes(len(texts), lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 3)
    got = simhash.near_duplicates(documents(texts)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fp[i]:016x}", want[i]) for i in range(len(texts))}


def test_dense_runs_are_searched():
    """However few candidate pairs a run may have before it is searched, the components stay."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    fps = np.array(sorted({int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 4)))) for b in base for _ in range(30)}), np.uint64)
    want = classes(len(fps), lambda i, j: bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3)
    key, of = simhash.keys_batch(fps, 3)
    order = np.argsort(key >> np.uint64(1), kind="stable")
    for wide in (0, 20, 4096):
        a, b = simhash.links_of_runs(key[order], of[order], 3, wide)
        edges = {tuple(sorted((int(x), int(y)))) for x, y in zip(a, b, strict=True)}
        assert classes(len(fps), lambda i, j, e=edges: tuple(sorted((int(fps[i]), int(fps[j])))) in e) == want


def test_chain_prunes_before_the_hamming_check():
    """Of candidates by the first two segments, the chain keeps all within budget that start there, and drops most others."""
    rng = np.random.default_rng(2)
    left = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    start = rng.integers(0, 4, len(left))
    masks = simhash.chain_masks(3)
    assert [[int(m).bit_count() for m in row] for row in masks] == [[16, 32, 48, 64]] * 4
    diff = rng.integers(0, 2**64, len(left), dtype=np.uint64) & left & ~masks[start, 1]
    kept = set(simhash.on_chain(diff, start, 3).tolist())

    def goes_on(d, i):
        return all((int(d) & int(masks[i, n])).bit_count() <= n for n in range(3))

    assert kept == {k for k in range(len(diff)) if goes_on(diff[k], start[k])}
    assert 0 < len(kept) < len(diff) / 2
    for _ in range(500):  # whatever is within budget starts a chain somewhere
        d = sum(1 << int(b) for b in set(rng.integers(0, 64, 3).tolist()))
        assert any(goes_on(d, i) and not d & int(masks[i, 0]) for i in range(4))


def test_degenerate_tables(spark, documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    got = simhash.near_duplicates(documents(["a b c d", None, "a b c d", "x"], ids=[7, None, 7, 3])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(False, 3, 3), (False, 7, 7), (False, 7, 7)]
    assert len(got) == 4


def jaccard(a, b):
    x, y = set(shingles(a, 5)), set(shingles(b, 5))
    return len(x & y) >= 0.8 * len(x | y) if x | y else True


@pytest.mark.parametrize("matches", [16, 0])
def test_near_texts_equal_all_pairs(spark, documents, monkeypatch, matches):
    """Also where every run counts as dense and has one hub at first, so that several passes are taken."""
    monkeypatch.setattr(simhash, "MATCHES", matches)
    monkeypatch.setattr(simhash, "HUBS", 16 if matches else 1)
    words = [f"w{R.randrange(5000)}" for _ in range(300)]
    copies = []
    for i in range(60):
        own = list(words)
        for _ in range(R.randint(0, 5)):
            own[R.randrange(300)] = f"x{i}"
        copies.append(" ".join(own))
    texts = copies + copies[:2] + [" ".join(f"v{R.randrange(3000)}" for _ in range(50)) for _ in range(30)] + ["", None, " ", "one two"]
    want = classes(len(texts), lambda i, j: jaccard(texts[i], texts[j]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(documents(texts)).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("matches", [16, 0])
def test_near_texts_with_passages_added_or_cut(spark, documents, monkeypatch, matches):
    """Many words change at once, so that fingerprints over words differ in many bits; a frequent tail is shared by all."""
    monkeypatch.setattr(simhash, "MATCHES", matches)
    tail = [f"t{i}" for i in range(30)]
    texts = []
    for i in range(40):
        own = [f"w{R.randrange(3000)}" for _ in range(R.choice([60, 300, 900]))] + tail
        other = [f"w{R.randrange(3000)}" for _ in range(len(own))]
        for share in (0.1, 0.2, 0.24, 0.3):
            texts.append(" ".join(own + other[: int(share * len(own))]))
            texts.append(" ".join(own[int(share * len(own) * 0.8) :]))
        texts.append(" ".join(own))
    want = classes(len(texts), lambda i, j: i // 9 == j // 9 and jaccard(texts[i], texts[j]))
    assert len(set(want)) < len(texts) / 2
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(documents(texts)).collect()}
    assert got == dict(enumerate(want))


def test_copies_of_one_text_give_few_pairs(spark, documents, monkeypatch):
    """No pass lists the pairs of a linked group, and texts that stand apart in it are still compared with all."""
    sent = []
    real = simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, *a: (sent.append(pairs.count()), real(pairs, *a))[1])
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:k] + [f"x{i}"] + base[k + 1 :]) for i, k in enumerate(R.choices(range(100), k=300))]
    texts += [" ".join(base[:k] + [f"y{k}"] * 3 + base[k + 3 :] + [f"z{k}"] * 14) for k in range(0, 90, 3)]
    want = classes(len(texts), lambda i, j: jaccard(texts[i], texts[j]))
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(documents(texts)).collect()} == dict(enumerate(want))
    assert sum(sent) < 30 * len(texts)


def test_unlike_texts_are_not_read(spark, documents, monkeypatch):
    """Texts with common words in chance order, some with one passage: no text is compared, but for those of the similar pair."""
    rng = random.Random(8)
    common, passage = "the of and to in a is it".split(), [f"passage{i}" for i in range(20)]

    def text(i):
        w = [rng.choice(common) for _ in range(60)] + [f"own{i}x{j}" for j in range(30)]
        return " ".join(w + passage * (i % 20 == 0))

    texts = [text(i) for i in range(400)]
    texts.append(texts[7] + " more")
    listed, read, may, put = [], [], simhash.similar, simhash.stored_at
    monkeypatch.setattr(simhash, "COUNTED", 100)  # common shingles are known from a quarter
    monkeypatch.setattr(simhash, "similar", lambda pairs, *a: (listed.append(pairs.count()), may(pairs, *a))[1])

    def stored_at(df, label):
        out = put(df, label)
        read.extend([out[0].count()] if label == "asked" else [])
        return out

    monkeypatch.setattr(simhash, "stored_at", stored_at)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(documents(texts)).collect()}
    assert got == {i: 7 if i == 400 else i for i in range(401)}
    assert sum(read) <= 4 and sum(listed) < 250


def test_sketches_lose_no_similar_pair(spark):
    """Sets of all sizes and of just the similarity, against the exact test; most pairs of unlike sets go."""
    rng = np.random.default_rng(3)
    sets, links = [np.zeros(0, np.int64), np.zeros(0, np.int64)], {(0, 1)}
    for size in (1, 2, 5, 9, 90, 900, 9000, 90000):
        for extra in (0, size // 9, size // 8):
            one = rng.integers(-(1 << 63), 1 << 63, size + extra, dtype=np.int64)
            sets += [one[:size], one[extra:]]
            if 10 * (size - extra) >= 8 * (size + extra):
                links.add((len(sets) - 2, len(sets) - 1))
    column = pa.LargeListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int64()), pa.array(np.concatenate(sets)))
    rows = [(i, len(x), bytearray(y)) for i, (x, y) in enumerate(zip(sets, simhash.sketches(column).to_pylist(), strict=True))]
    nodes = spark.createDataFrame(rows, "node long, size int, sketch binary")
    every = spark.createDataFrame([(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))], "a long, b long")
    got = {tuple(r) for r in simhash.possible(every, nodes, 0.8)[0].collect()}
    assert links <= got and len(got) < 150


def test_keep_one_with_clashing_columns(spark, documents):
    d = documents(["a b", "c", None, ""], ids=[1, 2, 3, 4])
    for name in ("digest", "row", "node", "root", "id", "d", "a.b", "_text_node"):
        d = d.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.digest, r["a.b"], r._text_node) for r in kept.collect()) == [(i, f"digest{i}", f"a.b{i}", f"_text_node{i}") for i in (1, 2, 3)]


def test_keep_one(spark, documents):
    t = " ".join(f"w{i}" for i in range(100))
    d = documents([t, t, t.replace("w50", "z"), "other text here that is not alike at all", "other"], ids=[5, 3, 4, 9, 9])
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text[:5]) for r in kept.collect()) == [(3, "w0 w1"), (9, "other"), (9, "other")]
    same = documents(["a b", "a b", "c"], ids=[1, 1, None])
    assert sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(same).collect()) == [(0, "c"), (1, "a b")]
