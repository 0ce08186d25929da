from __future__ import annotations

import collections
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import decontamination as D
from gaugeworks.llm import quality as Q
from gaugeworks.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_tokens(text):
    t = "".join(" " if 0x21 <= ord(c) < 0x7F and not c.isalnum() else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(t)


def leaks(docs, items, similarity=0.8):
    """All alignments of all pairs: windows with enough equal tokens; very short items only as whole texts."""
    out = set()
    for d, t in docs:
        a = plain_tokens(t)
        for i, s in items:
            b = plain_tokens(s)
            if not b or len(b) < D.WHOLE and len(a) != len(b):
                continue
            size = min(len(b), D.WINDOW)
            if sum(map(set(a).__contains__, b)) < np.ceil(similarity * size - 1e-9):
                continue
            for shift in range(size - len(b), len(a) - size + 1):
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                run = np.cumsum([0] + [a[k + shift] == b[k] for k in range(lo, hi)])
                if (run[size:] - run[:-size] >= np.ceil(similarity * size - 1e-9)).any():
                    out.add((d, i))
    return out


def test_masks_hit_whatever_tokens_differ():
    """By enumeration, for every length of a window and every allowed set of changed tokens."""
    for n in range(1, D.WINDOW + 1):
        apart = n - int(np.ceil(0.8 * n - 1e-9))
        for changed in itertools.combinations(range(n), apart):
            masks = [(m, s) for m in D.MASKS for s in range(n - D.SPAN + 1)] if n >= D.LONG else [(m, 0) for m in D.own_masks(n, 0.8)]
            assert any(not set(changed) & {s + k for k in m} for m, s in masks), (n, changed)


def case():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (8, 14, 20, 40, 5, 0, 30, 6, 7, 9, 10, 11, 12, 3, 1)] + [None]
    docs = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(20)]
    for i, s in enumerate(items[:5] + items[6:15]):
        w = s.split()
        for k in range(3):
            own = list(w)
            for x in rng.sample(range(len(w)), k * len(w) // 10 if k < 2 else len(w) - int(np.ceil(0.8 * len(w)))):
                own[x] = "other"
            docs.append("Intro, text " + ", ".join(own).title() + ". The end" if k else "x " * i + s)
    docs += [" ".join("other" if k == x else w for k, w in enumerate(items[0].split())) for x in range(8)]
    return docs + ["", None, items[3][: len(items[3]) // 2], items[4], items[13], items[14].upper() + "!", "y " + items[13]], items


def test_leaks_equal_all_alignments(spark, documents):
    docs, items = case()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = leaks(enumerate(docs), list(enumerate(items)))
    assert len(want) >= 40 and all((i, 0) in want for i, t in enumerate(docs) if t and t.count("other") == 1 and len(t.split()) == 8)
    for block in (500_000, 20):  # also with the benchmark in many blocks
        got = D.find_leaks(documents(docs), bench, block_tokens=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
        kept = D.drop_leaks(documents(docs), bench, block_tokens=block)
        assert kept.columns == documents([]).columns
        assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in want}
    assert all(r.n_equal >= 0.8 * r.n_words - 1e-9 or r.n_words > D.WINDOW for r in got)


def test_no_leaks_without_texts(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(documents(["a b c"]), none).count() == 0 and D.drop_leaks(documents(["a b c"]), none).count() == 1
    assert D.find_leaks(documents([]), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")).count() == 0


def test_whole_table(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = leaks([(d, t) for d, t in docs if len(t) < 6000], items)
    got = {(r.doc_id, r.item_id) for r in queries.op4_spaced_seeds(spark, data).collect()}
    short = {d for d, t in docs if len(t) < 6000}
    assert {x for x in got if x[0] in short} == want and want
    assert got >= {(d, i) for d, t in docs for i, s in items if s in t}


def test_very_long_text_and_frequent_seeds(spark, documents, monkeypatch):
    monkeypatch.setattr(D, "HITS", 100)
    rng = random.Random(1)
    item = " ".join(f"w{rng.randrange(50)}" for _ in range(20))
    docs = ["la " * 500 + item + " la" * 500, " ".join(f"v{i % 977}" for i in range(200_000)) + " " + item, "la " * 30, None]
    items = ["la " * 20, item, "la la la la la la", item]
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents(docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 3), (2, 0), (2, 2)}


def counts(t):
    w, seen, dup = WORD.findall(t or ""), set(), 0
    for x in (t or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)]


def test_base_counts_and_verdicts(spark, data, documents):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    texts += ["", None, " \n\n ", "a b\na b\n\na b ", "one two three four five six seven eight " * 5, "\u00e9 | \u4e2d #" * 30, "a\x0bb\nc"]
    got = {r.doc_id: r for r in Q.assess(documents(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        want = counts(t)
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def js(p, q):
    p, q = np.array(p, float) / max(sum(p), 1), np.array(q, float)
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    return np.sqrt(max(0, (kl(p) + kl(q)) / 2))


@pytest.mark.parametrize("held", [1 << 19, 100])
def test_distances_equal_plain_histograms(spark, data, documents, monkeypatch, held):
    """Also in scripts of two and three bytes a letter, with a null language, and where tasks pass counts on early."""
    monkeypatch.setattr(Q, "HELD", held)
    rng = random.Random(4)
    other = {"ru": "абвгдежз", "hi": "अआइईउऊ", None: "xyzäß", "rare": "q"}
    texts = [(" ".join("".join(rng.choice(x) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(30, 90))), lang) for lang, x in other.items() for _ in range(3 if lang != "rare" else 1)]
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").union(spark.createDataFrame([(10**6 + i, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string"))
    rows = [(r.doc_id, r.text, r.lang) for r in d.collect()]
    limits = Q.Limits()
    got = {r.doc_id: r for r in Q.assess(d, limits).collect()}
    for lang in {x[2] for x in rows}:
        own = [(i, t) for i, t, x in rows if x == lang]
        classes = {i: Q.class_counts(np.frombuffer(t.encode() + b"\n", np.uint8), np.array([0, len(t.encode()) + 1]))[0] for i, t in own}
        short = collections.Counter()
        words = {i: [w.encode().lower() for w in WORD.findall(t)] for i, t in own}
        for w in words.values():
            short.update(w)
        common = [w for w, _ in sorted(short.items(), key=lambda kv: (-kv[1], kv[0]))[: limits.common]]
        total = sum(len(w) for w in words.values())
        ref_words = [short[w] / total for w in common] + [1 - sum(short[w] for w in common) / total]
        ref_classes = sum(classes.values()) / sum(c.sum() for c in classes.values())
        for i, _ in own:
            c = collections.Counter(words[i])
            hist = [c[w] for w in common]
            assert got[i].js_characters == pytest.approx(js(classes[i], ref_classes), abs=1e-9)
            assert got[i].js_words == pytest.approx(js([*hist, len(words[i]) - sum(hist)], ref_words), abs=1e-9)


def test_counting_holds_little():
    """A task over 1.2 million different words, of which it may hold only a part: all are counted, in bounded memory."""
    texts = pa.array([" ".join(f"w{i:07x}" for i in range(at, at + 4000)) for at in range(0, 1_200_000, 4000)])
    table = pa.record_batch([pa.array(["en"] * len(texts)), texts], names=["lang", "text"])
    tracemalloc.start()
    try:
        n = sum(sum(b.column("n").to_pylist()) for b in Q.counted(iter([table])) if b.column("kind")[0].as_py() == 1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1_200_000 and peak < 64e6


def test_labels_agree(spark):
    """Held-out check on labels: few good documents go, most bad ones do."""
    folder = "/root/testdata/sf0.01"
    r = queries.op5_distribution_divergence(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert r[r.quality == 1].kept.mean() > 0.99
    assert r[r.quality == 0].kept.mean() < 0.1


def test_keep_good_and_empty(spark, documents):
    d = documents(["word " * 5, None, "a good text of many words " + " ".join(f"w{i}" for i in range(60))], langs=["en", None, None])
    kept = Q.keep_good(d)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]
    assert Q.assess(documents([])).count() == 0


def test_tokens_match_a_plain_model():
    texts = ["Don't stop, now!", "a.b-c", "\u00e9t\u00e9 \u2014 x", None, ""]
    got = [h.tolist() for _, _, h, first in D.tokens(pa.array(texts, pa.string())) for h in np.split(h, first[1:-1])]
    alone = lambda w: next(D.tokens(pa.array([w], pa.string())))[2].tolist()
    assert got == [[alone(w)[0] for w in plain_tokens(t)] for t in texts]
