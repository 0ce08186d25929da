from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from gaugeworks.llm import suffix_dedup as S


def brute(rows, length=50):
    """rows: (doc_id, text); doc_id None is smallest."""
    first: dict[bytes, int] = {}
    order = lambda d: -(2**63) if d is None else d
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, order(d)), order(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < order(d):
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcde ") for _ in range(rng.randint(40, 200))) for _ in range(12)] + ["ab" * 80, "\u00e9\u4e2d" * 40, "x" * 300]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("fghij ") for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 6))]
        out.append("".join(parts)[rng.randint(0, 5) :])
    return out


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_bytes", [S.SHARD_BYTES, 500])
def test_equals_brute_force(spark, documents, monkeypatch, shard_bytes):
    """Small shards make a bucket's shards meet by binary search."""
    monkeypatch.setattr(S, "SHARD_BYTES", shard_bytes)
    rows = list(enumerate(texts(1)))
    assert result(S.repeated_passages(documents([t for _, t in rows]))) == brute(rows)


def test_documents_of_the_test_data(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    assert result(S.repeated_passages(d)) == brute([(r.doc_id, r.text) for r in d.collect()])


def test_shared_and_null_ids(spark, documents):
    t = texts(2, 24)
    ids = [None, None, 5, 5, 5, *range(6, 25)]
    t[3] = t[2] = t[4] + t[2]
    t[0] = t[1] = t[10]
    t[7] = None
    assert result(S.repeated_passages(documents(t, ids=ids))) == brute(list(zip(ids, t, strict=True)))


def test_spans_and_kept(spark, documents):
    p = "".join(random.Random(4).choice("abcdefgh") for _ in range(70))
    r = {x.doc_id: x for x in S.repeated_passages(documents([p, "before " + p + " after"])).collect()}
    assert (r[0].spans, r[0].kept) == ([], p.encode()) and (r[1].spans, bytes(r[1].kept)) == ([7, 77], b"before  after")


def test_empty(spark, documents):
    assert S.repeated_passages(documents([])).count() == 0
    assert [tuple(r)[1:4] for r in S.repeated_passages(documents(["", None])).collect()] == [(0, 0, 0)] * 2
    with pytest.raises(ValueError):
        S.repeated_passages(documents([]), 20)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    text[1000:1300] = text[2000:2300]
    order, _ = S.suffix_array(text, 50)
    padded = text.tobytes() + b"\0" * 64
    prefixes = [padded[i : i + 50] for i in order.tolist()]
    assert prefixes == sorted(prefixes)
    begin, strings = np.array([0, 1000, 1400]), np.array([900, 350, 1500])
    inside = np.concatenate([np.arange(a, a + n) for a, n in zip(begin, strings, strict=True)])
    own = order[np.isin(order, inside)]
    got = S.common_prefixes(text, own, begin, strings, 50)
    want = [0]
    for i, j in zip(own[1:].tolist(), own[:-1].tolist(), strict=True):
        k = 0
        while k < 50 and padded[i + k] == padded[j + k]:
            k += 1
        want.append(k)
    assert got.tolist() == want
