from __future__ import annotations

import collections
import gzip
import hashlib
import math
import re
import string
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from test_decontamination_and_quality import counts

from gaugeworks.llm import classifier, queries, warc
from gaugeworks.llm.common import scratch_path


def test_archives(spark):
    big = "<p>\u00e9</p>\r\n\r\n" * 200
    pages = [(1, "http://a/", big), (2, "http://b/", big), (3, "u\r\nX: y", "small"), (4, None, "small"), (5, "http://c/", None), (6, "http://d/", "\u4e2d" * 400), (6, "http://d/", "\u4e2d" * 400), (None, "http://e/", big)]
    d, path = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string"), scratch_path(spark, "warc")
    index = warc.write_archives(d, path)
    got = sorted(warc.read_records(index, path).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (6, "response", None), (None, "revisit", 2)]
    for r, (_, _, html) in zip(got, pages, strict=True):
        body = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert r.payload == (None if r.record_type == "revisit" else body)
    # files are gzip members in a row, whole WARC records
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file://")).glob("archives/*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(pages)
    some = warc.read_records(index.where("page_id IN (3, 5)"), path).collect()
    assert {r.page_id for r in some} == {3, 5}
    # a changed archive is found
    p = next(Path(path.removeprefix("file://")).glob("archives/*.warc.gz"))
    first = index.where(f"archive = '{p.name}' AND record_type = 'response'").orderBy("offset").first()
    whole = p.read_bytes()
    member = gzip.decompress(whole[first.offset : first.offset + first.length])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    z = z.compress(member.replace(b"Content-Type: text/html", b"Content-Type: text/htmm", 1).replace(b"small", b"smell").replace("\u4e2d".encode(), "\u4e2e".encode()).replace(b"<p>", b"<q>")) + z.flush()
    p.write_bytes(z)
    with pytest.raises(Exception, match="digest"):
        warc.read_records(index.where(f"archive = '{p.name}'").limit(1).selectExpr("archive", "0L AS offset", f"{len(z)}L AS length", "digest", "page_id"), path).collect()


def test_ranges_cover_all_records():
    offset = np.array([0, 10, 20, 200_000, 200_010, 9_000_000, 20_000_000])
    length = np.array([10, 10, 30, 10, 10, 9_000_000, 5])
    got = warc.ranges(offset, length)
    assert [x for a, b in got for x in range(a, b)] == list(range(7))
    assert got == [(0, 3), (3, 5), (5, 6), (6, 7)]


def test_no_pages(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    assert warc.read_records(warc.write_archives(d, path), path).count() == 0


def test_pairwise_identity():
    """The linear-time form equals the sum over all pairs."""
    rng = np.random.default_rng(4)
    size, k = classifier.WORDS + classifier.STATISTICS, 3
    m = classifier.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, k)), np.zeros(classifier.STATISTICS), np.ones(classifier.STATISTICS))
    index, value, stats = rng.integers(0, classifier.WORDS, 12), rng.normal(size=12), rng.normal(size=(2, classifier.STATISTICS))
    first = np.array([0, 7, 12])
    for i, got in enumerate(m.raw(first, index, value, stats)):
        x = np.concatenate([value[first[i] : first[i + 1]], stats[i]])
        at = np.concatenate([index[first[i] : first[i + 1]], np.arange(classifier.WORDS, size)])
        pairs = sum(m.v[at[a]] @ m.v[at[b]] * x[a] * x[b] for a in range(len(x)) for b in range(a))
        assert got == pytest.approx(0.3 + m.w[at] @ x + pairs)


def plain_score(m, text, n_chars):
    """The machine's score of one text, word by word and pair by pair."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    hashed = collections.Counter(xxhash.xxh64_intdigest(w.encode(), 3) % classifier.WORDS for w in lower)
    x = {i: math.log1p(n) for i, n in hashed.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    x = {i: v / norm for i, v in x.items()}
    count = lambda chars: sum(c in chars for c in t)
    ascii_classes = [string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t\v\f\r", "\n", ".,", ";:!?'\"-()", "#*$%&|<>"]
    classes = [count(c) for c in ascii_classes]
    far = sum(ord(c) > 127 for c in t)
    classes += [len(t) - sum(classes) - far, far]
    n, word_chars, symbols, dup_lines, repeats = counts(t)
    stats = [math.log1p(n), word_chars / max(n, 1), symbols / max(n, 1), math.log1p(dup_lines), repeats / max(n, 1), math.log1p(n_chars or 0), math.log1p(classes[4]), float(n == 0)] + [c / max(len(t), 1) for c in classes]
    for i, v in enumerate(stats):
        x[classifier.WORDS + i] = min(4, max(-4, (v - m.mean[i]) / m.scale[i])) / 4
    at = sorted(x)
    z = m.w0 + sum(m.w[i] * x[i] for i in at) + sum(float(m.v[a] @ m.v[b]) * x[a] * x[b] for k, a in enumerate(at) for b in at[:k])
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_scores_equal_a_plain_machine(spark, documents):
    rng = np.random.default_rng(9)
    size = classifier.WORDS + classifier.STATISTICS
    m = classifier.Machine(0.1, rng.normal(0, 0.3, size), rng.normal(0, 0.2, (size, 4)), rng.normal(size=classifier.STATISTICS), rng.uniform(0.5, 2, classifier.STATISTICS))
    texts = ["One two TWO three.\nOne two", "", None, "\u00e9t\u00e9 \u4e2d| #1", " \n\n", "a b c d e f g h " * 3, "long " * 3000]
    got = {r.doc_id: r.score for r in classifier.score(documents(texts), m).collect()}
    assert got == {i: pytest.approx(plain_score(m, t, len(t) if t else None), abs=1e-9) for i, t in enumerate(texts)}


def test_repeated_rows_train_once(spark, documents):
    """However many rows share a doc_id, one of them is sent and counts."""
    texts, ids = [f"text {i} {'%%% ' * (i % 2) * 9}" for i in range(40)], list(range(40))
    y = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    one, many = (classifier.train(d, y) for d in (documents(texts, ids=ids), documents(texts + texts[:1] * 50, ids=ids + [0] * 50)))
    assert one.w0 == many.w0 and (one.w == many.w).all() and (one.v == many.v).all()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    r = queries.op10_factorisation_machine(spark, folder).toPandas()
    assert (r.held_out == r.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((r.score >= 0) & (r.score <= 1)).all() and (r.predicted == (r.score >= 0.3)).all()
    x = r[r.held_out].merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas())
    pos, neg = x[x.quality == 1].score.to_numpy(), x[x.quality == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.99
    assert (x.predicted == x.quality).mean() > 0.97


def test_labels_missing_or_odd(spark, documents):
    d = documents(["a few words", None, "", "more words here"], ids=[1, 2, 3, 3])
    for labels in ([], [(1, 1, 0), (2, None, 0), (None, 0, 1)]):
        y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = classifier.score(d, classifier.train(d, y)).collect()
        assert len(got) == 4 and len({r.score for r in got}) == 1
    assert classifier.score(documents([]), classifier.train(d, y)).count() == 0


def test_training_does_not_read_held_out_labels(spark, documents):
    d = documents([f"text number {i} {'%%% ' * (i % 2) * 9}" for i in range(60)])
    y = [(i, i % 2, 0) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in y]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id, r.score) for r in classifier.score(d, classifier.train(d, frame(x))).collect()) for x in (y, flipped))
    assert a == b
