from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gaugeworks.llm import queries, token_store
from gaugeworks.llm.common import scratch_path
from gaugeworks.llm.words import texts_of


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def expected(library, rows):
    """Directly encoded: rows sorted as the store sorts them."""
    start, out = 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_units_encode_as_whole_texts(library):
    rng = random.Random(3)
    parts = ["a", "B", "\u00e9", "\u00df", "1", "\u00b2", "'s", "'", "\u2019", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", ",", "!!", "%%%", "<|endoftext|>", "\u00a0", "\u3000", "\x85", "\x1c", "\x0b", "\U0001f600", "\u4e2d", "_", "-", "don't", "###", "\ufeff", "($", "|"]
    parts += ["\u2003", "\u2026", "\u00d7", "\u00f7", "\u00c9", "\x00", "z\x00", "a-unit-of-more-than-fifteen-bytes", "ninechars", "letters(", "q" * 15, "q" * 16, "u" * 300]
    encoder = token_store.UnitEncoder(library.to_str())
    for n in range(120):
        if n == 60:  # some units known, then none
            encoder.forget()
        some = parts if n % 2 else [p for p in parts if p.isascii() and "<|" not in p]
        texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(20)]
        (_, _, raw, at), = texts_of(pa.array(texts))
        ids, bounds = encoder.encode(raw, at, 2)
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids + [2], t


def test_memory_of_units_is_bounded(library, monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED_BYTES", 1000)
    encoder = token_store.UnitEncoder(library.to_str())
    for i in range(5):
        t = "\u4e2d" * 3000 + str(i)
        (_, _, raw, at), = texts_of(pa.array([t]))
        assert encoder.encode(raw, at, 2)[0].tolist() == library.encode(t, add_special_tokens=False).ids + [2]
        assert len(encoder.long) == 1


def test_query_with_an_added_token_and_a_very_long_text(spark, tmp_path, library):
    texts = ["x<|endoftext|>y", "<|endoftext|>", "a plain text", "one two, three. " * 200_000, None, "b" * 300_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_token_store(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == expected(library, list(enumerate(texts)))
    assert library.encode(texts[0], add_special_tokens=False).ids == [87, 50256, 88]


def test_query_equals_direct_encoding(spark, data, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
    got = queries.op1_token_store(spark, data).orderBy("doc_id").collect()
    assert [tuple(r)[:4] for r in got] == expected(library, rows)


def test_round_trip_and_manifest(spark, documents, library):
    texts = ["same passage of some length " * 60 + str(i % 3) for i in range(40)] + ["", None, "x"]
    d, path = documents(texts), scratch_path(spark, "test")
    token_store.write_store(d, path, queries.tokenizer_path(), 2)
    ids = {r.doc_id: r.ids for r in token_store.read_ids(spark, path).collect()}
    assert ids == {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert all(r.ok for r in token_store.verify_manifest(spark, path).collect())
    chunks = token_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count() < sum(len(x) for x in ids.values()) / 256
    # an altered payload is found
    bad = scratch_path(spark, "bad")
    token_store.write_store(d.limit(3), bad, queries.tokenizer_path(), 2)
    spark.read.parquet(f"{bad}/first/kind=1").selectExpr("key", "doc_id", "n", "chunks", "concat(substring(body, 1, length(body) - 2), X'0101') AS body").coalesce(1).write.parquet(f"{path}-x")
    spark.read.parquet(f"{path}-x").write.mode("overwrite").parquet(f"{bad}/first/kind=1")
    with pytest.raises(Exception, match="digest"):
        token_store.read_store(spark, bad).collect()


def test_query_finds_lost_files(spark, documents, monkeypatch):
    """A file of recipes that is lost after the store was written is an error, not fewer documents."""
    write = token_store.write_store

    def lossy(docs, path, *more):
        write(docs, path, *more)
        next(Path(path.removeprefix("file://")).glob("store/kind=0/*.parquet")).unlink()

    monkeypatch.setattr(token_store, "write_store", lossy)
    with pytest.raises(ValueError, match="manifest"):
        queries.stored_tokens(spark, documents([f"text {i}" for i in range(40)])).collect()


def test_repeated_and_null_ids(spark, documents, library):
    d = documents(["b", "a", "a", None], ids=[4, 4, None, 2])
    path = scratch_path(spark, "test")
    token_store.write_store(d, path, queries.tokenizer_path(), 2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_store.read_store(spark, path).collect())
    assert got == [(0, None, 2), (2, 2, 1), (3, 4, 2), (5, 4, 2)]


def test_empty_table(spark, documents):
    assert queries.stored_tokens(spark, documents([])).count() == 0


def test_crc_of_parts():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4") for n in (1, 700, 3, 64, 1)]
    after = np.cumsum([len(p) for p in parts][::-1])[::-1] - [len(p) for p in parts]
    got = token_store.crc_before(np.array([zlib.crc32(p.tobytes()) for p in parts]), after)
    assert np.bitwise_xor.reduce(got) == zlib.crc32(np.concatenate(parts).tobytes())


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 50_000, 5000).astype(np.uint32)
    a = np.concatenate([rng.integers(0, 50_000, 777).astype(np.uint32), shared])
    ends = [set((token_store.cuts(x, np.array([0, len(x)]))[0] - len(x)).tolist()) for x in (a, shared)]
    assert len(ends[0] & ends[1]) > 10
    sizes = np.diff(np.concatenate([[0], token_store.cuts(np.zeros(9000, np.uint32), np.array([0, 9000]))[0]]))
    assert sizes.sum() == 9000 and sizes.max() <= token_store.MOST
