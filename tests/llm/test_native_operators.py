from __future__ import annotations

import hashlib
import zlib

import pytest
from oracle import database, rows

from gaugeworks.llm import mixing, queries, sharding, url_filter


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(database(data).sql(queries.ORACLE_SQL[name]).df())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op6_sainte_lague_mix", "op7_sampled_splitters"])
def test_native_plans_run_no_python(spark, data, name):
    text = plan(queries.QUERIES[name](spark, data))
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))


def test_targets_and_caps(spark, documents):
    texts = ["w " * n for n in (10, 1000, 500, 500, 0)]
    d = documents(texts, sources=["a", "b", "c", None, None])
    got = {r.doc_id: r for r in mixing.mix(d, block=1).collect()}
    # weights 1, 2, 3, 1; a stops at 30 words, the rest is shared 2 : 3 : 1
    assert [got[i].target for i in range(4)] == pytest.approx([30, 1980 / 3, 1980 / 2, 1980 / 6])
    assert got[4].taken == 0 and got[4].size == 0
    assert [got[i].taken for i in range(4)] == [30, 660, 990, 330]
    assert sum(r.taken for r in got.values()) == 2010


def test_given_weights_whole_documents_and_repeats(spark, documents):
    d = documents(["a b c d"] * 50 + ["x y"] * 50, ids=[1] * 100, sources=["p"] * 50 + ["q"] * 50)
    w = spark.createDataFrame([("p", 0.0), ("q", 1.0)], "source string, weight double")
    got = mixing.mix(d, w, whole_documents=True, block=4).collect()
    assert all(r.taken == 0 for r in got if r["size"] == 4) and sum(r.taken for r in got) == 300
    assert all(r.taken == r.copies * r["size"] + r.part_to for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(d, w, whole_documents=True, block=4).collect()), key=str)


def test_many_shards_keep_near_targets(spark, documents):
    d = documents([f"w{i} " * (1 + i % 90) for i in range(600)], sources=["hot" if i % 3 else f"s{i % 7}" for i in range(600)])
    got = mixing.mix(d, rows_per_shard=20, block=16).toPandas().merge(d.select("doc_id", "source").toPandas())
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 0.05 * own.target.iloc[0] + 8
    assert (got.taken <= 3 * got["size"]).all()


def test_highest_quotients_equal_a_plain_model(spark):
    from pyspark.sql import functions as F

    votes = [(f"p{i}", v) for i, v in enumerate((53000, 24000, 23000, 0, 7, 1200, 53000))]
    for seats in (0, 1, 7, 50, 1001):
        got = {r.p: r.s for r in mixing.highest_quotients(spark.createDataFrame(votes, "p string, v long"), [], "v", F.lit(seats), "s").collect()}
        quotients = sorted(((-v / (2 * k + 1), p) for p, v in votes if v for k in range(seats)))[:seats]
        assert got == {p: sum(q[1] == p for q in quotients) for p, _ in votes}, seats


def test_mix_of_nothing(spark, documents):
    assert mixing.mix(documents([])).count() == 0
    assert [tuple(r)[1:5] for r in mixing.mix(documents([None, ""], sources=["a", None])).collect()] == [(0, 0, 0.0, 0)] * 2


def test_shards(spark, documents):
    texts = ["copy of one text"] * 400 + [f"text {i} " * (i % 40) for i in range(800)] + [None, ""]
    ids = [*range(1200), None, 5]
    got = sharding.shard_by_size(documents(texts, ids=ids), 24).toPandas()
    assert len(got) == 1202 and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    by = got.groupby("shard")
    assert sorted(by.groups) == list(range(24))
    total = got["size"].sum()
    assert (abs(by["size"].sum() - total / 24) < 0.15 * total / 24).all()
    for _, own in by:
        assert sorted(own.slot) == list(range(len(own)))
    want = sorted((None if i is None else float(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True) if i is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for _, r in got[got.doc_id.notna()].iterrows()) == want
    # equal texts stay together unless they are overfull
    alike = got[got.text_crc32 != zlib.crc32(b"copy of one text")].groupby("text_crc32").shard.nunique()
    assert (alike == 1).all()


def test_shards_equal_a_plain_model(spark, data):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    size = {i: len(t.encode()) + 8 for i, t in docs}
    digest = {i: hashlib.md5(t.encode()).hexdigest() for i, t in docs}
    total, groups = sum(size.values()), {}
    for i, _ in docs:
        groups[digest[i]] = groups.get(digest[i], 0) + size[i]
    want, at, seen = {}, 0, {}
    for i in sorted(size, key=lambda i: (digest[i], i)):
        begin = seen.setdefault(digest[i], at)
        hot = groups[digest[i]] * 24 * sharding.GROUP_SHARE > total
        middle = at + size[i] / 2 if hot else begin + groups[digest[i]] / 2
        want[i] = min(int(middle * 24 / total), 23)
        at += size[i]
    got = {r.doc_id: r.shard for r in queries.op7_sampled_splitters(spark, data).collect()}
    assert got == want


def test_shards_of_nothing(spark, documents):
    assert sharding.shard_by_size(documents([])).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/de/x", "https://a.b.example.net/en/y?q=/z", "http://example.net?x", "ftp://badexample.net/en/", "http://net/", "x://y://org/fr/", "http://www.org/fr/a#b", "http://a.org/f", "http://..net/"]
    rules = [url_filter.Rule(*x) for x in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "org", "/f"))]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*urls, urls[3]])] + [(3, urls[3], "x")], "page_id long, url string, host string")
    got = url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules)).collect()
    assert len(got) == len(urls) + 2

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host + r.path), r.action == "allow"), default=None)
        return host, path, best and best.host + best.path, best.action if best else "allow"

    for r in got:
        assert tuple(r)[1:] == plain([*urls, urls[3]][r.page_id]), r
    none = url_filter.rules_frame(spark, rules).limit(0)
    assert {r.verdict for r in url_filter.judge_urls(pages, none, default="block").collect()} == {"block"}
    shuffled = url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules)).collect()
    url_filter_limit, url_filter.BROADCAST_RULES = url_filter.BROADCAST_RULES, 0
    try:
        assert sorted(map(str, url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules)).collect())) == sorted(map(str, shuffled))
    finally:
        url_filter.BROADCAST_RULES = url_filter_limit
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
