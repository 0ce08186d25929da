"""The registered queries of this subpackage: thin wrappers that apply the operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import classifier, decontamination, mixing, quality, sharding, simhash, suffix_dedup, token_store, url_filter, warc
from gaugeworks.llm.common import scratch_path, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def stored_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes the token store of docs to the shared folder and reads it back, every shard against the manifest."""
    path, id_kind = scratch_path(spark, "tokens"), docs.schema["doc_id"].dataType.simpleString()
    token_store.write_store(docs, path, tokenizer_path(), END_ID)
    wrong = [r.shard for r in token_store.verify_manifest(spark, path, id_kind).where("NOT ok").limit(10).collect()]
    if wrong:
        raise ValueError(f"shards {wrong} of the token store don't match the manifest")
    return token_store.read_store(spark, path, id_kind)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(spark, table(spark, sf_dir, "documents"))


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, budget=3)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), 50).drop("spans", "kept")


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("js_characters", "js_words")})


def op6_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return sharding.shard_by_size(table(spark, sf_dir, "documents"), 24)


def op8_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_token_store": op1_token_store,
    "op2_simhash_pigeonring": op2_simhash_pigeonring,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_distribution_divergence": op5_distribution_divergence,
    "op6_sainte_lague_mix": op6_sainte_lague_mix,
    "op7_sampled_splitters": op7_sampled_splitters,
    "op8_warc_index_first": op8_warc_index_first,
    "op9_url_filter": op9_url_filter,
    "op10_factorisation_machine": op10_factorisation_machine,
}

OP6_SQL = r"""
WITH RECURSIVE d AS (
 SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s0),
-- shares again and again: round i has the set of sources capped so far
r(i, capped, level) AS (
 SELECT 0, CAST([] AS BIGINT[]), (SELECT sum(source_size)::DOUBLE / sum(weight) FROM s0)
 UNION ALL
 SELECT i + 1, c, (SELECT (sum(source_size) - coalesce(sum(3 * source_size) FILTER (list_contains(c, k)), 0))::DOUBLE / nullif(sum(weight) FILTER (NOT list_contains(c, k)), 0) FROM s1)
 FROM (SELECT i, capped, (SELECT coalesce(list(k), []) FROM s1 WHERE list_contains(capped, k) OR weight * level > 3 * source_size) AS c FROM r) WHERE len(c) > len(capped)),
t AS (SELECT s1.*, CASE WHEN list_contains(l.capped, k) THEN 3.0::DOUBLE * source_size ELSE weight * l.level END AS target, CAST(ceil(n_rows / 4000.0) AS BIGINT) AS shards FROM s1, (SELECT * FROM r ORDER BY i DESC LIMIT 1) l),
b AS (SELECT CAST(round(sum(source_size)::DOUBLE / 128) AS BIGINT) AS n FROM t),
q AS (SELECT k, count(*) AS blocks FROM (SELECT k FROM (SELECT t.*, unnest(range(1, (SELECT n FROM b) + 1)) AS j FROM t WHERE target > 0) ORDER BY target / (2 * j - 1) DESC, source NULLS LAST LIMIT (SELECT n FROM b)) GROUP BY k),
e AS (SELECT d.*, t.k, t.source_size, t.target, CAST('0x' || left(d.o, 8) AS BIGINT) % t.shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT e.k, shard, sum(size)::BIGINT AS cell, any_value(coalesce(q.blocks, 0)) AS blocks FROM e LEFT JOIN q ON e.k = q.k GROUP BY e.k, shard),
cq AS (SELECT k, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cell / (2 * j - 1)::DOUBLE DESC, shard) AS rn FROM (SELECT c.*, unnest(range(1, blocks + 1)) AS j FROM c WHERE cell > 0)) WHERE rn <= blocks GROUP BY k, shard),
w AS (SELECT c.k, c.shard, c.cell, least(coalesce(quota, 0) * 128, c.cell * 3) AS words FROM c LEFT JOIN cq ON c.k = cq.k AND c.shard = cq.shard),
f AS (SELECT e.*, w.cell, w.words, CASE WHEN w.cell > 0 THEN w.words // w.cell ELSE 0 END AS full_times, sum(size) OVER (PARTITION BY e.k, e.shard ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) AS e_end FROM e JOIN w ON e.k = w.k AND e.shard = w.shard)
SELECT doc_id, size, source_size, target, CAST(full_times * size + greatest(0, least(e_end, words - full_times * cell) - (e_end - size)) AS BIGINT) AS taken FROM f
"""

OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT h.page_id, h.host, h.path, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, action) AS n
 FROM h LEFT JOIN rules ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, lang, body, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
v AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d),
g8 AS (SELECT doc_id, i, CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i + 7], ' ') END AS s FROM g),
gd AS (SELECT doc_id, i, s IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, s) > 1 AS twice FROM g8),
rw AS (SELECT doc_id, count(*) FILTER (cov) AS n FROM (SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS cov FROM gd) GROUP BY doc_id),
c AS (SELECT doc_id, lang, length(body) AS n_all, CAST(length(body) - length(regexp_replace(body, '[a-z]', '', 'g')) AS BIGINT) AS k0, CAST(length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')) AS BIGINT) AS k1, CAST(length(body) - length(regexp_replace(body, '[0-9]', '', 'g')) AS BIGINT) AS k2, CAST(length(body) - length(regexp_replace(body, '[\x20\x09\x0B-\x0D]', '', 'g')) AS BIGINT) AS k3, CAST(length(body) - length(regexp_replace(body, '\n', '', 'g')) AS BIGINT) AS k4, CAST(length(body) - length(regexp_replace(body, '[.,]', '', 'g')) AS BIGINT) AS k5, CAST(length(body) - length(regexp_replace(body, '[;:!?''\"()\-]', '', 'g')) AS BIGINT) AS k6, CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS k7, CAST(length(body) - length(regexp_replace(body, '[^\x00-\x7F]', '', 'g')) AS BIGINT) AS k9 FROM d),
c2 AS (SELECT *, n_all - (k0+k1+k2+k3+k4+k5+k6+k7+k9) AS k8 FROM c),
cr AS (SELECT lang, sum(k0)::DOUBLE / sum(n_all) AS q0, sum(k1)::DOUBLE / sum(n_all) AS q1, sum(k2)::DOUBLE / sum(n_all) AS q2, sum(k3)::DOUBLE / sum(n_all) AS q3, sum(k4)::DOUBLE / sum(n_all) AS q4, sum(k5)::DOUBLE / sum(n_all) AS q5, sum(k6)::DOUBLE / sum(n_all) AS q6, sum(k7)::DOUBLE / sum(n_all) AS q7, sum(k8)::DOUBLE / sum(n_all) AS q8, sum(k9)::DOUBLE / sum(n_all) AS q9 FROM c2 GROUP BY lang),
cp AS (SELECT doc_id, lang, n_all, k0::DOUBLE / greatest(n_all, 1) AS p0, k1::DOUBLE / greatest(n_all, 1) AS p1, k2::DOUBLE / greatest(n_all, 1) AS p2, k3::DOUBLE / greatest(n_all, 1) AS p3, k4::DOUBLE / greatest(n_all, 1) AS p4, k5::DOUBLE / greatest(n_all, 1) AS p5, k6::DOUBLE / greatest(n_all, 1) AS p6, k7::DOUBLE / greatest(n_all, 1) AS p7, k8::DOUBLE / greatest(n_all, 1) AS p8, k9::DOUBLE / greatest(n_all, 1) AS p9 FROM c2),
jc AS (SELECT doc_id, n_all, sqrt(greatest(0, (CASE WHEN p0 > 0 THEN p0 * log2(p0 / ((p0 + q0) / 2)) ELSE 0 END + CASE WHEN q0 > 0 THEN q0 * log2(q0 / ((p0 + q0) / 2)) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 * log2(p1 / ((p1 + q1) / 2)) ELSE 0 END + CASE WHEN q1 > 0 THEN q1 * log2(q1 / ((p1 + q1) / 2)) ELSE 0 END + CASE WHEN p2 > 0 THEN p2 * log2(p2 / ((p2 + q2) / 2)) ELSE 0 END + CASE WHEN q2 > 0 THEN q2 * log2(q2 / ((p2 + q2) / 2)) ELSE 0 END + CASE WHEN p3 > 0 THEN p3 * log2(p3 / ((p3 + q3) / 2)) ELSE 0 END + CASE WHEN q3 > 0 THEN q3 * log2(q3 / ((p3 + q3) / 2)) ELSE 0 END + CASE WHEN p4 > 0 THEN p4 * log2(p4 / ((p4 + q4) / 2)) ELSE 0 END + CASE WHEN q4 > 0 THEN q4 * log2(q4 / ((p4 + q4) / 2)) ELSE 0 END + CASE WHEN p5 > 0 THEN p5 * log2(p5 / ((p5 + q5) / 2)) ELSE 0 END + CASE WHEN q5 > 0 THEN q5 * log2(q5 / ((p5 + q5) / 2)) ELSE 0 END + CASE WHEN p6 > 0 THEN p6 * log2(p6 / ((p6 + q6) / 2)) ELSE 0 END + CASE WHEN q6 > 0 THEN q6 * log2(q6 / ((p6 + q6) / 2)) ELSE 0 END + CASE WHEN p7 > 0 THEN p7 * log2(p7 / ((p7 + q7) / 2)) ELSE 0 END + CASE WHEN q7 > 0 THEN q7 * log2(q7 / ((p7 + q7) / 2)) ELSE 0 END + CASE WHEN p8 > 0 THEN p8 * log2(p8 / ((p8 + q8) / 2)) ELSE 0 END + CASE WHEN q8 > 0 THEN q8 * log2(q8 / ((p8 + q8) / 2)) ELSE 0 END + CASE WHEN p9 > 0 THEN p9 * log2(p9 / ((p9 + q9) / 2)) ELSE 0 END + CASE WHEN q9 > 0 THEN q9 * log2(q9 / ((p9 + q9) / 2)) ELSE 0 END) / 2)) AS js FROM cp JOIN cr ON cp.lang IS NOT DISTINCT FROM cr.lang),
vl AS (SELECT doc_id, lang, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM v),
top AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, hex(encode(word))) AS rk FROM (SELECT lang, word, count(*) AS n FROM vl GROUP BY ALL)),
ref AS (SELECT lang, word, n FROM top WHERE rk <= 32),
tot AS (SELECT lang, count(*) AS n FROM vl GROUP BY lang),
rq AS (SELECT ref.lang, word, ref.n::DOUBLE / tot.n AS q FROM ref JOIN tot ON ref.lang IS NOT DISTINCT FROM tot.lang UNION ALL SELECT tot.lang, NULL, (tot.n - sum(ref.n))::DOUBLE / tot.n FROM tot JOIN ref ON ref.lang IS NOT DISTINCT FROM tot.lang GROUP BY tot.lang, tot.n),
dw AS (SELECT vl.doc_id, vl.lang, ref.word, count(*) AS n FROM vl LEFT JOIN ref ON vl.lang IS NOT DISTINCT FROM ref.lang AND vl.word = ref.word GROUP BY ALL),
grid AS (SELECT b.doc_id, rq.word, rq.q, coalesce(dw.n, 0)::DOUBLE / greatest(n_words, 1) AS p FROM b JOIN rq ON b.lang IS NOT DISTINCT FROM rq.lang LEFT JOIN dw ON dw.doc_id = b.doc_id AND dw.word IS NOT DISTINCT FROM rq.word WHERE n_words > 0),
jw AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js FROM grid GROUP BY doc_id),
o AS (SELECT b.doc_id, n_words, word_chars, n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, CASE WHEN n_all > 0 THEN jc.js ELSE 0 END AS jsc, coalesce(jw.js, 0) AS jsw, n_all FROM b LEFT JOIN l ON b.doc_id = l.doc_id LEFT JOIN rw ON b.doc_id = rw.doc_id LEFT JOIN jc ON b.doc_id = jc.doc_id LEFT JOIN jw ON b.doc_id = jw.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, round(jsc, 6) AS js_characters, round(jsw, 6) AS js_words,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR (jsc > 0.32 AND n_all >= 200) OR (jsw > 0.48 AND n_words >= 40)) AS kept FROM o
"""

OP7_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT)) AS crc_table),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, md5(coalesce(text, '')) AS digest, coalesce(text, '') AS body FROM documents),
h AS (SELECT doc_id, hex(encode(body)) AS x, len(hex(encode(body))) // 2 AS n FROM d),
k AS (SELECT doc_id, xor(list_reduce(list_transform(range(n), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda a, c: xor(a >> 8, crc_table[CAST(xor(a, c) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM h, t),
r AS (SELECT *, sum(size) OVER (ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER (PARTITION BY digest) AS bytes, sum(size) OVER () AS total FROM d),
m AS (SELECT *, CASE WHEN bytes * 1200 > total THEN start + size / 2 ELSE min(start) OVER (PARTITION BY digest) + bytes / 2 END AS middle FROM r),
s AS (SELECT *, CAST(least(floor(middle * 24 / total::DOUBLE), 23) AS INTEGER) AS shard FROM m)
SELECT s.doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY digest, s.doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s JOIN k ON s.doc_id = k.doc_id
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS chosen FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> chosen THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> chosen THEN chosen END AS refers_to FROM m
"""

ORACLE_SQL: dict[str, str] = {"op5_distribution_divergence": OP5_SQL, "op6_sainte_lague_mix": OP6_SQL, "op7_sampled_splitters": OP7_SQL, "op8_warc_index_first": OP8_SQL, "op9_url_filter": OP9_SQL}
