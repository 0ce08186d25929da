"""Queries over readers, scores, pass@k, payloads and the crossed design."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import readers as R
from gaugeworks.operators import contrasts, detector, passk
from gaugeworks.plans.registry import query
from gaugeworks.sources.fixtures import SHAPES, items, samples, scored, table

# SQL equivalents of readers (x: an expression)


def _h1(x: str) -> str:
    return f"nullif(regexp_extract(replace({x}, ',', ''), '####\\s*(-?\\d+\\.?\\d*)', 1), '')"


def _last(x: str, pattern: str, group: int) -> str:
    return f"list_extract(regexp_extract_all({x}, '{pattern}', {group}), -1)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _hlast(x: str) -> str:
    return _last(f"replace({x}, ',', '')", "####\\s*(-?\\d+\\.?\\d*)", 1)


def _num(x: str) -> str:
    return _last(f"replace({x}, ',', '')", "-?\\d+\\.?\\d*", 0)


def _fold(x: str) -> str:
    opened = lambda i: f"(length(left({x}, {i})) - length(replace(left({x}, {i}), '{{', '')))"
    closed = lambda i: f"(length(left({x}, {i})) - length(replace(left({x}, {i}), '}}', '')))"
    return f"left({x}, list_filter(range(1, length({x}) + 1), lambda i: {closed('i')} > {opened('i')})[1] - 1)"


def _boxed(x: str) -> str:
    rest = f"substr({x}, strpos({x}, chr(92) || 'boxed{{') + 7)"
    return f"CASE WHEN strpos({x}, chr(92) || 'boxed{{') > 0 THEN {_fold(rest)} END"


def _eq(a: str, b: str) -> str:
    return f"coalesce(CASE WHEN TRY_CAST({a} AS DOUBLE) IS NOT NULL AND TRY_CAST({b} AS DOUBLE) IS NOT NULL THEN isfinite(TRY_CAST({a} AS DOUBLE)) AND isfinite(TRY_CAST({b} AS DOUBLE)) AND abs(TRY_CAST({a} AS DOUBLE) - TRY_CAST({b} AS DOUBLE)) < 1e-3 ELSE trim({a}) = trim({b}) END, false)"


GOLD = f"coalesce({_h1('ground_truth')}, {_num('ground_truth')}, ground_truth)"
STRICT, LENIENT = _eq(_h1("response"), GOLD), _eq(f"coalesce({_h1('response')}, {_num('response')})", GOLD)
BOXED = _eq(_num(_boxed("response")), GOLD)
#: Verdicts as columns of a common table.
JUDGED = f", judged AS (SELECT *, {STRICT} AS st, {LENIENT} AS le FROM scored)\n"
PER_ITEM = JUDGED + ", per_item AS (SELECT id, count(*) AS n, count(*) FILTER (le) AS c, count(*) FILTER (st) AS c_strict FROM judged GROUP BY id)\n"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored samples with both verdicts (le, st), each extraction made once a response."""
    both = scored(spark, sf_dir).withColumn("_v", R.verdicts(F.col("response"), F.col("ground_truth")))
    return both.withColumns({"le": F.col("_v.lenient"), "st": F.col("_v.strict")}).drop("_v")


def per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passk.per_item(judged(spark, sf_dir), F.col("le"), F.col("st"))


@query("per_item_counts", PER_ITEM + "SELECT * FROM per_item")
def per_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_item(spark, sf_dir)


@query("passk_summary", PER_ITEM + """SELECT count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_responses, min(n) AS min_n, max(n) AS max_n, CAST(sum(c) AS BIGINT) AS correct, CAST(sum(c_strict) AS BIGINT) AS correct_strict,
 round(avg(c::DOUBLE / n), 9) AS mean_solve_rate, round(avg(c_strict::DOUBLE / n), 9) AS mean_solve_rate_strict, count(*) FILTER (c = 0) AS zero_correct, count(*) FILTER (c_strict = 0) AS zero_correct_strict,
 round(avg(c::DOUBLE / n) - avg(c_strict::DOUBLE / n), 9) AS gap_at_1 FROM per_item""")  # fmt: skip
def passk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passk.summary(per_item(spark, sf_dir))


def _passk(c: str) -> str:
    return f"CASE WHEN {c} = 0 THEN 0.0 WHEN n - {c} < k THEN 1.0 ELSE 1.0 - exp(lgamma(n - {c} + 1) - lgamma(n - {c} - k + 1) - lgamma(n + 1) + lgamma(n - k + 1)) END"


_CURVE = f"round(avg({_passk('c')}), 9) AS lenient, round(avg({_passk('c_strict')}), 9) AS strict"


@query("passk_curve", PER_ITEM + f"SELECT k, {_CURVE} FROM per_item, (SELECT unnest([1, 2, 4, 8, 16, 32]) AS k) WHERE k <= (SELECT min(n) FROM per_item) GROUP BY k")
def passk_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all items, for k up to the smallest number of responses."""
    out = passk.curve(per_item(spark, sf_dir))
    return out.select("k", F.round("lenient", 9).alias("lenient"), F.round("strict", 9).alias("strict"))


@query("passk_curve_by_n", PER_ITEM + f"SELECT n, k, {_CURVE} FROM per_item, (SELECT unnest([1, 2, 4, 8, 16, 32]) AS k) WHERE k <= n GROUP BY n, k")
def passk_curve_by_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve for each number of responses that items have, so that all items count at every k that they reach."""
    out = passk.curve(per_item(spark, sf_dir), by="n")
    return out.select("n", "k", F.round("lenient", 9).alias("lenient"), F.round("strict", 9).alias("strict"))


@query("pass_at_k_per_item", PER_ITEM + f"SELECT id, k, round({_passk('c')}, 9) AS p FROM per_item, (SELECT unnest([1, 2, 4]) AS k) WHERE k <= n")
def pass_at_k_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = per_item(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).where("k <= n")
    return rows.select("id", "k", F.round(passk.pass_at_k(F.col("n"), F.col("c"), F.col("k")), 9).alias("p"))


@query("zero_correct_items", PER_ITEM + "SELECT id, n FROM per_item WHERE c = 0")
def zero_correct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_item(spark, sf_dir).where("c = 0").select("id", "n")


@query("dedup_keep_largest", """, r AS (SELECT id, supplier % 7 AS run, count(*) AS n, sum(output_tokens)::BIGINT AS tokens FROM samples GROUP BY id, supplier % 7)
SELECT id, run, n, tokens FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, run) AS k FROM r) WHERE k = 1""")
def dedup_keep_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = samples(spark, sf_dir).groupBy("id", (F.col("supplier") % 7).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("tokens"))
    return passk.keep_largest(runs, "run").select("id", "run", "n", "tokens")


@query("truncation_rate", "SELECT count(*) FILTER (finish_reason = 'length') AS truncated, count(*) AS responses, round(count(*) FILTER (finish_reason = 'length')::DOUBLE / count(*), 9) AS truncation_rate FROM samples")
def truncation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passk.truncation(samples(spark, sf_dir))


def _response() -> Column:
    return F.col("response")


def _reader(name: str, reader: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return samples(spark, sf_dir).select("id", "sample", reader(_response()).alias("answer"))

    query(name, f"SELECT id, sample, {sql} AS answer FROM samples")(run)


_reader("reader_hash_first", R.first_hash, _h1("response"))
_reader("reader_hash_last", R.last_hash, _hlast("response"))
_reader("reader_hash_tail300", R.tail_hash, _last("translate(right(response, 300), ',$', '')", "####\\s*(-?\\d+\\.?\\d*)", 1))
_reader("reader_hash_any", R.hash_any, f"nullif({_strip("regexp_extract(response, '####\\s*(.+)', 1)")}, '')")
_reader("reader_hash_line", R.hash_line, f"nullif({_strip("regexp_extract(response, '####[ \\t]*([^\\n]*)', 1)")}, '')")
_reader("reader_hash_line_last", lambda x: R.hash_line(x, "last"), f"nullif({_strip(_last('response', '####[ \\t]*([^\\n]*)', 1))}, '')")
_reader("reader_last_number", R.last_number, _num("response"))
_reader("reader_boxed_first", R.boxed, _boxed("response"))
_AFTER = "regexp_replace(response, '(?s)^.*?\\\\boxed\\s*\\{', '')"
_reader("reader_boxed_payload", R.boxed_payload, f"CASE WHEN regexp_matches(response, '\\\\boxed\\s*\\{{') THEN nullif(trim({_fold(_AFTER)}), '') END")
_reader("reader_boxed_flat", R.flat_box, f"translate(trim({_last('right(response, 300)', chr(92) * 2 + 'boxed' + chr(92) + '{([^{}]*)' + chr(92) + '}', 1)}), ',$', '')")
_reader("reader_flexible", R.flexible_number, "coalesce(list_extract(list_filter(regexp_extract_all(right(response, 300), '-?[0-9.,]+'), lambda x: x <> '.'), -1), list_extract(regexp_extract_all(right(response, 300), '-?[0-9.,]+'), 1))")


@query("reader_novel", "SELECT id, sample, nullif(regexp_extract(replace(replace(response, '####', '@@@'), ',', ''), '@@@\\s*(-?\\d+\\.?\\d*)', 1), '') AS answer FROM samples")
def reader_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(_response(), F.lit("####"), F.lit("@@@"))
    return samples(spark, sf_dir).select("id", "sample", R.novel(text).alias("answer"))


@query("reader_last_number_documents", f"SELECT doc_id, {_num('text')} AS answer FROM documents", fixtures=False)
def reader_last_number_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.last_number(F.col("text")).alias("answer"))


@query("score_verdicts", f"SELECT id, sample, {STRICT} AS strict, {LENIENT} AS lenient, {BOXED} AS boxed FROM scored")
def score_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).withColumn("_v", R.verdicts(_response(), F.col("ground_truth"), box=True))
    return d.select("id", "sample", "_v.strict", "_v.lenient", "_v.boxed")


@query("score_novel", f"SELECT id, sample, {_eq("nullif(regexp_extract(replace(replace(response, '####', '@@@'), ',', ''), '@@@\\s*(-?\\d+\\.?\\d*)', 1), '')", GOLD)} AS novel FROM scored")
def score_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "sample", R.novel_strict(F.replace(_response(), F.lit("####"), F.lit("@@@")), F.col("ground_truth")).alias("novel"))


@query("response_score_struct", f"""SELECT id, sample, {STRICT} AS strict_first_hash, {_eq(_hlast('response'), GOLD)} AS strict_last_hash, {LENIENT} AS frozen_lenient, {_eq(_num('response'), GOLD)} AS last_number,
 {_h1('response')} IS NOT NULL AS hash_parseable, contains(response, '####') AS marker_present, {_h1('response')} AS extracted_first_hash, {_hlast('response')} AS extracted_last_hash, {_num('response')} AS extracted_last_number FROM scored""")  # fmt: skip
def response_score_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "sample", R.score_struct(_response(), F.col("ground_truth")).alias("s")).select("id", "sample", "s.*")


@query("reader_parity", f"SELECT count(*) FILTER ({STRICT} <> {_eq(_h1('response'), GOLD)}) AS differing FROM scored")
def reader_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two statements of the strict reader must agree on every response."""
    first = F.get(R.matches(R.without_commas(_response()), R.HASH_NUMBER, 1), F.lit(0))
    other = R.numeric_equal(first, R.reference(F.col("ground_truth")))
    return scored(spark, sf_dir).agg(F.count_if(R.strict(_response(), F.col("ground_truth")) != other).alias("differing"))


_FLAT = f"translate(trim({_last('right(response, 300)', chr(92) * 2 + 'boxed' + chr(92) + '{([^{}]*)' + chr(92) + '}', 1)}), ',$', '')"


@query("rewards", f"SELECT id, sample, CASE WHEN {_FLAT} IS NULL THEN 0.0 WHEN {_FLAT} = CAST(answer AS VARCHAR) THEN 1.0 ELSE 0.1 END::DOUBLE AS boxed_reward, CASE WHEN {LENIENT} THEN 1.0 ELSE 0.0 END::DOUBLE AS lenient_reward FROM scored")
def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = R.boxed_reward(_response(), F.col("answer").cast("string"), format_score=0.1)
    return scored(spark, sf_dir).select("id", "sample", boxed.alias("boxed_reward"), R.lenient_reward(_response(), F.col("ground_truth")).alias("lenient_reward"))


# payloads

_FOUR = "regexp_matches(response, '(^|[^#])####([^#]|$)')"
_HP = "regexp_matches(response, '(^|[^#])####[ \\t]*(\\$|\\*\\*|`| )*[+-]?([0-9]|\\.[0-9])')"
#: What follows each box's marker, with escaped characters blotted out (two for two) to find the closing brace, and as it is.
_TAILS = """list_transform(range(2, len(string_split_regex(response, '\\\\boxed\\s*\\{')) + 1), lambda i: array_to_string(string_split_regex(response, '\\\\boxed\\s*\\{')[i:], '.....{'))"""
_CONTENTS = f"list_transform(tails, lambda t: left(t, length({_fold("regexp_replace(t, '(?s)\\\\.', '..', 'g')")})))"
_HOLLOW = """translate(replace(replace(replace(replace(replace(replace(replace(trim(c), chr(92) || '(', ''), chr(92) || ')', ''), chr(92) || '[', ''), chr(92) || ']', ''), chr(92) || '$', ''), chr(92) || '{', ''), chr(92) || '}', ''), ' $`*_{}[]()"''.,:;!?' || chr(9) || chr(10) || chr(13), '')"""
FLAGS = f""", tails AS (SELECT *, {_TAILS} AS tails FROM samples), contents AS (SELECT *, {_CONTENTS} AS contents FROM tails),
 flags AS (SELECT * EXCLUDE (tails, contents), {_FOUR} AS h_marker, len(tails) > 0 AS b_marker, {_HP} AS h_payload, len(list_filter(contents, lambda c: c IS NOT NULL AND {_HOLLOW} <> '')) > 0 AS b_payload FROM contents)\n"""
CATEGORY = "CASE WHEN h_payload AND b_payload THEN 'both' WHEN CASE WHEN request = 'hash' THEN h_payload ELSE b_payload END THEN 'requested_only' WHEN h_payload OR b_payload THEN 'other_only' ELSE 'neither' END"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumns(detector.flags(_response()))


@query("payload_flags", FLAGS + "SELECT id, sample, h_marker, b_marker, h_payload, b_payload FROM flags")
def payload_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("id", "sample", "h_marker", "b_marker", "h_payload", "b_payload")


@query("payload_category_by_cell", FLAGS + f"SELECT training, request, {CATEGORY} AS category, count(*) AS responses FROM flags GROUP BY ALL")
def payload_category_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = detector.category(F.col("h_payload"), F.col("b_payload"), F.col("request"))
    return _flagged(spark, sf_dir).groupBy("training", "request", kind.alias("category")).agg(F.count(F.lit(1)).alias("responses"))


@query("payload_cells", FLAGS + f""", k AS (SELECT *, {CATEGORY} AS category FROM flags)
SELECT seed, training, request, count(*) AS responses, count(*) FILTER (h_marker) AS h_marker, count(*) FILTER (b_marker) AS b_marker, count(*) FILTER (h_payload) AS h_payload, count(*) FILTER (b_payload) AS b_payload,
 count(*) FILTER (category = 'requested_only') AS requested_only, count(*) FILTER (category = 'other_only') AS other_only, count(*) FILTER (category = 'both') AS "both", count(*) FILTER (category = 'neither') AS neither FROM k GROUP BY ALL""")  # fmt: skip
def payload_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detector.cell_counts(samples(spark, sf_dir), "seed", "training", "request")
    return out.drop("raw_h_nonempty", "raw_b_nonempty")


@query("payload_candidates")
def payload_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.candidates(samples(spark, sf_dir), "id", "sample")


#: The reasons that each shape of the fixtures gives by the detector's rules, stated by hand.
_REASONS = ((4, "wrapped_numeric_hash_payload"), (6, "unbalanced_box"), (8, "empty_hash_payload"), (8, "instruction_cue_before_marker"), (9, "empty_hash_payload"), (11, "empty_box_payload"), (13, "unbalanced_box"), (15, "wrapped_numeric_hash_payload"), (15, "unbalanced_box"), (16, "nonnumeric_hash_continuation"))
_SHAPED = f"""WITH reasons(shape, reason) AS (VALUES {', '.join(map(str, _REASONS))}), l AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'hash' ELSE 'boxed' END AS training, CASE WHEN l_suppkey % 2 = 0 THEN 'hash' ELSE 'boxed' END AS request, l_partkey % {len(SHAPES)} AS shape FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


@query("payload_reason_counts", _SHAPED + "SELECT training, request, reason, count(*) AS count FROM l JOIN reasons ON l.shape = reasons.shape GROUP BY ALL", fixtures=False)
def payload_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.reason_counts(samples(spark, sf_dir), "training", "request")


@query("responses_with_candidates", _SHAPED + "SELECT training, request, count(*) AS responses_with_candidates FROM l WHERE shape IN (SELECT shape FROM reasons) GROUP BY ALL", fixtures=False)
def responses_with_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector.responses_with_candidates(samples(spark, sf_dir), "training", "request").where("responses_with_candidates > 0")


@query("instruction_cues", "SELECT id, sample, regexp_matches(split_part(response, '####', 1), '(?i)(output|report|write|put|place|give|provide|present|show)\\s+(the\\s+)?(final\\s+)?answer\\s+(after|within|inside)\\s*[\"''`]*\\s*$') AS cue FROM samples WHERE contains(response, '####')")
def instruction_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.substring_index(_response(), "####", 1)
    return samples(spark, sf_dir).where(F.contains(_response(), F.lit("####"))).select("id", "sample", detector.cue_before(before).alias("cue"))


# crossed design


@query("cell_rates", JUDGED + """SELECT training, request, count(*) AS responses, count(*) FILTER (st) AS strict_count, round(avg(st::INT), 9) AS strict_rate, count(*) FILTER (le) AS lenient_count, round(avg(le::INT), 9) AS lenient_rate,
 count(*) FILTER (finish_reason = 'length') AS truncated, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, median(output_tokens) AS median_tokens FROM judged GROUP BY ALL""")  # fmt: skip
def cell_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.cell_rates(judged(spark, sf_dir), ["training", "request"], {"strict": F.col("st"), "lenient": F.col("le")})


def _did(by: str) -> str:
    rate = lambda t, r: f"avg(CASE WHEN training = '{t}' AND request = '{r}' THEN st::INT END)"
    c = {t[0] + r[0]: rate(t, r) for t in ("hash", "boxed") for r in ("hash", "boxed")}
    own = ", ".join(f"round(100 * {v}, 9) AS {k}" for k, v in c.items())
    return f"SELECT {by}{own}, round(100 * (({c['hh']} - {c['bh']}) - ({c['hb']} - {c['bb']})), 9) AS interaction_pp FROM judged"


@query("interaction_did", JUDGED + _did(""))
def interaction_did(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.interaction(judged(spark, sf_dir), [], F.col("st"))


@query("interaction_by_seed", JUDGED + _did("seed, ") + " GROUP BY seed")
def interaction_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.interaction(judged(spark, sf_dir), ["seed"], F.col("st"))


@query("seed_aggregate", JUDGED + ", i AS (" + _did("seed, ") + " GROUP BY seed) SELECT round(avg(interaction_pp), 9) AS mean, round(stddev_samp(interaction_pp), 9) AS sd, min(interaction_pp) AS min, max(interaction_pp) AS max, round(max(interaction_pp) - min(interaction_pp), 9) AS span, count(interaction_pp) AS n FROM i")
def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.spread(interaction_by_seed(spark, sf_dir), "interaction_pp", [])


PAIRS = JUDGED + """, pairs AS (SELECT id, request, min_by(st::INT, sample) FILTER (training = 'boxed') AS b, min_by(st::INT, sample) FILTER (training = 'hash') AS r FROM judged GROUP BY id, request
 HAVING count(*) FILTER (training = 'boxed') > 0 AND count(*) FILTER (training = 'hash') > 0)\n"""
TRANSITIONS = PAIRS + ", t AS (SELECT request, count(*) AS pairs, count(*) FILTER (b = 0 AND r = 1) AS gained, count(*) FILTER (b = 1 AND r = 0) AS lost, round(avg(r - b), 9) AS mean_difference FROM pairs GROUP BY request)\n"


def _pairs(spark: SparkSession, sf_dir: str, outcome: str = "st") -> DataFrame:
    return contrasts.paired(judged(spark, sf_dir), "training", "boxed", "hash", F.col(outcome), ["id", "request"])


@query("paired_transitions", TRANSITIONS + "SELECT * FROM t")
def paired_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.transitions(_pairs(spark, sf_dir), ["request"])


@query("mcnemar_exact", TRANSITIONS.replace("GROUP BY request)\n", "GROUP BY request, id % 101)\n").replace("SELECT request, count(*) AS pairs", "SELECT request, id % 101 AS block, count(*) AS pairs") + """SELECT request, block, gained, lost, round(CASE WHEN gained + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1),
 lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))))) END, 7) AS p FROM t""")  # fmt: skip
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumn("block", F.col("id") % 101)
    t = contrasts.transitions(pairs, ["request", "block"])
    return t.select("request", "block", "gained", "lost", F.round(contrasts.mcnemar_p(F.col("gained"), F.col("lost")), 7).alias("p"))


@query("mcnemar_exact_whole", TRANSITIONS + """SELECT request, gained, lost, round(CASE WHEN gained + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1),
 lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))))) END, 7) AS p FROM t""")  # fmt: skip
def mcnemar_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = paired_transitions(spark, sf_dir)
    return t.select("request", "gained", "lost", F.round(contrasts.mcnemar_exact(F.col("gained"), F.col("lost")), 7).alias("p"))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a cell are bounded by its evaluation set: blocks of 500 ids."""
    pairs = _pairs(spark, sf_dir).withColumn("block", F.expr("id div 500")).withColumn("position", F.col("id")).withColumn("d", F.col("r") - F.col("b"))
    return contrasts.bootstrap(pairs, ["request", "block"], "d")


@query("readout_gap", JUDGED + """, g AS (SELECT id, request, min_by(st::INT - le::INT, sample) FILTER (training = 'boxed') AS b, min_by(st::INT - le::INT, sample) FILTER (training = 'hash') AS r FROM judged GROUP BY id, request
 HAVING count(*) FILTER (training = 'boxed') > 0 AND count(*) FILTER (training = 'hash') > 0) SELECT request, round(avg(r - b), 9) AS net_gap_reduction FROM g GROUP BY request""")  # fmt: skip
def readout_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("st").cast("int") - F.col("le").cast("int")
    pairs = contrasts.paired(judged(spark, sf_dir), "training", "boxed", "hash", gap, ["id", "request"])
    return pairs.groupBy("request").agg(F.round(F.avg((F.col("r") - F.col("b")).cast("double")), 9).alias("net_gap_reduction"))


@query("gap_decomposition", JUDGED + """, a AS (SELECT avg(CASE WHEN training = 'boxed' THEN st::INT END) AS bs, avg(CASE WHEN training = 'boxed' THEN le::INT END) AS bl, avg(CASE WHEN training = 'hash' THEN st::INT END) AS rs, avg(CASE WHEN training = 'hash' THEN le::INT END) AS rl FROM judged)
SELECT round(rs - bs, 9) AS strict_gain, round(rl - bl, 9) AS lenient_gain, round(bl - bs, 9) AS initial_gap, round(rl - rs, 9) AS residual_gap, round((bl - bs) - (rl - rs), 9) AS net_gap_reduction, round((bl - bs) / nullif(rs - bs, 0), 6) AS initial_gap_share FROM a""")  # fmt: skip
def gap_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda t, c: F.avg(F.when(F.col("training") == t, F.col(c).cast("double")))
    a = judged(spark, sf_dir).agg(rate("boxed", "st").alias("bs"), rate("boxed", "le").alias("bl"), rate("hash", "st").alias("rs"), rate("hash", "le").alias("rl"))
    parts = contrasts.decompose(*map(F.col, ("bs", "bl", "rs", "rl")))
    return a.select(*[F.round(c, 6 if n == "initial_gap_share" else 9).alias(n) for n, c in parts.items()])


@query("protocol_drift", "SELECT request, count(DISTINCT (seed, finish_reason)) AS protocols FROM samples GROUP BY request")
def protocol_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.protocol_drift(samples(spark, sf_dir), "request", ["seed", "finish_reason"])


@query("missing_cells", "SELECT s.seed, t.training, r.request FROM (SELECT unnest(range(1990, 2003))::INTEGER AS seed) s, (VALUES ('hash'), ('boxed')) t(training), (VALUES ('hash'), ('boxed')) r(request) WHERE NOT EXISTS (SELECT 1 FROM samples x WHERE x.seed = s.seed AND x.training = t.training AND x.request = r.request)")
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrasts.missing_cells(samples(spark, sf_dir), {"seed": list(range(1990, 2003)), "training": ["hash", "boxed"], "request": ["hash", "boxed"]})


@query("disagreements", JUDGED + "SELECT id, sample, st AS strict, le AS lenient, finish_reason FROM judged WHERE st <> le OR finish_reason = 'length'")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).where("st <> le OR finish_reason = 'length'")
    return rows.select("id", "sample", F.col("st").alias("strict"), F.col("le").alias("lenient"), "finish_reason")


@query("pending_items", "SELECT id FROM items WHERE id NOT IN (SELECT id FROM samples WHERE supplier % 2 = 0)")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = samples(spark, sf_dir).where("supplier % 2 = 0").select("id")
    return items(spark, sf_dir).join(done, "id", "left_anti").select("id")


@query("cell_receipts", "SELECT count(DISTINCT (seed, training, request)) AS cells, count(*) AS responses FROM samples")
def cell_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).agg(F.count_distinct(F.struct("seed", "training", "request")).alias("cells"), F.count(F.lit(1)).alias("responses"))


@query("long_metrics", JUDGED + """, c AS (SELECT training, request, avg(st::INT) AS strict, avg(le::INT) AS lenient, avg((finish_reason = 'length')::INT) AS truncated FROM judged GROUP BY ALL)
SELECT training, request, metric, round(value, 9) AS value FROM (UNPIVOT c ON strict, lenient, truncated INTO NAME metric VALUE value)""")
def long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.col("finish_reason") == "length"
    c = judged(spark, sf_dir).groupBy("training", "request").agg(*[F.avg(x.cast("double")).alias(n) for n, x in (("strict", F.col("st")), ("lenient", F.col("le")), ("truncated", cut))])
    return c.unpivot(["training", "request"], ["strict", "lenient", "truncated"], "metric", "value").withColumn("value", F.round("value", 9))
