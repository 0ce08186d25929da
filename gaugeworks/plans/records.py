"""Queries over sampler metrics, ledgers, label rows and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import budget, calibration, gates, sampling
from gaugeworks.plans.registry import query
from gaugeworks.plans.scoring import JUDGED, judged
from gaugeworks.plans.statistics import DRAWS, STRATA, _draws, _strata
from gaugeworks.sources.fixtures import table

# sampler

_BATCH = STRATA + """, r AS (SELECT o_orderkey AS draw, o_custkey AS item, c_mktsegment AS stratum, CAST(l_discount AS DOUBLE) AS proxy FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
 pre AS (SELECT c_mktsegment AS stratum, sum(mixed / n) AS proposal_mass FROM customer JOIN m ON c_mktsegment = stratum GROUP BY 1),
 pd AS (SELECT stratum, count(*) AS k, avg(x) AS mean FROM (SELECT stratum, draw, avg(proxy) AS x FROM r GROUP BY ALL) GROUP BY 1),
 it AS (SELECT stratum, avg(x) AS obs FROM (SELECT stratum, item, avg(proxy) AS x FROM r GROUP BY ALL) GROUP BY 1),
 nx AS (SELECT m.stratum, target, moment, CASE WHEN obs IS NULL THEN moment ELSE 0.9 * moment + 0.1 * greatest(obs, 0.000001) END AS nm FROM m LEFT JOIN it ON m.stratum = it.stratum),
 np AS (SELECT *, 0.9 * target * sqrt(nm) / sum(target * sqrt(nm)) OVER () + 0.1 * target AS q FROM nx)
"""


@query("sampler_metrics", _BATCH + "SELECT np.stratum, round(target, 9) AS target_mass, round(proposal_mass, 9) AS proposal_mass, round(moment, 9) AS second_moment, coalesce(k, 0) AS realized_prompt_count, round(coalesce(mean, 0), 9) AS raw_proxy_mean, round(q / sum(q) OVER (), 9) AS next_proposal_mass, round(nm, 9) AS next_second_moment, 1.0::DOUBLE AS proposal_exponent FROM np LEFT JOIN pre ON np.stratum = pre.stratum LEFT JOIN pd ON np.stratum = pd.stratum", fixtures=False)
def sampler_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws are orders, items customers, rows line items, the proxy their discount."""
    strata = _strata(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("stratum"))
    items = sampling.item_probabilities(customers, strata, "stratum", "mixed").withColumnRenamed("item_probability", "proposal")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw"), F.col("o_custkey").alias("item")).join(customers, "item")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draw"), F.col("l_discount").cast("double").alias("proxy")).join(orders, "draw")
    out = sampling.metrics(strata.select("stratum", "target", F.col("moment").alias("second_moment")), items, rows, decay=0.9, floor=1e-6, exponent=1.0, epsilon=0.1)
    return out.select("stratum", "realized_prompt_count", "proposal_exponent", *[F.round(c, 9).alias(c) for c in ("target_mass", "proposal_mass", "second_moment", "raw_proxy_mean", "next_proposal_mass", "next_second_moment")])


@query("default_draws", "SELECT o_orderkey AS item, o_orderpriority AS stratum, 1.0 / count(*) OVER () AS target_probability, 1.0 / count(*) OVER () AS proposal_probability, 1.0::DOUBLE AS importance_weight, -1::BIGINT AS draw_number FROM orders", fixtures=False)
def default_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.default_draws(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("stratum")), "item", "stratum")


#: Spoiled draws, in words that both dialects have.
_SPOILED = {
    "target_probability": "CASE WHEN draw_number % 89 = 0 THEN NULL ELSE target_probability END",
    "proposal_probability": "CASE WHEN draw_number % 83 = 0 THEN -proposal_probability ELSE proposal_probability END",
    "importance_weight": "CASE WHEN draw_number % 97 = 0 THEN importance_weight * 1.000000001 ELSE importance_weight END",
}


@query("draw_violations", DRAWS + f", x AS (SELECT draw_number, {', '.join(f'{v} AS {k}' for k, v in _SPOILED.items())} FROM d)" + """
SELECT draw_number, 'index' AS gate FROM x WHERE draw_number >= 5000 UNION ALL SELECT draw_number, 'target_probability' FROM x WHERE target_probability IS NULL
UNION ALL SELECT draw_number, 'proposal_probability' FROM x WHERE proposal_probability <= 0
UNION ALL SELECT draw_number, 'importance_weight' FROM x WHERE target_probability IS NOT NULL AND proposal_probability > 0 AND draw_number % 97 = 0""", fixtures=False)  # fmt: skip
def draw_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of which some were spoiled, against 5,000 items."""
    draws = _draws(spark, sf_dir).selectExpr("draw_number", *[f"{v} AS {k}" for k, v in _SPOILED.items()])
    return sampling.draw_violations(draws, "draw_number", "draw_number", F.lit(5000))


@query("probability_violations", "SELECT 'negative' AS gate, CAST(c_custkey AS VARCHAR) AS detail FROM customer WHERE c_custkey % 10 <> 0 AND c_acctbal < 0 UNION ALL SELECT 'not finite', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 0", fixtures=False)
def probability_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("c_custkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal").cast("double"))
    return sampling.probability_violations(table(spark, sf_dir, "customer"), "c_custkey", weight)


# ledgers


@query("batch_counts", "SELECT l_suppkey % 7 AS batch, count(DISTINCT l_orderkey) AS sampled_prompts, count(*) AS completions, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS generated_tokens FROM lineitem GROUP BY 1", fixtures=False)
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("batch"), F.col("l_orderkey").alias("draw"), F.array_repeat(F.lit(1), F.col("l_quantity").cast("int")).alias("mask"))
    return budget.batch_counts(rows, ["batch"], "draw", F.col("mask"))


_LEDGER = {
    "completions": "CASE WHEN o_orderkey % 50 = 0 THEN -1.0 WHEN o_orderkey % 51 = 0 THEN 0.5 ELSE CAST(o_custkey AS DOUBLE) END",
    "reward_calls": "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END",
    "wall_seconds": "CASE WHEN o_orderkey % 59 = 0 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 61 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) END",
}


@query("counter_violations", "SELECT o_orderkey AS id, 'completions' AS field FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 51 = 0 UNION ALL SELECT o_orderkey, 'reward_calls' FROM orders WHERE o_orderkey % 53 = 0 UNION ALL SELECT o_orderkey, 'wall_seconds' FROM orders WHERE o_orderkey % 59 = 0 OR o_orderkey % 61 = 0", fixtures=False)
def counter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", *[f"{v} AS {k}" for k, v in _LEDGER.items()])
    return budget.domain_violations(ledger, "id", ["completions", "reward_calls"], ["wall_seconds"])


_CELLS = "SELECT seed, training, request, count(*) AS responses, count(*) FILTER (st) AS strict FROM judged GROUP BY ALL"


@query("archive_differences", JUDGED + f", now AS ({_CELLS}) SELECT seed, training, request, 'strict' AS count, strict AS recomputed, strict + 1 AS archived FROM now WHERE seed = 1995")
def archive_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts recomputed from responses, against an archive in which one seed's strict counts are off by one."""
    cells = judged(spark, sf_dir).groupBy("seed", "training", "request").agg(F.count(F.lit(1)).alias("responses"), F.count_if("st").alias("strict"))
    archived = cells.withColumn("strict", F.col("strict") + (F.col("seed") == 1995).cast("int"))
    return gates.archive_differences(cells, archived, ["seed", "training", "request"], ["responses", "strict"])


# labels: a row per order, each field by a rule that both dialects have


def _pick(key: str, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN ({key}) % {len(values)} = {i} THEN {v if v == 'NULL' else repr(v)}" for i, v in enumerate(values)) + " END"


_STATUS = ("CLEAR_ANSWER", "CLEAR_ANSWER", "CLEAR_ANSWER", "NO_ANSWER", "UNRESOLVED_CONFLICT", "AMBIGUOUS", "CLEAR")
_CORRECT = ("CORRECT", "CORRECT", "INCORRECT", "UNRESOLVED", "MAYBE")
_FIELDS = {
    "state": "o_orderpriority",
    "final_status": _pick("o_custkey + o_orderkey", *_STATUS[:6]),
    "final_answer_correct": _pick("o_orderkey", *_CORRECT[:4]),
    "A_status": _pick("o_custkey", *_STATUS),
    "B_status": _pick("o_custkey + o_orderkey % 2 * 3", *_STATUS),
    "A_answer_correct": _pick("o_orderkey", *_CORRECT),
    "B_answer_correct": _pick("o_orderkey + o_custkey % 3 % 2", *_CORRECT),
    "A_B_answer_equivalence": _pick("o_custkey", "EQUIVALENT", "EQUIVALENT", "DIFFERENT", "UNRESOLVED"),
    "agreement_type": _pick("o_orderkey", "FULL_AGREEMENT", "STATUS_DISAGREEMENT", "FULL_AGREEMENT"),
    "adjudication_reason": _pick("o_custkey", "", "read again", "INDEPENDENT_A_B_AGREEMENT_NOT_SELECTED_FOR_AUDIT", " "),
    "final_has_conflict": _pick("o_orderkey", "YES", "NO", "NO", "yes"),
    "final_self_correction": _pick("o_orderkey", "YES", "NO"),
    **{f"{w}_{f}": _pick(f"o_orderkey + {k}", "YES", "NO", "NO", "NO", "NO") for k, w in enumerate("AB") for f in ("has_self_correction", "has_conflicting_answer_fields")},
    **{f"{w}_old_answer_explicitly_withdrawn": _pick("o_orderkey", "N/A", "NO", "NULL") for w in "AB"},
    **{f"{w}_reference_issue": _pick(f"o_custkey + {k}", "NO", "NO", "NO", "POSSIBLE_REFERENCE_ERROR") for k, w in enumerate("AB")},
    **{f"{w}_{f}": _pick("o_custkey", "text", "", "NULL") for w in "AB" for f in ("committed_answer", "evidence_span", "notes")},
    **{f"{w}_fidelity_{s}": _pick("o_orderkey", "FAITHFUL", "NULL") for w in "AB" for s in ("R1", "R2", "R3")},
    **{f"{r}_fidelity": _pick(f"o_custkey + {k}", "FAITHFUL", "UNFAITHFUL", "UNRESOLVED", "NOT_APPLICABLE") for k, r in enumerate(("strict", "mv"))},
}
LABELS = f"WITH labels AS (SELECT o_orderkey AS sample_id, {', '.join(f'{v} AS {k}' for k, v in _FIELDS.items())} FROM orders)\n"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sample_id", *[f"{v} AS {k}" for k, v in _FIELDS.items()])


_H = "CASE WHEN final_status = 'NO_ANSWER' THEN 0 WHEN final_status = 'CLEAR_ANSWER' AND final_answer_correct <> 'UNRESOLVED' THEN (final_answer_correct = 'CORRECT')::INT END"
_FLAGS_SAME = " AND ".join(f"A_{f} IS NOT DISTINCT FROM B_{f}" for f in ("has_self_correction", "has_conflicting_answer_fields", "old_answer_explicitly_withdrawn", "reference_issue", "fidelity_R1", "fidelity_R2", "fidelity_R3"))
_ENDPOINTS = {
    "h_lower": f"coalesce(({_H}) = 1, false)", "h_upper": f"coalesce(({_H}) <> 0, true)", "unresolved": f"({_H}) IS NULL", "clear": "final_status = 'CLEAR_ANSWER'",
    "status_agreement": "A_status = B_status", "correctness_agreement": "A_answer_correct = B_answer_correct", "answer_lower": "A_B_answer_equivalence = 'EQUIVALENT'", "answer_upper": "A_B_answer_equivalence <> 'DIFFERENT'",
    "raw_agreement": f"A_status = B_status AND A_answer_correct = B_answer_correct AND {_FLAGS_SAME} AND A_B_answer_equivalence = 'EQUIVALENT'", "adjudication": "agreement_type <> 'FULL_AGREEMENT'",
    "reviewed": "adjudication_reason = 'read again'", "reference_issue": "A_reference_issue <> 'NO' OR B_reference_issue <> 'NO'",
    **{f"{r}_fidelity_{k}": f"final_status = 'CLEAR_ANSWER' AND {r}_fidelity IN ({v})" for r in ("strict", "mv") for k, v in (("lower", "'FAITHFUL'"), ("upper", "'FAITHFUL', 'UNRESOLVED'"), ("unresolved", "'UNRESOLVED'"))},
}
_ALL_ENDPOINTS = ", ".join(f"CAST({v} AS INTEGER) AS {k}" for k, v in _ENDPOINTS.items())


@query("label_endpoints", LABELS + f"SELECT sample_id, {_ALL_ENDPOINTS} FROM labels", fixtures=False)
def label_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("sample_id", *[c.alias(n) for n, c in calibration.label_endpoints(("strict", "mv")).items()])


@query("raw_agreement", LABELS + f", e AS (SELECT state, {_ALL_ENDPOINTS} FROM labels) SELECT state, count(*) AS labels, round(avg(raw_agreement), 9) AS raw_agreement, round(avg(reviewed), 9) AS reviewed FROM e GROUP BY state", fixtures=False)
def raw_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted shares of the sample."""
    e = _labels(spark, sf_dir).select("state", *[c.alias(n) for n, c in calibration.label_endpoints(("strict", "mv")).items()])
    return e.groupBy("state").agg(F.count(F.lit(1)).alias("labels"), *[F.round(F.avg(c), 9).alias(c) for c in ("raw_agreement", "reviewed")])


@query("label_completion", "SELECT o_orderpriority AS state, count(*) AS labels, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') AS filled, CASE WHEN o_orderpriority = '1-URGENT' THEN 'PENDING_HUMAN_LABELS' ELSE 'PARTIAL' END AS status FROM orders GROUP BY o_orderpriority", fixtures=False)
def label_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "1-URGENT")
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("state"), F.when(done, "CLEAR_ANSWER").alias("final_status"))
    return calibration.completion(d, ["state"])


_DOMAINS = {
    "final_has_conflict": "final_has_conflict = 'yes'", **{f"{w}_status": f"{w}_status = 'CLEAR'" for w in "AB"}, **{f"{w}_answer_correct": f"{w}_answer_correct = 'MAYBE'" for w in "AB"},
    **{f"{w}_old_answer_explicitly_withdrawn": f"{w}_old_answer_explicitly_withdrawn IS NULL" for w in "AB"}, **{f"{w}_{f}": f"{w}_{f} IS NULL" for w in "AB" for f in ("committed_answer", "evidence_span", "notes")},
}


@query("label_vocabularies", LABELS + " UNION ALL ".join(f"SELECT sample_id, '{k}' AS rule FROM labels WHERE {v}" for k, v in _DOMAINS.items()), fixtures=False)
def label_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = gates.label_vocabularies()
    bad = [F.when(when & ~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, (when, ok) in rules.items()]
    return _labels(spark, sf_dir).select("sample_id", F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("rule"))


_BITS = "CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '0' END || CASE WHEN c_custkey % 5 < 2 THEN '1' ELSE '0' END"
_POPULATION = f"""WITH c AS (SELECT c_custkey, c_mktsegment AS state, {_BITS} AS bits FROM customer),
 s AS (SELECT state, bits, count(*) AS N, least(count(*), 20) AS k, sum(count(*)) OVER (PARTITION BY state) AS population FROM c GROUP BY state, bits),
 x AS (SELECT state, bits, N, CASE WHEN state = 'BUILDING' AND bits = '11' THEN 0 ELSE k END AS n_sampled, k, CASE WHEN state = 'MACHINERY' THEN population + 1 ELSE population END AS population FROM s)
"""


@query("population_violations", _POPULATION + """SELECT 'unsampled' AS gate, state || '/' || bits AS detail FROM x WHERE n_sampled = 0 UNION ALL SELECT 'quota', state || '/' || bits FROM x WHERE n_sampled <> k
UNION ALL SELECT 'sum', 'MACHINERY' FROM x WHERE state = 'MACHINERY' GROUP BY 1, 2 UNION ALL SELECT 'accuracy', 'FURNITURE/1' FROM x WHERE state = 'FURNITURE' GROUP BY 1, 2
UNION ALL SELECT 'accuracy', 'MACHINERY/' || p FROM (SELECT unnest(['0', '1']) AS p) WHERE EXISTS (SELECT 1 FROM x WHERE state = 'MACHINERY')""", fixtures=False)  # fmt: skip
def population_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A population of customers and a sample of it, with a stratum without a quota, a wrong size and a wrong accuracy."""
    bit = lambda c: F.when(c, "1").otherwise("0")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"), F.concat(bit(F.col("c_custkey") % 3 == 0), bit(F.col("c_custkey") % 5 < 2)).alias("stratum"))
    sample = sampling.capped_srs(c, ["state", "stratum"], "c_custkey", 20, 1).select("state", "stratum")
    sizes = c.groupBy("state", F.col("stratum").alias("bits")).agg(F.count(F.lit(1)).alias("size"))
    whole = c.groupBy("state").agg(F.count(F.lit(1)).alias("whole"), *[F.avg(F.substring("stratum", i + 1, 1).cast("double")).alias(f"a{i}") for i in range(2)])
    off = F.when((F.col("state") == "BUILDING") & (F.col("bits") == "11"), 0).otherwise(F.least(F.col("size"), F.lit(20)))
    strata = sizes.join(whole, "state").select("state", "bits", "size", off.alias("quota"), (F.col("whole") + (F.col("state") == "MACHINERY").cast("int")).alias("population"))
    stated = whole.select("state", F.posexplode(F.array("a0", F.col("a1") + F.when(F.col("state") == "FURNITURE", 0.01).otherwise(0.0))).alias("position", "accuracy"))
    return gates.population_violations(strata, sample, stated)


_TERMS = {"building": {"BUILDING": 1.0, "MACHINERY": -1.0}, "mean": {"AUTOMOBILE": -1.0, "BUILDING": 0.5, "MACHINERY": 0.5}, "missing": {"NOWHERE": 1.0, "BUILDING": -1.0}}
_PARTS = """WITH c AS (SELECT c_mktsegment AS state, CASE WHEN c_custkey % 2 = 0 THEN 'strict' ELSE 'mv' END AS reader, c_acctbal > 0 AS good, c_acctbal > 1000 AS surely, c_custkey % 7 = 0 AS odd FROM customer),
 st AS (SELECT state, avg(surely::INT) AS lo, avg(good::INT) AS hi FROM c GROUP BY state),
 rd AS (SELECT state, reader, avg(good::INT) AS accuracy, avg((odd AND surely)::INT) AS fp0, avg((odd AND good)::INT) AS fp1, avg((NOT odd AND surely)::INT) AS fn0, avg((NOT odd AND good)::INT) AS fn1 FROM c GROUP BY ALL),
 t(comparison, state, k) AS (VALUES ('building', 'BUILDING', 1.0::DOUBLE), ('building', 'MACHINERY', -1.0), ('mean', 'AUTOMOBILE', -1.0), ('mean', 'BUILDING', 0.5), ('mean', 'MACHINERY', 0.5)),
 g AS (SELECT comparison, reader, sum(k * accuracy) AS reader_gain, sum(k * CASE WHEN k >= 0 THEN lo ELSE hi END) AS hl, sum(k * CASE WHEN k >= 0 THEN hi ELSE lo END) AS hh, sum(k * CASE WHEN k >= 0 THEN fp0 ELSE fp1 END) AS pl, sum(k * CASE WHEN k >= 0 THEN fp1 ELSE fp0 END) AS ph, sum(-k * CASE WHEN k < 0 THEN fn0 ELSE fn1 END) AS rl, sum(-k * CASE WHEN k < 0 THEN fn1 ELSE fn0 END) AS rh FROM t JOIN st USING (state) JOIN rd USING (state) GROUP BY ALL)
"""


@query("gains_table", _PARTS + """SELECT comparison, reader, round(reader_gain, 9) AS reader_gain, round(hl, 9) AS human_gain_low, round(hh, 9) AS human_gain_high, round(reader_gain - hh, 9) AS gap_low, round(reader_gain - hl, 9) AS gap_high, round(rl, 9) AS fn_recovery_low, round(rh, 9) AS fn_recovery_high,
 round(pl, 9) AS fp_increase_low, round(ph, 9) AS fp_increase_high, hl > 0 AS gain_positive, coalesce(rl / nullif(reader_gain, 0) > 0.5, false) AS majority_recovered, ph <= 0.05 AS fp_within_5pp FROM g""", fixtures=False)  # fmt: skip
def gains_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains with their claims; states are segments, bounds are shares of customers above two balances."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("state"), F.when(F.col("c_custkey") % 2 == 0, "strict").otherwise("mv").alias("reader"), (F.col("c_acctbal") > 0).alias("good"), (F.col("c_acctbal") > 1000).alias("surely"), (F.col("c_custkey") % 7 == 0).alias("odd"))
    share = lambda x: F.avg(x.cast("double"))
    bounds = lambda a, b: calibration.interval(a, b, a, b)
    states = c.groupBy("state").agg(share(F.col("surely")).alias("lo"), share(F.col("good")).alias("hi")).select("state", bounds(F.col("lo"), F.col("hi")).alias("human"))
    parts = {"accuracy": F.col("good"), "fp0": F.col("odd") & F.col("surely"), "fp1": F.col("odd") & F.col("good"), "fn0": ~F.col("odd") & F.col("surely"), "fn1": ~F.col("odd") & F.col("good")}
    readers = c.groupBy("state", "reader").agg(*[share(x).alias(n) for n, x in parts.items()])
    readers = readers.select("state", "reader", "accuracy", bounds(F.col("fp0"), F.col("fp1")).alias("joint_fp"), bounds(F.col("fn0"), F.col("fn1")).alias("joint_fn"))
    out = calibration.gains_table(states, readers, _TERMS)
    claims = calibration.claim(F.col("human_gain"), F.col("fp_increase"), F.col("fn_recovery"), F.col("reader_gain"))
    flat = [F.round(F.col(f"{m}.ci_{end}"), 9).alias(f"{m}_{end}") for m in ("human_gain", "gap", "fn_recovery", "fp_increase") for end in ("low", "high")]
    return out.select("comparison", "reader", F.round("reader_gain", 9).alias("reader_gain"), *flat, *[x.alias(n) for n, x in claims.items()])
