"""Queries over binning, sampling, budgets, calibration, gates, builders and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions import hashing
from gaugeworks.operators import binning, budget, builders, calibration, gates, sampling
from gaugeworks.plans.registry import query
from gaugeworks.plans.scoring import LENIENT, judged
from gaugeworks.sources.fixtures import items, samples, table
from gaugeworks.sources.sinks import written

# difficulty

SCORES = f", scores AS (SELECT id AS row_id, count(*) FILTER ({LENIENT}) AS solve_count, count(*) AS rollouts, round(avg(output_tokens), 9) AS mean_response_tokens, count(*) FILTER (finish_reason = 'length') AS truncated_count FROM scored GROUP BY id)\n"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.rollout_scores(judged(spark, sf_dir).withColumnRenamed("id", "row_id"), F.col("le"))


@query("rollout_scores", SCORES + "SELECT * FROM scores")
def rollout_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query("modulo_shards", "SELECT o_orderkey AS row_id, 2 AS shard FROM orders WHERE o_orderkey % 7 = 2", fixtures=False)
def modulo_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    return binning.modulo_shard(rows, 2, 7).withColumn("shard", F.lit(2))


@query("shard_merge_cover", "SELECT 'missing' AS gate, CAST(o_orderkey AS VARCHAR) AS detail FROM orders WHERE o_orderkey % 7 = 6 UNION ALL SELECT 'duplicate', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 7 = 3", fixtures=False)
def shard_merge_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 5 of 7 with shard 3 read twice, against the whole."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))
    merged = rows.where("row_id % 7 < 6").unionByName(rows.where("row_id % 7 = 3"))
    return gates.cover(merged, rows, "row_id")


BINS = SCORES + ", ranked AS (SELECT *, row_number() OVER (ORDER BY solve_count, sha256('difficulty-tie:' || row_id)) - 1 AS rk FROM scores), bins AS (SELECT row_id, solve_count, rollouts, CAST(least(rk * 4 // (SELECT count(*) FROM scores), 3) AS INTEGER) AS difficulty_bin FROM ranked)\n"
AUDIT = BINS + ", audit AS (SELECT row_id, difficulty_bin, rn AS audit_rank FROM (SELECT *, row_number() OVER (PARTITION BY difficulty_bin ORDER BY sha256('audit:20260717:' || row_id)) AS rn FROM bins) WHERE rn <= 25)\n"


def _scores_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores written to the checkpoint folder: responses are scored once, whoever reads them how often."""
    return written(_scores(spark, sf_dir))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.balanced_bins(_scores_once(spark, sf_dir), 4).select("row_id", "solve_count", "rollouts", "difficulty_bin")


@query("balanced_bins", BINS + "SELECT * FROM bins")
def balanced_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir)


@query("balanced_bins_blake2b")
def balanced_bins_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.balanced_bins(_scores_once(spark, sf_dir), 4, hashing.blake2b64).select("row_id", "solve_count", "difficulty_bin")


@query("cutpoint_bins", SCORES + "SELECT row_id, solve_count, CAST((solve_count > 0)::INT + (solve_count > 1)::INT + (solve_count > 3)::INT AS INTEGER) AS difficulty_bin FROM scores")
def cutpoint_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.cutpoint_bins(_scores(spark, sf_dir), [0, 1, 3]).select("row_id", "solve_count", "difficulty_bin")


@query("audit_topk_per_bin", AUDIT + "SELECT * FROM audit")
def audit_topk_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.audit_pool(_bins(spark, sf_dir), 25, 20260717).select("row_id", "difficulty_bin", "audit_rank")


@query("bin_summary", AUDIT + """SELECT b.difficulty_bin, count(*) AS full_count, round(avg(solve_count::DOUBLE / rollouts), 9) AS mean_rate, min(solve_count::DOUBLE / rollouts) AS min_rate, max(solve_count::DOUBLE / rollouts) AS max_rate,
 count(*) FILTER (a.row_id IS NULL) AS training_count, count(a.row_id) AS audit_count FROM bins b LEFT JOIN audit a ON b.row_id = a.row_id GROUP BY b.difficulty_bin""")  # fmt: skip
def bin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = written(_bins(spark, sf_dir))
    return binning.bin_summary(binning.marked_audit(bins, binning.audit_pool(bins, 25, 20260717)))


@query("id_and_seed_rules", "SELECT o_orderkey AS id, 'H' || upper(left(sha256('20260716:orders:' || o_orderkey), 10)) AS sample_id, CAST((20260716::BIGINT * 1000003 + o_orderkey) % 2147483647 AS BIGINT) AS seed FROM orders", fixtures=False)
def id_and_seed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("id"), hashing.sample_id(20260716, F.lit("orders"), key).alias("sample_id"), hashing.shard_seed(20260716, key).alias("seed"))


# sampling

# strata: market segments; weights: customers; moments: mean absolute balance over 5000
STRATA = "WITH s AS (SELECT c_mktsegment AS stratum, count(*) AS n, avg(abs(c_acctbal)) / 5000 AS moment FROM customer GROUP BY 1), t AS (SELECT *, n::DOUBLE / sum(n) OVER () AS target FROM s), p AS (SELECT *, target * sqrt(moment) / sum(target * sqrt(moment)) OVER () AS optimal, target * pow(moment, 0.25) / sum(target * pow(moment, 0.25)) OVER () AS half FROM t), m AS (SELECT *, (0.9 * optimal + 0.1 * target) / sum(0.9 * optimal + 0.1 * target) OVER () AS mixed FROM p)\n"


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.abs("c_acctbal")) / 5000).alias("moment"))
    t = sampling.normalized(s, F.col("n"), "target")
    t = sampling.powered_proposal(t, F.col("target"), F.col("moment"), 1.0, "optimal")
    t = sampling.powered_proposal(t, F.col("target"), F.col("moment"), 0.5, "half")
    return sampling.epsilon_mixture(t, F.col("optimal"), F.col("target"), 0.1, "mixed")


@query("proposals", STRATA + "SELECT stratum, round(target, 9) AS target, round(optimal, 9) AS optimal, round(half, 9) AS half, round(mixed, 9) AS mixed FROM m", fixtures=False)
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).select("stratum", *[F.round(c, 9).alias(c) for c in ("target", "optimal", "half", "mixed")])


@query("item_probabilities", STRATA + "SELECT c_custkey AS item, round(mixed / n, 12) AS item_probability FROM customer JOIN m ON c_mktsegment = stratum", fixtures=False)
def item_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("stratum"))
    return sampling.item_probabilities(c, _strata(spark, sf_dir), "stratum", "mixed").select("item", F.round("item_probability", 12).alias("item_probability"))


DRAWS = STRATA + ", d AS (SELECT o_orderkey AS draw_number, c_mktsegment AS stratum, target / n AS target_probability, mixed / n AS proposal_probability, target / mixed AS importance_weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN m ON c_mktsegment = stratum)\n"


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("stratum"))
    d = table(spark, sf_dir, "orders").join(owner, "o_custkey").join(_strata(spark, sf_dir), "stratum")
    return d.select(F.col("o_orderkey").alias("draw_number"), "stratum", (F.col("target") / F.col("n")).alias("target_probability"), (F.col("mixed") / F.col("n")).alias("proposal_probability"), sampling.importance(F.col("target"), F.col("mixed")).alias("importance_weight"))


@query("importance_weights", DRAWS + "SELECT draw_number, stratum, round(importance_weight, 9) AS importance_weight FROM d", fixtures=False)
def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, sf_dir).select("draw_number", "stratum", F.round("importance_weight", 9).alias("importance_weight"))


@query("weight_diagnostics", DRAWS + """SELECT draw_number % 5 AS batch, count(*) AS draws, round(avg(importance_weight), 9) AS mean_weight, round(min(importance_weight), 9) AS min_weight, round(max(importance_weight), 9) AS max_weight,
 round(pow(sum(importance_weight), 2) / sum(importance_weight * importance_weight), 6) AS ess, round(pow(sum(importance_weight), 2) / sum(importance_weight * importance_weight) / count(*), 9) AS ess_fraction,
 round(avg(-importance_weight * ln(proposal_probability)), 9) AS cross_entropy, round(avg(importance_weight * ln(importance_weight)), 9) AS kl, round(min(proposal_probability), 12) AS min_proposal FROM d GROUP BY 1""", fixtures=False)  # fmt: skip
def weight_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.weight_diagnostics(_draws(spark, sf_dir).withColumn("batch", F.col("draw_number") % 5), ["batch"])
    return out.withColumns({"ess": F.round("ess", 6), "min_proposal": F.round("min_proposal", 12)})


@query("draw_categorical")
def draw_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as there are orders."""
    n = table(spark, sf_dir, "orders").count()
    return sampling.draw_categorical(_strata(spark, sf_dir), "stratum", "mixed", n, 17)


@query("masked_second_moment", """WITH e AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS mask FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * embedding[i]::DOUBLE * mask[i])) / nullif(list_sum(mask), 0), 9) AS proxy,
 round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * 1.25::DOUBLE)), 6) AS corrected_sum FROM e""", fixtures=False)
def masked_second_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("mask", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
    fixed = F.aggregate(sampling.corrected(F.col("embedding"), F.lit(1.25)), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.round(sampling.masked_second_moment(F.col("embedding"), F.col("mask")), 9).alias("proxy"), F.round(fixed, 6).alias("corrected_sum"))


@query("two_level_mean", "SELECT event_type, count(*) AS items, round(avg(m), 9) AS mean FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1", fixtures=False)
def two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.two_level_mean(table(spark, sf_dir, "events"), "event_type", "user_id", F.col("value"))


@query("ema_by_stratum", """WITH RECURSIVE d AS (SELECT event_type, CAST(ts AS DATE) AS day, greatest(avg(value), 0.5::DOUBLE) AS v FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k FROM d),
 r AS (SELECT event_type, 0::BIGINT AS k, 1.0::DOUBLE AS m FROM (SELECT DISTINCT event_type FROM d) UNION ALL SELECT n.event_type, n.k, 0.9::DOUBLE * r.m + (1 - 0.9::DOUBLE) * n.v FROM r JOIN n ON n.event_type = r.event_type AND n.k = r.k + 1)
SELECT event_type, max(k) AS steps, round(max_by(m, k), 9) AS second_moment FROM r GROUP BY event_type""", fixtures=False)
def ema_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return sampling.ema(days, "event_type", "day", "v", 1.0, 0.9, 0.5)


@query("within_draw_consistency", "SELECT l_orderkey AS draw, count(*) AS rows FROM lineitem GROUP BY 1 HAVING min(l_suppkey) <> max(l_suppkey) OR max(l_tax) - min(l_tax) > 1e-12 * abs(min(l_tax))", fixtures=False)
def within_draw_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw_consistency(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "draw"), "draw", ["l_suppkey"], ["l_tax"])


@query("first_representatives", "SELECT l_orderkey AS draw, min(l_partkey) AS position FROM lineitem GROUP BY 1", fixtures=False)
def first_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draw"), F.col("l_partkey").alias("position"))
    return sampling.first_representatives(rows, "draw", "position")


SRS = """WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n_all, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || lang || ':' || doc_id)) AS k FROM documents)
SELECT doc_id, lang, n_all AS stratum_population, least(n_all, 30) AS stratum_sample_n, least(n_all, 30)::DOUBLE / n_all AS inclusion_probability, n_all::DOUBLE / least(n_all, 30) AS weight FROM r WHERE k <= 30"""


@query("srs_per_stratum", SRS, fixtures=False)
def srs_per_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.capped_srs(rows, ["lang"], "doc_id", 30, 7).select("doc_id", "lang", "stratum_population", F.col("stratum_sample_n").cast("long").alias("stratum_sample_n"), "inclusion_probability", "weight")


@query("sample_weight_check", SRS.replace("SELECT doc_id, lang, n_all AS stratum_population", "SELECT lang, round(sum(weight), 6) AS weight_sum, max(stratum_population) AS population FROM (SELECT doc_id, lang, n_all AS stratum_population") + ") GROUP BY lang", fixtures=False)
def sample_weight_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srs_per_stratum(spark, sf_dir).groupBy("lang").agg(F.round(F.sum("weight"), 6).alias("weight_sum"), F.max("stratum_population").alias("population"))


# budget

LEDGER = """WITH b AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run, sum(1)::BIGINT AS sampled_prompts, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS completions, sum(CAST(floor(value) AS BIGINT))::BIGINT AS generated_tokens,
 sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS reward_calls, count(DISTINCT CAST(ts AS DATE)) AS optimizer_updates, sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END)::BIGINT AS validation_calls, round(sum(value) / 1000, 6) AS wall_seconds, round(sum(value * 4) / 1000, 6) AS gpu_seconds FROM events GROUP BY 1)\n"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("run"), F.lit(1).alias("sampled_prompts"), (F.col("event_type") == "purchase").cast("int").alias("completions"), F.floor("value").alias("generated_tokens"),
        (F.col("value") > 50).cast("int").alias("reward_calls"), (F.row_number().over(sampling_window()) == 1).cast("int").alias("optimizer_updates"), (F.col("event_id") % 97 == 0).cast("int").alias("validation_calls"),
        (F.col("value") / 1000).alias("wall_seconds"), F.lit(4).alias("gpus"),
    )
    return budget.totals(rows)


def sampling_window():  # noqa: ANN201
    from pyspark.sql import Window

    return Window.partitionBy(F.col("user_id") % 2, F.to_date("ts")).orderBy("event_id")


@query("budget_totals", LEDGER + "SELECT * FROM b", fixtures=False)
def budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)


@query("budget_compare", LEDGER + """, u AS (UNPIVOT (SELECT run, sampled_prompts::DOUBLE AS sampled_prompts, completions::DOUBLE AS completions, reward_calls::DOUBLE AS reward_calls, optimizer_updates::DOUBLE AS optimizer_updates, validation_calls::DOUBLE AS validation_calls, generated_tokens::DOUBLE AS generated_tokens, wall_seconds, gpu_seconds FROM b)
 ON COLUMNS(* EXCLUDE run) INTO NAME counter VALUE v) SELECT counter, max(v) FILTER (run = 'even') AS "left", max(v) FILTER (run = 'odd') AS "right", round(max(v) FILTER (run = 'odd') - max(v) FILTER (run = 'even'), 6) AS difference,
 counter IN ('sampled_prompts', 'completions', 'reward_calls', 'optimizer_updates', 'validation_calls') AS hard FROM u GROUP BY counter""", fixtures=False)  # fmt: skip
def budget_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.compare(_ledger(spark, sf_dir), "even", "odd")


# calibration: labels as two raters, languages as states, readers' bits from label columns

LABELLED = "WITH x AS (SELECT d.lang AS state, l.quality, l.toxic, (d.n_chars > 1000)::INT AS long_text FROM documents d JOIN labels l ON d.doc_id = l.doc_id)\n"
STRATA_X = LABELLED + ", h AS (SELECT state, CAST(toxic AS VARCHAR) || CAST(long_text AS VARCHAR) AS bits, count(*) AS N, least(count(*), 20) AS n, avg(quality) AS mean, sum(quality) AS x FROM x GROUP BY ALL)\n".replace(", least(count(*), 20) AS n", ", least(count(*), 20) AS n_sample")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("state"), (F.col("n_chars") > 1000).cast("int").alias("long_text"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select("state", "quality", "toxic", "long_text")


def _bits() -> object:
    return F.concat(F.col("toxic").cast("string"), F.col("long_text").cast("string"))


def _label_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("state", _bits().alias("bits")).agg(F.count(F.lit(1)).alias("N"), F.avg("quality").alias("mean"), F.sum("quality").alias("x"))


@query("strata_histogram", STRATA_X + "SELECT state, bits, N AS population, CAST(n_sample AS BIGINT) AS sampled FROM h", fixtures=False)
def strata_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calibration.strata_histogram(_labelled(spark, sf_dir), "state", _bits(), 20)
    return out.select("state", "bits", F.col("N").alias("population"), F.col("sampled").cast("long").alias("sampled"))


@query("weighted_mean_by_state", STRATA_X + ", w AS (SELECT *, N::DOUBLE / sum(N) OVER (PARTITION BY state) AS share FROM h) SELECT state, round(sum(share * mean), 9) AS value FROM w GROUP BY state", fixtures=False)
def weighted_mean_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.weighted_mean(_label_strata(spark, sf_dir), "state", F.col("mean"))


@query("joint_fp_fn", STRATA_X + ", w AS (SELECT *, N::DOUBLE / sum(N) OVER (PARTITION BY state) AS share FROM h) SELECT state, round(sum(CASE WHEN left(bits, 1) = '1' THEN share * (1 - mean) ELSE 0 END), 9) AS joint_fp, round(sum(CASE WHEN left(bits, 1) = '0' THEN share * mean ELSE 0 END), 9) AS joint_fn FROM w GROUP BY state", fixtures=False)
def joint_fp_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _label_strata(spark, sf_dir)
    bit = F.left("bits", F.lit(1))
    fp = calibration.weighted_mean(s, "state", F.col("mean"), bit == "1", complement=True).withColumnRenamed("value", "joint_fp")
    fn = calibration.weighted_mean(s, "state", F.col("mean"), bit == "0").withColumnRenamed("value", "joint_fn")
    return fp.join(fn, "state")


@query("kappa_weighted", LABELLED + """, j AS (SELECT state, quality AS a, toxic AS b, sum(1.0 + long_text) AS w FROM x GROUP BY ALL), p AS (SELECT state, a, b, w / sum(w) OVER (PARTITION BY state) AS p FROM j),
 ma AS (SELECT state, a AS v, sum(p) AS x FROM p GROUP BY ALL), mb AS (SELECT state, b AS v, sum(p) AS y FROM p GROUP BY ALL), e AS (SELECT ma.state, sum(x * y) AS e FROM ma JOIN mb ON ma.state = mb.state AND ma.v = mb.v GROUP BY 1),
 o AS (SELECT state, sum(CASE WHEN a = b THEN p ELSE 0 END) AS o FROM p GROUP BY 1) SELECT o.state, round(o, 9) AS observed, round(coalesce(e, 0), 9) AS expected, CASE WHEN coalesce(e, 0) < 1 - 1e-12 THEN round((o - coalesce(e, 0)) / (1 - coalesce(e, 0)), 9) END AS kappa FROM o LEFT JOIN e ON o.state = e.state""", fixtures=False)  # fmt: skip
def kappa_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.kappa(_labelled(spark, sf_dir), ["state"], "quality", "toxic", 1 + F.col("long_text"))


@query("hypergeom_ci")
def hypergeom_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _label_strata(spark, sf_dir).withColumn("drawn", F.least(F.col("N"), F.lit(20)).cast("long")).withColumn("hits", F.round(F.col("mean") * F.least(F.col("N"), F.lit(20))).cast("long"))
    return calibration.hypergeometric_columns(s.select("state", "bits", F.col("N").alias("population"), F.col("drawn").alias("sampled"), "hits"), "hits", "sampled", "population", F.lit(0.05))


@query("bonferroni_cells", STRATA_X + "SELECT CAST(sum(CASE WHEN n_sample < N THEN 3 ELSE 0 END) AS BIGINT) AS cells, 0.05::DOUBLE / greatest(1, sum(CASE WHEN n_sample < N THEN 3 ELSE 0 END)) AS cell_alpha FROM h", fixtures=False)
def bonferroni_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sum(F.when(F.least(F.col("N"), F.lit(20)) < F.col("N"), 3).otherwise(0))
    return _label_strata(spark, sf_dir).agg(n.alias("cells"), (F.lit(0.05) / F.greatest(F.lit(1), n)).alias("cell_alpha"))


@query("interval_linear_ratio", STRATA_X + """, b AS (SELECT state, bits, mean * 0.9::DOUBLE AS lo, least(1, mean * 1.1::DOUBLE) AS hi, mean * 0.8::DOUBLE AS cl, least(1, mean * 1.2::DOUBLE) AS ch FROM h)
SELECT state, bits, round(0.5 - hi, 9) AS lin_low, round(0.5 - lo, 9) AS lin_high, round(greatest(0, least(1, lo * 0.5 / hi)), 9) AS ratio_low, round(CASE WHEN lo > 0 THEN greatest(0, least(1, hi * 0.5 / lo)) ELSE 1 END, 9) AS ratio_high FROM b WHERE hi > 0""", fixtures=False)
def interval_linear_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("mean")
    s = _label_strata(spark, sf_dir).where(m > 0)
    full = calibration.interval(m * 0.9, F.least(F.lit(1.0), m * 1.1), m * 0.8, F.least(F.lit(1.0), m * 1.2))
    half = calibration.linear([(0.5, full)])
    line = calibration.linear([(1.0, calibration.exact(F.lit(0.5))), (-1.0, full)])
    share = calibration.ratio(half, full)
    r = lambda c, name: F.round(c, 9).alias(name)
    return s.select("state", "bits", r(line["lower_estimate"], "lin_low"), r(line["upper_estimate"], "lin_high"), r(share["lower_estimate"], "ratio_low"), r(share["upper_estimate"], "ratio_high"))


# Reader accuracies of frozen populations.
ACCURACIES = [
    ("qwen15_base", "strict", 0.11069), ("qwen15_base", "fallback", 0.70735), ("qwen15_base", "mv", 0.71418), ("qwen15_rl", "strict", 0.7536), ("qwen15_rl", "fallback", 0.7536), ("qwen15_rl", "mv", 0.75284),
    ("smol_base", "strict", 0.10159), ("smol_base", "fallback", 0.37756), ("smol_base", "mv", 0.38514), ("smol_rl", "strict", 0.41471), ("smol_rl", "fallback", 0.42911), ("smol_rl", "mv", 0.42608),
    ("initial", "strict", 0.53), ("initial", "mv", 0.734), ("seed83", "strict", 0.518), ("seed83", "mv", 0.666), ("seed84", "strict", 0.64), ("seed84", "mv", 0.624), ("seed85", "strict", 0.688), ("seed85", "mv", 0.652),
]
_VALUES = ", ".join(f"('{s}', '{r}', {a}::DOUBLE)" for s, r, a in ACCURACIES)
_TERMS = ", ".join(f"('{n}', '{s}', {c!r}::DOUBLE)" for n, t in calibration.GAINS.items() for s, c in t.items())


@query("gains_table", f"SELECT comparison, reader, round(sum(c * a), 9) AS reader_gain FROM (VALUES {_VALUES}) v(state, reader, a) JOIN (VALUES {_TERMS}) t(comparison, state, c) ON v.state = t.state GROUP BY ALL", fixtures=False)
def gains_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.gains(spark.createDataFrame(ACCURACIES, "state string, reader string, accuracy double"))


@query("human_values", "SELECT doc_id, CASE WHEN quality + toxic = 0 THEN 0 WHEN toxic = 0 THEN quality END AS h, coalesce(CASE WHEN quality + toxic = 0 THEN 0 WHEN toxic = 0 THEN quality END = 1, false) AS h_lower, coalesce(CASE WHEN quality + toxic = 0 THEN 0 WHEN toxic = 0 THEN quality END <> 0, true) AS h_upper FROM labels", fixtures=False)
def human_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality 0 and toxic 0: no answer; toxic: unresolved; else clear."""
    q, t = F.col("quality"), F.col("toxic")
    status = F.when(q + t == 0, "NO_ANSWER").otherwise("CLEAR_ANSWER")
    correct = F.when(t == 1, "UNRESOLVED").when(q == 1, "CORRECT").otherwise("INCORRECT")
    h = calibration.human_value(status, correct)
    ends = calibration.endpoints(h)
    return table(spark, sf_dir, "labels").select("doc_id", h.alias("h"), ends["h_lower"].alias("h_lower"), ends["h_upper"].alias("h_upper"))


@query("duplicate_text_groups", "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1", fixtures=False)
def duplicate_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


# builders

TEXTS = ", q AS (SELECT id, 'user: What is item ' || id || '?' || chr(10) || 'Answer after \"####\".' AS prompt, 'Work on ' || answer || chr(10) || '#### ' || (answer + 1) || chr(10) || '#### ' || answer AS solution FROM items)\n"
SUFFIX, BOX_SUFFIX = '\nAnswer after "####".', "\nAnswer within a box."


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("answer")
    return items(spark, sf_dir).select("id", F.concat(F.lit("user: What is item "), F.col("id").cast("string"), F.lit("?" + SUFFIX)).alias("prompt"), F.concat(F.lit("Work on "), a.cast("string"), F.lit("\n#### "), (a + 1).cast("string"), F.lit("\n#### "), a.cast("string")).alias("solution"))


@query("suffix_rewrite", TEXTS + "SELECT id, left(prompt, length(prompt) - 21) || chr(10) || 'Answer within a box.' AS rewritten FROM q")
def suffix_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", builders.suffix_rewrite(F.col("prompt"), SUFFIX, BOX_SUFFIX).alias("rewritten"))


@query("question_extract", TEXTS + "SELECT id, 'What is item ' || id || '?' AS question FROM q")
def question_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", builders.question_between(F.col("prompt"), "user: ", "<end>", SUFFIX).alias("question"))


@query("split_last_marker", TEXTS + "SELECT id, regexp_extract(solution, '(?s)^(.*)\\n#### (.*)$', 1) AS body, trim(regexp_extract(solution, '(?s)^(.*)\\n#### (.*)$', 2)) AS final FROM q")
def split_last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, answer = builders.split_answer(F.col("solution"))
    return _texts(spark, sf_dir).select("id", body.alias("body"), answer.alias("final"))


@query("arm_render", TEXTS + "SELECT id, solution AS hash_arm, regexp_extract(solution, '(?s)^(.*)\\n#### (.*)$', 1) || chr(10) || chr(92) || 'boxed{' || regexp_extract(solution, '(?s)^(.*)\\n#### (.*)$', 2) || '}' AS boxed_arm FROM q")
def arm_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, answer = builders.split_answer(F.col("solution"))
    return _texts(spark, sf_dir).select("id", builders.render_arm(body, answer, "hash").alias("hash_arm"), builders.render_arm(body, answer, "boxed").alias("boxed_arm"))


@query("arm_alignment_violations", TEXTS + "SELECT id FROM q WHERE id % 97 = 0")
def arm_alignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 97th boxed arm has another question."""
    t = _texts(spark, sf_dir)
    body, answer = builders.split_answer(F.col("solution"))
    a = t.select("id", F.col("prompt").alias("question"), builders.render_arm(body, answer, "hash").alias("completion"))
    b = t.select("id", F.when(F.col("id") % 97 == 0, "other").otherwise(F.col("prompt")).alias("question"), builders.render_arm(body, answer, "boxed").alias("completion"))
    return builders.arm_violations(a, b, "id")


@query("contamination_overlap", "SELECT DISTINCT lower(trim(regexp_replace(a.text, '\\s+', ' ', 'g'))) AS text FROM conversations a WHERE lower(trim(regexp_replace(a.text, '\\s+', ' ', 'g'))) IN (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM conversations WHERE conv_id % 2 = 1) AND conv_id % 2 = 0", fixtures=False)
def contamination_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return builders.contamination(c.where("conv_id % 2 = 0"), c.where("conv_id % 2 = 1"), "text", "text")


@query("column_carry", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 89 = 0", fixtures=False)
def column_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy in which the priority of every 89th order was changed."""
    a = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    b = a.withColumn("o_orderpriority", F.when(F.col("id") % 89 == 0, "changed").otherwise(F.col("o_orderpriority")))
    return builders.column_changes(a, b, "id", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


@query("micro_batches", ", p AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT k // 256 AS batch, count(*) AS rows, min(id) AS first_id FROM p GROUP BY 1")
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions come from ranks within ranges of ids and the ranges' sizes."""
    ranked = binning.position_in_order(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 10_000, "position")
    return builders.micro_batches(ranked, "position", 256).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))


@query("receipt_hashes")
def receipt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt per priority over all orders."""
    return builders.row_receipts(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


# events


@query("throughput", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, count(*) AS items, round(sum(value), 6) AS seconds, round(count(*) / greatest(sum(value), 0.01::DOUBLE), 9) AS per_second FROM events GROUP BY 1", fixtures=False)
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("batch")).agg(F.count(F.lit(1)).alias("items"), F.sum("value").alias("s"))
    return e.select("batch", "items", F.round("s", 6).alias("seconds"), F.round(F.col("items") / F.greatest(F.col("s"), F.lit(0.01)), 9).alias("per_second"))


@query("first_last_value", "SELECT event_type, min_by(value, event_id) AS first_value, max_by(value, event_id) AS last_value, max_by(value, event_id) < min_by(value, event_id) AS fell FROM events GROUP BY 1", fixtures=False)
def first_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, final = F.min_by("value", "event_id"), F.max_by("value", "event_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(first.alias("first_value"), final.alias("last_value"), (final < first).alias("fell"))


@query("running_coverage", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS done FROM events", fixtures=False)
def running_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts per type from ranks per slice and the slices' sizes, so that a type with most rows isn't one task's."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr("event_id div 4096").alias("slice"))
    sizes = e.groupBy("event_type", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("event_type").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("event_type", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("event_type", "slice").orderBy("event_id"))
    return e.withColumn("k", own).join(starts, ["event_type", "slice"]).select("event_id", (F.col("start") + F.col("k")).alias("done"))


@query("label_gate_violations", "SELECT 'implication' AS gate, doc_id || ': ' || rule AS detail FROM (SELECT doc_id, 'toxic is low quality' AS rule FROM labels WHERE toxic = 1 AND quality = 1 UNION ALL SELECT doc_id, 'quality is a flag' FROM labels WHERE quality NOT IN (0, 1))", fixtures=False)
def label_gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"toxic is low quality": (F.col("toxic") == 1, F.col("quality") == 0), "quality is a flag": (F.lit(True), F.col("quality").isin(0, 1))}
    return gates.implications(table(spark, sf_dir, "labels"), "doc_id", rules)


@query("input_token_drift", "SELECT request, id FROM samples GROUP BY ALL HAVING count(DISTINCT output_tokens) > 1")
def input_token_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request and item, vectors that should be constant."""
    return samples(spark, sf_dir).groupBy("request", "id").agg(F.count_distinct("output_tokens").alias("k")).where("k > 1").select("request", "id")


@query("prompt_length_gate", "SELECT max(length(text)) AS longest, max(length(text)) + 640 > 4096 AS over_budget FROM benchmark", fixtures=False)
def prompt_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.max(F.length("text"))
    return table(spark, sf_dir, "benchmark").agg(n.alias("longest"), (n + 640 > 4096).alias("over_budget"))


@query("events_rollup", "SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ROLLUP (event_type, user_id % 10)", fixtures=False)
def events_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals rows (an extension)."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("bucket"), "value")
    return e.rollup("event_type", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("events_hourly", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL", fixtures=False)
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows (an extension)."""
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")

