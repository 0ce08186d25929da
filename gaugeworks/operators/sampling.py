"""Target and proposal distributions, draws, importance weights and the online second-moment state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(strata: DataFrame, weight: Column, out: str) -> DataFrame:
    """weight over its sum; strata is one row per stratum."""
    return strata.withColumn("_w", weight.cast("double")).withColumn(out, F.col("_w") / F.sum("_w").over(Window.partitionBy())).drop("_w")


def probability_violations(rows: DataFrame, row_id: str, weight: Column) -> DataFrame:
    """gate, detail: weights that aren't finite or are negative, and a table without mass."""
    w = weight.cast("double")
    finite = w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf"))
    kind = F.when(~finite, "not finite").when(w < 0, "negative")
    each = rows.select(kind.alias("gate"), F.col(row_id).cast("string").alias("detail")).where("gate IS NOT NULL")
    mass = rows.agg(F.coalesce(F.sum(F.when(finite & (w > 0), w)), F.lit(0.0)).alias("m")).where("m <= 0")
    return each.unionByName(mass.select(F.lit("no mass").alias("gate"), F.col("m").cast("string").alias("detail")))


def epsilon_mixture(strata: DataFrame, adaptive: Column, target: Column, epsilon: float, out: str) -> DataFrame:
    if not 0 < epsilon <= 1:
        raise ValueError("epsilon must be in (0, 1]")
    return normalized(strata, (1 - epsilon) * adaptive + epsilon * target, out)


def powered_proposal(strata: DataFrame, target: Column, moment: Column, exponent: float, out: str) -> DataFrame:
    """Proportional to target * moment ^ (exponent / 2): the target at 0, least variance at 1."""
    powered = target if exponent == 0 else target * F.sqrt(moment) if exponent == 1 else target * F.pow(moment, F.lit(exponent / 2))
    return normalized(strata, powered, out)


def item_probabilities(items: DataFrame, strata: DataFrame, stratum: str, probability: str) -> DataFrame:
    """Each item's share of its stratum's probability. strata: one row per stratum."""
    counts = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    shares = counts.join(strata.select(stratum, probability), stratum).withColumn("item_probability", F.col(probability) / F.col("_n"))
    return items.join(shares.select(stratum, "item_probability"), stratum)


def draw_categorical(strata: DataFrame, stratum: str, probability: str, draws: int, seed: int) -> DataFrame:
    """draw_number, stratum: seeded draws with replacement. Bounds of the strata go to executors; draws are made there in order of number."""
    rows = strata.select(stratum, probability).orderBy(stratum).collect()  # one row per stratum
    names = [r[0] for r in rows]
    bounds = np.cumsum([r[1] for r in rows])
    kind = strata.schema[stratum].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(0).to_numpy()
            u = np.empty(len(n))
            for block in np.unique(n >> 12):  # a generator per 4096 draws: any split of the work draws the same
                own = (n >> 12) == block
                u[own] = np.random.Generator(np.random.PCG64([seed, int(block)])).random(4096)[n[own] & 4095]
            at = np.minimum(np.searchsorted(bounds, u * bounds[-1], side="right"), len(names) - 1)
            yield pa.record_batch([b.column(0), pa.array([names[i] for i in at])], names=["draw_number", stratum])

    return strata.sparkSession.range(draws).withColumnRenamed("id", "draw_number").mapInArrow(run, f"draw_number long, {stratum} {kind.simpleString()}")


def importance(target: Column, proposal: Column) -> Column:
    return F.try_divide(target, proposal)


def default_draws(items: DataFrame, index: str, stratum: str) -> DataFrame:
    """What an item counts as when nothing was drawn: uniform target and proposal, weight 1, draw number -1."""
    size = items.agg((1.0 / F.count(F.lit(1))).alias("p"))  # one row
    rows = items.select(index, stratum).crossJoin(F.broadcast(size))
    return rows.select(index, stratum, F.col("p").alias("target_probability"), F.col("p").alias("proposal_probability"), F.lit(1.0).alias("importance_weight"), F.lit(-1).cast("long").alias("draw_number"))


def draw_violations(draws: DataFrame, row_id: str, index: str, size: Column, tolerance: float = 1e-12) -> DataFrame:
    """row_id, gate: an index outside 0 to size - 1, probabilities that aren't positive and finite, weights other than
    target over proposal (relative tolerance)."""
    t, q, w = (F.col(c) for c in ("target_probability", "proposal_probability", "importance_weight"))
    sound = lambda c: c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
    fits = F.abs(w - F.try_divide(t, q)) <= tolerance * F.abs(F.try_divide(t, q))
    gates = [(F.coalesce((F.col(index) >= 0) & (F.col(index) < size), F.lit(False)), "index"), (sound(t), "target_probability"), (sound(q), "proposal_probability"), (~sound(t) | ~sound(q) | (sound(w) & fits), "importance_weight")]
    found = F.filter(F.array(*[F.when(~ok, F.lit(name)) for ok, name in gates]), lambda g: g.isNotNull())
    return draws.select(row_id, F.explode(found).alias("gate"))


def apply_correction(rows: DataFrame, advantages: str = "advantages", weight: str = "importance_weight") -> DataFrame:
    """Advantages times weights, once: a table that was corrected says so and is refused."""
    if "corrected" in rows.columns:
        raise ValueError("importance correction was applied already")
    return rows.withColumn(advantages, corrected(F.col(advantages), F.col(weight))).withColumn("corrected", F.lit(True))


def weighted_bincount(items: DataFrame, stratum: str, weight: Column, out: str) -> DataFrame:
    return items.groupBy(stratum).agg(F.sum(weight.cast("double")).alias(out))


def per_draw_means(rows: DataFrame, stratum: str, draw: str, value: Column) -> DataFrame:
    """stratum, draws, mean: means per draw, then over a stratum's draws."""
    return rows.groupBy(stratum, draw).agg(F.avg(value).alias("_m")).groupBy(stratum).agg(F.count(F.lit(1)).alias("draws"), F.avg("_m").alias("mean"))


def metrics(strata: DataFrame, items: DataFrame, rows: DataFrame, *, decay: float, floor: float, exponent: float, epsilon: float) -> DataFrame:
    """Seven metrics per stratum and the exponent, for one batch of rows.

    strata: stratum, target, second_moment; items: item, stratum, proposal; rows: stratum, draw, item, proxy. The moment
    moves towards the mean over items of their rows' mean proxy; strata without rows keep theirs."""
    before = weighted_bincount(items, "stratum", F.col("proposal"), "proposal_mass")
    drawn = per_draw_means(rows, "stratum", "draw", F.col("proxy"))
    seen = rows.groupBy("stratum", "item").agg(F.avg("proxy").alias("_m")).groupBy("stratum").agg(F.avg("_m").alias("observed"))
    one = strata.join(before, "stratum", "left").join(drawn, "stratum", "left").join(seen, "stratum", "left")
    moved = decay * F.col("second_moment") + (1 - decay) * F.greatest(F.col("observed"), F.lit(floor))
    one = one.withColumn("next_second_moment", F.when(F.col("observed").isNull(), F.col("second_moment")).otherwise(moved))
    one = powered_proposal(one, F.col("target"), F.col("next_second_moment"), exponent, "_adaptive")
    one = epsilon_mixture(one, F.col("_adaptive"), F.col("target"), epsilon, "next_proposal_mass")
    return one.select("stratum", F.col("target").alias("target_mass"), F.coalesce("proposal_mass", F.lit(0.0)).alias("proposal_mass"), "second_moment", F.coalesce("draws", F.lit(0)).alias("realized_prompt_count"), F.coalesce("mean", F.lit(0.0)).alias("raw_proxy_mean"), "next_proposal_mass", "next_second_moment", F.lit(float(exponent)).alias("proposal_exponent"))


def weight_diagnostics(draws: DataFrame, by: list[str]) -> DataFrame:
    """Mean, min and max weight, effective sample size and share, cross-entropy, KL divergence, least proposal."""
    w, q = F.col("importance_weight"), F.col("proposal_probability")
    ess = F.pow(F.sum(w), F.lit(2)) / F.sum(w * w)
    r = lambda c, name: F.round(c, 9).alias(name)
    return draws.groupBy(*by).agg(
        F.count(F.lit(1)).alias("draws"), r(F.avg(w), "mean_weight"), r(F.min(w), "min_weight"), r(F.max(w), "max_weight"), r(ess, "ess"), r(ess / F.count(F.lit(1)), "ess_fraction"),
        r(F.avg(-w * F.ln(q)), "cross_entropy"), r(F.avg(w * F.ln(w)), "kl"), F.min(q).alias("min_proposal"),
    )


def masked_second_moment(advantages: Column, mask: Column) -> Column:
    """Sum of squared advantages under the mask over the mask's sum; null for an empty mask, which a gate rejects."""
    pairs = F.zip_with(advantages, mask, lambda a, m: a.cast("double") * a.cast("double") * m)
    return F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x), F.aggregate(mask, F.lit(0.0), lambda s, m: s + m))


def corrected(advantages: Column, weight: Column) -> Column:
    return F.transform(advantages, lambda a: a.cast("double") * weight)


def two_level_mean(rows: DataFrame, stratum: str, item: str, value: Column) -> DataFrame:
    """Means per item, then per stratum: items with many rows don't count more."""
    return rows.groupBy(stratum, item).agg(F.avg(value).alias("_m")).groupBy(stratum).agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("_m"), 9).alias("mean"))


def ema(steps: DataFrame, stratum: str, step: str, observed: str, start: float, decay: float, floor: float) -> DataFrame:
    """stratum, second_moment: m <- decay * m + (1 - decay) * max(observed, floor), in the order of steps.

    One row per stratum and step comes in, so what is collected per stratum is one number a step."""
    series = steps.groupBy(stratum).agg(F.array_sort(F.collect_list(F.struct(F.col(step), F.col(observed).alias("v")))).alias("_s"))
    fold = F.aggregate("_s", F.lit(float(start)), lambda m, x: decay * m + (1 - decay) * F.greatest(x["v"].cast("double"), F.lit(float(floor))))
    return series.select(stratum, F.size("_s").cast("long").alias("steps"), F.round(fold, 9).alias("second_moment"))


def draw_consistency(rows: DataFrame, draw: str, same: list[str], close: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Draws whose rows differ in an index or stratum, or by more than a relative tolerance in a probability."""
    bad = F.lit(False)
    for c in same:
        bad = bad | (F.min(c) != F.max(c))
    for c in close:
        bad = bad | (F.max(c) - F.min(c) > tolerance * F.abs(F.min(c)))
    return rows.groupBy(draw).agg(F.count(F.lit(1)).alias("rows"), bad.alias("inconsistent")).where("inconsistent").drop("inconsistent")


def first_representatives(rows: DataFrame, draw: str, position: str) -> DataFrame:
    return rows.groupBy(draw).agg(F.min(position).alias(position))


def capped_srs(rows: DataFrame, stratum: list[str], row_id: str, cap: int, seed: int) -> DataFrame:
    """Per stratum the first `cap` rows by a seeded hash, with N, n, inclusion probability and weight."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in stratum], F.col(row_id).cast("string")), 256)
    keyed = rows.withColumn("_h", key).withColumn("_slice", F.left("_h", F.lit(2)))
    few = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*stratum, "_slice").orderBy("_h"))).where(F.col("_r") <= cap)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*stratum).orderBy("_h"))).where(F.col("_r") <= cap)
    sizes = rows.groupBy(*stratum).agg(F.count(F.lit(1)).alias("stratum_population"))
    n = F.least(F.col("stratum_population"), F.lit(cap))
    return few.join(sizes, stratum).drop("_h", "_slice", "_r").withColumn("stratum_sample_n", n).withColumn("inclusion_probability", n.cast("double") / F.col("stratum_population")).withColumn("weight", F.col("stratum_population").cast("double") / n)


#: Named run conditions: epsilon (None: as given), adaptation, correction, strict target preservation, stratified batches,
#: initial weights. How replays follow a schedule is left to the trainer.
CONDITIONS = {
    "iid": (1.0, False, True, True, False, "target"),
    "adaptive_uncorrected": (None, True, False, False, False, "target"),
    "adaptive_corrected": (None, True, True, True, False, "target"),
    "replay_uncorrected": (None, False, False, False, False, "target"),
    "replay_corrected": (None, False, True, True, False, "target"),
    "replay_stratified_corrected": (None, False, True, True, True, "target"),
    "oracle_corrected": (None, False, True, True, False, "oracle"),
}
