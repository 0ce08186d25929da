"""Finite-population calibration against human labels: exact intervals, bounds, weighted agreement, gains."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.readers import strip

INTERVAL = ("lower_estimate", "upper_estimate", "ci_low", "ci_high")


def hypergeometric_interval(x: int, n: int, population: int, alpha: float) -> tuple[float, float]:
    """Equal-tail exact inversion: the successes K under which both tails of x have at least alpha / 2. A census is exact.

    Both tails are monotone in K, so each end is found by bisection over whole-number counts.
    """
    if not 0 <= x <= n <= population or n < 1 or not 0 < alpha < 1:
        raise ValueError("0 <= x <= n <= population, n > 0 and 0 < alpha < 1 are needed")
    if n == population:
        return x / n, x / n
    ways = comb(population, n)

    def enough(k: int, outcomes: range) -> bool:
        rest = population - k
        return sum(comb(k, j) * comb(rest, n - j) for j in outcomes if j <= k and n - j <= rest) / ways >= alpha / 2

    def edge(good: int, bad: int, outcomes: range) -> int:
        """The last count from `good` towards `bad` that is still good."""
        while abs(good - bad) > 1:
            middle = (good + bad) // 2
            good, bad = (middle, bad) if enough(middle, outcomes) else (good, middle)
        return good

    lowest, highest = x, population - n + x
    low = lowest if enough(lowest, range(x, n + 1)) else edge(highest, lowest, range(x, n + 1))
    high = highest if enough(highest, range(x + 1)) else edge(lowest, highest, range(x + 1))
    return low / population, high / population


def hypergeometric_columns(cells: DataFrame, x: str, n: str, population: str, alpha: Column) -> DataFrame:
    """Adds ci_low and ci_high. The intervals are computed once per distinct (x, n, N, alpha)."""
    asked = cells.select(F.col(x).alias("_x"), F.col(n).alias("_n"), F.col(population).alias("_N_"), alpha.cast("double").alias("_alpha"))

    @F.pandas_udf("ci_low double, ci_high double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for xs, ns, sizes, alphas in batches:
            yield pd.DataFrame([hypergeometric_interval(int(a), int(b), int(c), float(d)) for a, b, c, d in zip(xs, ns, sizes, alphas, strict=True)], columns=["ci_low", "ci_high"])

    found = asked.distinct().withColumn("_ci", run("_x", "_n", "_N_", "_alpha"))
    keyed = cells.withColumn("_alpha", alpha.cast("double"))
    on = [keyed[x].eqNullSafe(found["_x"]), keyed[n].eqNullSafe(found["_n"]), keyed[population].eqNullSafe(found["_N_"]), keyed["_alpha"] == found["_alpha"]]
    return keyed.join(found, on).select(*[keyed[c] for c in cells.columns], "_ci.ci_low", "_ci.ci_high")


def interval(low: Column, high: Column, ci_low: Column, ci_high: Column) -> Column:
    """estimate (null unless the bounds meet) and the four bounds."""
    estimate = F.when(F.abs(low - high) < 1e-12, (low + high) / 2)
    return F.struct(estimate.alias("estimate"), low.alias("lower_estimate"), high.alias("upper_estimate"), ci_low.alias("ci_low"), ci_high.alias("ci_high"))


def exact(value: Column) -> Column:
    return interval(value, value, value, value)


def linear(terms: list[tuple[float, Column]]) -> Column:
    """Bounds of a signed sum: a negative coefficient takes the other end."""

    def side(low: str, high: str, upper: bool) -> Column:
        total = F.lit(0.0)
        for c, m in terms:
            total = total + F.lit(c) * m[high if (c >= 0) == upper else low]
        return total

    points, limits = ("lower_estimate", "upper_estimate"), ("ci_low", "ci_high")
    return interval(side(*points, False), side(*points, True), side(*limits, False), side(*limits, True))


def linear_aggregate(coefficient: Column, metric: Column) -> Column:
    """linear() over the rows of a group."""

    def side(low: str, high: str, upper: bool) -> Column:
        plus, minus = (high, low) if upper else (low, high)
        return F.sum(coefficient * F.when(coefficient >= 0, metric[plus]).otherwise(metric[minus]))

    points, limits = ("lower_estimate", "upper_estimate"), ("ci_low", "ci_high")
    return interval(side(*points, False), side(*points, True), side(*limits, False), side(*limits, True))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Conservative bounds of a ratio in [0, 1]; undefined where the denominator's upper bound isn't positive."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    low = lambda n, d: F.when(denominator[d] > 0, clip(F.try_divide(numerator[n], denominator[d]))).otherwise(0.0)
    high = lambda n, d: F.when(denominator[d] > 0, clip(F.try_divide(numerator[n], denominator[d]))).otherwise(1.0)
    known = interval(low("lower_estimate", "upper_estimate"), high("upper_estimate", "lower_estimate"), low("ci_low", "ci_high"), high("ci_high", "ci_low"))
    none, some = F.lit(None).cast("double"), denominator["ci_high"] > 0
    unknown = F.struct(none.alias("estimate"), none.alias("lower_estimate"), none.alias("upper_estimate"), F.when(some, 0.0).alias("ci_low"), F.when(some, 1.0).alias("ci_high"))
    return F.when(denominator["upper_estimate"] <= 0, unknown).otherwise(known)


def human_value(status: Column, correctness: Column) -> Column:
    """0 without an answer, null while unresolved, else whether the answer is correct."""
    clear = (status == "CLEAR_ANSWER") & (correctness != "UNRESOLVED")
    return F.when(status == "NO_ANSWER", 0).when(clear, (correctness == "CORRECT").cast("int"))


# What two annotators' labels are compared by, and the reason that stands for a review not made.
FLAGS = ("has_self_correction", "has_conflicting_answer_fields", "old_answer_explicitly_withdrawn", "reference_issue")
SLOTS = ("R1", "R2", "R3")
NOT_REVIEWED = "INDEPENDENT_A_B_AGREEMENT_NOT_SELECTED_FOR_AUDIT"


def endpoints(h: Column) -> dict[str, Column]:
    """Binary endpoints that bound an unresolved value from both sides."""
    return {"h_lower": F.coalesce(h == 1, F.lit(False)), "h_upper": F.coalesce(h != 0, F.lit(True)), "unresolved": h.isNull()}


def label_endpoints(readers: tuple[str, ...]) -> dict[str, Column]:
    """All binary endpoints of a label row as 0 or 1: twelve, and three a reader."""
    col = F.col
    same = lambda field: col(f"A_{field}").eqNullSafe(col(f"B_{field}"))
    flags = F.lit(True)
    for field in (*FLAGS, *(f"fidelity_{s}" for s in SLOTS)):
        flags = flags & same(field)
    clear, equal = col("final_status") == "CLEAR_ANSWER", col("A_B_answer_equivalence")
    reason = F.coalesce(strip(col("adjudication_reason")), F.lit(""))
    out = endpoints(human_value(col("final_status"), col("final_answer_correct"))) | {
        "clear": clear,
        "status_agreement": same("status"),
        "correctness_agreement": same("answer_correct"),
        "answer_lower": equal == "EQUIVALENT",
        "answer_upper": equal != "DIFFERENT",
        "raw_agreement": same("status") & same("answer_correct") & flags & (equal == "EQUIVALENT"),
        "adjudication": col("agreement_type") != "FULL_AGREEMENT",
        "reviewed": (reason != "") & (col("adjudication_reason") != NOT_REVIEWED),
        "reference_issue": (col("A_reference_issue") == "POSSIBLE_REFERENCE_ERROR") | (col("B_reference_issue") == "POSSIBLE_REFERENCE_ERROR"),
    }
    for reader in readers:
        fidelity = col(f"{reader}_fidelity")
        out |= {f"{reader}_fidelity_lower": clear & (fidelity == "FAITHFUL"), f"{reader}_fidelity_upper": clear & fidelity.isin("FAITHFUL", "UNRESOLVED"), f"{reader}_fidelity_unresolved": clear & (fidelity == "UNRESOLVED")}
    return {name: c.cast("int") for name, c in out.items()}


def completion(labels: DataFrame, by: list[str]) -> DataFrame:
    """labels, filled and status per group: pending without a final status, complete with all, else partial (an error to
    whoever analyses)."""
    filled = F.count_if(F.coalesce(F.col("final_status"), F.lit("")) != "")
    out = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), filled.alias("filled"))
    return out.withColumn("status", F.when(F.col("filled") == 0, "PENDING_HUMAN_LABELS").when(F.col("filled") == F.col("labels"), "COMPLETE").otherwise("PARTIAL"))


def strata_histogram(rows: DataFrame, state: str, bits: Column, cap: int) -> DataFrame:
    """state, bits, N and sampled = min(cap, N)."""
    return rows.groupBy(state, bits.alias("bits")).agg(F.count(F.lit(1)).alias("N")).withColumn("sampled", F.least(F.col("N"), F.lit(cap)))


def weighted_mean(strata: DataFrame, state: str, mean: Column, select: Column | None = None, complement: bool = False) -> DataFrame:
    """state, value: sum over strata of N_h / N times the stratum's mean, or of one minus it."""
    share = F.col("N").cast("double") / F.sum("N").over(Window_by(state))
    value = 1 - mean if complement else mean
    part = share * (value if select is None else F.when(select, value).otherwise(0.0))
    return strata.select(state, part.alias("_p")).groupBy(state).agg(F.round(F.sum("_p"), 9).alias("value"))


def Window_by(*columns: str):  # noqa: N802, ANN201
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def kappa(rows: DataFrame, by: list[str], a: str, b: str, weight: Column) -> DataFrame:
    """Weighted agreement, expected agreement and Cohen's kappa (null where chance explains all). Null labels are a category."""
    joint = rows.groupBy(*by, a, b).agg(F.sum(weight.cast("double")).alias("_w"))
    # the confusion table is as large as the square of the categories
    total = F.sum("_w").over(Window_by(*by))
    side = lambda c: F.sum("_w").over(Window_by(*by, c)) / total
    shares = joint.select(*by, a, b, (F.col("_w") / total).alias("_p"), side(a).alias("_pa"), side(b).alias("_pb"))
    left = shares.select(*by, F.col(a).alias("_v"), F.col("_pa").alias("_x")).distinct()
    right = shares.select(*by, F.col(b).alias("_v"), F.col("_pb").alias("_y")).distinct()
    same = left["_v"].eqNullSafe(right["_v"])
    for c in by:
        same = same & left[c].eqNullSafe(right[c])
    chance = left.join(right, same).groupBy(*[left[c] for c in by]).agg(F.sum(F.col("_x") * F.col("_y")).alias("_e"))
    seen = shares.groupBy(*by).agg(F.sum(F.when(F.col(a).eqNullSafe(F.col(b)), F.col("_p")).otherwise(0.0)).alias("_o"))
    both = seen.join(chance, by, "left") if by else seen.crossJoin(chance)
    e = F.coalesce(F.col("_e"), F.lit(0.0))
    return both.select(*by, F.round("_o", 9).alias("observed"), F.round(e, 9).alias("expected"), F.when(e < 1 - 1e-12, F.round((F.col("_o") - e) / (1 - e), 9)).alias("kappa"))


def duplicate_groups(rows: DataFrame, row_id: str, text: Column) -> DataFrame:
    """digest, copies, first_id of texts that occur more than once (ids are joined back where they are wanted)."""
    return rows.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_id")).where("copies > 1")


# Comparisons and coefficients of states.
GAINS = {
    "qwen15": {"qwen15_base": -1.0, "qwen15_rl": 1.0},
    "smol": {"smol_base": -1.0, "smol_rl": 1.0},
    "math_seed83": {"initial": -1.0, "seed83": 1.0},
    "math_seed84": {"initial": -1.0, "seed84": 1.0},
    "math_seed85": {"initial": -1.0, "seed85": 1.0},
    "math_fixed_seed_mean": {"initial": -1.0, "seed83": 1 / 3, "seed84": 1 / 3, "seed85": 1 / 3},
}


def gains(accuracies: DataFrame, comparisons: dict[str, dict[str, float]] = GAINS) -> DataFrame:
    """comparison, reader, reader_gain: signed sums of accuracies (state, reader, accuracy) for complete comparisons."""
    rows = [(name, state, c, len(terms)) for name, terms in comparisons.items() for state, c in terms.items()]
    terms = accuracies.sparkSession.createDataFrame(rows, "comparison string, state string, coefficient double, terms int")
    joined = accuracies.join(F.broadcast(terms), "state")
    return joined.groupBy("comparison", "reader").agg(F.round(F.sum(F.col("coefficient") * F.col("accuracy")), 9).alias("reader_gain"), F.count(F.lit(1)).alias("_n"), F.max("terms").alias("_t")).where("_n = _t").drop("_n", "_t")


def gains_table(states: DataFrame, readers: DataFrame, comparisons: dict[str, dict[str, float]] = GAINS) -> DataFrame:
    """comparison, reader, reader_gain and intervals human_gain, gap (reader minus human), fn_recovery, fp_increase.

    states: state, human (interval); readers: state, reader, accuracy, joint_fp, joint_fn (intervals). Comparisons whose
    states aren't all there are left out."""
    rows = [(name, state, c, len(terms)) for name, terms in comparisons.items() for state, c in terms.items()]
    terms = F.broadcast(states.sparkSession.createDataFrame(rows, "comparison string, state string, coefficient double, terms int"))
    c = F.col("coefficient")
    joined = readers.join(states, "state").join(terms, "state")
    out = joined.groupBy("comparison", "reader").agg(
        F.sum(c * F.col("accuracy")).alias("reader_gain"),
        linear_aggregate(c, F.col("human")).alias("human_gain"),
        linear_aggregate(-c, F.col("joint_fn")).alias("fn_recovery"),
        linear_aggregate(c, F.col("joint_fp")).alias("fp_increase"),
        F.count(F.lit(1)).alias("_n"),
        F.max("terms").alias("_t"),
    )
    gap = linear([(1.0, exact(F.col("reader_gain"))), (-1.0, F.col("human_gain"))])
    return out.where("_n = _t").drop("_n", "_t").withColumn("gap", gap)


def claim(gain: Column, fp_increase: Column, recovery: Column, strict_gain: Column) -> dict[str, Column]:
    """Decision rules: a gain wholly above 0, recovery over half of the strict gain, false positives up by 5 points at most."""
    return {"gain_positive": gain["ci_low"] > 0, "majority_recovered": F.coalesce(F.try_divide(recovery["ci_low"], strict_gain) > 0.5, F.lit(False)), "fp_within_5pp": fp_increase["ci_high"] <= 0.05}


def agreement_type(answer: Column, status: Column, correctness: Column, flags: Column) -> Column:
    """Which of two annotations' parts differ: none, one by name, or several; flags alone count as several."""
    differ = [(~answer, "ANSWER_DISAGREEMENT"), (~status, "STATUS_DISAGREEMENT"), (~correctness, "CORRECTNESS_DISAGREEMENT")]
    n = sum((c.cast("int") for c, _ in differ), F.lit(0))
    only = F.lit("MULTIPLE_DISAGREEMENTS")
    for c, name in differ:
        only = F.when((n == 1) & flags & c, name).otherwise(only)
    return F.when((n == 0) & flags, "FULL_AGREEMENT").otherwise(only)
