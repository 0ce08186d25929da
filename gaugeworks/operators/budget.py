"""Resource ledgers: totals per run and comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HARD = ("sampled_prompts", "completions", "reward_calls", "optimizer_updates", "validation_calls")
#: Counted and reported, but free to differ: equal runs may stop generating at different lengths.
COUNTERS = (*HARD, "generated_tokens")


def totals(events: DataFrame, by: str = "run") -> DataFrame:
    """Sums of all counters; GPU seconds are wall seconds times GPUs."""
    return events.groupBy(by).agg(*[F.sum(c).alias(c) for c in COUNTERS], F.round(F.sum("wall_seconds"), 6).alias("wall_seconds"), F.round(F.sum(F.col("wall_seconds") * F.col("gpus")), 6).alias("gpu_seconds"))


def compare(ledger: DataFrame, a: str, b: str, by: str = "run") -> DataFrame:
    """counter, left, right, difference, hard: hard counters must not differ."""
    fields = [*COUNTERS, "wall_seconds", "gpu_seconds"]
    long = ledger.select(by, *[F.col(c).cast("double").alias(c) for c in fields]).unpivot([by], fields, "counter", "value")
    side = lambda x: F.max(F.when(F.col(by) == x, F.col("value")))
    both = long.where(F.col(by).isin(a, b)).groupBy("counter").agg(side(a).alias("left"), side(b).alias("right"))
    return both.select("counter", "left", "right", F.round(F.col("right") - F.col("left"), 6).alias("difference"), F.col("counter").isin(*HARD).alias("hard"))


def batch_counts(rows: DataFrame, by: list[str], draw: str, mask: Column) -> DataFrame:
    """sampled_prompts (different draws), completions and generated_tokens (the masks' sums) per batch."""
    tokens = F.aggregate(mask, F.lit(0).cast("long"), lambda a, m: a + m.cast("long"))
    return rows.groupBy(*by).agg(F.count_distinct(draw).alias("sampled_prompts"), F.count(F.lit(1)).alias("completions"), F.sum(tokens).alias("generated_tokens"))


def domain_violations(rows: DataFrame, row_id: str, counters: list[str], durations: list[str]) -> DataFrame:
    """row_id, field: counters that aren't whole numbers from 0 on, durations that aren't finite numbers from 0 on. Booleans
    are neither."""
    kinds = dict(rows.dtypes)

    def sound(c: str, whole: bool) -> Column:
        if kinds[c] == "boolean":
            return F.lit(False)
        v = F.col(c).cast("double")
        good = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
        return good & (v == F.floor(v)) if whole else good

    bad = [F.when(~sound(c, c in counters), F.lit(c)) for c in (*counters, *durations)]
    return rows.select(row_id, F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("field"))


def require_equal(comparison: DataFrame) -> None:
    """Raises over all hard counters that differ or that only one run has."""
    found = comparison.where("hard AND NOT coalesce(difference = 0, false)").orderBy("counter").collect()  # a row a counter
    if found:
        raise ValueError("runs differ in " + ", ".join(f"{r.counter} ({r.left}, {r.right})" for r in found))
