"""Cells of a crossed design: rates, paired contrasts, interactions, exact tests and bootstraps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_rates(scored: DataFrame, cell: list[str], flags: dict[str, Column]) -> DataFrame:
    """Count and rate of each flag, responses, truncated, sum and median of output tokens per cell."""
    own = [e for name, c in flags.items() for e in (F.count_if(c).alias(f"{name}_count"), F.round(F.avg(c.cast("double")), 9).alias(f"{name}_rate"))]
    return scored.groupBy(*cell).agg(F.count(F.lit(1)).alias("responses"), *own, F.count_if(F.col("finish_reason") == "length").alias("truncated"), F.sum("output_tokens").alias("output_tokens"), F.median("output_tokens").alias("median_tokens"))


def interaction(scored: DataFrame, by: list[str], outcome: Column) -> DataFrame:
    """(hash/hash - boxed/hash) - (hash/boxed - boxed/boxed) of trained/requested rates, in percentage points."""
    rate = lambda t, r: F.avg(F.when((F.col("training") == t) & (F.col("request") == r), outcome.cast("double")))
    corners = {f"{t[0]}{r[0]}": rate(t, r) for t in ("hash", "boxed") for r in ("hash", "boxed")}
    did = 100 * ((corners["hh"] - corners["bh"]) - (corners["hb"] - corners["bb"]))
    return scored.groupBy(*by).agg(*[F.round(100 * v, 9).alias(k) for k, v in corners.items()], F.round(did, 9).alias("interaction_pp"))


def spread(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """mean, sample SD, min, max and span of a column."""
    c = F.col(column)
    return values.groupBy(*by).agg(F.round(F.avg(c), 9).alias("mean"), F.round(F.stddev_samp(c), 9).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.max(c) - F.min(c), 9).alias("span"), F.count(c).alias("n"))


def paired(scored: DataFrame, arm: str, base: str, trained: str, outcome: Column, keys: list[str]) -> DataFrame:
    """keys, b, r: the outcome of a key's first sample in the base and the trained arm, where both exist."""
    value = lambda a: F.min_by(outcome.cast("int"), F.when(F.col(arm) == a, F.col("sample")))
    both = scored.where(F.col(arm).isin(base, trained)).groupBy(*keys).agg(value(base).alias("b"), value(trained).alias("r"), F.count_if(F.col(arm) == base).alias("_b"), F.count_if(F.col(arm) == trained).alias("_r"))
    return both.where("_b > 0 AND _r > 0").drop("_b", "_r")


def mcnemar_p(gained: Column, lost: Column) -> Column:
    """Two-sided exact binomial test at 1/2, inside the JVM: terms C(n, i) from the middle down, as shares of the middle one,
    so that none underflows before it stops to count. About 20 sqrt(n) steps a row."""
    n, k = gained + lost, F.least(gained, lost)
    middle = F.floor(n / 2)
    lowest = F.greatest(F.lit(0).cast("long"), middle - F.floor(20 * F.sqrt(n)) - 20)
    # term_middle = 1; term_{i-1} = term_i i / (n + 1 - i)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), F.when(middle == k, 1.0).otherwise(0.0).alias("tail"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * i / (n + 1 - i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), (s["tail"] + F.when(i - 1 <= k, term).otherwise(0.0)).alias("tail"))

    steps = F.when(middle > lowest, F.sequence(middle, lowest + 1, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    # both sides; an even n has one middle
    return F.aggregate(steps, start, step, lambda s: F.least(F.lit(1.0), 2 * s["tail"] / (2 * s["sum"] - (1 - n % 2))))


def mcnemar_exact(gained: Column, lost: Column) -> Column:
    """The same for counts of any size, in Arrow batches; about 20 sqrt(n) terms a row."""

    @F.pandas_udf("double")
    def run(g: pd.Series, x: pd.Series) -> pd.Series:
        def p(a: int, b: int) -> float:
            # terms C(n, i) from the middle down, as shares of the middle one; those beyond are below 1e-323 of it
            n, k = a + b, min(a, b)
            middle = n // 2
            i = np.arange(middle, max(0, middle - int(20 * n**0.5) - 20), -1, dtype=float)
            terms = np.concatenate([[1.0], np.cumprod(i / (n + 1 - i))])
            whole = 2 * terms.sum() - (1 - n % 2)  # both sides; an even n has one middle
            return float(min(1.0, 2 * terms[middle - k :].sum() / whole))

        return pd.Series([p(int(a), int(b)) for a, b in zip(g, x, strict=True)], dtype=float)

    return run(gained, lost)


def transitions(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs, gained (0 to 1), lost (1 to 0) and mean difference."""
    b, r = F.col("b"), F.col("r")
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), F.count_if((b == 0) & (r == 1)).alias("gained"), F.count_if((b == 1) & (r == 0)).alias("lost"), F.round(F.avg((r - b).cast("double")), 9).alias("mean_difference"))


def bootstrap(values: DataFrame, by: list[str], column: str, replicates: int = 20_000, seed: int = 20260909) -> DataFrame:
    """mean and percentile interval (2.5, 97.5) over replicates that share their indices between groups of equal size.

    Values are aligned by `position`. A group's rows come together in one task: groups are evaluation cells of a fixed
    number of items. Indices are drawn in blocks, so memory is bounded by a block and a number per replicate.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("position")[column].to_numpy(float)
        rng, means = np.random.Generator(np.random.PCG64(seed)), []
        for at in range(0, replicates, 500):
            index = rng.integers(0, len(x), size=(min(500, replicates - at), len(x)), dtype=np.int32)
            means.append(x[index].mean(axis=1))
        low, high = np.quantile(np.concatenate(means), [0.025, 0.975])
        return pd.DataFrame([[*key, len(x), x.mean(), low, high]])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.select(*by).schema)
    return values.select(*by, "position", column).groupBy(*by).applyInPandas(run, f"{fields}, n long, mean double, ci_low double, ci_high double")


def protocol_drift(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Distinct protocols per group; more than one is drift."""
    return rows.groupBy(by).agg(F.count_distinct(F.struct(*fields)).alias("protocols"))


def missing_cells(rows: DataFrame, levels: dict[str, list]) -> DataFrame:
    """Cells of the full design that no row has. Levels are design constants, so their product is small."""
    grid = rows.sparkSession.range(1).select()
    for name, values in levels.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid.join(rows.select(*levels).distinct(), list(levels), "left_anti")


def decompose(base_strict: Column, base_lenient: Column, rl_strict: Column, rl_lenient: Column) -> dict[str, Column]:
    """Strict and lenient gains, gaps before and after, their reduction and its share of the strict gain."""
    gap0, gap1, gain = base_lenient - base_strict, rl_lenient - rl_strict, rl_strict - base_strict
    return {"strict_gain": gain, "lenient_gain": rl_lenient - base_lenient, "initial_gap": gap0, "residual_gap": gap1, "net_gap_reduction": gap0 - gap1, "initial_gap_share": F.try_divide(gap0, gain)}
