"""pass@k: per-item counts, curves and summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 2, 4, 8, 16, 32)


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n - c, k) / C(n, k) as a product of k factors: NaN if k > n, 0 if c is 0, 1 if fewer than k are wrong."""
    factors = F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1)
    miss = F.aggregate(factors, F.lit(1.0), lambda acc, i: acc * (n - c - i).cast("double") / (n - i))
    return F.when(k > n, F.lit(float("nan"))).when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1.0 - miss)


def per_item(scored: DataFrame, lenient: Column, strict: Column) -> DataFrame:
    """id, n, c, c_strict: one row per item, counted in one shuffle with partial sums."""
    return scored.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(lenient).alias("c"), F.count_if(strict).alias("c_strict"))


def keep_largest(records: DataFrame, order: str) -> DataFrame:
    """One record per id: the largest n, and of equal ones the first by `order`."""
    rank = Window.partitionBy("id").orderBy(F.desc("n"), order)
    return records.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def curve(records: DataFrame, ks: Iterable[int] = KS, by: str | None = None) -> DataFrame:
    """k, lenient, strict: means over items of pass@k, for k up to the smallest n (of each value of `by`, if given). Items
    collapse to their (n, c) first."""
    group = [by] if by else []
    shapes = records.groupBy(*dict.fromkeys(["n", "c", "c_strict", *group])).agg(F.count(F.lit(1)).alias("items"))
    least = F.min("n").over(Window.partitionBy(*group))  # of different (n, c): as many rows as there are shapes
    grid = shapes.withColumn("least", least).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("k <= least")
    mean = lambda c: F.sum(pass_at_k(F.col("n"), F.col(c), F.col("k")) * F.col("items")) / F.sum("items")
    return grid.groupBy(*group, "k").agg(mean("c").alias("lenient"), mean("c_strict").alias("strict"))


def summary(records: DataFrame) -> DataFrame:
    """One row: items, responses, smallest and largest n, pass@1, correct counts, items without a correct response."""
    rate = lambda c: F.avg(F.col(c).cast("double") / F.col("n"))
    return records.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("n").alias("n_responses"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
        F.sum("c").alias("correct"),
        F.sum("c_strict").alias("correct_strict"),
        F.round(rate("c"), 9).alias("mean_solve_rate"),
        F.round(rate("c_strict"), 9).alias("mean_solve_rate_strict"),
        F.count_if(F.col("c") == 0).alias("zero_correct"),
        F.count_if(F.col("c_strict") == 0).alias("zero_correct_strict"),
        F.round(rate("c") - rate("c_strict"), 9).alias("gap_at_1"),
    )


def truncation(rows: DataFrame) -> DataFrame:
    """Truncated and all responses over all sample rows, repeated ones included."""
    cut = F.count_if(F.col("finish_reason") == "length")
    return rows.agg(cut.alias("truncated"), F.count(F.lit(1)).alias("responses"), F.round(cut / F.count(F.lit(1)), 9).alias("truncation_rate"))
