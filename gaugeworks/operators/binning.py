"""Frozen difficulty: shards, merged scores, bins and audit pools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.hashing import sha256_key

def modulo_shard(rows: DataFrame, index: int, shards: int, row_id: str = "row_id") -> DataFrame:
    if not 0 <= index < shards:
        raise ValueError("index must be in [0, shards)")
    return rows.where(F.pmod(F.col(row_id), F.lit(shards)) == index)


def rollout_scores(rollouts: DataFrame, correct: Column) -> DataFrame:
    """row_id, solve_count, rollouts, mean_response_tokens, truncated_count."""
    return rollouts.groupBy("row_id").agg(F.count_if(correct).alias("solve_count"), F.count(F.lit(1)).alias("rollouts"), F.round(F.avg("output_tokens"), 9).alias("mean_response_tokens"), F.count_if(F.col("finish_reason") == "length").alias("truncated_count"))


def global_rank(rows: DataFrame, major: str, minor: Column, out: str) -> DataFrame:
    """0-based rank by (major, minor), and `_total`, without one task seeing all rows.

    `major` has few values or few rows each, and `minor` is a hex digest, so rows are dealt to (major, first two digits); a
    table of those groups' sizes, at most 256 per value of major, gives each group's first rank. `rows` is read twice.
    """
    keyed = rows.withColumn("_minor", minor).withColumn("_slice", F.left("_minor", F.lit(2)))
    sizes = keyed.groupBy(major, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(major, "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy())).drop("_n")
    inside = Window.partitionBy(major, "_slice").orderBy("_minor")
    return keyed.join(starts, [major, "_slice"]).withColumn(out, F.row_number().over(inside) - 1 + F.col("_start")).drop("_minor", "_slice", "_start")


def position_in_order(rows: DataFrame, key: str, width: int, out: str) -> DataFrame:
    """0-based position by a whole number `key`: ranks within ranges of `width` keys, and the ranges' sizes summed in two
    levels, so that no task sees more than `width` keys or ranges."""
    keyed = rows.withColumn("_range", F.floor(F.col(key) / width)).withColumn("_far", F.floor(F.col("_range") / width))
    sizes = keyed.groupBy("_far", "_range").agg(F.count(F.lit(1)).alias("_n"))
    far = sizes.groupBy(F.col("_far").alias("_f")).agg(F.sum("_n").alias("_m"))  # one row per width * width keys
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    far = far.select("_f", F.coalesce(F.sum("_m").over(before(Window.orderBy("_f"))), F.lit(0)).alias("_first"))
    sizes = sizes.withColumn("_own", F.coalesce(F.sum("_n").over(before(Window.partitionBy("_far").orderBy("_range"))), F.lit(0)))
    starts = sizes.join(far, F.col("_far") == F.col("_f")).select(F.col("_range").alias("_r"), (F.col("_own") + F.col("_first")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return keyed.join(starts, F.col("_range") == F.col("_r")).withColumn(out, inside + F.col("_start")).drop("_range", "_far", "_r", "_start")


def balanced_bins(scores: DataFrame, bins: int, key: Callable[[Column], Column] = sha256_key) -> DataFrame:
    """Bins of sizes one apart at most by (solve_count, hash of row_id); lower counts never get easier bins. Not ntile. Reads
    `scores` twice: hand it over written."""
    tie = key(F.concat(F.lit("difficulty-tie:"), F.col("row_id").cast("string")))
    ranked = global_rank(scores, "solve_count", tie, "_rank")
    bin_of = F.least(F.expr(f"_rank * {bins} div _total"), F.lit(bins - 1)).cast("int")
    return ranked.withColumn("difficulty_bin", bin_of).drop("_rank", "_total")


def cutpoint_bins(scores: DataFrame, cutpoints: list[int]) -> DataFrame:
    """The number of cutpoints below the solve count."""
    if sorted(set(cutpoints)) != cutpoints or not cutpoints:
        raise ValueError("cutpoints must be strictly increasing")
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cutpoints]), lambda c: c < F.col("solve_count")))
    return scores.withColumn("difficulty_bin", below)


def audit_pool(binned: DataFrame, per_bin: int, seed: int, key: Callable[[Column], Column] = sha256_key) -> DataFrame:
    """The first per_bin rows of each bin in the order of a hash of row_id.

    Ranks are taken per slice of hashes first, then over the slices' own first rows, so no task sees a whole bin.
    """
    h = key(F.concat(F.lit(f"audit:{seed}:"), F.col("row_id").cast("string")))
    keyed = binned.withColumn("_h", h).withColumn("_slice", F.left("_h", F.lit(2)))
    few = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("difficulty_bin", "_slice").orderBy("_h"))).where(F.col("_r") <= per_bin)
    rank = F.row_number().over(Window.partitionBy("difficulty_bin").orderBy("_h"))
    return few.withColumn("audit_rank", rank).where(F.col("audit_rank") <= per_bin).drop("_h", "_slice", "_r")


def without_audit(binned: DataFrame, audit: DataFrame) -> DataFrame:
    return binned.join(audit.select("row_id"), "row_id", "left_anti")


def marked_audit(binned: DataFrame, audit: DataFrame) -> DataFrame:
    """Adds audit_rank, null for training rows. The pool has per_bin rows a bin, so it's broadcast."""
    return binned.join(F.broadcast(audit.select("row_id", "audit_rank")), "row_id", "left")


def bin_summary(marked: DataFrame) -> DataFrame:
    """Counts of all, training and audit rows and mean, min and max solve rate per bin, in one pass over marked rows."""
    rate = F.col("solve_count").cast("double") / F.col("rollouts")
    counts = [F.count(F.lit(1)).alias("full_count"), F.count_if(F.col("audit_rank").isNull()).alias("training_count"), F.count("audit_rank").alias("audit_count")]
    return marked.groupBy("difficulty_bin").agg(*counts, F.round(F.avg(rate), 9).alias("mean_rate"), F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"))
