"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Every source is laid out as shards of documents in a seeded order and cut into blocks of `block` words. Blocks are
allocated to sources by highest quotients target / (2k - 1), then a source's blocks to its shards in the same way, so
each shard has an integer quota. A shard gives all of its blocks as often as the quota covers the whole shard, and for the rest the
first blocks of its seeded order.

Sizes are words. A source without weight gets weight 0. Targets share the given total by weight and stop at `cap` times
a source's size; the excess is shared again by weight until none is above.

Defined cases: null texts and texts without words have size 0 and are never taken; a null source is a source of its
own, last in order; null and repeated doc_ids are rows like any other; extra columns are left out; an empty table or one
without words gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored, word_count

ROWS_PER_SHARD = 4_000


def default_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, for sources in code-point order with null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))


def capped_targets(sources: DataFrame, cap: int) -> DataFrame:
    """Adds `target`: total by weight, at most cap times source_size, the excess reshared by weight until none is above.

    Sources sorted by cap * size / weight are capped from the front, so the level of the rest follows from running sums.
    `sources` has one row per source, so its windows see as many rows as there are sources.
    """
    everything = Window.partitionBy()
    ratio = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    most = F.col("source_size") * cap
    s = sources.withColumn("ratio", F.when(F.col("weight") > 0, most.cast("double") / F.col("weight")).otherwise(F.lit(float("inf"))))
    s = s.withColumn("all_size", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.col("all_size") - F.coalesce(F.sum(F.when(F.col("weight") > 0, most).otherwise(0)).over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", F.when(F.col("left_weight") > 0, F.col("left").cast("double") / F.col("left_weight")))
    # the level holds from the first source that isn't capped at it
    s = s.withColumn("_rank", F.row_number().over(ratio))
    s = s.withColumn("water", F.min(F.when((F.col("ratio") >= F.col("level")) & (F.col("weight") > 0), F.struct("_rank", "level"))).over(everything)["level"])
    uncapped = F.col("water").isNotNull() & (F.col("ratio") >= F.col("water"))
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(uncapped, F.col("weight") * F.col("water")).otherwise(most.cast("double"))
    return s.withColumn("target", target).drop("ratio", "left", "left_weight", "level", "water", "all_weight", "_rank")


def highest_quotients(parties: DataFrame, group: list[str], votes: str, seats: Column, out: str) -> DataFrame:
    """Sainte-Lague: within each group, `seats` go to the highest quotients votes / (2k - 1).

    All but about two seats a party are certain beforehand: the divisor of the last seat lies between
    V / (seats + n/2) and V / (seats - n/2) for n parties with V votes, so only the quotients between them are ranked.
    Rows ranked: about twice the parties.
    """
    whole = Window.partitionBy(*group)
    p = parties.withColumn("_v", F.col(votes).cast("double")).withColumn("_seats", seats.cast("long"))
    p = p.withColumn("_votes", F.sum("_v").over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    low, high = F.col("_votes") / (F.col("_seats") + F.col("_n") / 2 + 1), F.col("_votes") / (F.col("_seats") - F.col("_n") / 2 - 1)
    sure = F.when((F.col("_v") > 0) & (F.col("_seats") > F.col("_n") / 2 + 1), F.floor(F.col("_v") / high)).otherwise(F.lit(0)).cast("long")
    p = p.withColumn("_sure", F.greatest(sure - 1, F.lit(0)).cast("long"))
    last = F.when(F.col("_v") > 0, F.ceil(F.col("_v") / low) + 1).otherwise(F.lit(0)).cast("long")
    p = p.withColumn("_open", F.when((F.col("_v") > 0) & (F.col("_seats") > 0) & (last > F.col("_sure")), F.sequence(F.col("_sure") + 1, last)))
    p = p.withColumn("_left", F.col("_seats") - F.sum("_sure").over(whole))
    names = [c for c in p.columns if c != "_open"]
    rows = p.select(*names, F.explode_outer("_open").alias("_k"))
    ties = [F.col(c).asc_nulls_last() for c in parties.columns]
    rank = Window.partitionBy(*group).orderBy((F.col("_v") / (2 * F.col("_k") - 1)).desc_nulls_last(), *ties)
    won = F.col("_k").isNotNull() & (F.row_number().over(rank) <= F.col("_left"))
    rows = rows.withColumn("_won", won.cast("long"))
    return rows.groupBy(*parties.columns).agg((F.first("_sure") + F.sum("_won")).alias(out))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, seed: int = 17, cap: int = 3, block: int = 128, whole_documents: bool = False, keep: tuple[str, ...] = (), rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies, part_from, part_to.

    `copies` counts how often the whole document is taken; words part_from to part_to (excluded) are taken once more.
    With `whole_documents` a document is taken once more if the middle of it lies in the blocks taken once more, and
    part_from and part_to are then 0 and its size. `weights` has source and weight; without it weights are 1, 2, 3, repeating.
    `keep` names further columns of docs to carry along with whole documents; these aren't shuffled while the table of
    shards is small enough for Spark to broadcast.
    """
    measured = [word_count(F.col("text")).alias("size"), F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_order")]
    # words are counted once; what follows reads ids and sizes only
    d = stored(docs.select("doc_id", "source", *measured), "sizes")
    sources = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    if weights is None:
        sources = default_weights(sources)
    else:
        w = weights.groupBy(F.col("source").alias("_w")).agg(F.max("weight").alias("weight"))
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("_w")), "left").drop("_w").withColumn("weight", F.coalesce("weight", F.lit(0)))
    sources = capped_targets(sources, cap).withColumn("_shards", F.ceil(F.col("_rows") / rows_per_shard))
    blocks = F.round(F.col("all_size") / F.lit(block))
    quotas = highest_quotients(sources, [], "target", blocks, "source_blocks")
    shard = F.pmod(F.conv(F.left(F.col("_order"), F.lit(8)), 16, 10).cast("long"), F.col("_shards"))
    # one row per source: as many as there are names of sources; Spark broadcasts it while it is small
    placed = sources.select(F.col("source").alias("_s"), "source_size", "target", "_shards")

    def in_shards(rows: DataFrame) -> DataFrame:
        return rows.join(placed, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_shard", shard)

    d = in_shards(d)
    cells = d.groupBy("source", "_shard").agg(F.sum("size").alias("_cell"))
    cells = cells.join(quotas.select(F.col("source").alias("_s"), "source_blocks"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cells = highest_quotients(cells, ["source"], "_cell", F.col("source_blocks"), "_quota")
    words = F.least(F.col("_quota") * block, F.col("_cell") * cap)
    cells = cells.withColumn("_full", F.when(F.col("_cell") > 0, F.floor(words / F.col("_cell"))).otherwise(F.lit(0)).cast("long")).withColumn("_more", (words - F.col("_full") * F.col("_cell")).cast("long"))
    cells = cells.select(F.col("source").alias("_s"), F.col("_shard").alias("_t"), "_full", "_more")
    by_cell = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_t"))
    whole = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "size")
    if whole_documents:
        # rows with equal keys are taken together, so a shard's last key tells which of its documents are taken once more
        row = F.struct("_order", "doc_id", "size")
        met = d.join(cells, by_cell).withColumn("_end", F.sum("size").over(whole.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        last = met.groupBy("_s", "_t", "_full").agg(F.max(F.when(2 * F.col("_end") - F.col("size") < 2 * F.col("_more"), row)).alias("_last"))
        # written, so that Spark knows how small it is before it plans the join
        d = in_shards(docs.select("doc_id", "source", *measured, *keep)).join(stored(last, "shards"), by_cell)
        more = F.when(row <= F.col("_last"), F.col("size")).otherwise(F.lit(0))
    else:
        d = d.join(cells, by_cell).withColumn("_end", F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        more = F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_more")) - F.col("_end") + F.col("size"))
    carried = keep if whole_documents else ()
    return d.select("doc_id", "size", "source_size", "target", (F.col("_full") * F.col("size") + more).cast("long").alias("taken"), F.col("_full").alias("copies"), F.lit(0).cast("long").alias("part_from"), more.cast("long").alias("part_to"), *carried)
