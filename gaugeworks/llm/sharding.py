"""Sharding by sampled splitters, with DataFrame functions only; the law held is `bytes`: shards of nearly equal size.

Records are ordered by key (digest of the text, then doc_id), so equal texts stand together. A size-weighted sample of
keys gives splitters at quantiles, which deal the records into many fine ranges of similar size. Exact sizes of the
ranges, and running sums inside each, then place every record on the line of all bytes, and that line is cut into equal
shards. A group of equal texts stays in one shard, by its middle, unless it is overfull, that is, larger than
1 / (shards * GROUP_SHARE) of all bytes: such ranges are subdivided by doc_id.

The sample only steers how evenly the work is dealt; no result depends on it.

Defined cases: null texts count as empty (size 8, checksum 0); null doc_ids sort first within equal texts; repeated rows
get slots of their own; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Overhead in bytes that a record has besides its text.
OVERHEAD = 8
#: A group of equal texts above 1 / GROUP_SHARE of a shard is divided.
GROUP_SHARE = 50
#: Fine ranges per shard at least, records of a range at most on average (up to MOST ranges, whose splitters the driver and every
#: task hold: 64 bytes each), and sampled keys per fine range.
RANGES, RECORDS, MOST, SAMPLES = 24, 1_000_000, 1 << 16, 8


def _key(digest: Column, doc_id: Column) -> Column:
    """A string that sorts as (digest, doc_id), null doc_id first."""
    return F.concat(digest, F.coalesce(F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("")))


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at most the key: a binary search over a literal array."""
    if not splitters:
        return F.lit(0)
    steps, step = [], 1
    while step <= len(splitters):
        steps.insert(0, step)
        step *= 2
    held, n = F.lit(splitters), len(splitters)
    fits = lambda at, by: (at + by <= n) & (F.element_at(held, F.least(at + by, F.lit(n))) <= key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, by: F.when(fits(at, by), at + by).otherwise(at))


def shard_by_size(docs: DataFrame, shards: int = 24, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"))
    # a record is 32 + some 30 bytes here, whatever its text: cut the lineage, so that texts are read once
    d = d.checkpoint() if docs.sparkSession.sparkContext.getCheckpointDir() else d
    total, records = d.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(shards * RANGES, min(MOST, records // RECORDS))
    # fewer than shards * GROUP_SHARE groups can be this large
    overfull = {r[0]: r[1] for r in d.groupBy("digest").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * (shards * GROUP_SHARE) > total).collect()}
    key = _key(F.col("digest"), F.col("doc_id"))
    wanted = ranges * SAMPLES
    drawn = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30) < F.least(F.lit(1.0), F.col("size") * F.lit(wanted / max(total, 1)))
    sample = d.filter(drawn).select(key.alias("key")).orderBy("key").withColumn("at", F.row_number().over(Window.orderBy("key")))
    picked = [r[0] for r in sample.filter(F.col("at") % SAMPLES == 0).select("key").collect()]
    # a splitter inside a group that stays whole moves to the front of it
    splitters = sorted({k if k[:32] in overfull else k[:32] for k in picked})
    hot = F.col("digest").isin(list(overfull)) if overfull else F.lit(False)
    d = d.withColumn("key", key).withColumn("hot", hot).withColumn("range", _range_of(F.col("key"), splitters))
    sizes = d.groupBy("range").agg(F.sum("size").alias("bytes")).collect()  # at most one row per splitter and one more
    before, offsets = 0, {}
    for r in sorted(sizes, key=lambda r: r["range"]):
        offsets[r["range"]], before = before, before + r["bytes"]
    starts = F.lit([offsets.get(i, 0) for i in range(len(splitters) + 1)])
    run = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("range", "digest")
    d = d.withColumn("start", F.sum("size").over(run) - F.col("size"))
    middle = F.when(F.col("hot"), F.col("start") + F.col("size") / 2).otherwise(F.min("start").over(group) + F.sum("size").over(group) / 2)
    at = F.element_at(starts, F.col("range") + 1) + middle
    d = d.withColumn("shard", F.least(F.floor(at * shards / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int"))
    # a shard's slots follow the ranges it meets: at most len(splitters) + shards pairs
    met = d.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("rows")).collect()
    filled: dict[int, int] = {}
    first: dict[str, int] = {}
    for r in sorted(met, key=lambda r: (r["shard"], r["range"])):
        first[f"{r['shard']}|{r['range']}"] = filled.get(r["shard"], 0)
        filled[r["shard"]] = filled.get(r["shard"], 0) + r["rows"]
    slots = docs.sparkSession.createDataFrame([(int(k.split("|")[0]), int(k.split("|")[1]), v) for k, v in first.items()], "s int, r int, first long")
    inside = Window.partitionBy("range", "shard").orderBy("key")
    d = d.withColumn("inside", F.row_number().over(inside) - 1)
    d = d.join(F.broadcast(slots), (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r")))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
