"""URL filters: host-suffix and path-prefix expressions matched to rules by hash prefix, then by full digest.

A rule (action, host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's path. Of the rules that fit, the longest (host and path together) wins; of equally long ones `allow` wins.

Defined cases: a null URL and one without `://` have an empty host and path and fit no rule; repeated rows each get
their own result row; extra columns of the input are left out; an empty table gives an empty result; an empty rule set
leaves every verdict to the default. Hosts keep ports and user names as they are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule sets of up to this many rows (some 20 MB) are broadcast; larger ones are joined by a shuffle on the hash prefix.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.action, r.host, r.path) for r in rules]
    return spark.createDataFrame(rows, "action string, host string, path string")


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every host suffix with as many labels, and every path prefix of as many characters, as some rule has."""
    parts = F.split(host, r"\.", -1)
    hosts = [F.when((F.size(parts) >= n) & (host != ""), F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")) for n in labels]
    paths = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_compact(F.array(*[h_p for h in hosts for h_p in (F.concat(h, p) for p in paths)]))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (its text, null where none fits) and verdict."""
    shapes = rules.select(F.size(F.split("host", r"\.", -1)).alias("n"), F.length("path").alias("m")).distinct()
    # Both are counts of labels and characters of a host name and a path: a few dozen values however many rules there are.
    found = shapes.agg(F.collect_set("n").alias("n"), F.collect_set("m").alias("m")).first()
    key = [F.col(id_col).alias("id"), F.col(url_col).alias("url")]
    rows = pages.select(*key).groupBy("id", "url").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if found["n"]:
        size = rules.count()
        digests = rules.select(
            F.sha2(F.concat("host", "path"), 256).alias("digest"),
            F.struct(F.length(F.concat("host", "path")).alias("len"), (F.col("action") == "allow").alias("allow"), F.concat("host", "path").alias("rule"), F.col("action").alias("action")).alias("fit"),
        ).withColumn("prefix", F.left("digest", F.lit(PREFIX_HEX)))
        digests = digests.groupBy("prefix", "digest").agg(F.max("fit").alias("fit"))
        asked = rows.withColumn("expr", F.explode_outer(_expressions(F.col("host"), F.col("path"), sorted(found["n"]), sorted(found["m"]))))
        asked = asked.withColumn("asked", F.sha2("expr", 256)).withColumn("prefix", F.left("asked", F.lit(PREFIX_HEX))).drop("expr")
        hit = asked.join(F.broadcast(digests) if size <= BROADCAST_RULES else digests, "prefix", "left")
        best = F.max(F.when(F.col("digest") == F.col("asked"), F.col("fit"))).alias("fit")  # the full digest confirms
        rows = hit.groupBy("id", "url", "copies", "host", "path").agg(best)
    else:
        rows = rows.withColumn("fit", F.lit(None).cast("struct<len:int,allow:boolean,rule:string,action:string>"))
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", F.lit(default)).alias("verdict"))
