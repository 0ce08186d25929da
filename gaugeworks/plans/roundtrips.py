"""Queries that write through a sink to the shared folder and return what a scan reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import binning
from gaugeworks.plans.registry import query
from gaugeworks.plans.statistics import SCORES, _scores_once
from gaugeworks.sources import readers, sinks
from gaugeworks.sources.fixtures import table
from gaugeworks.sources.schemas import SCHEMAS

_ROWS = "SELECT o_orderkey AS id, o_orderpriority AS priority, CAST(o_totalprice AS DOUBLE) AS price FROM orders"
_SCHEMA = "id bigint, priority string, price double"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("double").alias("price"))


@query("published_roundtrip", _ROWS, fixtures=False)
def published_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that replaces another under one name."""
    rows, path = _rows(spark, sf_dir), sinks.shared_scratch(spark, "published")
    sinks.published(rows.limit(1), path)  # the version that goes
    sinks.published(rows, path)
    return spark.read.parquet(path)


@query("jsonl_roundtrip", _ROWS, fixtures=False)
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.shared_scratch(spark, "jsonl")
    sinks.jsonl(_rows(spark, sf_dir), path)
    return readers.strict_jsonl(spark, path, _SCHEMA)


@query("csv_roundtrip", _ROWS, fixtures=False)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sinks.shared_scratch(spark, "csv")
    sinks.csv(_rows(spark, sf_dir), path, ["id", "priority", "price"])
    return spark.read.schema(_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)


@query("tolerant_lines", _ROWS + " WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0", fixtures=False)
def tolerant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which some are broken and some blank, and a file that isn't there."""
    path = sinks.shared_scratch(spark, "lines")
    line = F.when(F.col("id") % 11 == 0, F.concat(F.lit('{"id": '), F.col("id").cast("string"))).when(F.col("id") % 13 == 0, "").otherwise(F.to_json(F.struct("id", "priority", "price")))
    _rows(spark, sf_dir).select(line.alias("value")).write.text(path)
    return readers.tolerant_jsonl(spark, [f"{path}/part-*", f"{path}/missing.jsonl"], _SCHEMA)


@query("last_row_wins", "SELECT id, priority, CASE WHEN id % 3 = 0 THEN price + 1 ELSE price END AS price FROM (" + _ROWS + ")", fixtures=False)
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files' rows by key: every third key comes again in the second."""
    rows, path = _rows(spark, sf_dir), sinks.shared_scratch(spark, "keyed")
    sinks.jsonl(rows, f"{path}/1")
    sinks.jsonl(rows.where("id % 3 = 0").withColumn("price", F.col("price") + 1), f"{path}/2")
    return readers.keyed_jsonl(spark, f"{path}/*", _SCHEMA)


@query("append_and_resume", _ROWS, fixtures=False)
def append_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append that was broken off half way, and run again twice."""
    rows, path = _rows(spark, sf_dir), sinks.shared_scratch(spark, "append")
    for part in (rows.where("id % 2 = 0"), rows, rows):
        sinks.append_new(part, path)
    return spark.read.parquet(path)


@query("score_shards", SCORES + "SELECT * FROM scores")
def score_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as modulo shards and read back by patterns, one of which names a shard twice."""
    scores, path = _scores_once(spark, sf_dir), sinks.shared_scratch(spark, "shards")
    for i in range(3):
        shard = binning.modulo_shard(scores, i, 3)
        sinks.create_only(shard.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], SCHEMAS["score_shard"]).schema if f.name in shard.columns]), f"{path}/shard-{i}.parquet")
    return readers.score_shards(spark, [f"{path}/shard-*.parquet", f"{path}/shard-0.parquet"]).select(*scores.columns)


@query("document_roundtrip", "SELECT r_regionkey AS regionkey, r_name AS name FROM region", fixtures=False)
def document_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of one list, written durably twice. region is a dimension of a fixed size."""
    path = sinks.shared_scratch(spark, "document")
    rows = [{"regionkey": r.r_regionkey, "name": r.r_name} for r in table(spark, sf_dir, "region").collect()]
    for part in (rows[:1], rows):
        sinks.durable_json({"regions": part}, spark, path)
    return readers.json_document(spark, path, "regions array<struct<regionkey:int,name:string>>").select(F.inline("regions"))


@query("marked_folders", "SELECT r_name AS cell FROM region WHERE r_regionkey <> 2", fixtures=False)
def marked_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that hold a marker."""
    path = sinks.shared_scratch(spark, "cells")
    for r in table(spark, sf_dir, "region").collect():
        sinks.durable_json({"complete": True}, spark, f"{path}/a/{r.r_name}/{'COMPLETE' if r.r_regionkey != 2 else 'STARTED'}.json")
    return readers.markers(spark, path, "COMPLETE.json").select(F.regexp_extract("folder", "([^/]+)$", 1).alias("cell"))
