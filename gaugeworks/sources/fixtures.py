"""Items and samples derived from the TPC-H-like tables: the shapes of saved model responses at any scale."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FAR = " and so on" * 40
#: Responses; <a> is the item's answer, <w> a wrong one.
SHAPES = (
    "We get #### <a>",
    "We get \\boxed{<a>}",
    "so the total is <a>.",
    "#### <w> and then #### <a>",
    "#### $<a> dollars\n\\boxed{<a>}",
    "\\boxed{\\frac{<a>}{1}}",
    "\\boxed{<a>",
    "##### <a>",
    'Output the final answer after "####".',
    "####\n<a>",
    "#### <w>",
    "first \\boxed{} then \\boxed{<a>}",
    "spaced \\boxed { <a> }",
    "\\boxed{<a>\\} is not closed",
    "#### <a>" + _FAR + " \\boxed{<w>}" + _FAR,
    "#### **`<a>`** or \\boxed{$\\}",
    "#### nan\r\n\\boxed{{<a>}<w>}",
    "no digits here",
)


#: The twelve shapes that the golden figures of the survey are stated for.
TWELVE = (*SHAPES[:11], SHAPES[-1])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, answer, ground_truth."""
    answer = (F.floor("o_totalprice") % 10000).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), answer.alias("answer"), F.concat(F.lit("#### "), answer.cast("string")).alias("ground_truth"))


def _parts(shape: str) -> list[str]:
    return [x for x in re.split("(<[aw]>)", shape) if x]


def _filled(shape: str) -> Column:
    names = {"<a>": F.col("answer").cast("string"), "<w>": (F.col("answer") + 1).cast("string")}
    return F.concat(*[names.get(x, F.lit(x)) for x in _parts(shape)])


def scored(spark: SparkSession, sf_dir: str, shapes: tuple[str, ...] = SHAPES) -> DataFrame:
    """id, sample, training, request, finish_reason, seed, output_tokens, supplier, response, answer, ground_truth: samples
    with their item's gold answer, in one join. Catalyst picks it: items grow with the input."""
    # scoring costs far more than reading, so lines are dealt by item over all cores, however few row groups their file has;
    # sample numbers, per-item counts and a shuffled join all use this partitioning
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    line = table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey")
    line = line.join(items(spark, sf_dir), F.col("l_orderkey") == F.col("id"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    which, response = F.col("l_partkey") % len(shapes), F.lit(None).cast("string")
    for i, shape in reversed(list(enumerate(shapes))):
        response = F.when(which == i, _filled(shape)).otherwise(response)
    return line.select(
        "id",
        (F.row_number().over(order) - 1).cast("long").alias("sample"),
        F.when(F.col("l_linestatus") == "O", "hash").otherwise("boxed").alias("training"),
        F.when(F.col("l_suppkey") % 2 == 0, "hash").otherwise("boxed").alias("request"),
        F.when(F.col("l_returnflag") == "R", "length").otherwise("stop").alias("finish_reason"),
        F.year("l_shipdate").alias("seed"),
        F.col("l_quantity").cast("long").alias("output_tokens"),
        F.col("l_suppkey").alias("supplier"),
        response.alias("response"),
        "answer",
        "ground_truth",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the gold answer."""
    return scored(spark, sf_dir).drop("answer", "ground_truth")


def _sql_filled(shape: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''").replace("\\", "' || chr(92) || '").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(x[1] if x in ("<a>", "<w>") else quoted(x) for x in _parts(shape))


ITEMS_SQL = """items AS (SELECT o_orderkey AS id, CAST(CAST(floor(o_totalprice) AS BIGINT) % 10000 AS BIGINT) AS answer,
 '#### ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 10000 AS VARCHAR) AS ground_truth FROM orders)"""
SAMPLES_SQL = f"""samples AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS sample,
 CASE WHEN l_linestatus = 'O' THEN 'hash' ELSE 'boxed' END AS training, CASE WHEN l_suppkey % 2 = 0 THEN 'hash' ELSE 'boxed' END AS request,
 CASE WHEN l_returnflag = 'R' THEN 'length' ELSE 'stop' END AS finish_reason, CAST(year(l_shipdate) AS INTEGER) AS seed, CAST(l_quantity AS BIGINT) AS output_tokens, l_suppkey AS supplier,
 CASE l_partkey % {len(SHAPES)} {" ".join(f"WHEN {i} THEN {_sql_filled(s)}" for i, s in enumerate(SHAPES))} END AS response
 FROM (SELECT l.*, CAST(i.answer AS VARCHAR) AS a, CAST(i.answer + 1 AS VARCHAR) AS w FROM lineitem l JOIN items i ON l.l_orderkey = i.id) t)"""
SCORED_SQL = "scored AS (SELECT s.*, i.answer, i.ground_truth FROM samples s JOIN items i ON s.id = i.id)"
