"""Scans: JSON lines in three tolerances, JSON documents, partitioned cells, shards, metadata, synthetic items."""

from __future__ import annotations

import ast
import random
from collections.abc import Iterable
from fractions import Fraction
from operator import add, mul, sub, truediv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.sources.schemas import SCHEMAS


def existing(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """Paths that patterns and literal paths name, each once, sorted; through Hadoop's file system, so any store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: set[str] = set()
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found.update(s.getPath().toString() for s in path.getFileSystem(conf).globStatus(path) or [])
    return sorted(found)


def tolerant_jsonl(spark: SparkSession, paths: Iterable[str], schema: str) -> DataFrame:
    """Missing files, blank lines and malformed lines are skipped."""
    there = existing(spark, paths)
    if not there:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(there)


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A malformed line is an error; blank lines and a byte-order mark are not."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def keyed_jsonl(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """The last row of each key, by file and place."""
    rows = strict_jsonl(spark, path, schema).withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    rank = Window.partitionBy(key).orderBy(F.desc("_file"), F.desc("_block"), F.desc("_at"))
    return rows.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_file", "_block", "_at", "_rank")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def cell_responses(spark: SparkSession, root: str) -> DataFrame:
    """root/seed/trained/request/responses.jsonl with the three parts of the path as columns."""
    rows = spark.read.schema(SCHEMAS["responses"]).option("mode", "FAILFAST").json(f"{root}/*/*/*/responses.jsonl")
    part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/([^/]+)/([^/]+)/responses\.jsonl$", i)
    return rows.select(part(1).alias("seed"), part(2).alias("trained"), part(3).alias("request"), "*")


def exploded(responses: DataFrame) -> DataFrame:
    """One row per response with its sample number, finish reason and tokens."""
    keep = [c for c in responses.columns if c not in ("responses", "finish_reasons", "output_token_counts")]
    zipped = F.posexplode(F.arrays_zip("responses", "finish_reasons", "output_token_counts")).alias("sample", "r")
    return responses.select(*keep, zipped).select(*keep, "sample", F.col("r.responses").alias("response"), F.col("r.finish_reasons").alias("finish_reason"), F.col("r.output_token_counts").alias("output_tokens"))


def markers(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Folders below root/*/* that hold a marker file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", r"/[^/]+$", "").alias("folder"), "modificationTime")


def score_shards(spark: SparkSession, patterns: Iterable[str]) -> DataFrame:
    found = existing(spark, patterns)
    if not found:
        raise FileNotFoundError("no score shards match")
    return spark.read.schema(SCHEMAS["score_shard"]).parquet(*found)


def one_revision(spark: SparkSession, root: str) -> str:
    """The first line of every *.metadata file below root, which must be one value."""
    lines = spark.read.option("wholetext", True).option("pathGlobFilter", "*.metadata").option("recursiveFileLookup", True).text(root)
    values = lines.select(F.trim(F.substring_index("value", "\n", 1)).alias("v")).distinct().limit(2).collect()
    if len(values) != 1:
        raise ValueError(f"{len(values)} revisions")
    return values[0]["v"]


def exact_value(expression: str) -> Fraction:
    """Value of an expression of numbers and + - * / in exact fractions; anything else is an error."""
    binary = {ast.Add: add, ast.Sub: sub, ast.Mult: mul, ast.Div: truediv}

    def value(node: ast.AST) -> Fraction:
        match node:
            case ast.Constant(value=int() as n) if not isinstance(n, bool):
                return Fraction(n)
            case ast.UnaryOp(op=ast.USub(), operand=inner):
                return -value(inner)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in binary:
                return binary[type(op)](value(a), value(b))
        raise ValueError("not plain arithmetic")

    return value(ast.parse(expression, mode="eval").body)


def exact_rows(spark: SparkSession, path: str, schema: str, n: int, key: str = "id") -> DataFrame:
    """A JSONL file of exactly n rows whose keys are 0 to n - 1 in order, else an error; empty lines and a byte order mark
    are passed over. n is the size of an evaluation set, so one task may number its lines."""
    lines = spark.read.text(path, wholetext=False).withColumn("at", F.monotonically_increasing_id())
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    if (found := lines.count()) != n:
        raise ValueError(f"{path} has {found} rows instead of {n}")
    rows = lines.withColumn("place", F.row_number().over(Window.orderBy("at")) - 1).withColumn("row", F.from_json("value", schema, {"mode": "FAILFAST"}))
    wrong = rows.where(~F.coalesce(F.get_json_object("value", f"$.{key}") == F.col("place").cast("string"), F.lit(False)))
    if first := wrong.orderBy("place").select("place").first():
        raise ValueError(f"{path}: row {first.place} has another {key}")
    return rows.select("row.*")


class _Steps:
    """A chain of whole-number steps. The ranges, the sign lists and the order of draws (first number, then for
    each step its sign and its operand), on which the items of a seed depend."""

    FIRST, OPERAND, DIVISORS, FURTHEST = (2, 40), (2, 20), range(2, 13), 10_000

    def __init__(self, rng: random.Random, length: int):
        self.value = rng.randint(*self.FIRST)
        self.text, self.signs = str(self.value), []
        for _ in range(length):
            self._extend(rng)

    def _extend(self, rng: random.Random) -> None:
        exact = [] if self.value == 0 else [d for d in self.DIVISORS if not self.value % d]
        sign = rng.choice("+-*/" if exact else "+-*")
        operand = rng.choice(exact) if sign == "/" else rng.randint(*self.OPERAND)
        self.text = f"({self.text} {sign} {operand})"
        self.value = int(exact_value(f"{self.value} {sign} {operand}"))
        self.signs.append(sign)

    def usable(self, taken: set[str]) -> bool:
        return abs(self.value) <= self.FURTHEST and self.text not in taken


def arithmetic_items(spark: SparkSession, seed: int = 20260908, sizes: tuple[tuple[str, int], ...] = (("dev", 32), ("test", 500))) -> DataFrame:
    """Seeded items of two to four steps with unique expressions; a few hundred rows made on the driver. Each answer is the
    exact value of the whole expression."""
    rng, taken, rows = random.Random(seed), set(), []
    for split, index in ((name, i) for name, count in sizes for i in range(count)):
        chain = next(c for c in iter(lambda n=2 + index % 3: _Steps(rng, n), None) if c.usable(taken))
        taken.add(chain.text)
        answer = str(exact_value(chain.text))
        rows.append((index, f"Calculate the exact value of {chain.text}.", answer, (split, seed, len(chain.signs), chain.text, chain.signs)))
    return spark.createDataFrame(rows, SCHEMAS["arithmetic_items"])
