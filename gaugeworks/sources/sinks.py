"""Sinks: create-only tables, resumable appends, receipts, CSV, Markdown and LaTeX reports."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import gates


def create_only(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Refuses an existing target; readers see a committed table or none (the committer renames at the end)."""
    df.write.mode("errorifexists").format(kind).save(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and a function that makes its paths."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to


def published(df: DataFrame, path: str) -> None:
    """Writes beside the target, then swaps folders: the old table stays, under its name or under .old, until the new one has
    the name. If a run ended between the two renames, `recovered` (called here first) brings the old table back."""
    fs, to = _file_system(df.sparkSession, path)
    recovered(df.sparkSession, path)
    old = to(f"{path}.old")
    df.write.mode("overwrite").parquet(f"{path}.next")
    if fs.exists(to(path)) and not fs.rename(to(path), old):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(to(f"{path}.next"), to(path)):
        recovered(df.sparkSession, path)
        raise OSError(f"{path} could not be published")
    fs.delete(old, True)


def recovered(spark: SparkSession, path: str) -> None:
    """Undoes or ends a swap that was broken off: without a target the old table comes back, else it goes."""
    fs, to = _file_system(spark, path)
    if fs.exists(to(f"{path}.old")):
        fs.delete(to(f"{path}.old"), True) if fs.exists(to(path)) else fs.rename(to(f"{path}.old"), to(path))


def shared_scratch(spark: SparkSession, label: str = "scratch") -> str:
    """A new path in the folder that spark.checkpoint.dir names; only a local session may do without that setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='gaugeworks-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back, for what is read more than once."""
    shared_scratch(df.sparkSession)
    return df.checkpoint()


def durable_json(document: object, spark: SparkSession, path: str) -> None:
    """A JSON document (sorted keys, indented) that is written beside its target, synced and renamed over it."""
    fs, to = _file_system(spark, path)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(to(path)).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(to(f"{path}.next"), True)
    try:
        out.write(bytearray((json.dumps(document, indent=2, sort_keys=True) + "\n").encode()))
        out.hsync()
    finally:
        out.close()
    option = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    option[0] = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(to(f"{path}.next"), to(path), option)


def frozen_manifest(spark: SparkSession, path: str, stated: dict) -> dict:
    """A manifest as first written: made read-only if it isn't there, read if it is and refused if it states anything else."""
    fs, to = _file_system(spark, path)
    if not fs.exists(to(path)):
        durable_json(stated, spark, path)
        fs.setPermission(to(path), spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("0444"))
        return stated
    there = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if different := sorted(k for k in {*there, *stated} if there.get(k) != stated.get(k)):
        raise ValueError(f"the manifest {path} states other values of {different}")
    return there


def append_new(rows: DataFrame, path: str, key: str = "id") -> None:
    """Appends rows whose key the table doesn't hold yet: running it again adds nothing."""
    spark = rows.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows.dropDuplicates([key]).write.mode("append").parquet(path)


def receipts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, sha256 and bytes of files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_receipts(spark: SparkSession, stated: DataFrame, path: str) -> None:
    gates.require_empty(gates.receipts_match(stated, receipts(spark, path)))


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str, columns: list[str], byte_order_mark: bool = False) -> None:
    """Create-only CSV with a header; with a byte order mark each file begins with U+FEFF, which spreadsheets ask for."""
    named = [F.col(c).alias(f"\ufeff{c}" if byte_order_mark and not i else c) for i, c in enumerate(columns)]
    df.select(*named).write.mode("errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A table of a small report (its limit is the feature), numbers with a sign and four places."""
    rows = df.limit(limit).collect()
    text = lambda v: "" if v is None else f"{v:+.4f}" if isinstance(v, float) else str(v)
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns), *(" | ".join(map(text, r)) for r in rows)]
    return "\n".join(f"| {x} |" for x in lines) + "\n"


def latex(df: DataFrame, limit: int = 1000) -> str:
    """Rows of a LaTeX table of percentages; pending values are XX.X."""
    text = lambda v: "XX.X" if v is None else f"{100 * v:.1f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    return "".join(" & ".join(map(text, r)) + " \\\\\n" for r in df.limit(limit).collect())
