"""Shared helpers: the folder that all executors see, stored tables, and words."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests), a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_MADE: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/gaugeworks/{label}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextlib.contextmanager
def scratch_freed(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end all scratch made within it, but for paths that its caller takes out of the list."""
    _MADE.append(made := [])
    try:
        yield made
    finally:
        del _MADE[next(i for i, x in enumerate(_MADE) if x is made)]
        drop_scratch(spark, *made)


@contextlib.contextmanager
def files_freed(spark: SparkSession) -> Iterator[None]:
    """For writes, which nobody repeats: within it, Spark deletes a query's shuffle files as soon as the query ends, and
    Arrow batches are small, since a worker and its executor each hold several."""
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and no executor's loss undoes it.
    Also the path, for drop_scratch once nothing reads it any more."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with files_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same, for tables that a result reads until the end; `scratch_freed` can delete these."""
    return stored_at(df, label)[0]


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders through Hadoop's file system, so any store works."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def word_count(text: Column) -> Column:
    """Number of words (null text: 0), inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
