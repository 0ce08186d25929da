"""Connected components by alternating large-star and small-star rounds, as joins and aggregates on written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import drop_scratch, files_freed, scratch_path

#: Edges that a task joins into stars before any shuffle.
LOCAL_EDGES = 1 << 19


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node but the roots: root is the smallest node that these edges reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, LOCAL_EDGES at a time, as stars with the same components."""
    held, count = [], 0

    def out() -> pa.RecordBatch:
        child, root = stars(*(np.concatenate([x[c] for x in held]) for c in (0, 1)))
        return pa.record_batch([pa.array(child, pa.int64()), pa.array(root, pa.int64())], names=["a", "b"])

    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        count += batch.num_rows
        if count >= LOCAL_EDGES:
            yield out()
            held, count = [], 0
    if count:
        yield out()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a > b) are stars: no node has two smaller neighbours, or both a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1 AND down > 0").limit(1).count()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that is reachable.

    Edges are first joined into stars, LOCAL_EDGES of them in a task. If there was more than one task, each round sends every node's larger neighbours to its smallest
    one, then its smaller ones, until the edges are stars. Only minima are aggregated, and neighbours meet them in joins,
    so a node with very many neighbours is never gathered into one row. Self-loops and repeated edges are ignored; no
    edges give no rows.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "edges")
        with files_freed(spark):
            df.write.parquet(path)
        return spark.read.schema("a long, b long").parquet(path), path

    def contracted(df: DataFrame) -> tuple[DataFrame, str, bool]:
        """Stars made task by task, and whether one task has seen all edges."""
        whole, whole_path = written(df.where("a <> b"))
        tasks = 1 + whole.count() // LOCAL_EDGES
        out = written(whole.coalesce(tasks).mapInArrow(_contract, "a long, b long"))
        drop_scratch(spark, whole_path)
        return *out, tasks == 1

    # a > b throughout
    now, path, done = contracted(edges.select("a", "b"))
    for _ in range(max_rounds):
        if done or _settled(now):
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        middle, middle_path = written(large.where("a <> b").distinct())
        least = middle.groupBy("a").agg(F.min("b").alias("m"))
        small = middle.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after, after_path, done = contracted(small.distinct())
        drop_scratch(spark, middle_path, path)
        now, path = after, after_path
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
