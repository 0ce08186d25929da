from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import readers
from gaugeworks.sources.fixtures import scored
from gaugeworks.streaming import queue, scoring


def test_stream_equals_batch(spark, data, tmp_path):
    batch = scored(spark, data).select("id", "sample", "response", "ground_truth", F.lit(datetime(2026, 1, 1)).alias("ts"))
    source = str(tmp_path / "in")
    batch.repartition(4).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        scoring.run_available(scoring.score_stream(scoring.response_stream(spark, source, 2)), str(tmp_path / "out"), str(tmp_path / "state"))
    batch.limit(10).write.mode("append").parquet(source)  # repeats are dropped
    scoring.run_available(scoring.score_stream(scoring.response_stream(spark, source, 2)), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = batch.select(F.count_if(readers.strict(F.col("response"), F.col("ground_truth"))), F.count_if(readers.lenient(F.col("response"), F.col("ground_truth"))), F.count(F.lit(1))).first()
    assert tuple(got.select(F.count_if("strict"), F.count_if("lenient"), F.count(F.lit(1))).first()) == tuple(want)


def test_windows_and_sessions(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = scoring.windowed_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hours").agg(F.sum("count")).first()[0] == events.count()
    assert scoring.sessions(events).agg(F.sum("count")).first()[0] == events.count()
    assert scoring.ledger_stream(events.select(F.lit("r").alias("run"), F.col("event_id").alias("tokens"), F.col("value").alias("seconds"))).first()["rows"] == events.count()


def test_online_moments(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "run string, stratum bigint, item bigint, proxy double"
        for rows in ([("r", 0, 1, 2.0), ("r", 0, 1, 4.0), ("r", 0, 2, 1.0)], [("r", 0, 1, 0.0)]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = scoring.moment_stream(stream, 0.5, 1.0, 1.0).writeStream.format("memory").queryName("moments").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = [(r.second_moment, r.steps) for r in spark.table("moments").orderBy("steps").collect()]
        assert got == [(pytest.approx(1.5), 1), (pytest.approx(1.25), 2)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_queue_scores_marked_cells_once(spark, tmp_path):
    root = tmp_path / "cells"
    for name in "abc":
        (root / name).mkdir(parents=True)
    (root / "d").mkdir()  # never marked
    for name in "ab":
        (root / name / "COMPLETE.json").write_text("{}")
    seen = []

    def score(session, cell):
        seen.append(cell.rpartition("/")[2])
        if cell.endswith("b"):
            raise ValueError("no rows")
        if cell.endswith("a"):  # arrives while the queue runs
            (root / "c" / "COMPLETE.json").write_text("{}")
            (root / "INFERENCE_FINISHED.json").write_text("{}")

    run = lambda: queue.run_queue(spark, str(root), score, str(tmp_path / "out"), str(tmp_path / "state"), poll=0.1, wait=60)
    got = {r.cell.rpartition("/")[2]: (r.ok, r.error) for r in run().collect()}
    assert got == {"a": (True, None), "b": (False, "ValueError: no rows"), "c": (True, None)} and sorted(seen) == ["a", "b", "c"]
    assert run().count() == 3 and len(seen) == 3  # a restart queues nothing again


def test_one_shot_refuses_a_restart(spark, data, tmp_path):
    scored(spark, data).limit(20).select("id", "sample", "response", "ground_truth", F.lit(datetime(2026, 1, 1)).alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = lambda: scoring.score_stream(scoring.response_stream(spark, str(tmp_path / "in")))
    queue.one_shot(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    for out, state in (("out", "state"), ("new", "state"), ("out", "new")):
        with pytest.raises(FileExistsError):
            queue.one_shot(stream(), str(tmp_path / out), str(tmp_path / state))
    progress = scoring.Progress()
    progress.status["rows"] = 7
    queue.heartbeat(progress, spark, str(tmp_path / "status.json"))
    assert json.loads((tmp_path / "status.json").read_text())["rows"] == 7
