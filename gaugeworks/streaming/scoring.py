"""Streams: scoring of arriving responses, exactly-once appends, ledgers, the online sampler, windowed events."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.functions import readers
from gaugeworks.sources.schemas import SCHEMAS


def response_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Response files (Parquet with items' gold answers) as they arrive."""
    return spark.readStream.schema("id bigint, sample bigint, response string, ground_truth string, ts timestamp").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(responses: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each (id, sample) once within the watermark, scored."""
    once = responses.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id", "sample"])
    r, g = F.col("response"), F.col("ground_truth")
    return once.select("id", "sample", "ts", readers.strict(r, g).alias("strict"), readers.lenient(r, g).alias("lenient"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, to Parquet; the checkpoint makes each file count once over restarts."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ledger_stream(events: DataFrame, by: str = "run") -> DataFrame:
    """Running totals per run, for update mode."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need instants; files may hold local times."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and type; rows later than the watermark are dropped (an extension)."""
    return _timed(events).withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").count()


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "2 hours") -> DataFrame:
    return _timed(events).withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").count()


class Moments(StatefulProcessor):
    """Second-moment estimates per run and stratum: m <- decay * m + (1 - decay) * max(mean of item means, floor)."""

    def __init__(self, decay: float = 0.9, floor: float = 1e-6, start: float = 1.0) -> None:
        self.decay, self.floor, self.start = decay, floor, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moment = handle.getValueState("moment", "m double, steps bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = pd.concat(list(rows))
        m, steps = self.moment.get() if self.moment.exists() else (self.start, 0)
        observed = max(float(seen.groupby("item")["proxy"].mean().mean()), self.floor)
        m, steps = self.decay * m + (1 - self.decay) * observed, steps + 1
        self.moment.update((m, steps))
        yield pd.DataFrame({"run": [key[0]], "stratum": [key[1]], "second_moment": [m], "steps": [steps]})

    def close(self) -> None:
        pass


def moment_stream(batches: DataFrame, decay: float = 0.9, floor: float = 1e-6, start: float = 1.0) -> DataFrame:
    """Updates per micro-batch of (run, stratum, item, proxy). Needs the RocksDB state store."""
    return batches.groupBy("run", "stratum").transformWithStateInPandas(Moments(decay, floor, start), "run string, stratum bigint, second_moment double, steps bigint", "Update", "None")


class Progress(StreamingQueryListener):
    """Counts of started, running, failed and finished queries, and rows seen: the status document of a queue."""

    def __init__(self) -> None:
        self.status = {"started": 0, "rows": 0, "failed": 0, "finished": 0}

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        self.status["started"] += 1

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        self.status["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        self.status["failed" if event.exception else "finished"] += 1


__all__ = ["SCHEMAS", "Moments", "Progress", "ledger_stream", "moment_stream", "response_stream", "run_available", "score_stream", "sessions", "windowed_counts"]
