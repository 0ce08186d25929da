"""A queue of cells that are scored when their marker file appears, one-shot streams, and the status document."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.sources.sinks import _file_system, durable_json
from gaugeworks.streaming.scoring import Progress, run_available

#: What a queue writes of each cell.
OUTCOME = "cell string, ok boolean, error string"


def marked_cells(spark: SparkSession, root: str, marker: str, at_once: int = 64) -> DataFrame:
    """cell: the folder of each marker file below root, as the files appear."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    files = files.option("pathGlobFilter", marker).option("recursiveFileLookup", True).option("maxFilesPerTrigger", at_once).load(root)
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("cell"))


def run_queue(spark: SparkSession, root: str, score: Callable[[SparkSession, str], None], outcomes: str, checkpoint: str, *, marker: str = "COMPLETE.json", finished: str = "INFERENCE_FINISHED.json", poll: float = 5.0, wait: float = float("inf")) -> DataFrame:
    """Scores every marked cell once and returns the outcomes; ends when root holds the `finished` file and nothing is left.

    The checkpoint remembers what was queued, so another run goes on where this one stopped. A cell that fails is recorded
    and stops no other. A batch's outcomes replace those of its own earlier attempt. `wait` bounds the seconds without work."""
    fs, to = _file_system(spark, root)
    handled = [0]

    def batch(cells: DataFrame, number: int) -> None:
        rows = []
        for r in cells.dropDuplicates(["cell"]).orderBy("cell").collect():  # at most as many as files of one trigger
            try:
                score(spark, r.cell)
                rows.append((r.cell, True, None))
            except Exception as error:  # noqa: BLE001  a cell's failure is an outcome
                rows.append((r.cell, False, f"{type(error).__name__}: {error}"[:500]))
        spark.createDataFrame(rows, OUTCOME).coalesce(1).write.mode("overwrite").parquet(f"{outcomes}/batch={number}")
        handled[0] += len(rows)

    idle = time.monotonic()
    while True:
        over, before = fs.exists(to(f"{root}/{finished}")), handled[0]
        stream = marked_cells(spark, root, marker).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()
        if handled[0] > before:
            idle = time.monotonic()
        elif over or time.monotonic() - idle > wait:
            break
        else:
            time.sleep(poll)
    if not fs.exists(to(outcomes)):
        return spark.createDataFrame([], OUTCOME)
    return spark.read.schema(OUTCOME).parquet(outcomes).select("cell", "ok", "error")


def one_shot(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A formal run that happens once: an existing checkpoint or target is refused, so nothing can be restarted into it."""
    spark = stream.sparkSession
    for place in (checkpoint, path):
        fs, to = _file_system(spark, place)
        if fs.exists(to(place)):
            raise FileExistsError(f"{place} exists; a one-shot run can't be restarted")
    return run_available(stream, path, checkpoint)


def heartbeat(progress: Progress, spark: SparkSession, path: str) -> dict:
    """Writes the listener's counts and the time as a status document."""
    document = dict(progress.status) | {"utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    durable_json(document, spark, path)
    return document
