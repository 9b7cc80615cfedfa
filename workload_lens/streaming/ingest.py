"""Structured Streaming twins of the batch jobs."""

import hashlib
import json
import threading
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from workload_lens.config import JobConfig
from workload_lens.plans.ingest import ingest_batch
from workload_lens.schemas import METRICS, SOURCE, STATEMENT_ID, WINDOW


# A time behind every window.
END_OF_INPUT = "TIMESTAMP '9000-01-01 00:00:00'"


def hold_until_closed(snapshots: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Let the rows of a window pass together, once the watermark is past its end.

    Use it for sources that deliver a window in several pieces or several times: rows that
    are equal in every column become one, all others stay, and rows of a window that has
    passed already are dropped as late. The state holds the open windows only.
    """
    columns = [*WINDOW, *SOURCE, *STATEMENT_ID, *METRICS]
    held = snapshots.withWatermark("window_end", delay).groupBy(*columns)
    return held.agg(F.count("*").alias("deliveries")).drop("deliveries")


def start_ingest(
    snapshots: DataFrame,
    root: str,
    checkpoint: str,
    config: JobConfig | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Ingest snapshots as they arrive; ``once`` stops when nothing is left to read.

    Statistics of several windows are folded into one write per trigger, which is twice
    the observation interval. The checkpoint folder and the id of the micro-batch name its
    partitions in the store, so a batch that is repeated after a failure replaces itself,
    and those of other streams, or of an earlier checkpoint, stay.
    """
    config = config or JobConfig()
    stream = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch is read several times; its stateful part should run once.
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not batch.isEmpty():
                ingest_batch(batch, root, f"stream-{stream}-{batch_id:012d}", config)
        finally:
            batch.unpersist()

    writer = snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{config.flush_interval} seconds").start()


def start_table(
    rows: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append the closed windows of a stream to a parquet table."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def with_end(rows: DataFrame, folder: str) -> DataFrame:
    """A stream that ``end_input`` can end: its rows and those that come to ``folder``.

    Give it a watermark after this, so that an end moves the watermark of all rows.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(folder)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(folder))


def end_input(
    spark: SparkSession, schema: StructType, folder: str, time: str, start: Callable[[], StreamingQuery]
) -> None:
    """Let a bounded stream that has read all its rows release the windows that are still open.

    One row far behind the last window, without any other value, goes to the folder of
    ``with_end``, and the stream is started once more from its checkpoint. The row moves the
    watermark past every window; its own window never closes, so it reaches no table. What
    comes later than this is late.
    """
    end = spark.range(1).select(
        *[
            (F.expr(f"cast({END_OF_INPUT} as {f.dataType.simpleString()})") if f.name == time else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )
    end.write.mode("append").parquet(folder)
    start().awaitTermination()


def progress(query: StreamingQuery, config: JobConfig) -> dict[str, object]:
    """Status of the last micro-batch; ``overrun`` if it took longer than its trigger."""
    last = query.lastProgress
    if last is None:
        return {"batch_id": None, "rows": 0, "seconds": 0.0, "overrun": False}
    seconds = last["durationMs"].get("triggerExecution", 0) / 1000
    return {
        "batch_id": last["batchId"],
        "rows": last["numInputRows"],
        "seconds": seconds,
        "overrun": seconds > config.flush_interval,
    }


class StatusLines:
    """Writes a line about a running stream at every status interval, and tells which batches took too long.

    A line says how many rows and batches there were since the last one, how long the longest
    batch took, and whether one took longer than its trigger. ``write`` gets each line.
    """

    def __init__(self, query: StreamingQuery, config: JobConfig, write: Callable[[str], None] = print):
        self.query, self.config, self.write = query, config, write
        self.overruns: list[int] = []
        self._seen = -1
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, name="status", daemon=True)

    def __enter__(self) -> "StatusLines":
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        self._thread.join()
        self.line()

    def _run(self) -> None:
        while not self._stop.wait(self.config.status_interval):
            self.line()

    def line(self) -> None:
        fresh = [p for p in self.query.recentProgress if p["batchId"] > self._seen]
        if fresh:
            self._seen = max(p["batchId"] for p in fresh)
        seconds = {p["batchId"]: p["durationMs"].get("triggerExecution", 0) / 1000 for p in fresh}
        late = sorted(b for b, s in seconds.items() if s > self.config.flush_interval)
        self.overruns += late
        status = {
            "batches": len(fresh),
            "rows": sum(p["numInputRows"] for p in fresh),
            "longest_seconds": max(seconds.values(), default=0.0),
            "overruns": late,
            "last_batch": self._seen,
        }
        self.write(json.dumps(status))
