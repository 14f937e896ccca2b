"""Streaming jobs: event stream to running daily counts and to a session list."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from liftloom.config import SessionSettings
from liftloom.operators.conversion import alike, leaf_counts, steps
from liftloom.operators.counts import with_event_totals
from liftloom.session import dropped_after, shared_folder, written
from liftloom.sources import fixtures
from liftloom.sources.counts_store import read_increments, refresh, write_increment
from liftloom.streaming.panes import REFRESH, ended_rows, ended_sessions, gate, rows_of


def _start(rows: DataFrame, write, checkpoint: str, drain: bool) -> StreamingQuery:
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=REFRESH)
    return writer.start()


def start_counts(events: DataFrame, settings: SessionSettings, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep increments of the daily counts under ``path``; :func:`read_increments` sums them to running totals.

    A session that ends late simply adds to its day in a later increment.
    """

    def write(ended: DataFrame, batch_id: int) -> None:
        # the state is read once, and its sessions are scanned where it lies; a micro-batch in which no session ends leaves no increment,
        # and none leaves anything else. A stream runs without adaptive execution, so what follows is left to the session that started it
        with dropped_after(events.sparkSession):
            prepared = written(alike(steps(rows_of(ended, settings), int(settings.local_hint_ms))), "steps", by=events.sparkSession)
            if prepared.isEmpty():
                return
            write_increment(with_event_totals(leaf_counts(prepared, settings, stored=True)), path, batch_id)

    return _start(ended_rows(events, settings), write, checkpoint, drain)


def start_sessions(events: DataFrame, settings: SessionSettings, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep one row per ended session under ``path``."""

    def write(ended: DataFrame, batch_id: int) -> None:
        ended.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(ended_sessions(events, settings), write, checkpoint, drain)


def compact(spark: SparkSession, increments: str, store: str, mark_ms: int | None = None) -> None:
    """Add the increments that are new to the running totals in the day folders; see :func:`refresh`."""
    refresh(spark, increments, store, mark_ms)


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The test table as a stream, and one event long after it, which lets all its sessions end."""
    last = f"{shared_folder(spark)}/last-{uuid.uuid4().hex}"
    closing = [c.cast(f.dataType).alias(f.name) for f, c in ((f, F.lit(_CLOSING.get(f.name))) for f in fixtures.EVENTS_TABLE)]
    spark.range(1).select(*closing).write.parquet(last)
    table = spark.readStream.schema(fixtures.EVENTS_TABLE).option("pathGlobFilter", "events.parquet").parquet(folder)
    return fixtures.canonical(table.union(spark.readStream.schema(fixtures.EVENTS_TABLE).parquet(last)))


# user -1 is of a project of its own, and its session never ends
_CLOSING = {"event_id": -1, "ts": "2100-01-01 00:00:00", "user_id": -1, "event_type": "view", "value": 0.0, "props": "{}"}
_CLOSING_PROJECT = "p-1"


def _fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def drained_sessions(spark: SparkSession, folder: str, settings: SessionSettings) -> DataFrame:
    """Run the test table through the session stream."""
    out, checkpoint = _fresh(spark, "sessions")
    start_sessions(_event_stream(spark, folder), settings, out, checkpoint, drain=True).awaitTermination()
    ended = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*").drop("batch_id").withColumnRenamed("session_start", "start_ms")
    return ended.where(F.col("project_id") != _CLOSING_PROJECT)


def drained_counts(spark: SparkSession, folder: str, settings: SessionSettings) -> DataFrame:
    """Run the test table through the counting stream."""
    out, checkpoint = _fresh(spark, "counts")
    start_counts(_event_stream(spark, folder), settings, out, checkpoint, drain=True).awaitTermination()
    return read_increments(spark, out).where(F.col("project_id") != _CLOSING_PROJECT)


def drained_gate(spark: SparkSession, folder: str, settings: SessionSettings, held_back: str) -> DataFrame:
    """Run the test table through the gate, the rows of ``held_back`` (an SQL condition) after all others; rows with ``late``."""
    out, checkpoint = _fresh(spark, "gate")
    queue = f"{out}-queue"
    for condition in (f"NOT ({held_back})", held_back):
        fixtures.load_raw(spark, folder).where(condition).write.mode("append").parquet(queue)
        arriving = fixtures.canonical(spark.readStream.schema(fixtures.EVENTS_TABLE).parquet(queue))
        gate(arriving, settings, out, checkpoint, drain=True).awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/rows/batch_id=*/late=*").select(
        "event_id", "project_id", "session_id", "ts_ms", F.col("late").cast("boolean").alias("late")
    )
