"""Sessions of a stream, in Spark's own session windows and state store.

A session leaves once the watermark has passed its end. Rows that come too late are told apart before that by :func:`gate`,
as the session window drops them without a trace.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from liftloom.config import SessionSettings
from liftloom.operators.sessions import SESSION_KEYS, route, session_window
from liftloom.schemas import EVENTS

# How late an event may come, and how often counts are refreshed.
LATENESS = "1 minute"
LATENESS_MS = 60_000
REFRESH = "1 minute"

_ROW_FIELDS = ["event_id", "ts_ms", "gap_ms", "event_type", "event_name", "label", "hint"]


def _windowed(events: DataFrame, settings: SessionSettings) -> DataFrame:
    return route(events, settings).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", LATENESS)


def ended_sessions(events: DataFrame, settings: SessionSettings) -> DataFrame:
    """Streaming canonical events to ended sessions, with start, end and number of rows; the state holds one count per session."""
    counted = _windowed(events, settings).groupBy(*SESSION_KEYS, session_window("ts").alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.selectExpr(*SESSION_KEYS, "unix_millis(w.start) AS session_start", "unix_millis(w.end) AS end_ms", "n_events")


def ended_rows(events: DataFrame, settings: SessionSettings) -> DataFrame:
    """Streaming canonical events to one row per ended session, with ``members``, its rows in any order. They are held as state."""
    members = F.collect_list(F.struct(*_ROW_FIELDS)).alias("members")
    held = _windowed(events, settings).groupBy(*SESSION_KEYS, session_window("ts").alias("w")).agg(members)
    return held.selectExpr(*SESSION_KEYS, "unix_millis(w.start) AS session_start", "members")


def rows_of(ended: DataFrame, settings: SessionSettings) -> DataFrame:
    """Ended sessions of a micro-batch to the columns of the batch session rows."""
    length = settings.pane_rows
    pane, place = (f"seq div {length}", f"seq % {length}") if length else ("0L", "seq")
    over = f"OVER (PARTITION BY {', '.join(SESSION_KEYS)}, session_start ORDER BY ts_ms, event_id"
    rows = ended.selectExpr(*SESSION_KEYS, "session_start", "inline(members)").selectExpr(
        "*", f"row_number() {over}) - 1 AS seq", f"max(ts_ms + gap_ms) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS run_end"
    )
    return rows.selectExpr("*", f"cast({pane} AS bigint) AS pane", f"cast({place} AS bigint) AS place").drop("seq")


def _written_marks(spark: SparkSession, path: str, before_batch: int) -> int | None:
    try:
        marks = spark.read.schema("batch_id bigint, mark_ms bigint, accepted bigint, late bigint").parquet(f"{path}/marks")
    except AnalysisException:
        return None
    return marks.where(F.col("batch_id") < before_batch).agg(F.max("mark_ms")).first()[0]


def gate(events: DataFrame, settings: SessionSettings, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Tell late rows of a stream of canonical events apart: ``rows`` under ``path`` hold all routed rows of every micro-batch, by ``late``.

    A row is late if its session, were it alone, would have ended by the watermark: a minute before the latest time that earlier
    batches brought. Nothing is dropped: rows of both kinds together are the routed input. ``marks`` has the watermark after each batch and, as it was observed
    while writing, how many rows were accepted and late. A replay of a batch overwrites what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = _written_marks(spark, path, batch_id)
        late = F.lit(False) if mark is None else F.col("ts_ms") + F.col("gap_ms") - 1 <= F.lit(mark)
        seen = Observation(f"gate-{batch_id}")
        flagged = route(batch, settings).withColumn("late", F.coalesce(late, F.lit(False)))
        observed = flagged.observe(
            seen, F.max("ts_ms").alias("latest"), F.expr("count_if(NOT late)").alias("accepted"), F.expr("count_if(late)").alias("late")
        )
        observed.drop("gap_ms").write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch_id={batch_id}")
        found = seen.get
        latest = found["latest"] - LATENESS_MS if found["latest"] is not None else None
        marks = [m for m in (mark, latest) if m is not None]
        row = [(batch_id, max(marks) if marks else None, found["accepted"], found["late"])]
        # one folder per batch, so that a replay overwrites it
        spark.createDataFrame(row, "batch_id bigint, mark_ms bigint, accepted bigint, late bigint").write.mode("overwrite").parquet(f"{path}/marks/of={batch_id}")

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=REFRESH)).start()


def accepted_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that :func:`gate` accepted, as a stream."""
    return spark.readStream.schema(EVENTS).parquet(f"{path}/rows/batch_id=*/late=false")
