"""The stored counts: one folder per day, written whole days at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftloom.operators.counts import distribution, keyed, merge_counts
from liftloom.schemas import COUNTS
from liftloom.session import dropped_after, written


#: rows of one file of a day, unless told how many files to write
FILE_ROWS = 2_000_000


def write_days(counts: DataFrame, path: str, files_per_day: int | None = None) -> None:
    """Replace exactly the days that ``counts`` holds and leave all others alone.

    Rows are spread over ``files_per_day`` tasks per day by key, as many as the largest day needs if not told, and sorted by
    project and key in each file, so a reader of one project skips most row groups without a folder per project.
    """
    if files_per_day is None:
        counts = written(counts, "days")
        largest = counts.groupBy("day").count().agg(F.max("count")).first()[0] or 0
        files_per_day = -(-largest // FILE_ROWS) or 1
    slot = F.pmod(F.xxhash64("project_id", "goal", "action"), F.lit(files_per_day))
    (
        counts.withColumn("_slot", slot)
        .repartition("day", "_slot")
        .drop("_slot")
        .sortWithinPartitions("day", "project_id", "goal", "action", "leaf")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(path).select(*COUNTS.fieldNames())


def read_range(spark: SparkSession, path: str, first_day: str, last_day: str) -> DataFrame:
    """Days ``first_day`` to ``last_day``, both included; other day folders are not listed for reading."""
    return read_counts(spark, path).where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))


def flat_view(counts: DataFrame) -> DataFrame:
    """Stored keys in their flat form ``key::YYYYMMDD``, with the rows that mirror the distribution."""
    label = F.date_format("day", "yyyyMMdd")
    plain = keyed(counts).select(
        "project_id", F.concat_ws("::", "rec_key", label).alias("key"), "success", "total"
    )
    mirrored = distribution(counts).select(
        "project_id", F.concat_ws("::", "kind", label, "leaf").alias("key"), "success", "total"
    )
    return plain.unionByName(mirrored)


def write_increment(counts: DataFrame, path: str, batch_id: int) -> None:
    """Counts of one micro-batch. A replay of the batch overwrites the same folder, so it adds nothing twice."""
    counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_increments(spark: SparkSession, path: str) -> DataFrame:
    """Running daily totals over all micro-batches so far."""
    return merge_counts(spark.read.schema(COUNTS).option("basePath", path).parquet(f"{path}/batch_id=*"))


# Fixed value: how long after its end a day still takes increments up.
DAY_LATENESS_MS = 4 * 3_600_000

_LEDGER = "refresh bigint, through bigint, mark_ms bigint"


def _ledger(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.schema(_LEDGER).parquet(f"{store}-ledger/of=*")
    except AnalysisException:
        return None


def refresh(spark: SparkSession, increments: str, store: str, mark_ms: int | None = None) -> None:
    """Add micro-batches that are new to the stored running totals. Only their days are rewritten, once each.

    :param mark_ms: up to when the stream is known to be complete. From the next refresh on, days that ended four hours or more before are
        sealed: increments of sealed days are kept apart, for :func:`read_corrections`, and change no total.

    A ledger next to the store says through which micro-batch and mark it goes, so older increments are not read again. Each day also carries the
    micro-batch it goes through: after a crash between two steps the refresh is run once more, and days that were written take nothing twice.
    """
    ledger = _ledger(spark, store)
    last = None if ledger is None else ledger.orderBy(F.col("refresh").desc()).first()
    number, through, sealed_by = (last.refresh + 1, last.through, last.mark_ms) if last else (0, -1, None)
    # the folder of a batch is its id, so older ones are not listed for reading
    try:
        fresh = spark.read.schema(f"{_COLUMNS}, batch_id bigint").option("basePath", increments).parquet(f"{increments}/batch_id=*")
    except AnalysisException:
        return
    fresh = fresh.where(F.col("batch_id") > through)
    newest = fresh.agg(F.max("batch_id")).first()[0]
    sealed = F.lit(False)
    if sealed_by is not None:
        day_end = (F.unix_date("day") + 1).cast("bigint") * 86_400_000
        sealed = day_end + DAY_LATENESS_MS <= F.lit(sealed_by)
    if newest is not None:
        late = merge_counts(fresh.where(sealed))
        late.write.mode("overwrite").parquet(f"{store}-corrections/after={through}")
        _add(spark, fresh.where(~sealed), store, newest)
    marks = [m for m in (sealed_by, mark_ms) if m is not None]
    row = [(number, through if newest is None else newest, max(marks) if marks else None)]
    spark.createDataFrame(row, _LEDGER).write.mode("overwrite").parquet(f"{store}-ledger/of={number}")


_COLUMNS = "project_id string, day date, goal string, action string, leaf string, n bigint"


def _add(spark: SparkSession, fresh: DataFrame, store: str, newest: int) -> None:
    """Rewrite the days of ``fresh`` with its counts added, but for those that are in already."""
    days = [r.day for r in fresh.select("day").distinct().collect()]
    try:
        held = spark.read.schema(f"{_COLUMNS}, through bigint").parquet(store).where(F.col("day").isin(days))
    except AnalysisException:
        # nothing is stored yet: an empty table that Spark knows to be empty, so no tasks are started for it
        held = fresh.withColumnRenamed("batch_id", "through").where("false")
    done = held.groupBy("day").agg(F.max("through").alias("done"))
    added = fresh.join(F.broadcast(done), "day", "left").where("done IS NULL OR batch_id > done").select(*COUNTS.fieldNames())
    totals = merge_counts(held.select(*COUNTS.fieldNames()).unionByName(added))
    # a day is read while it is rewritten, so its new rows are complete before
    with dropped_after(spark):
        write_days(written(totals.withColumn("through", F.lit(newest).cast("bigint")), "totals"), store)


def read_corrections(spark: SparkSession, store: str) -> DataFrame:
    """Counts that came after their day was sealed."""
    return merge_counts(spark.read.schema(COUNTS).parquet(f"{store}-corrections/after=*"))


def read_spans(spark: SparkSession, path: str, spans: DataFrame) -> DataFrame:
    """The days from the first to the last that ``spans`` (``project_id, start_day, end_day``) ask for, and their projects only.

    Two dates are read from ``spans``, so that other day folders are not even listed; projects are a semi join. ``spans`` is read once, and one row
    a project is written. A project none of whose spans holds a day has no counts to read.
    """
    asked = spans.where("start_day <= end_day").groupBy("project_id").agg(F.min("start_day").alias("first"), F.max("end_day").alias("last"))
    asked = written(asked, "asked")
    first = asked.agg(F.min("first"), F.max("last")).first()
    held = read_counts(spark, path).where(F.col("day").between(F.lit(first[0]).cast("date"), F.lit(first[1]).cast("date")))
    return held.join(asked.select("project_id"), "project_id", "left_semi")
