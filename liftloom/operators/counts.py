"""Daily counts: totals, key forms, distribution rows and sums over days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.config import SessionSettings
from liftloom.functions.tokens import ALL, EVENT_TOTAL, NO_ACTION, SESSION_TOTAL, rec_key
from liftloom.operators.conversion import EVENT, FAMILIES, alike, leaf_counts, sliced_steps, steps
from liftloom.operators.scans import before
from liftloom.operators.sessions import SESSION_KEYS, session_rows
from liftloom.session import written

KEY = ["goal", "action", "leaf"]


def with_event_totals(leaves: DataFrame) -> DataFrame:
    """Add the ``[TE]`` rows, the sum over event leaves. Works on rows that are already summed, so it moves little."""
    both = F.array(F.col("leaf"), F.lit(EVENT_TOTAL))
    return (
        leaves.withColumn("leaf", F.explode(F.when(F.col("leaf") == SESSION_TOTAL, F.array("leaf")).otherwise(both)))
        .groupBy("project_id", "day", *KEY)
        .agg(F.sum("n").alias("n"))
    )


def daily_counts(
    events: DataFrame, settings: SessionSettings, families: frozenset[str] = FAMILIES
) -> DataFrame:
    """Canonical events to one count per (project, day, key)."""
    hint_ms = int(settings.local_hint_ms)
    # events alone are one sum, for which panes need not be compared
    merged = alike if families - {EVENT} else lambda part: part
    prepared = session_rows(
        events,
        settings,
        then=lambda part: merged(steps(part, hint_ms)),
        then_sliced=lambda part: sliced_steps(part, hint_ms, settings.hot_keys.slot_rows),
    )
    return with_event_totals(leaf_counts(prepared, settings, families))


def merge_counts(counts: DataFrame) -> DataFrame:
    """Sum counts that came in parts, such as one set per micro-batch."""
    return counts.groupBy("project_id", "day", *KEY).agg(F.sum("n").alias("n"))


def keyed(counts: DataFrame) -> DataFrame:
    """The flat form: key text, successes (goal keys only) and total."""
    return counts.select(
        "project_id",
        "day",
        rec_key(F.col("goal"), F.col("action"), F.col("leaf")).alias("rec_key"),
        F.when(F.col("goal") != ALL, F.col("n")).otherwise(F.lit(0)).cast("long").alias("success"),
        F.col("n").alias("total"),
    )


def tally(outcomes: DataFrame, keys: list[str], hit: str) -> DataFrame:
    """Successes and total of a column of yes/no outcomes per key."""
    return outcomes.groupBy(*keys).agg(
        F.sum(F.when(F.col(hit), 1).otherwise(0)).cast("long").alias("success"), F.count(F.lit(1)).alias("total")
    )


def distribution(counts: DataFrame) -> DataFrame:
    """Counts over all sessions turned round: record kind first, then day, then the token or total."""
    kind = (
        F.when(F.col("leaf").startswith("EVENT#"), "[EVT-DIST]")
        .when(F.col("leaf").startswith("ATR#"), "[ATR-DIST]")
        .otherwise("[OTH-DIST]")
    )
    return counts.where((F.col("goal") == ALL) & (F.col("action") == NO_ACTION)).select(
        "project_id", kind.alias("kind"), "day", "leaf", F.lit(0).cast("long").alias("success"), F.col("n").alias("total")
    )


def window_counts(counts: DataFrame, spans: DataFrame) -> DataFrame:
    """Counts summed over day spans.

    ``spans`` holds ``(project_id, start_day, end_day)``, both days included; one that ends before it starts has no counts. The
    counts of a key before a day are looked up at the two ends of a span, so a count is not repeated for every span that covers its day.
    """
    ends = spans.select("project_id", "start_day", "end_day").where("start_day <= end_day").distinct()
    ends = ends.selectExpr("*", "cast(unix_date(start_day) AS bigint) AS low", "cast(unix_date(end_day) + 1 AS bigint) AS high")
    key = ["project_id", *KEY]
    # read for the keys and for the sums
    entries = written(counts.selectExpr(*key, "cast(unix_date(day) AS bigint) AS pos", "n"), "entries")
    keys = entries.groupBy(*key).agg(F.min("pos").alias("first"))
    asked = ends.selectExpr("project_id", "explode(array(low, high)) AS pos").distinct().join(keys, "project_id").where("first < pos")
    # read for both ends
    upto = written(before(entries, asked.select(*key, "pos"), key, {"upto": "n"}, None), "upto")
    high = upto.withColumnsRenamed({"pos": "high", "upto": "more"}).join(ends, ["project_id", "high"])
    low = upto.withColumnsRenamed({"pos": "low", "upto": "less"})
    return (
        high.join(low, [*key, "low"], "left")
        .selectExpr("project_id", "start_day", "end_day", *KEY, "more - coalesce(less, 0L) AS n")
        .where("n <> 0")
    )


def with_new_events(stored: DataFrame, events: DataFrame, new: DataFrame, settings: SessionSettings) -> DataFrame:
    """Stored daily counts of ``events``, kept up with ``new`` ones.

    Only sessions of keys that the new events touch are counted, once without and once with them: the difference is added, so a session that grows,
    merges with the next or moves to another day takes its old counts with it.
    """
    touched = written(new.select(*SESSION_KEYS).distinct(), "touched")
    old = written(events.join(touched, SESSION_KEYS, "left_semi"), "touched_events")
    taken = daily_counts(old, settings).withColumn("n", -F.col("n"))
    added = daily_counts(old.unionByName(new.select(*old.columns)), settings)
    return merge_counts(stored.unionByName(taken).unionByName(added)).where("n <> 0")
