"""Gap-based sessions, and panes where they are asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftloom.config import SessionSettings
from liftloom.operators.chains import gap_chains

SESSION_KEYS = ["project_id", "session_id"]


def gap_ms(conf: Column, settings: SessionSettings) -> Column:
    """The gap of a row's session setting; an unknown or missing setting takes the default one."""
    known = F.lit(None).cast("long")
    for name, seconds in settings.gaps.items():
        known = F.when(conf == name, F.lit(seconds * 1000)).otherwise(known)
    return F.coalesce(known, F.lit(settings.gaps[settings.default_conf] * 1000)).cast("long")


def route(events: DataFrame, settings: SessionSettings) -> DataFrame:
    """Drop rows without a session key and give the others their gap."""
    return events.where("project_id IS NOT NULL AND session_id IS NOT NULL").withColumn(
        "gap_ms", gap_ms(F.col("session_conf"), settings)
    )


def session_window(time: str = "timestamp_millis(ts_ms)") -> Column:
    """The session window of a routed row; ``time`` is its timestamp.

    A pause of exactly the gap starts a new session. Spark's window would still join it, hence the gap less 1 ms.
    """
    return F.expr(
        f"session_window({time}, make_interval(0, 0, 0, 0, 0, 0, cast((gap_ms - 1) / 1000 AS decimal(18, 6))))"
    )


def sessions(events: DataFrame, settings: SessionSettings) -> DataFrame:
    """One row per session: start, end (last end minus 1 ms) and number of rows."""
    return (
        route(events, settings)
        .groupBy(*SESSION_KEYS, session_window().alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .selectExpr(*SESSION_KEYS, "unix_millis(w.start) AS start_ms", "unix_millis(w.end) AS end_ms", "n_events")
    )


def session_rows(
    events: DataFrame,
    settings: SessionSettings,
    then: Callable[[DataFrame], DataFrame] = lambda part: part,
    then_sliced: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Every event with its session (``session_start``), pane and place in the pane.

    Where ``pane_rows`` is set, a pane is a run of that many consecutive rows of a session and is counted as a session of
    its own; otherwise a session is one pane, however long. ``run_end`` is the session's end as known up to the row, in the
    form of :func:`sessions`. ``then`` and ``then_sliced`` are those of :func:`gap_chains`.
    """
    routed = route(events, settings)
    length = settings.pane_rows
    pane, place = (f"(chain_seq - 1) div {length}", f"(chain_seq - 1) % {length}") if length else ("0L", "chain_seq - 1")

    def paned(part: DataFrame) -> DataFrame:
        return part.selectExpr(
            *routed.columns,
            "chain_start AS session_start",
            "chain_end - 1 AS run_end",
            f"{pane} AS pane",
            f"cast({place} AS bigint) AS place",
        )

    return gap_chains(
        routed,
        SESSION_KEYS,
        "ts_ms",
        "ts_ms + gap_ms",
        "event_id",
        hot=settings.hot_keys,
        then=lambda part: then(paned(part)),
        then_sliced=lambda part: (then_sliced or then)(paned(part)),
    )
