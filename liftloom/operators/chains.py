"""Gap chains: the one ordered scan behind sessions, context lists and repeated decisions.

Rows of one key, in order of ``(ts, rank, id)``, form a chain as long as each row starts before the latest end seen so
far. A chain is found with window functions over the key. A key that holds very many rows would put them all in one
task, so hot keys are cut into slots of consecutive rows, scanned slot by slot, and joined up through one small row per
slot. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.config import HotKeys
from liftloom.operators.scans import dealt
from liftloom.session import written

_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_TO_HERE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _over(keys: list[str], order: str, frame: str) -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order} {frame})"


def _opened(ts: str) -> str:
    """The row itself where it opens a chain, null elsewhere; ``before`` is the weight in front of it."""
    return (
        f"CASE WHEN _end_before IS NULL OR {ts} >= _end_before THEN"
        f" named_struct('ts', {ts}, 'rank', _rank, 'id', _id, 'before', _weight_to - _weight) END"
    )


def _chain_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.selectExpr(
        *columns,
        "_first.ts AS chain_start",
        "_first.id AS chain_first_id",
        "greatest(_end_before, _end) AS chain_end",
        "_weight_to - _first.before AS chain_seq",
    )


def _whole_keys(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    order = f"{ts}, _rank, _id"
    scanned = df.selectExpr(
        "*",
        f"max(_end) {_over(keys, order, _BEFORE)} AS _end_before",
        f"sum(_weight) {_over(keys, order, _TO_HERE)} AS _weight_to",
    )
    opened = scanned.selectExpr("*", f"last({_opened(ts)}, true) {_over(keys, order, _TO_HERE)} AS _first")
    return _chain_columns(opened, columns)


def _sliced_keys(df: DataFrame, keys: list[str], ts: str, columns: list[str], parts: int) -> DataFrame:
    """The same columns as :func:`_whole_keys`, with every key cut into slots of consecutive rows."""
    rows = dealt(df.withColumn("_at", F.col(ts)), keys, ["_at", "_rank", "_id"], "slots", parts=parts).drop("_at")

    slot_keys = [*keys, "_slot"]
    across = _over(keys, "_slot", _BEFORE)
    ends = (
        rows.groupBy(*slot_keys)
        .agg(F.expr("max(_end) AS _slot_end"), F.expr("sum(_weight) AS _slot_weight"))
        .selectExpr(
            *slot_keys,
            f"max(_slot_end) {across} AS _end_carried",
            f"coalesce(sum(_slot_weight) {across}, 0) AS _weight_carried",
        )
    )

    order = f"{ts}, _rank, _id"
    scanned = (
        rows.selectExpr(
            "*",
            f"max(_end) {_over(slot_keys, order, _BEFORE)} AS _end_local",
            f"sum(_weight) {_over(slot_keys, order, _TO_HERE)} AS _weight_local",
        )
        .join(ends, slot_keys)
        .selectExpr(
            *columns,
            *["_slot", "_end", "_id", "_rank", "_weight"],
            "greatest(_end_local, _end_carried) AS _end_before",
            "_weight_local + _weight_carried AS _weight_to",
        )
        .selectExpr("*", f"{_opened(ts)} AS _opened")
    )
    firsts = (
        scanned.groupBy(*slot_keys)
        .agg(F.expr("max(_opened) AS _slot_first"))
        .selectExpr(*slot_keys, f"max(_slot_first) {across} AS _first_carried")
    )
    joined = (
        scanned.selectExpr("*", f"last(_opened, true) {_over(slot_keys, order, _TO_HERE)} AS _first_local")
        .join(firsts, slot_keys)
        .selectExpr("*", "coalesce(_first_local, _first_carried) AS _first")
    )
    return _chain_columns(joined, columns)


@dataclass(frozen=True)
class BusyKeys:
    """A written list of the keys above the limit, and how many slots all their rows make."""

    listed: DataFrame
    slots: int


def busiest_keys(df: DataFrame, keys: list[str], hot: HotKeys | None) -> BusyKeys | None:
    """All keys above the limit; None if there are none.

    Runs a job over the key columns alone; rows are counted before the shuffle. The list holds fewer keys than the rows divided
    by the limit. It stays a table, and only its size and sum are read.
    """
    if hot is None:
        return None
    listed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot.min_rows)
    rows = listed.agg(F.sum("_rows")).first()[0]
    return BusyKeys(written(listed.select(*keys), "busy"), -(-rows // hot.slot_rows)) if rows else None


def gap_chains(
    df: DataFrame,
    keys: list[str],
    ts: str,
    end: str,
    row_id: str,
    rank: str = "0",
    weight: str = "1",
    hot: HotKeys | None = None,
    busiest: BusyKeys | None = None,
    then: Callable[[DataFrame], DataFrame] = lambda part: part,
    then_sliced: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add the chain of every row. ``end``, ``row_id``, ``rank`` and ``weight`` are SQL expressions.

    :param end: up to when (not including) a later row still joins the chain
    :param row_id: a number that no two rows of a key share; orders rows of equal ``ts`` and ``rank``
    :param rank: 0 or 1, orders rows of equal ``ts`` before ``row_id`` does
    :param weight: what ``chain_seq`` adds up; 1 by default, so that it is the place of the row in its chain
    :param hot: when and how to cut large keys into slots; None treats all keys alike
    :param busiest: the keys to cut, where the caller has looked for them before
    :param then: further work per part; hot and other keys are joined up only after it, which spares the keys that are
        not hot a second shuffle when ``then`` groups inside a chain
    :param then_sliced: the same for the hot keys, where it has to be done another way

    New columns: ``chain_start`` (its first ``ts``), ``chain_first_id`` (its first ``row_id``), ``chain_end`` (latest
    end up to this row), ``chain_seq`` (weight summed from the chain's first row to this one).
    """
    prepared = df.selectExpr(
        "*",
        f"{end} AS _end",
        f"cast({row_id} AS bigint) AS _id",
        f"cast({rank} AS int) AS _rank",
        f"cast({weight} AS bigint) AS _weight",
    )
    found = busiest_keys(df, keys, hot) if busiest is None else busiest
    if found is None:
        return then(_whole_keys(prepared, keys, ts, df.columns))
    rest = then(_whole_keys(prepared.join(found.listed, keys, "left_anti"), keys, ts, df.columns))
    sliced = (then_sliced or then)(_sliced_keys(prepared.join(found.listed, keys, "left_semi"), keys, ts, df.columns, found.slots))
    return rest.unionByName(sliced)
