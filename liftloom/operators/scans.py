"""Running sums over large groups, spread over many tasks.

A group is cut into slots of consecutive rows. A running sum is then an ordinary window inside a slot plus what is carried
over from the slots before, and only one small row per slot is summed over a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.session import written

#: rows of a slot, in which a running sum is one ordinary window
SLOT_ROWS = 100_000


def dealt(df: DataFrame, keys: list[str], order: list[str], name: str, slot: str = "_slot", parts: int | None = None, slot_rows: int | None = None) -> DataFrame:
    """Rows written in ranges of ``keys`` and ``order``, with the number of their range in the column ``slot``.

    Ranges come from a sample of the rows and hold about as many rows each, whatever the keys, so a key with most of the rows has many.
    Rows equal in all of ``keys`` and ``order`` are dealt out as well; which of them comes first is open. At most one key reaches
    from one range into the next. ``parts`` is the number of ranges; told
    ``slot_rows`` instead, rows are written and counted first. Without either adaptive execution finds a number.
    """
    if slot_rows:
        df = written(df, f"{name}_all")
        parts = -(-df.count() // slot_rows) or 1
    numbered = df.withColumn("_arrival", F.monotonically_increasing_id())
    by = [*keys, *order, "_arrival"]
    ranged = numbered.repartitionByRange(parts, *by) if parts else numbered.repartitionByRange(*by)
    return written(ranged.withColumn(slot, F.spark_partition_id()).select(*df.columns, slot), name)


def before(entries: DataFrame, asked: DataFrame, keys: list[str], sums: dict[str, str], slot_rows: int | None, function: str = "sum") -> DataFrame:
    """What entries of the same keys add up to before a place: for each row of ``asked``, ``keys``, ``pos`` and the columns of ``sums``.

    :param entries: ``keys``, ``pos`` (a whole number) and what ``sums`` reads
    :param asked: ``keys`` and ``pos``, without repeats; entries at this place itself do not count
    :param slot_rows: cut groups into slots of so many places; None takes each group as a whole
    """
    types = dict(entries.selectExpr(*[f"{expression} AS {name}" for name, expression in sums.items()]).dtypes)
    rows = entries.selectExpr(*keys, "pos", "1 AS tag", *[f"{expression} AS {name}" for name, expression in sums.items()])
    rows = rows.unionByName(asked.selectExpr(*keys, "pos", "0 AS tag", *[f"cast(NULL AS {types[name]}) AS {name}" for name in sums]))
    if slot_rows is None:
        over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY pos, tag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        added = rows.selectExpr(*keys, "pos", "tag", *[f"{function}({name}) {over} AS {name}" for name in sums])
    else:
        cut = rows.withColumn("_slot", F.floor(F.col("pos") / F.lit(slot_rows)))
        added = running(cut, keys, "pos, tag", {f"{name}_to": name for name in sums}, function=function).selectExpr(
            *keys, "pos", "tag", *[f"{name}_to AS {name}" for name in sums]
        )
    return added.where("tag = 0").drop("tag")


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], slot: str = "_slot", function: str = "sum") -> DataFrame:
    """Add running sums over the rows of the same keys, up to and with the row itself.

    :param keys: grouping columns; nulls form a group
    :param order: SQL order inside a slot; rows that are equal in it may swap
    :param sums: new columns and the SQL expressions they sum up
    :param slot: column that numbers stretches of consecutive rows of a key, growing with ``order``
    :param function: ``sum``, ``max`` or ``min``; null expressions change nothing, and with nothing before it the column is null
    """
    join = {"sum": lambda here, before: f"coalesce({here} + {before}, {here}, {before})", "max": "greatest({}, {})".format, "min": "least({}, {})".format}[function]
    over = ", ".join(keys)
    parts = [f"{function}({expression}) AS _{name}" for name, expression in sums.items()]
    totals = df.groupBy(*keys, slot).agg(*[F.expr(part) for part in parts])
    before = f"OVER (PARTITION BY {over} ORDER BY {slot} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = totals.selectExpr(
        *[f"{key} AS _of_{key}" for key in keys],
        f"{slot} AS _of_slot",
        f"count(1) {before} AS _slots",
        *[f"{function}(_{name}) {before} AS _before_{name}" for name in sums],
    ).where("_slots > 0")
    match = F.col(slot) == F.col("_of_slot")
    for key in keys:
        match &= F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    inside = f"OVER (PARTITION BY {over}, {slot} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = df.selectExpr("*", *[f"{function}({expression}) {inside} AS _{name}" for name, expression in sums.items()])
    return local.join(carried, match, "left").selectExpr(*df.columns, *[f"{join(f'_{name}', f'_before_{name}')} AS {name}" for name in sums])
