"""Running sums over large groups without putting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a slot, in which a running sum is one ordinary window
SLOT_ROWS = 100_000


def running_before(df: DataFrame, keys: list[str], weight: str, order: list[str], rows: int, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the same keys that come before a row, and its key's whole sum.

    :param keys: grouping columns; nulls form a group; with none, all rows are one group
    :param weight: a whole-number SQL expression, null counting as 0
    :param order: columns that set the order inside a key, the first a hexadecimal digest; rows equal in all may swap
    :param rows: about how many rows there are, which sets into how many slots every key is cut
    :param name: new column; the key's sum is in ``<name>_all``

    Every key is cut into slots by the first digits of the digest, so a key with most of the rows is spread over many
    tasks. Only one small row per key and slot is summed over a whole key.
    """
    digits = 1
    while 16**digits < max(16, rows / SLOT_ROWS * 4):
        digits += 1
    cut = df.withColumn("_slot", F.substring(order[0], 1, digits)).withColumn("_weight", F.expr(f"coalesce(cast({weight} as bigint), 0)"))
    sums = cut.groupBy(*keys, "_slot").agg(F.sum("_weight").alias("_sum"))
    over = f"partition by {', '.join(keys)}" if keys else ""
    sums = sums.selectExpr(
        *[f"{key} as _{key}" for key in keys],
        "_slot as _of",
        f"sum(_sum) over ({over} order by _slot rows between unbounded preceding and current row) - _sum as _carried",
        f"sum(_sum) over ({over}) as {name}_all",
    )
    match = F.col("_slot").eqNullSafe(F.col("_of"))
    for key in keys:
        match &= F.col(key).eqNullSafe(F.col(f"_{key}"))
    within = f"partition by {', '.join([*keys, '_slot'])} order by {', '.join(order)} rows between unbounded preceding and current row"
    placed = cut.selectExpr("*", f"sum(_weight) over ({within}) - _weight as _inside").join(sums, match)
    return placed.select(*df.columns, (F.col("_carried") + F.col("_inside")).alias(name), f"{name}_all")
