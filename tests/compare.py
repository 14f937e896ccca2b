"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

As a script: ``python tests/compare.py 0.01 [query ...]``
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata"


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows(columns, records) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in records)


def duck(folder: str, sql: str) -> tuple[list[str], Counter, dict[str, str]]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    return columns, rows(columns, result.fetchall()), types


def spark_rows(df) -> tuple[list[str], Counter]:
    return df.columns, rows(df.columns, [tuple(r) for r in df.collect()])


def difference(spark, folder: str, query, sql: str) -> str:
    """Empty when both sides agree."""
    df = query(spark, folder)
    columns, got = spark_rows(df)
    expected_columns, expected, _ = duck(folder, sql)
    if sorted(columns) != sorted(expected_columns):
        return f"columns {sorted(columns)} against {sorted(expected_columns)}"
    if got != expected:
        only = list((got - expected).items())[:3]
        missing = list((expected - got).items())[:3]
        return f"{sum(got.values())} against {sum(expected.values())} rows; only here {only}; missing {missing}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from liftloom.session import build

    scale, chosen = sys.argv[1], sys.argv[2:]
    session = build("compare")
    statements = entry.oracle_sql()
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        begin = time.time()
        try:
            found = difference(session, f"{DATA}/sf{scale}", query, statements[name])
        except Exception as error:  # report and go on with the next query
            found = f"failed: {str(error)[:500]}"
        print(f"{name:22} {time.time() - begin:6.1f}s {'ok' if not found else found}", flush=True)
