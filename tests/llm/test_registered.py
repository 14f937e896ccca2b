"""Registered queries against their SQL."""

import duckdb
import pytest
from compare import DATA, rows, spark_rows

from liftloom.llm.oracle import STATEMENTS
from liftloom.llm.queries import QUERIES


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", list(STATEMENTS))
def test_against_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    columns, got = spark_rows(QUERIES[name](spark, folder))
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(STATEMENTS[name])
    found = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found)
    assert got == rows(found, result.fetchall())
