"""Every registered query against its SQL, and the plans of the main ones."""

import pytest
from compare import DATA, difference

import __spark_entry__ as entry
from liftloom.operators import conversion
from liftloom.plans import catalog
from liftloom.session import written

STATEMENTS = entry.oracle_sql()


def test_every_query_has_its_statement():
    assert set(catalog.QUERIES) <= set(STATEMENTS) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    assert difference(spark, f"{DATA}/sf0.001", catalog.QUERIES[name], STATEMENTS[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["project_id", "day", "rec_key", "success", "total"] and df.count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sessions_are_scanned_once(spark, monkeypatch):
    """Of the events, one job counts keys, and one scans sessions and writes their rows; all else reads what was written.

    Nothing runs in Python, and only used columns are read.
    """
    plans = []

    def kept(df, name):
        plans.append(plan_of(df))
        return written(df, name)

    monkeypatch.setattr(conversion, "written", kept)
    plans.append(plan_of(catalog.QUERIES["daily_counts"](spark, f"{DATA}/sf0.001")))
    scans = [line for plan in plans for line in plan.splitlines() if "ReadSchema" in line and "events.parquet" in line]
    assert len(scans) == 1 and "value" not in scans[0].split("ReadSchema")[1]
    scanned = plans[0]
    # the session scan moves events once, by session
    exchanges = [line for line in scanned.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "session_id" in exchanges[0]
    assert not any(word in plan for plan in plans for word in ("Python", "BatchEval", "CartesianProduct"))


def test_spans_are_read_once(spark):
    """Requests are read for their spans, which are written; the lookups and their sums read those."""
    assert "events.parquet" not in plan_of(catalog.QUERIES["action_likelihood"](spark, f"{DATA}/sf0.001"))
