"""Tallies, stored counts and day sums."""

import datetime as dt

from pyspark.sql import functions as F

from liftloom.session import written
from liftloom.config import SessionSettings
from liftloom.operators import counts
from liftloom.schemas import COUNTS
from liftloom.sources import counts_store

D1, D2, D3 = (dt.date(2024, 1, n) for n in (1, 2, 3))


def sample(spark):
    return spark.createDataFrame(
        [
            ("p", D1, "[AL]", "", "EVENT#a", 3),
            ("p", D2, "[AL]", "", "EVENT#a", 4),
            ("p", D2, "[AL]", "", "ATR#b", 1),
            ("p", D2, "[AL]", "", "[TS]", 2),
            ("p", D2, "GOAL#g", "ACT#x", "EVENT#a", 5),
            ("q", D3, "GOAL#g", "", "[TS]", 6),
        ],
        COUNTS,
    )


def as_set(df):
    return sorted(map(tuple, df.collect()))


def test_tally(spark):
    df = spark.createDataFrame([("projectXD", "evt001", v) for v in (True, True, False)], "project string, event string, hit boolean")
    assert as_set(counts.tally(df, ["project", "event"], "hit")) == [("projectXD", "evt001", 2, 3)]


def test_keys_and_success(spark):
    got = {(r.rec_key, r.success, r.total) for r in counts.keyed(sample(spark)).collect()}
    assert ("GOAL#g::ACT#x::EVENT#a", 5, 5) in got and ("[AL]::EVENT#a", 0, 3) in got


def test_totals_are_sums_of_leaves(spark, make_events):
    rows = [(1_704_067_200_000 + 1000 * n, ["EVENT", "GOAL", "ACT", "ATR"][n % 4], f"n{n % 3}", "", "") for n in range(80)]
    got = counts.daily_counts(make_events(rows), SessionSettings())
    sums = got.where("leaf LIKE '%#%'").groupBy("goal", "action").agg(F.sum("n").alias("n"))
    totals = got.where("leaf = '[TE]'").select("goal", "action", "n")
    assert as_set(sums) == as_set(totals)


def test_distribution(spark):
    got = {(r.kind, r.leaf, r.total) for r in counts.distribution(sample(spark)).collect()}
    assert got == {("[EVT-DIST]", "EVENT#a", 3), ("[EVT-DIST]", "EVENT#a", 4), ("[ATR-DIST]", "ATR#b", 1), ("[OTH-DIST]", "[TS]", 2)}


def test_window_counts_include_both_days(spark):
    spans = spark.createDataFrame([("p", D1, D2), ("p", D2, D2), ("p", D2, D2), ("q", D1, D1)], "project_id string, start_day date, end_day date")
    got = {(r.start_day, r.leaf): r.n for r in counts.window_counts(sample(spark), spans).where("goal = '[AL]'").collect()}
    assert got[(D1, "EVENT#a")] == 7 and got[(D2, "EVENT#a")] == 4


def test_store_replaces_whole_days_only(spark, tmp_path):
    path = str(tmp_path / "counts")
    first = sample(spark)
    counts_store.write_days(first, path)
    counts_store.write_days(first, path)
    assert as_set(counts_store.read_counts(spark, path)) == as_set(first)
    again = spark.createDataFrame([("p", D2, "[AL]", "", "EVENT#z", 9)], COUNTS)
    counts_store.write_days(again, path, files_per_day=2)
    assert as_set(counts_store.read_counts(spark, path)) == as_set(first.where(F.col("day") != D2).unionByName(again))
    ranged = counts_store.read_range(spark, path, "2024-01-02", "2024-01-02")
    assert as_set(ranged) == as_set(again)
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_flat_view_has_mirror_rows(spark):
    got = {r.key: (r.success, r.total) for r in counts_store.flat_view(sample(spark)).collect()}
    assert got["[AL]::EVENT#a::20240101"] == (0, 3)
    assert got["[EVT-DIST]::20240101::EVENT#a"] == (0, 3)
    assert got["GOAL#g::ACT#x::EVENT#a::20240102"] == (5, 5)


def test_replayed_increment_counts_once(spark, tmp_path):
    path = str(tmp_path / "increments")
    one, two = sample(spark), sample(spark).where("project_id = 'p'")
    counts_store.write_increment(one, path, 0)
    counts_store.write_increment(two, path, 1)
    counts_store.write_increment(two, path, 1)
    assert as_set(counts_store.read_increments(spark, path)) == as_set(counts.merge_counts(one.unionByName(two)))


def test_refresh_reads_new_batches_only_and_replays_change_nothing(spark, tmp_path, monkeypatch):
    increments, store = str(tmp_path / "increments"), str(tmp_path / "store")
    one = sample(spark)
    two = sample(spark).where(F.col("day") == D2)
    counts_store.write_increment(one, increments, 0)
    counts_store.refresh(spark, increments, store)
    before = {p.name for p in (tmp_path / "store" / f"day={D1}").iterdir()}
    counts_store.write_increment(two, increments, 1)
    add = counts_store._add

    def kept(session, fresh, *rest):
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(batch_id" in plan
        add(session, fresh, *rest)

    monkeypatch.setattr(counts_store, "_add", kept)
    ledger = tmp_path / "store-ledger"
    counts_store.refresh(spark, increments, store)
    expected = as_set(counts.merge_counts(one.unionByName(two)))
    assert as_set(counts_store.read_counts(spark, store)) == expected
    # a day that nothing came for is left alone
    assert {p.name for p in (tmp_path / "store" / f"day={D1}").iterdir()} == before
    counts_store.refresh(spark, increments, store)
    # as after a crash before the ledger was written: the batch is offered once more, and its days have it already
    counts_store.write_increment(two, increments, 1)
    spark.createDataFrame([(9, 0, None)], counts_store._LEDGER).write.parquet(str(ledger / "of=9"))
    counts_store.refresh(spark, increments, store)
    assert as_set(counts_store.read_counts(spark, store)) == expected


def test_sealed_days_take_nothing(spark, tmp_path):
    increments, store = str(tmp_path / "increments"), str(tmp_path / "store")
    counts_store.write_increment(sample(spark), increments, 0)
    end_of_second = (dt.datetime(2024, 1, 3, tzinfo=dt.timezone.utc).timestamp()) * 1000
    counts_store.refresh(spark, increments, store, int(end_of_second) + counts_store.DAY_LATENESS_MS - 1)
    more = spark.createDataFrame([("p", D1, "[AL]", "", "EVENT#a", 10), ("p", D2, "[AL]", "", "EVENT#a", 100)], COUNTS)
    counts_store.write_increment(more, increments, 1)
    counts_store.refresh(spark, increments, store)
    assert as_set(counts_store.read_corrections(spark, store)) == [("p", D1, "[AL]", "", "EVENT#a", 10)]
    added = sample(spark).unionByName(more.where(F.col("day") == D2))
    assert as_set(counts_store.read_counts(spark, store)) == as_set(counts.merge_counts(added))


def test_window_sums_look_up_two_ends(spark):
    """Rows of the final join are at most twice the lookups, however many days a span has."""
    many = spark.range(4000).selectExpr("'p' AS project_id", "date_add(date'2024-01-01', cast(id % 100 AS int)) AS day", "'[AL]' AS goal", "'' AS action",
                                        "concat('EVENT#', id % 7) AS leaf", "1L AS n")
    spans = spark.range(60).selectExpr("'p' AS project_id", "date_add(date'2024-01-01', cast(id AS int)) AS start_day", "date_add(date'2024-01-01', cast(id + 30 AS int)) AS end_day")
    got = counts.window_counts(many, spans)
    plain = many.join(spans, "project_id").where("day BETWEEN start_day AND end_day").groupBy("project_id", "start_day", "end_day", "goal", "action", "leaf").agg(F.sum("n"))
    assert as_set(got) == as_set(plain)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString() and "sequence" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stored_scoring_reads_asked_days_only(spark, tmp_path):
    path = str(tmp_path / "counts")
    counts_store.write_days(sample(spark), path)
    spans = spark.createDataFrame([("p", D2, D2), ("p", D3, D1)], "project_id string, start_day date, end_day date")
    held = counts_store.read_spans(spark, path, spans)
    assert {str(r.day) for r in held.collect()} == {str(D2)}
    assert "PartitionFilters: [isnotnull(day" in held._jdf.queryExecution().executedPlan().toString()
    assert counts_store.read_spans(spark, path, spans.where("start_day > end_day")).isEmpty()


def test_spans_of_a_store_are_read_once(spark, tmp_path):
    from liftloom.sources import counts_store

    rows = [(p, dt.date(2024, 1, d), "[AL]", "", "EVENT#a", 1) for p in "pqr" for d in (1, 2, 3)]
    counts_store.write_days(spark.createDataFrame(rows, COUNTS), str(tmp_path / "store"))
    spans = spark.range(3).selectExpr("array('p', 'q', 'q')[id] AS project_id", "date'2024-01-02' AS start_day", "date_add(date'2024-01-02', array(0, -1, -2)[id]) AS end_day")
    held = counts_store.read_spans(spark, str(tmp_path / "store"), spans)
    assert [(r.project_id, r.day.day) for r in held.collect()] == [("p", 2)]
    assert "Range" not in held._jdf.queryExecution().executedPlan().toString()


def test_first_refresh_starts_no_tasks_for_what_is_not_there(spark, tmp_path, monkeypatch):
    from liftloom.sources import counts_store

    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(counts_store, "written", kept)
    one = spark.createDataFrame([("p", dt.date(2024, 1, 1), "[AL]", "", "EVENT#a", 1)], COUNTS)
    counts_store.write_increment(one, str(tmp_path / "increments"), 0)
    counts_store.refresh(spark, str(tmp_path / "increments"), str(tmp_path / "store"))
    assert "Union" not in plans[0] and "LogicalRDD" not in plans[0]
    assert counts_store.read_counts(spark, str(tmp_path / "store")).count() == 1
