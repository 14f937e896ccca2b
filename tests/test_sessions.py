"""Session edges, panes, and the two ways of scanning a key."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from liftloom.config import HotKeys, SessionSettings, parse_gaps
from liftloom.operators import chains, sessions
from liftloom.operators.chains import busiest_keys, gap_chains
from liftloom.operators.counts import daily_counts
from liftloom.operators.scans import dealt

DAY = 1_704_067_200_000
PLAIN = SessionSettings()


def ends(df):
    return sorted((r.start_ms, r.end_ms, r.n_events) for r in df.collect())


def test_gap_text():
    assert parse_gaps(" standard : 1800 , lab:120, broken, a:b:c ") == {"standard": 1800, "lab": 120}
    with pytest.raises(ValueError):
        SessionSettings(gaps={"lab": 120})


def test_unknown_setting_takes_the_default_gap(make_events):
    events = make_events([(0, "EVENT", "a", "", "", "s", conf, "p") for conf in ("lab", "other", None)])
    assert [r.gap_ms for r in sessions.route(events, PLAIN).orderBy("event_id").collect()] == [120_000, 1_800_000, 1_800_000]


def test_rows_without_a_session_are_dropped(make_events):
    events = make_events([(0, "EVENT", "a", "", "", None, "lab", "p"), (0, "EVENT", "a", "", "", "s", "lab", None)])
    assert sessions.sessions(events, PLAIN).count() == 0


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(0, "lab"), (120_000, "lab")], 2),
        ([(0, "lab"), (119_999, "lab")], 1),
        ([(0, "standard"), (600_000, "lab"), (750_000, "lab"), (1_860_000, "lab")], 2),
    ],
)
def test_edges(make_events, rows, expected):
    events = make_events([(DAY + t, "EVENT", "a", "", "", "s", conf, "p") for t, conf in rows])
    assert sessions.sessions(events, PLAIN).count() == expected
    assert sessions.session_rows(events, PLAIN).select("session_start").distinct().count() == expected


def test_session_end_sets_the_day(make_events):
    late = DAY + 23 * 3_600_000 + 45 * 60_000
    [row] = daily_counts(make_events([(late, "EVENT", "a", "", "")]), PLAIN, frozenset({"session"})).collect()
    assert str(row.day) == "2024-01-02"


def test_window_and_scan_agree(spark, make_events):
    rng = random.Random(7)
    rows = [
        (DAY + rng.randrange(0, 40_000_000), "EVENT", "a", "", "", f"s{rng.randrange(6)}", rng.choice(["lab", "standard"]), "p")
        for _ in range(600)
    ]
    events = make_events(rows)
    scanned = (
        sessions.session_rows(events, PLAIN)
        .groupBy("project_id", "session_id", F.col("session_start").alias("start_ms"))
        .agg(F.max("run_end").alias("end_ms"), F.count("*").alias("n_events"))
    )
    assert ends(scanned) == ends(sessions.sessions(events, PLAIN))


def bursts():
    """Rows of few keys, many in the same millisecond."""
    rng = random.Random(11)
    rows = []
    for n in range(1500):
        session = "big" if n % 3 else f"s{n % 7}"
        ts = DAY if n % 5 == 0 else DAY + rng.randrange(0, 30_000_000)
        rows.append((ts, rng.choice(["EVENT", "GOAL", "ACT", "ATR"]), f"n{rng.randrange(3)}", rng.choice(["", "L0", "ACT#n1"]),
                     rng.choice(["", "local"]), session, rng.choice(["lab", "standard"]), "p"))
    return rows


@pytest.mark.parametrize("hot", [HotKeys(min_rows=0, slot_rows=9), HotKeys(min_rows=300, slot_rows=40), HotKeys(min_rows=100, slot_rows=100_000)])
@pytest.mark.parametrize("pane_rows", [7, 500])
def test_sliced_keys_give_the_same_rows(make_events, hot, pane_rows):
    events = make_events(bursts())
    whole = replace(PLAIN, hot_keys=None, pane_rows=pane_rows)
    columns = ["event_id", "session_start", "pane", "place", "run_end"]
    one = sessions.session_rows(events, whole).select(columns)
    two = sessions.session_rows(events, replace(whole, hot_keys=hot)).select(columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert sorted(map(tuple, daily_counts(events, whole).collect())) == sorted(
        map(tuple, daily_counts(events, replace(whole, hot_keys=hot)).collect())
    )


def test_sliced_chains_with_rank_and_weight(spark):
    rng = random.Random(3)
    rows = [("k", rng.randrange(0, 4000), n, rng.randrange(2)) for n in range(400)]
    df = spark.createDataFrame(rows, "key string, ts long, id long, ask int")
    kwargs = dict(end="CASE WHEN ask = 0 THEN ts + 15 ELSE ts END", row_id="id", rank="ask", weight="1 - ask")
    columns = ["id", "chain_start", "chain_end", "chain_seq"]
    one = gap_chains(df, ["key"], "ts", **kwargs).select(columns).collect()
    two = gap_chains(df, ["key"], "ts", hot=HotKeys(0, 11), **kwargs).select(columns).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_all_busy_keys_are_listed(make_events):
    events = make_events(bursts())
    found = busiest_keys(events, ["project_id", "session_id"], HotKeys(min_rows=10, slot_rows=400))
    assert {r.session_id for r in found.listed.collect()} == {"big", *(f"s{n}" for n in range(7))} and found.slots == 4
    assert busiest_keys(events, ["session_id"], HotKeys()) is None


def test_slots_of_a_burst_are_even(spark, monkeypatch):
    """Nearly all rows of a key in one hour, and one a month later."""
    sizes = []

    def measured(*args, **kwargs):
        rows = dealt(*args, **kwargs)
        sizes.extend(r["count"] for r in rows.groupBy("_slot").count().collect())
        return rows

    monkeypatch.setattr(chains, "dealt", measured)
    burst = spark.range(99_999).selectExpr("'k' AS key", "1000000 + id * 36 AS ts", "id AS event_id")
    df = burst.union(spark.range(1).selectExpr("'k'", "1000000 + 30L * 86400000", "99999L"))
    sliced = gap_chains(df, ["key"], "ts", "ts + 1800000", "event_id", hot=HotKeys(min_rows=1000, slot_rows=5000))
    found = sliced.groupBy("chain_start").agg(F.count("*").alias("n"), F.max("chain_seq").alias("last")).orderBy("chain_start").collect()
    assert [(r.n, r["last"]) for r in found] == [(99_999, 99_999), (1, 1)]
    assert sum(sizes) == 100_000 and len(sizes) >= 15 and max(sizes) <= 2 * 5000


def test_slots_of_a_busy_key_are_even(spark):
    """Even rows of one millisecond are spread over slots."""
    rows = [("k", 5, n) for n in range(1000)]
    df = spark.createDataFrame(rows, "key string, ts long, event_id long")
    sliced = gap_chains(df, ["key"], "ts", "ts + 10", "event_id", hot=HotKeys(0, 100))
    assert sliced.select("chain_start").distinct().count() == 1
    assert sorted(r.chain_seq for r in sliced.collect()) == list(range(1, 1001))
    assert "_slot" in sliced._jdf.queryExecution().optimizedPlan().toString()
