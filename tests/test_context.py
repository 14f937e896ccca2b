"""Lists a session keeps, and what a request sees of them."""

import random

import pytest

from liftloom.config import HotKeys
from liftloom.operators.context import lists, merged_states

REQUEST = """request_id long, project_id string, session_id string, ts_ms long, ctxlength long,
    states array<struct<name:string,type:string>>"""


def ask(spark, *rows):
    return spark.createDataFrame([(n, "p", "s", *r) for n, r in enumerate(rows)], REQUEST)


def history(make_events, *tokens, step=1):
    return make_events([(n * step, *t.split("#"), "", "") for n, t in enumerate(tokens)])


SIX = ("EVENT#a", "ATR#b", "EVENT#c", "EVENT#d", "ATR#e", "EVENT#a")


def test_event_list_keeps_order_and_repeats(spark, make_events):
    wanted = ask(spark, (100, 10, None)).selectExpr("*", "50 AS take")
    got = {r.kind: r.tokens for r in lists(history(make_events, *SIX, "GOAL#g"), wanted).collect()}
    assert got == {"evt": ["EVENT#a", "EVENT#c", "EVENT#d", "EVENT#a"], "atr": ["ATR#b", "ATR#e"]}


def test_merge(spark, make_events):
    sent = [("a", "event"), ("f", "event")]
    requests = ask(
        spark, (100, 10, sent), (100, 0, sent), (100, -1, sent + sent), (100, 1, None), (100, -3, sent), (3, 10, None), (100, 10, [("a", "event"), ("x", "Event"), ("y", "atr")])
    )
    got = {r.request_id: r.states for r in merged_states(history(make_events, *SIX), requests).collect()}
    full = ["EVENT#a", "EVENT#c", "EVENT#d", "ATR#b", "ATR#e", "EVENT#f"]
    assert got == {
        0: full, 1: full, 2: ["EVENT#a", "EVENT#f", "EVENT#a", "EVENT#f"], 3: ["EVENT#a", "ATR#e"],
        5: ["EVENT#a", "EVENT#c", "EVENT#d", "ATR#b"], 6: ["EVENT#a", "EVENT#c", "EVENT#d", "ATR#b", "ATR#e", ""],
    }


def test_at_most_fifty_are_kept(spark, make_events):
    events = history(make_events, *[f"EVENT#n{n}" for n in range(70)])
    [row] = lists(events, ask(spark, (1000, 0, None)).selectExpr("*", "60 AS take")).collect()
    assert row.tokens == [f"EVENT#n{n}" for n in range(20, 70)]


def test_lists_expire_on_their_own(spark, make_events):
    events = make_events([(0, "EVENT", "a", "", ""), (1_000_000, "ATR", "b", "", ""), (1_800_000, "EVENT", "c", "", "")])
    requests = ask(spark, (1_799_999, 10, None), (1_800_000, 10, None), (2_799_999, 10, None), (2_800_000, 10, None), (9_000_000, 10, None))
    got = {r.request_id: r.states for r in merged_states(events, requests).collect()}
    assert got == {0: ["EVENT#a", "ATR#b"], 1: ["EVENT#c", "ATR#b"], 2: ["EVENT#c", "ATR#b"], 3: ["EVENT#c"], 4: []}


@pytest.mark.parametrize("hot", [None, HotKeys(0, 13)])
def test_against_a_stepwise_list(spark, make_events, hot):
    rng = random.Random(5)
    events = sorted((rng.randrange(0, 6000), n) for n in range(300))
    rows = [(t, rng.choice(["EVENT", "ATR", "ACT"]), f"n{n}", "", "") for t, n in events]
    asked = [(rng.randrange(0, 6500), rng.choice([1, 3, 4, 9]), None) for _ in range(120)]
    expected = {}
    for number, (at, take, _) in enumerate(asked):
        kept = {"EVENT": [], "ATR": []}
        last = {}
        for t, kind, name, *_ in rows:
            if t > at or kind == "ACT":
                continue
            if kind in last and t - last[kind] >= 60:
                kept[kind] = []
            kept[kind] = (kept[kind] + [f"{kind}#{name}"])[-4:]
            last[kind] = t
        seen = [x for kind in ("EVENT", "ATR") if kind in last and at - last[kind] < 60 for x in kept[kind][-take:]]
        expected[number] = list(dict.fromkeys(seen))
    got = merged_states(make_events(rows), ask(spark, *asked), expiry_ms=60, kept=4, hot=hot)
    assert {r.request_id: r.states for r in got.collect()} == expected


def test_rows_move_once(spark, make_events):
    wanted = ask(spark, (100, 10, None)).selectExpr("*", "50 AS take")
    clears = spark.createDataFrame([("p", "s", 3)], "project_id string, session_id string, ts_ms long")
    for found in (lists(history(make_events, *SIX), wanted, hot=None), lists(history(make_events, *SIX), wanted, hot=None, clears=clears)):
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_clears_in_long_sessions(spark, make_events):
    events = history(make_events, *SIX * 9)
    wanted = ask(spark, *[(at, 0, None) for at in range(0, 60, 5)]).selectExpr("*", "4 AS take")
    clears = spark.createDataFrame([("p", "s", at) for at in (7, 20, 21, 35)], "project_id string, session_id string, ts_ms long")
    found = [sorted((r.request_id, r.kind, tuple(r.tokens)) for r in lists(events, wanted, hot=hot, clears=clears).collect()) for hot in (None, HotKeys(0, 13))]
    assert found[0] == found[1] and (4, "evt", ()) not in found[0] and not [r for r in found[0] if r[0] == 4 or r[0] == 7]


def test_a_request_is_one_row(spark, make_events):
    """Both lists come from one row of a request: nothing is taken twice or gathered again."""
    found = merged_states(history(make_events, *SIX), ask(spark, (100, 10, None)), hot=None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
