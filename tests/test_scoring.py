"""Scores, actions, policies and decisions on small tables."""

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from liftloom.functions.ordering import by_byte_length, by_text
from liftloom.functions.tokens import hashed_uniform
from liftloom.operators import actions, policies, scoring
from liftloom.schemas import COUNTS
from liftloom.session import written

DAY = dt.date(2024, 1, 10)
BASE = {"[AL]||[TS]": 100, "GOAL#g||[TS]": 30, "GOAL#g||EVENT#e": 20, "GOAL#g||[TE]": 60, "[AL]||EVENT#e": 40, "[AL]||[TE]": 300}


def table(spark, numbers, day=DAY):
    return spark.createDataFrame([("p", day, *k.split("|"), n) for k, n in numbers.items()], COUNTS)


def score(spark, numbers, states=("EVENT#e",), window=3, goals=("g",)):
    requests = spark.createDataFrame([(1, "p", DAY, window, list(goals))], "request_id long, project_id string, as_of date, `window` long, goals array<string>")
    given = spark.createDataFrame([(1, list(states))], "request_id long, states array<string>")
    return {r.goal: r for r in scoring.predict(requests, given, table(spark, numbers)).collect()}


def test_posterior(spark):
    got = score(spark, BASE)["g"]
    t, f = 0.3 * 21 / 160, 0.7 * 21 / 340
    assert got.probability == pytest.approx(t / (t + f)) and round(got.probability, 6) == 0.476636 and got.code == 0


@pytest.mark.parametrize(
    "change, states, expected",
    [
        ({"[AL]||[TS]": 10}, ["EVENT#e"], "101"),
        ({}, ["EVENT#never"], "102"),
        ({}, [], "102"),
    ],
)
def test_failures(spark, change, states, expected):
    got = score(spark, {**BASE, **change}, states)["g"]
    assert got.probability == -1 and got.code == 1 and got.message.endswith(expected)


def test_bounds(spark):
    unseen = score(spark, {k: v for k, v in BASE.items() if k != "GOAL#g||[TS]"})["g"].probability
    assert unseen == pytest.approx(1e-9 * 21 / 160 / (0.7 * 0 + (1 - 1e-9) * 21 / 340 + 1e-9 * 21 / 160))
    always = score(spark, {**BASE, "GOAL#g||[TS]": 100})["g"].probability
    assert always == pytest.approx(0.999 * 21 / 160 / (0.999 * 21 / 160 + 0.001 * 21 / 340))
    crowded = score(spark, {**BASE, "GOAL#g||EVENT#e": 50})["g"].probability  # more per goal than in all: term below 0
    assert crowded == pytest.approx(0.3 * 51 / 160 / (0.3 * 51 / 160 + 0.7 * 1e-9))
    zero_divisor = score(spark, {**BASE, "GOAL#g||[TE]": 400})["g"].probability
    assert zero_divisor == 0.0


def test_repeated_states_count_twice(spark):
    got = score(spark, BASE, ["EVENT#e", "EVENT#e", "EVENT#never"])["g"].probability
    t, f = 0.3 * (21 / 160) ** 2, 0.7 * (21 / 340) ** 2
    assert got == pytest.approx(t / (t + f))


def test_window_and_goal_limits(spark):
    assert score(spark, BASE, goals=["g"] * 6) == {} and score(spark, BASE, goals=[]) == {}
    requests = spark.createDataFrame([(1, "p", DAY + dt.timedelta(days=d), w) for d, w in ((2, 0), (3, 0), (3, 4))], "request_id long, project_id string, as_of date, `window` long")
    spans = requests.selectExpr(*scoring.day_span(3)).collect()
    assert [s.start_day <= DAY <= s.end_day for s in spans] == [True, False, True]


def test_detail(spark):
    requests = spark.createDataFrame([(1, "p", DAY, 3, ["g"])], "request_id long, project_id string, as_of date, `window` long, goals array<string>")
    given = spark.createDataFrame([(1, ["EVENT#e", "EVENT#no"])], "request_id long, states array<string>")
    rows = scoring.score_detail(scoring.predict_rows(requests, given, table(spark, BASE))).orderBy("place").collect()
    assert [(r.predictor, round(r.log_true, 6)) for r in rows] == [("EVENT#e", round(math.log(21 / 160), 6)), ("EVENT#no", -1.0)]


REQUEST = """request_id long, project_id string, session_id string, ts_ms long, as_of date, `window` long, goal string,
    actions array<struct<name:string,cost:double>>, reward double, gainonly boolean, explore string, anchor_id string,
    mute boolean, label string, session_conf string, detail boolean"""
WITH_ACTION = {**BASE, "GOAL#g|ACT#x|EVENT#e": 10, "GOAL#g|ACT#x|[TE]": 20, "[AL]|ACT#x|EVENT#e": 15, "[AL]|ACT#x|[TE]": 50}


def ask(spark, **fields):
    row = dict(request_id=1, project_id="p", session_id="s", ts_ms=0, as_of=DAY, window=7, goal="g", actions=[("x", 0.25), ("y", 0.0)],
               reward=2.0, gainonly=False, explore="G", anchor_id="", mute=False, label="L", session_conf="standard", detail=True)
    rows = fields.pop("rows", [fields])
    return spark.createDataFrame([tuple({**row, **r}.values()) for r in rows], REQUEST)


def given(spark, ids=(1,)):
    return spark.createDataFrame([(i, ["EVENT#e"]) for i in ids], "request_id long, states array<string>")


def test_action_results(spark):
    scored = actions.score_actions(ask(spark), given(spark), table(spark, WITH_ACTION))
    x, y = actions.action_results(scored).orderBy("item").collect()
    p = 0.3 * 21 / 160 / (0.3 * 21 / 160 + 0.7 * 21 / 340)
    t, f = 0.3 * 11 / 120, 0.7 * 6 / 130
    a = t / (t + f)
    assert x.action_prob == pytest.approx(a) and x.lift == pytest.approx((a - p) / p * 100)
    assert x.gain == pytest.approx(a * 1.75 - 2 * p) and x.expected_reward == pytest.approx(a * 1.75) and x.code == 0
    assert (y.action_prob, y.lift, y.gain, y.code) == (-1.0, 0.0, 0.0, 1) and y.message.endswith("202")
    assert scored.collect()[0].baseline == pytest.approx(2 * p)


def test_impossible_against_the_goal_is_certain(spark):
    scored = actions.score_actions(ask(spark), given(spark), table(spark, {**WITH_ACTION, "[AL]|ACT#x|EVENT#e": 9}))
    assert actions.action_results(scored).where("action = 'x'").collect()[0].action_prob == 1.0


def test_invalid_requests_are_left_out(spark):
    bad = ask(spark, rows=[dict(goal=""), dict(actions=[]), dict(actions=[("a", 0.0)] * 11)])
    assert actions.valid_actions(bad).count() == 0
    assert actions.valid_actions(ask(spark, reward=0.0)).collect()[0].reward == 1.0


def test_goal_still_to_learn(spark):
    scored = actions.score_actions(ask(spark, goal="new", detail=False), given(spark), table(spark, {"[AL]||[TS]": 5}))
    chosen = policies.choose(scored)
    [row] = chosen.collect()
    assert row.mode == "learn-goal" and row.decision in ("x", "y") and row.status_message.endswith("101")
    assert [(r.goal, r.action, r.action_prob) for r in actions.response_rows(chosen).collect()] == [("", "", 0.0)] * 2


CHOICES = "request_id long, choices array<struct<name:string,learned:boolean,value:double>>, baseline double, gainonly boolean, explore string, baseline_ok boolean"


def pick(spark, choices, policy, n=1, baseline=0.0, gainonly=False, strict=False, explore=""):
    rows = [(i, [(f"c{j}", *c) for j, c in enumerate(choices)], baseline, gainonly, explore, True) for i in range(n)]
    return policies.choose(spark.createDataFrame(rows, CHOICES), policy, strict).orderBy("request_id").collect()


def draw(i, salt):
    return int(hashlib.md5(f"{i}|{salt}".encode()).hexdigest()[:8], 16) / 4294967296


def test_draws(spark):
    got = spark.range(50).select(hashed_uniform(F.col("id"), "pick").alias("u")).collect()
    assert [r.u for r in got] == [draw(i, "pick") for i in range(50)]


def test_greedy(spark):
    def greedy(*values, **kw):
        [row] = pick(spark, [(True, v) for v in values], "G", **kw)
        return row.picked, row.mode, row.decision

    assert greedy(1.0, 3.0, 3.0) == (1, "exploit", "c1")
    assert greedy(-1.0, -2.0) == (-1, "error", "no-action")
    assert greedy(0.0, -2.0) == (0, "exploit", "c0")
    assert greedy(3.0, baseline=2.0, gainonly=True) == (-1, "suppress", "no-action")
    assert greedy(2.0, baseline=2.0, gainonly=True) == (0, "exploit", "c0")
    assert greedy(3.0, baseline=2.0, gainonly=True, strict=True) == (0, "exploit", "c0")
    assert greedy(2.0, baseline=2.0, gainonly=True, strict=True) == (-1, "suppress", "no-action")


def test_exploring(spark):
    rows = pick(spark, [(True, 1.0), (True, 2.0), (True, 0.5)], "E", n=200)
    assert all(r.mode == "explore" and r.picked == int(draw(r.request_id, "pick") * 3) for r in rows)
    rows = pick(spark, [(True, 1.0), (True, 2.0)], "EG", n=400)
    assert all((r.mode == "explore") == (draw(r.request_id, "gate") < 0.05) for r in rows)
    assert {r.picked for r in rows if r.mode == "exploit"} == {1}


def test_curious(spark):
    rows = pick(spark, [(True, 1.0), (False, 0.0), (False, 0.0), (True, 2.0)], "CEG", n=300)
    learning = [r for r in rows if draw(r.request_id, "fresh") < 0.5]
    assert all(r.mode == "learn-action" and r.picked == int(draw(r.request_id, "fresh-pick") * 2) for r in learning)
    assert all(r.mode in ("explore", "exploit") for r in rows if r not in learning)


@pytest.mark.parametrize("policy", ["S", "CS"])
def test_softmax(spark, policy):
    values = [0.1, 0.0, 0.25]
    rows = pick(spark, [(v > 0, v) for v in values], policy, n=300)
    used = [v if v > 0 or policy == "S" else max(values) for v in values]
    weights = [math.exp(v / 0.1) for v in used]
    for r in rows:
        share = [sum(weights[: i + 1]) / sum(weights) for i in range(3)]
        assert r.mode == "softmax" and r.picked == next(i for i, s in enumerate(share) if s > draw(r.request_id, "softmax"))
    assert pick(spark, [(True, 1e9)], policy)[0].mode == "error"


def test_policy_named_by_the_request(spark):
    both = [(True, 1.0), (True, 2.0)]
    assert pick(spark, both, None, explore="g")[0].mode == "exploit"
    assert pick(spark, both, None, explore="e")[0].mode == "explore"
    assert pick(spark, both, None, explore="s")[0].mode == "softmax"
    assert {r.mode for r in pick(spark, both, None, explore="other", n=200)} == {"explore", "exploit"}


def test_repeated_decisions_and_feedback(spark):
    minute = 60_000
    times = [(1, 0, "a"), (2, 29 * minute, "a"), (3, 58 * minute, "a"), (4, 88 * minute, "a"), (5, 88 * minute, ""), (6, 89 * minute, ""), (7, 0, "b")]
    requests = ask(spark, rows=[dict(request_id=i, ts_ms=t, anchor_id=a, explore="e", mute=i == 6) for i, t, a in times])
    got = actions.decide(requests, given(spark, range(1, 8)), table(spark, WITH_ACTION)).orderBy("request_id")
    rows = got.collect()
    assert [r.leader_id for r in rows] == [1, 1, 1, 4, 5, 6, 7]
    assert rows[0].decision == rows[1].decision == rows[2].decision
    events = actions.feedback_events(requests, got).orderBy("event_id").collect()
    assert [e.event_id for e in events] == [-8, -6, -5, -2]
    assert {(e.event_type, e.label, e.session_conf) for e in events} == {("ACT", "L", "standard")}


def test_ordering_helpers(spark):
    df = spark.createDataFrame([("ccc",), ("a",), ("bb",), ("aa",), ("é",)], "x string")
    assert [r.x for r in by_text(df, "x").collect()] == ["a", "aa", "bb", "ccc", "é"]
    assert [r.x for r in by_byte_length(df, "x").collect()] == ["a", "aa", "bb", "é", "ccc"]


def test_each_question_is_answered_once(spark):
    asked = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, None), (5, None)], "request_id long, project_id string")
    given = []

    def answer(questions):
        given.append(questions.count())
        return questions.selectExpr("request_id", "coalesce(project_id, '-') AS said")

    got = {r.request_id: [a.said for a in r.answers] for r in scoring.answered(asked, ["project_id"], answer).collect()}
    assert given == [3]
    assert got == {1: ["p"], 2: ["p"], 3: ["q"], 4: ["-"], 5: ["-"]}


def test_softmax_over_vanishing_weights(spark):
    """Weights that all vanish decide nothing and divide nothing."""
    for policy in ("S", "CS"):
        [row] = pick(spark, [(True, -1e9), (True, -1e8)], policy)
        assert (row.picked, row.mode) == (-1, "error")


def test_order_of_states_asks_nothing_new(spark, monkeypatch):
    """Requests that saw the same in another order are one question, and one offer where costs and reward are the same too."""
    asked = {}

    def kept(df, name):
        table = written(df, name)
        asked.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(scoring, "written", kept)
    requests = ask(spark, rows=[dict(request_id=1), dict(request_id=2), dict(request_id=3, reward=5.0)])
    seen = spark.createDataFrame([(1, ["EVENT#e", "ATR#b"]), (2, ["ATR#b", "EVENT#e"]), (3, ["EVENT#e", "ATR#b"])], "request_id long, states array<string>")
    scored = actions.score_actions(requests, seen, table(spark, WITH_ACTION)).orderBy("request_id").collect()
    assert asked["questions"] == [2, 1]
    assert scored[0].choices == scored[1].choices and scored[2].choices[0].action_prob == scored[0].choices[0].action_prob
    assert scored[2].baseline == pytest.approx(2.5 * scored[0].baseline)
