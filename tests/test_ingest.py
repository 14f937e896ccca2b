"""Request checks, prefix acceptance, messages, admission."""

import base64

from liftloom.operators.admission import admit
from liftloom.schemas import PROJECT_KEYS, PROJECTS
from liftloom.sources import fixtures, pulses

RAW = "request_id long, project_id string, session_id string, session_conf string, arrival_ms long, encoded boolean, body string"


def checked(spark, bodies):
    rows = [(n, "p", s, "standard", 1000 + n, enc, body) for n, (s, enc, body) in enumerate(bodies)]
    return pulses.check_requests(pulses.decode_bodies(spark.createDataFrame(rows, RAW)))


def one(name="a", **fields):
    parts = {"name": name, **fields}
    return "{" + ",".join(f'"{k}":{v if isinstance(v, (int, float)) else chr(34) + v + chr(34)}' for k, v in parts.items()) + "}"


def body(*events, timestamp=None):
    stamp = f',"timestamp":"{timestamp}"' if timestamp is not None else ""
    return '{"events":[' + ",".join(events) + "]" + stamp + "}"


def test_requests(spark):
    bodies = [
        ("s", False, body(one(), timestamp="2024-01-01T00:00:01.500Z")),
        ("s", True, base64.b64encode(body(one(), timestamp="2024-01-01T02:00:00+02:00").encode()).decode()),
        ("s", False, body(one())),
        ("s", False, body(one(), timestamp="2024-01-01 00:00:00")),
        ("s", False, body(*[one()] * 26)),
        ("x" * 61, False, body(one())),
        ("é" * 30, False, body(*[one()] * 25)),
        ("s", False, '{"events": ['),
        ("s", False, body(one(value="text"))),
        ("s", True, "%%%"),
        ("s", False, "{}"),
    ]
    rows = {r.request_id: r for r in checked(spark, bodies).collect()}
    assert [rows[n].request_reason for n in range(11)] == [
        None, None, None, "bad-timestamp", "too-many-events", "long-session-id", None, "bad-json", "bad-json", "bad-json", None,
    ]
    assert rows[0].ts_ms == 1_704_067_201_500 and rows[1].ts_ms == 1_704_067_200_000 and rows[2].ts_ms == 1002


def test_events_up_to_the_first_bad_one(spark):
    bodies = [
        ("s", False, body(one("a"), one("b", type="goal", value=5), one("c", type="EVENT"), one("d"))),
        ("s", False, body(one("a", value=5))),
        ("s", False, body(one("é" * 21))),
        ("s", False, body(one("é" * 20), one("b", label="l" * 41))),
        ("s", False, body(one("a", type="act"), one("b", hint="h" * 41, type="nope"))),
        ("s", False, body(one("a", type="atr"))),
    ]
    result = checked(spark, bodies)
    kept = [(r.event_id, r.event_type, r.event_name, r.value) for r in pulses.accepted_events(result).orderBy("event_id").collect()]
    assert kept == [
        (0, "EVENT", "a", 0.0), (1, "GOAL", "b", 5.0), (96, "EVENT", "é" * 20, 0.0), (128, "ACT", "a", 0.0), (160, "ATR", "a", 0.0),
    ]
    assert sorted(map(tuple, pulses.rejects(result).collect())) == [
        (0, 2, "bad-type"), (1, 0, "bad-value"), (2, 0, "long-name"), (3, 1, "long-label"), (4, 1, "long-hint"),
    ]


def test_checks_need_no_shuffle(spark):
    plan = pulses.accepted_events(checked(spark, [("s", False, body(one()))]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_messages(spark, make_events, tmp_path):
    events = make_events([(5, "EVENT", "a", "L", ""), (6, "GOAL", "b", "", "local")])
    path = str(tmp_path / "queue")
    pulses.publish(events, path)
    good, bad = pulses.split_messages(pulses.read_messages(spark, path))
    assert sorted(map(tuple, good.collect())) == sorted(map(tuple, events.collect())) and bad.count() == 0
    odd = spark.createDataFrame([(1, "{"), (2, '{"projectid":"p"}'), (3, None), (4, '{"type":"EVENT","event":"a","timestamp":7}')], "event_id long, value string")
    good, bad = pulses.split_messages(odd)
    assert [r.ts_ms for r in good.collect()] == [7]
    assert sorted(r.event_id for r in bad.collect()) == [1, 2, 3]


def test_admission(spark):
    calls = [
        (1, "p0", "predict", None), (2, "p1", "predict", "k-open"), (3, "p1", "predict", "k-locked"), (4, "p1", "predict", "k-x"),
        (5, "p1", "predict", None), (6, "p2", "predict", "k-open"), (7, "none", "predict", "k-open"), (8, "p1", "action", None),
    ]
    log = spark.createDataFrame(calls, "request_id long, project_id string, api string, api_key string")
    got = admit(log, spark.createDataFrame(fixtures.PROJECT_ROWS, PROJECTS), spark.createDataFrame(fixtures.PROJECT_KEY_ROWS, PROJECT_KEYS))
    assert {r.request_id: (r.status, r.session_conf) for r in got.collect()} == {
        1: (200, "standard"), 2: (200, "lab"), 3: (401, "lab"), 4: (403, "lab"), 5: (403, "lab"), 6: (404, None), 7: (404, None), 8: (200, "lab"),
    }


def test_predict_and_action_bodies(spark):
    columns = "request_id long, project_id string, session_id string, session_conf string, ts_ms long, as_of date, encoded boolean, body string"
    bodies = [
        '{"goal":"g","actions":[{"name":"x","cost":0.5},{"name":"y"}],"reward":2,"anchorid":"a","explore":"S","states":[{"name":"e","type":"event"}]}',
        '{"goal":"g","window":5,"actions":[{"name":"x"}],"mute":true,"ctxlength":-1}',
        '{"goal":',
    ]
    raw = spark.createDataFrame([(n, "p", "s", "standard", 0, None, False, b) for n, b in enumerate(bodies)], columns)
    one_, two = pulses.decode_actions(raw).orderBy("request_id").collect()
    assert (one_.goal, one_.anchor_id, one_.explore, one_.reward, one_.window, one_.mute, one_.ctxlength) == ("g", "a", "S", 2.0, 0, False, 0)
    assert [tuple(a) for a in one_.actions] == [("x", 0.5), ("y", None)] and [tuple(s) for s in one_.states] == [("e", "event")]
    assert (two.anchor_id, two.window, two.mute, two.ctxlength, two.gainonly) == ("", 5, True, -1, False)
    predicts = spark.createDataFrame([(7, "p", "s", "standard", 0, None, True, base64.b64encode(b'{"goals":["a","b"]}').decode())], columns)
    [row] = pulses.decode_predicts(predicts).collect()
    assert row.goals == ["a", "b"] and row.window == 0
