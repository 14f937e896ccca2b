"""Pair counts: a worked session, and random panes against plain loops over the rules."""

import random
import re
from collections import Counter

import pytest

from liftloom.config import HotKeys, SessionSettings
from liftloom.operators import chains, conversion, scans
from liftloom.operators.conversion import FAMILIES, GOAL, SESSION
from liftloom.operators.counts import daily_counts, keyed
from liftloom.operators.scans import before
from liftloom.operators.sessions import session_rows
from liftloom.session import written

DAY = 1_704_067_200_000

WORKED = [
    (0, "EVENT", "home", "", ""),
    (1000, "ATR", "vip", "", ""),
    (2000, "EVENT", "list", "L1", ""),
    (3000, "ACT", "promo", "", ""),
    (4000, "EVENT", "cart", "ACT#promo", ""),
    (10000, "ACT", "promo", "", ""),
    (70000, "EVENT", "pay", "", ""),
    (80000, "GOAL", "buy", "L1", ""),
    (81000, "GOAL", "buy", "", "local"),
]
EXPECTED = {
    "[AL]::EVENT#home": 1, "[AL]::EVENT#list": 1, "[AL]::EVENT#cart": 1, "[AL]::EVENT#pay": 1, "[AL]::ATR#vip": 1,
    "[AL]::ACT#promo": 2, "[AL]::GOAL#buy": 2, "[AL]::[TE]": 9, "[AL]::[TS]": 1,
    "[AL]::ACT#promo::EVENT#home": 1, "[AL]::ACT#promo::EVENT#list": 1, "[AL]::ACT#promo::EVENT#cart": 1,
    "[AL]::ACT#promo::ATR#vip": 2, "[AL]::ACT#promo::[TE]": 5, "[AL]::ACT#promo::[TS]": 2,
    "GOAL#buy::[TS]": 1, "GOAL#buy::EVENT#list": 1, "GOAL#buy::EVENT#cart": 1, "GOAL#buy::EVENT#pay": 2,
    "GOAL#buy::ACT#promo": 2, "GOAL#buy::GOAL#buy": 1, "GOAL#buy::ATR#vip": 2, "GOAL#buy::[TE]": 9,
    "GOAL#buy::ACT#promo::[TS]": 2, "GOAL#buy::ACT#promo::EVENT#home": 1, "GOAL#buy::ACT#promo::EVENT#list": 1,
    "GOAL#buy::ACT#promo::EVENT#cart": 1, "GOAL#buy::ACT#promo::ATR#vip": 4, "GOAL#buy::ACT#promo::[TE]": 7,
}


def counted(df):
    return {r.rec_key: r.total for r in keyed(df).collect()}


def test_worked_session(make_events):
    events = make_events([(DAY + t, *rest) for t, *rest in WORKED])
    rows = keyed(daily_counts(events, SessionSettings())).collect()
    assert {r.rec_key: r.total for r in rows} == EXPECTED
    assert all(r.success == (r.total if r.rec_key.startswith("GOAL#") else 0) for r in rows)
    assert {str(r.day) for r in rows} == {"2024-01-01"}


def test_panes_that_look_alike_are_one(spark, make_events):
    """Only panes with the same rows in all that counting knows are taken together, and counts stay as they were."""
    worked = [(DAY + t, *rest) for t, *rest in WORKED]
    changed = [
        worked,
        worked,
        [(t + 500, *rest) for t, *rest in worked],  # other times, the same order
        [(t + 86_400_000, *rest) for t, *rest in worked],  # another day
        [*worked[:-1], (*worked[-1][:4], "")],  # not local
        [*worked[:-1], (*worked[-1][:3], "L2", "local")],  # a label
        [*worked[:7], (worked[6][0], *worked[7][1:]), worked[8]],  # a goal at the time of the row before
        worked[:-1],
        [(t + (60_000 if t > DAY + 4000 else 0), *rest) for t, *rest in worked],  # as many rows further back than the hint
        [*worked[:-1], (worked[-1][0] + 60_000, *worked[-1][1:])],  # more of them
    ]
    events = make_events([(*row, f"s{n}", "standard", project) for n, rows in enumerate(changed) for project in ("p", "q") for row in rows])
    prepared = conversion.steps(session_rows(events, SessionSettings()), SessionSettings().local_hint_ms)
    together = written(conversion.alike(prepared), "alike")
    panes = together.groupBy("project_id", "session_id", "session_start", "pane").agg({"place": "count", "copies": "max"}).collect()
    assert sorted(r["max(copies)"] for r in panes) == [1] * 12 + [4] * 2
    for families in (FAMILIES, frozenset({SESSION}), frozenset({GOAL})):
        expected = conversion.leaf_counts(prepared, SessionSettings(), families)
        assert sorted(map(tuple, conversion.leaf_counts(together, SessionSettings(), families).collect())) == sorted(map(tuple, expected.collect()))


def test_copies_add_no_rows_to_count_from(make_events, monkeypatch):
    found = []
    for copies in (1, 4):
        sizes = {}

        def recorded(df, name, **more):
            table = written(df, name, **more)
            sizes[name] = sizes.get(name, 0) + table.count()
            return table

        monkeypatch.setattr(conversion, "written", recorded)
        events = make_events([(DAY + t, *rest, f"s{k}", "standard", "p") for t, *rest in WORKED for k in range(copies)])
        assert counted(daily_counts(events, SessionSettings())) == {key: copies * n for key, n in EXPECTED.items()}
        found.append(sizes)
    assert found[0] == found[1] and found[0]["steps"] == len(WORKED)


def test_families_can_be_asked_for_alone(make_events):
    events = make_events([(DAY + t, *rest) for t, *rest in WORKED])
    only = counted(daily_counts(events, SessionSettings(), frozenset({SESSION})))
    assert only == {"[AL]::[TS]": 1, "GOAL#buy::[TS]": 1}
    only = counted(daily_counts(events, SessionSettings(), frozenset({GOAL})))
    assert only == {k: v for k, v in EXPECTED.items() if k.startswith("GOAL#buy::") and k.count("::") == 1 and "[TS]" not in k}


def by_rule(pane, hint_ms):
    """Counts of one pane, straight from the rules. ``pane`` is in order of time."""
    found = Counter()
    token = [f"{kind}#{name}" for _, kind, name, _, _ in pane]
    at = [row[0] for row in pane]
    traits = [i for i, row in enumerate(pane) if row[1] == "ATR"]
    steps = [i for i, row in enumerate(pane) if row[1] != "ATR"]
    goals = [i for i, row in enumerate(pane) if row[1] == "GOAL"]
    acts = [i for i, row in enumerate(pane) if row[1] == "ACT"]

    def visible(i, marker):
        earlier = [e for e in steps if at[e] < at[i]]
        marks = [e for e in earlier if marker and pane[e][1] == "EVENT" and pane[e][3] == marker]
        return [e for e in earlier if not marks or e >= marks[-1]]

    def near(g, e):
        return pane[g][4] != "local" or at[g] - at[e] <= hint_ms

    def add(prefix, leaves):
        for e in leaves:
            found[f"{prefix}::{token[e]}"] += 1
            found[f"{prefix}::[TE]"] += 1

    found["[AL]::[TS]"] += 1
    add("[AL]", range(len(pane)))
    for name in {token[g] for g in goals}:
        found[f"{name}::[TS]"] += 1
    for g in goals:
        add(token[g], [e for e in visible(g, pane[g][3]) if near(g, e)] + traits)
    for a in acts:
        add(f"[AL]::{token[a]}", visible(a, token[a]) + traits)
        found[f"[AL]::{token[a]}::[TS]"] += 1
        later = [g for g in goals if at[g] > at[a]]
        for name in {token[g] for g in later}:
            found[f"{name}::{token[a]}::[TS]"] += 1
        for g in later:
            seen = visible(a, token[a] if pane[g][3] else "")
            add(f"{token[g]}::{token[a]}", [e for e in seen if near(g, e)] + traits)
    return found


@pytest.mark.parametrize("pane_rows", [25, None])
@pytest.mark.parametrize("seed", range(4))
def test_random_panes(make_events, seed, pane_rows):
    rng = random.Random(seed)
    rows, expected = [], Counter()
    for s in range(30):
        size = rng.choice([1, 2, 5, 20, 60])
        t, session = DAY, []
        for _ in range(size):
            t += rng.choice([0, 0, 1, 500, 30_000, 60_000])
            kind = rng.choice(["EVENT", "EVENT", "GOAL", "ACT", "ATR"])
            label = rng.choice(["", "L0", "L1", "ACT#n0", "ACT#n1"])
            session.append((t, kind, f"n{rng.randrange(3)}", label, rng.choice(["", "", "local", "far"])))
        rows += [(*r, f"s{s}", "standard", "p") for r in session]
        length = pane_rows or size
        for begin in range(0, size, length):
            expected += by_rule(session[begin : begin + length], 60_000)
    settings = SessionSettings(pane_rows=pane_rows)
    got = Counter()
    for key, n in ((r.rec_key, r.total) for r in keyed(daily_counts(make_events(rows), settings)).collect()):
        got[key] += n
    assert got == expected


def test_long_session_is_counted_whole(make_events):
    """More rows than any pane had: goals see all that came before."""
    kinds = ["EVENT", "ACT", "GOAL"]
    rows = [(DAY + n, kinds[n % 3], f"n{n % 6}", "", "") for n in range(1500)]
    got = counted(daily_counts(make_events(rows), SessionSettings(), FAMILIES))
    assert got["[AL]::[TE]"] == 1500
    assert got == dict(by_rule(rows, 60_000))


def busy_session(seed, size):
    rng = random.Random(seed)
    t, rows = DAY, []
    for _ in range(size):
        t += rng.choice([0, 0, 1, 500, 30_000])
        kind = rng.choice(["EVENT", "EVENT", "EVENT", "GOAL", "ACT", "ATR"])
        rows.append((t, kind, f"n{rng.randrange(3)}", rng.choice(["", "L0", "ACT#n0", "ACT#n1"]), rng.choice(["", "local"])))
    return rows


def test_a_third_of_the_rows_in_one_session(make_events, monkeypatch):
    """Long sessions are cut in every step: no window group and no slot is larger than twice what is asked for."""
    sizes, plans = [], []

    def measured(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        out = written(df, name)
        if "_slot" in out.columns:
            sizes.append(out.groupBy("_slot").count().agg({"count": "max"}).first()[0])
        return out

    for module in (chains, conversion, scans):
        monkeypatch.setattr(module, "written", measured)
    slot_rows = 60
    hot = busy_session(3, 500)
    others = {f"s{n}": busy_session(n, 10) for n in range(100)}
    rows = [(*r, "hot", "standard", "p") for r in hot] + [(*r, name, "standard", "p") for name, session in others.items() for r in session]
    df = daily_counts(make_events(rows), SessionSettings(hot_keys=HotKeys(min_rows=200, slot_rows=slot_rows)))
    plans.append(("counts", df._jdf.queryExecution().optimizedPlan().toString()))
    got = Counter()
    for r in keyed(df).collect():
        got[r.rec_key] += r.total
    assert got == sum((by_rule(session, 60_000) for session in others.values()), by_rule(hot, 60_000))
    assert sizes and max(sizes) <= 2 * slot_rows
    # once sessions are scanned, every window is within slots, or goes over one row per slot
    after = [plan for _, plan in plans[[name for name, _ in plans].index("steps") + 1 :]]
    windows = [line for plan in after for line in plan.splitlines() if re.search(r"Window \[", line)]
    assert windows and all("_slot" in line for line in windows)


def test_work_grows_with_leaves_and_not_with_steps_times_keys(make_events, monkeypatch):
    """20 goals and 20 actions in a session of many rows: few rows look up counts."""
    looked = []

    def measured(entries, asked, *args, **kwargs):
        looked.append(asked.count())
        return before(entries, asked, *args, **kwargs)

    monkeypatch.setattr(conversion, "before", measured)
    rng = random.Random(1)
    kinds = ["GOAL"] * 20 + ["ACT"] * 20 + ["EVENT"] * 960
    rng.shuffle(kinds)
    rows = [(DAY + 1000 * n, kind, f"n{rng.randrange(4)}", "", "") for n, kind in enumerate(kinds)]
    got = counted(daily_counts(make_events(rows), SessionSettings()))
    assert got == dict(by_rule(rows, 60_000))
    # 40 places, 12 tokens; steps times keys would be 1,000 x (4 + 4 + 16)
    assert sum(looked) <= 40 * 12
