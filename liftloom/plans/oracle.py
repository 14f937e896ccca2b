"""The registered queries once more, as SQL for another engine. Set-based and plain, to check the Spark jobs against.

Each query is a final SELECT over named steps; the steps it needs are put in front of it.
"""

from __future__ import annotations

import re

GAP = {"standard": 21_600_000, "lab": 3_600_000}
HINT = 7_200_000
EXPIRY = 43_200_000
KEPT = 50

STEPS: dict[str, str] = {}

STEPS["raw"] = """SELECT event_id, ts, user_id, event_type AS src, value AS src_value,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events"""

STEPS["ev"] = f"""SELECT event_id, 'p' || (user_id % 3) AS project_id, 'u' || user_id AS session_id,
    CASE src WHEN 'purchase' THEN 'GOAL' WHEN 'click' THEN 'ACT' WHEN 'signup' THEN 'ATR' ELSE 'EVENT' END AS event_type,
    src || '_' || (k % 4) AS event_name,
    CASE WHEN src = 'purchase' THEN src_value ELSE 0.0 END AS value,
    CASE WHEN src NOT IN ('purchase', 'click', 'signup') AND k % 10 < 3 THEN 'ACT#click_' || (k % 4)
        WHEN src NOT IN ('purchase', 'click', 'signup') OR (src = 'purchase' AND k % 3 = 0) THEN 'L' || (k % 2)
        ELSE '' END AS label,
    CASE WHEN src = 'purchase' AND k % 4 = 1 THEN 'local' ELSE '' END AS hint,
    epoch_us(ts) // 1000 AS ts_ms,
    CASE WHEN user_id % 5 = 0 THEN 'lab' ELSE 'standard' END AS session_conf,
    CASE WHEN user_id % 5 = 0 THEN {GAP['lab']} ELSE {GAP['standard']} END AS gap_ms,
    k, src FROM raw"""


def _place_rows(rows_each: int | None) -> tuple[str, str, str, str]:
    """Steps from events to rows with session, pane and place."""
    pane, place = (f"seq // {rows_each}", f"seq % {rows_each}") if rows_each else ("0", "seq")
    ended = """SELECT *, max(ts_ms + gap_ms) OVER (PARTITION BY project_id, session_id ORDER BY ts_ms, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS end_before FROM ev"""
    numbered = """SELECT *, sum(CASE WHEN end_before IS NULL OR ts_ms >= end_before THEN 1 ELSE 0 END) OVER (
        PARTITION BY project_id, session_id ORDER BY ts_ms, event_id) AS sno FROM ended"""
    placed = """SELECT *, row_number() OVER w - 1 AS seq, min(ts_ms) OVER w AS session_start,
        max(ts_ms + gap_ms) OVER w - 1 AS run_end FROM numbered
        WINDOW w AS (PARTITION BY project_id, session_id, sno ORDER BY ts_ms, event_id)"""
    rows = f"""SELECT *, {pane} AS pane, {place} AS place, event_type || '#' || event_name AS x,
        CAST(make_timestamp(1000 * max(run_end) OVER (PARTITION BY project_id, session_id, sno, {pane})) AS DATE) AS day
        FROM placed"""
    return ended, numbered, placed, rows


STEPS["ended"], STEPS["numbered"], STEPS["placed"], STEPS["rows_"] = _place_rows(None)
_, _, _, STEPS["rows_of_three"] = _place_rows(3)

STEPS["session_list"] = """SELECT project_id, session_id, min(ts_ms) AS start_ms, max(run_end) AS end_ms,
    count(*) AS n_events FROM placed GROUP BY project_id, session_id, sno"""

_SAME = "{0}.project_id = {1}.project_id AND {0}.session_id = {1}.session_id AND {0}.sno = {1}.sno AND {0}.pane = {1}.pane"


def _reach(kind: str, marker: str) -> str:
    same = _SAME.format("m", "o")
    return f"""SELECT o.*, coalesce(CASE WHEN {marker} <> '' THEN (SELECT max(m.place) FROM rows_ m
        WHERE {same} AND m.event_type = 'EVENT' AND m.label = {marker} AND m.ts_ms < o.ts_ms) END, -1) AS reach
        FROM rows_ o WHERE o.event_type = '{kind}'"""


STEPS["goals"] = _reach("GOAL", "o.label")
STEPS["acts"] = _reach("ACT", "o.x")

STEPS["event_leaves"] = "SELECT project_id, day, '[AL]' AS goal, '' AS action, x AS leaf FROM rows_"
STEPS["session_leaves"] = """SELECT project_id, day, '[AL]' AS goal, '' AS action, '[TS]' AS leaf FROM rows_ WHERE place = 0
    UNION ALL SELECT project_id, day, x, '', '[TS]' FROM (
        SELECT DISTINCT project_id, session_id, sno, pane, day, x FROM rows_ WHERE event_type = 'GOAL')"""
STEPS["goal_leaves"] = f"""SELECT g.project_id, g.day, g.x AS goal, '' AS action, e.x AS leaf FROM goals g JOIN rows_ e
    ON {_SAME.format('g', 'e')} WHERE e.event_type = 'ATR' OR (e.ts_ms < g.ts_ms AND e.place >= g.reach
        AND (g.hint <> 'local' OR g.ts_ms - e.ts_ms <= {HINT}))"""
STEPS["action_leaves"] = f"""SELECT a.project_id, a.day, '[AL]' AS goal, a.x AS action, e.x AS leaf FROM acts a JOIN rows_ e
    ON {_SAME.format('a', 'e')} WHERE e.event_type = 'ATR' OR (e.ts_ms < a.ts_ms AND e.place >= a.reach)
    UNION ALL SELECT project_id, day, '[AL]', x, '[TS]' FROM acts"""
STEPS["goal_action_leaves"] = f"""SELECT g.project_id, g.day, g.x AS goal, a.x AS action, e.x AS leaf
    FROM acts a JOIN goals g ON {_SAME.format('a', 'g')} AND g.ts_ms > a.ts_ms JOIN rows_ e ON {_SAME.format('a', 'e')}
    WHERE e.event_type = 'ATR' OR (e.ts_ms < a.ts_ms AND (g.label = '' OR e.place >= a.reach)
        AND (g.hint <> 'local' OR g.ts_ms - e.ts_ms <= {HINT}))
    UNION ALL SELECT project_id, day, goal, action, '[TS]' FROM (
        SELECT DISTINCT a.project_id, a.day, a.event_id, a.x AS action, g.x AS goal FROM acts a JOIN goals g
        ON {_SAME.format('a', 'g')} AND g.ts_ms > a.ts_ms)"""
STEPS["all_leaves"] = """SELECT * FROM event_leaves UNION ALL SELECT * FROM session_leaves UNION ALL
    SELECT * FROM goal_leaves UNION ALL SELECT * FROM action_leaves UNION ALL SELECT * FROM goal_action_leaves"""


STEPS["few_leaves"] = """SELECT * FROM event_leaves UNION ALL SELECT * FROM session_leaves UNION ALL
    SELECT * FROM goal_leaves UNION ALL SELECT * FROM action_leaves"""


def _counted(leaves: str) -> str:
    return f"""SELECT project_id, day, goal, action, leaf, CAST(count(*) AS BIGINT) AS n FROM {leaves}
        GROUP BY ALL UNION ALL SELECT project_id, day, goal, action, '[TE]', CAST(count(*) AS BIGINT) FROM {leaves}
        WHERE leaf <> '[TS]' GROUP BY ALL"""


for _name in ("event", "session", "goal", "action", "goal_action", "few", "all"):
    STEPS[f"{_name}_counts"] = _counted(f"{_name}_leaves")


def _keyed(counts: str) -> str:
    return f"""SELECT project_id, day, goal || '::' || CASE WHEN action <> '' THEN action || '::' ELSE '' END || leaf AS rec_key,
        CASE WHEN goal <> '[AL]' THEN n ELSE 0 END AS success, n AS total FROM {counts}"""


STEPS["req"] = """SELECT event_id AS request_id, project_id, session_id, session_conf, ts_ms,
    CAST(DATE '2024-01-30' - CAST(k % 3 AS INTEGER) AS DATE) AS as_of, k,
    CASE WHEN k % 4 = 0 THEN 0 ELSE 30 END AS days,
    CASE WHEN k % 4 = 0 THEN 1.0 ELSE CAST(k % 4 AS DOUBLE) END AS reward, k % 2 = 1 AS gainonly,
    (['e', 'G', 'EG', 's', 'CEG', 'cs', ''])[k % 7 + 1] AS explore,
    CASE WHEN k % 3 = 0 THEN '' ELSE 'a' || (k % 3) END AS anchor_id, k % 5 = 0 AS mute,
    ([0, -1, 3, 2, 10, 0])[k % 6 + 1] AS ctxlength, 'L' || (k % 2) AS label, k % 2 = 0 AS detail,
    'purchase_' || (k % 2) AS goal,
    CASE WHEN k % 9 = 0 THEN ['EVENT#view_' || (k % 4), '', ''] ELSE ['EVENT#view_' || (k % 4), 'ATR#signup_' || (k % 4)] END AS sent
    FROM ev"""

STEPS["odd_requests"] = """SELECT request_id, CASE WHEN request_id % 11 = 3 THEN request_id % 8 ELSE 3 END AS goals,
    request_id % 13 = 4 AS no_goal, CASE WHEN request_id % 17 = 5 THEN request_id % 14 ELSE 4 END AS actions,
    CASE WHEN request_id % 7 = 2 THEN -(request_id % 5) ELSE ctxlength END AS ctx FROM req"""
STEPS["action_span"] = """SELECT request_id, project_id,
    CAST(as_of - CAST(CASE WHEN days = 0 THEN 7 ELSE days END - 1 AS INTEGER) AS DATE) AS start_day, as_of AS end_day FROM req"""
STEPS["predict_span"] = """SELECT request_id, project_id,
    CAST(as_of - CAST(CASE WHEN days = 0 THEN 3 ELSE days END - 1 AS INTEGER) AS DATE) AS start_day, as_of AS end_day FROM req"""
STEPS["spans"] = """SELECT DISTINCT project_id, start_day, end_day FROM action_span
    UNION SELECT DISTINCT project_id, start_day, end_day FROM predict_span"""


STEPS["windowed"] = """SELECT s.project_id, s.start_day, s.end_day, c.goal, c.action, c.leaf, CAST(sum(c.n) AS BIGINT) AS n
    FROM all_counts c JOIN spans s ON c.project_id = s.project_id AND c.day BETWEEN s.start_day AND s.end_day GROUP BY ALL"""

# session context
STEPS["list_steps"] = f"""SELECT *, ts_ms - lag(ts_ms) OVER w >= {EXPIRY} AS fresh FROM (
    SELECT project_id, session_id, CASE event_type WHEN 'EVENT' THEN 'evt' ELSE 'atr' END AS kind, ts_ms, event_id,
    event_type || '#' || event_name AS x FROM ev WHERE event_type IN ('EVENT', 'ATR'))
    WINDOW w AS (PARTITION BY project_id, session_id, kind ORDER BY ts_ms, event_id)"""
STEPS["list_chains"] = """SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (
    PARTITION BY project_id, session_id, kind ORDER BY ts_ms, event_id) AS chain FROM list_steps"""
STEPS["asked"] = f"""SELECT r.request_id, r.ts_ms AS asked_ms, s.kind, s.x, s.chain, s.ts_ms, r.ctxlength,
    row_number() OVER w AS back, first_value(s.chain) OVER w AS last_chain, first_value(s.ts_ms) OVER w AS last_ms
    FROM req r JOIN list_chains s ON r.project_id = s.project_id AND r.session_id = s.session_id AND s.ts_ms <= r.ts_ms
    WINDOW w AS (PARTITION BY r.request_id, s.kind ORDER BY s.ts_ms DESC, s.event_id DESC)"""
STEPS["alive"] = f"SELECT * FROM asked WHERE chain = last_chain AND asked_ms < last_ms + {EXPIRY} AND back <= {KEPT}"
STEPS["state_parts"] = """SELECT request_id, 1 AS part, -back AS nr, x FROM alive WHERE kind = 'evt' AND ctxlength <> -1
        AND back <= CASE WHEN ctxlength = 0 THEN 10 ELSE ctxlength END
    UNION ALL SELECT request_id, 2, -back, x FROM alive WHERE kind = 'atr' AND ctxlength <> -1
        AND back <= CASE WHEN ctxlength = 0 THEN 10 ELSE ctxlength END
    UNION ALL SELECT request_id, 3, nr, sent[nr] FROM (SELECT request_id, sent, unnest(range(1, len(sent) + 1)) AS nr FROM req)"""
STEPS["state_rows"] = """SELECT p.request_id, part, nr, x FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id, x ORDER BY part, nr) AS copy FROM state_parts) p
    JOIN req r ON p.request_id = r.request_id WHERE copy = 1 OR r.ctxlength = -1"""
STEPS["states"] = "SELECT request_id, list(x ORDER BY part, nr) AS states FROM state_rows GROUP BY request_id"

# scoring: every probe is judged on its own, from sums over its days
_KEY = "w.project_id = p.project_id AND w.start_day = p.start_day AND w.end_day = p.end_day"


def _number(goal: str, action: str, leaf: str) -> str:
    return f"""coalesce((SELECT w.n FROM windowed w WHERE {_KEY} AND w.goal = {goal} AND w.action = {action}
        AND w.leaf = {leaf}), 0)"""


def _judged(lookups: str) -> str:
    total = "CASE WHEN p.leaf = '[TS]' THEN '[TS]' ELSE '[TE]' END"
    return f"""SELECT *, CASE WHEN leaf = '[TS]' THEN CASE WHEN b > 10 THEN ln(prior) END
            WHEN t > 0 AND a > 0 THEN ln((s + 1.0) / (t + 100.0)) END AS lt,
        CASE WHEN leaf = '[TS]' THEN CASE WHEN b > 10 THEN ln(1 - prior) END
            WHEN t > 0 AND a > 0 THEN CASE WHEN den = 0 AND num > 0 THEN 'inf'::DOUBLE WHEN den = 0 AND num = 0 THEN 'nan'::DOUBLE
                WHEN den = 0 THEN ln(1e-9) WHEN num = 0 AND action <> '' THEN '-inf'::DOUBLE
                WHEN num / den <= 0 THEN ln(1e-9) ELSE ln(num / den) END END AS lf
        FROM (SELECT *, CAST(a - s + 1 AS DOUBLE) AS num, CAST(b - t + 100 AS DOUBLE) AS den,
            CASE WHEN s = 0 THEN 1e-9::DOUBLE WHEN s >= b THEN 0.999::DOUBLE ELSE CAST(s AS DOUBLE) / b END AS prior
        FROM (SELECT p.project_id, p.start_day, p.end_day, p.goal, p.action, p.leaf,
            {_number('p.goal', 'p.action', 'p.leaf')} AS s, {_number('p.goal', 'p.action', total)} AS t,
            {_number("'[AL]'", 'p.action', 'p.leaf')} AS a, {_number("'[AL]'", 'p.action', total)} AS b FROM {lookups} p))"""


STEPS["pairs"] = """SELECT c.project_id, s.start_day, s.end_day, c.goal, c.action, c.leaf FROM (
        SELECT DISTINCT project_id, goal, action, leaf FROM all_counts WHERE goal <> '[AL]' AND leaf <> '[TE]') c
    JOIN (SELECT DISTINCT project_id, start_day, end_day FROM action_span) s ON c.project_id = s.project_id"""
STEPS["judged_pairs"] = _judged("pairs")


def _pairs(shape: str) -> str:
    return f"""SELECT project_id, start_day, end_day, goal, action, leaf, s, t, a, b, round(lt, 6) AS log_true,
        round(lf, 6) + 0.0 AS log_false FROM judged_pairs WHERE {shape}"""


_PRIOR_PROBE = "SELECT request_id, item, project_id, start_day, end_day, goal, '' AS action, '[TS]' AS leaf, -1 AS place"
STEPS["predict_items"] = """SELECT r.request_id, i.item, s.project_id, s.start_day, s.end_day, r.k,
    (['GOAL#purchase_0', 'GOAL#purchase_' || (r.k % 4), 'GOAL#purchase_9'])[i.item + 1] AS goal
    FROM req r JOIN predict_span s ON r.request_id = s.request_id CROSS JOIN (SELECT unnest([0, 1, 2]) AS item) i"""
STEPS["predict_probes"] = f"""{_PRIOR_PROBE} FROM predict_items UNION ALL
    SELECT i.request_id, i.item, i.project_id, i.start_day, i.end_day, i.goal, '', x.x,
        row_number() OVER (PARTITION BY i.request_id, i.item ORDER BY x.part, x.nr) - 1
    FROM predict_items i JOIN state_rows x ON i.request_id = x.request_id"""
STEPS["action_items"] = """SELECT r.request_id, i.item, s.project_id, s.start_day, s.end_day, 'GOAL#' || r.goal AS goal,
    CASE WHEN i.item = -1 THEN '' ELSE 'ACT#click_' || i.item END AS action
    FROM req r JOIN action_span s ON r.request_id = s.request_id CROSS JOIN (SELECT unnest([-1, 0, 1, 2, 3]) AS item) i"""
STEPS["action_probes"] = f"""{_PRIOR_PROBE} FROM action_items UNION ALL
    SELECT i.request_id, i.item, i.project_id, i.start_day, i.end_day, i.goal, i.action, x.x, 0
    FROM action_items i JOIN state_rows x ON i.request_id = x.request_id"""
for _kind in ("predict", "action"):
    STEPS[f"{_kind}_lookups"] = f"""SELECT DISTINCT project_id, start_day, end_day, goal, action, leaf FROM {_kind}_probes"""
    STEPS[f"{_kind}_judged"] = _judged(f"{_kind}_lookups")
    STEPS[f"{_kind}_evidence"] = f"""SELECT p.*, j.lt, j.lf FROM {_kind}_probes p JOIN {_kind}_judged j
        ON p.project_id = j.project_id AND p.start_day = j.start_day AND p.end_day = j.end_day AND p.goal = j.goal
        AND p.action = j.action AND p.leaf = j.leaf"""
    STEPS[f"{_kind}_scores"] = f"""SELECT *, CASE WHEN has_prior AND known > 0 THEN 1 / (1 + exp(f - t)) ELSE -1.0 END AS p
        FROM (SELECT request_id, item, bool_or(place = -1 AND lt IS NOT NULL) AS has_prior,
            count(CASE WHEN place >= 0 AND lt IS NOT NULL THEN 1 END) AS known, sum(lt) AS t,
            sum(CASE WHEN lt IS NOT NULL THEN lf END) AS f FROM {_kind}_evidence GROUP BY request_id, item)"""

STEPS["judged_actions"] = """SELECT r.request_id, a.item, r.goal, 'click_' || a.item AS action, r.reward, b.p AS bp,
    b.p > 0 AND NOT isnan(b.p) AS baseline_ok, b.p > 0 AND NOT isnan(b.p) AND a.has_prior AND a.known > 0 AS learned, a.p AS ap,
    r.reward - (a.item / 10.0)::DOUBLE AS net, r.gainonly, r.explore, r.detail, a.has_prior
    FROM req r JOIN action_scores a ON r.request_id = a.request_id AND a.item >= 0
    JOIN action_scores b ON r.request_id = b.request_id AND b.item = -1"""
STEPS["results"] = """SELECT request_id, item, goal, action, CASE WHEN baseline_ok THEN bp ELSE 0.0 END AS baseline_prob,
    CASE WHEN baseline_ok THEN ap ELSE 0.0 END AS action_prob,
    CASE WHEN learned THEN (ap - bp) / bp * 100 ELSE 0.0 END AS lift,
    CASE WHEN learned THEN ap * net - bp * reward ELSE 0.0 END AS gain,
    CASE WHEN learned THEN ap * net ELSE 0.0 END AS expected_reward,
    CASE WHEN baseline_ok AND NOT learned THEN 1 ELSE 0 END AS code,
    CASE WHEN NOT baseline_ok OR learned THEN '' WHEN NOT has_prior THEN 'No Goal event can be referenced. Reason: 201'
        ELSE 'All predictor event(s) are not recognized. Reason: 202' END AS message,
    baseline_ok, learned, gainonly, explore, detail, bp, reward FROM judged_actions"""


def _u(salt: str) -> str:
    return f"(('0x' || substr(md5(request_id || '|{salt}'), 1, 8))::BIGINT / 4294967296.0)"


# one row per request, with everything the policies look at
STEPS["choices"] = f"""SELECT request_id, bool_and(baseline_ok) AS baseline_ok, bool_and(gainonly) AS gainonly,
    min(explore) AS explore, count(*) AS size, count(CASE WHEN NOT learned THEN 1 END) AS fresh,
    list(expected_reward ORDER BY item) AS vals, list(learned ORDER BY item) AS known,
    greatest(0.0, max(expected_reward)) AS best, greatest(0.0, coalesce(max(CASE WHEN learned THEN expected_reward END), 0.0)) AS best_learned,
    CASE WHEN bool_or(learned) THEN min(bp * reward) ELSE 0.0 END AS baseline,
    {_u('gate')} AS u_gate, {_u('pick')} AS u_pick, {_u('fresh')} AS u_fresh, {_u('fresh-pick')} AS u_fresh_pick,
    {_u('softmax')} AS u_soft FROM results GROUP BY request_id"""
STEPS["greedy"] = """SELECT *, coalesce(list_position(vals, best), 0) - 1 AS top FROM choices"""


def _softmax(name: str, value: str) -> str:
    return f"""SELECT request_id, coalesce(min(CASE WHEN upto / total > u_soft THEN item END), -1) AS pick FROM (
        SELECT request_id, item, u_soft, sum(w) OVER (PARTITION BY request_id ORDER BY item) AS upto,
            sum(w) OVER (PARTITION BY request_id) AS total FROM (
            SELECT r.request_id, r.item, c.u_soft, exp(({value}) / 0.1) AS w FROM results r JOIN choices c
            ON r.request_id = c.request_id)) GROUP BY request_id"""


STEPS["soft"] = _softmax("soft", "r.expected_reward")
STEPS["curious_soft"] = _softmax("curious_soft", "CASE WHEN r.learned THEN r.expected_reward ELSE c.best_learned END")
STEPS["policy_inputs"] = """SELECT g.*, s.pick AS soft_pick, k.pick AS curious_pick FROM greedy g
    JOIN soft s ON g.request_id = s.request_id JOIN curious_soft k ON g.request_id = k.request_id"""


def _eg(eps: float, strict: bool = False) -> tuple[str, str]:
    held = "best <= baseline" if strict else "best > baseline"
    pick = f"""CASE WHEN u_gate < {eps} THEN CAST(floor(u_pick * size) AS INTEGER) WHEN top < 0 THEN -1
        WHEN gainonly AND {held} THEN -1 ELSE top END"""
    mode = f"""CASE WHEN u_gate < {eps} THEN 'explore' WHEN top < 0 THEN 'error'
        WHEN gainonly AND {held} THEN 'suppress' ELSE 'exploit' END"""
    return pick, mode


def _policy(name: str, strict: bool = False) -> tuple[str, str]:
    if name in ("S", "CS"):
        pick = "soft_pick" if name == "S" else "curious_pick"
        return pick, f"CASE WHEN {pick} < 0 THEN 'error' ELSE 'softmax' END"
    pick, mode = _eg({"E": 1.0, "G": 0.0, "EG": 0.05, "CEG": 0.05}[name], strict)
    if name == "CEG":
        fresh = "u_fresh < fresh / CAST(size AS DOUBLE)"
        pick = f"CASE WHEN {fresh} THEN CAST(floor(u_fresh_pick * fresh) AS INTEGER) ELSE {pick} END"
        mode = f"CASE WHEN {fresh} THEN 'learn-action' ELSE {mode} END"
    return pick, mode


_NAMES = ("E", "G", "EG", "S", "CEG", "CS")


def _chosen(pick: str, mode: str) -> str:
    return f"""SELECT request_id, picked, CASE WHEN picked >= 0 THEN 'click_' || picked ELSE 'no-action' END AS decision, mode
        FROM (SELECT request_id, CAST(CASE WHEN baseline_ok THEN {pick} ELSE CAST(floor(u_pick * size) AS INTEGER) END AS INTEGER) AS picked,
            CASE WHEN baseline_ok THEN {mode} ELSE 'learn-goal' END AS mode FROM policy_inputs)"""


def _by_request() -> str:
    branches = {n: _policy(n) for n in _NAMES}
    pick = "CASE upper(explore) " + " ".join(f"WHEN '{n}' THEN {b[0]}" for n, b in branches.items())
    mode = "CASE upper(explore) " + " ".join(f"WHEN '{n}' THEN {b[1]}" for n, b in branches.items())
    return _chosen(f"{pick} ELSE {branches['EG'][0]} END", f"{mode} ELSE {branches['EG'][1]} END")


STEPS["chosen"] = _by_request()
STEPS["anchor_gaps"] = f"""SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY project_id, session_id, anchor_id
    ORDER BY ts_ms, request_id) >= {EXPIRY} AS fresh FROM req WHERE anchor_id <> ''"""
STEPS["anchor_runs"] = """SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, session_id, anchor_id
    ORDER BY ts_ms, request_id) AS run FROM anchor_gaps"""
STEPS["led"] = """SELECT request_id, first_value(request_id) OVER (PARTITION BY project_id, session_id, anchor_id, run
    ORDER BY ts_ms, request_id) AS leader_id FROM anchor_runs
    UNION ALL SELECT request_id, request_id FROM req WHERE anchor_id = ''"""
STEPS["decisions"] = """SELECT l.request_id, l.leader_id, l.request_id <> l.leader_id AS repeated, c.decision, c.mode
    FROM led l JOIN chosen c ON l.leader_id = c.request_id"""

# ingest
STEPS["pulse_rows"] = """SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY event_id) - 1 AS idx,
        first_value(project_id) OVER w AS p, first_value(session_id) OVER w AS s, first_value(session_conf) OVER w AS c,
        first_value(ts_ms) OVER w AS t, count(*) OVER (PARTITION BY request_id) AS listed FROM (
    SELECT (event_id // 64) * 4 + CASE WHEN event_id % 64 < 26 THEN 0 WHEN event_id % 64 < 36 THEN 1
            WHEN event_id % 64 < 60 THEN 2 ELSE 3 END AS request_id, event_id, project_id, session_id, session_conf, ts_ms,
        CASE WHEN event_id % 90 = 11 THEN repeat('é', 21) ELSE event_name END AS name,
        CASE WHEN event_id % 50 = 7 THEN event_type WHEN event_name LIKE 'error%' THEN 'event' ELSE lower(event_type) END AS type,
        CASE WHEN event_id % 70 = 3 THEN 5.0 ELSE value END AS value,
        CASE WHEN event_id % 80 = 9 THEN repeat('l', 41) ELSE label END AS label,
        CASE WHEN event_id % 85 = 4 THEN repeat('h', 41) ELSE hint END AS hint FROM ev)
    WINDOW w AS (PARTITION BY request_id ORDER BY event_id)"""
STEPS["pulse_judged"] = """SELECT *, CASE WHEN request_id % 11 = 4 THEN rpad(s, 61, 'x') ELSE s END AS sid,
        CASE WHEN request_id % 13 = 6 THEN 'bad-json' WHEN request_id % 7 = 5 THEN 'bad-timestamp'
            WHEN listed > 25 THEN 'too-many-events' WHEN request_id % 11 = 4 THEN 'long-session-id' END AS request_reason,
        CASE WHEN octet_length(encode(name)) > 40 THEN 'long-name' WHEN length(label) > 40 THEN 'long-label'
            WHEN length(hint) > 40 THEN 'long-hint' WHEN type NOT IN ('event', 'atr', 'goal', 'act') THEN 'bad-type'
            WHEN value <> 0 AND type <> 'goal' THEN 'bad-value' END AS reason FROM pulse_rows"""
STEPS["pulse_cut"] = """SELECT *, min(CASE WHEN reason IS NOT NULL THEN idx END) OVER (PARTITION BY request_id) AS first_bad
    FROM pulse_judged"""
STEPS["calls"] = """SELECT event_id AS request_id, CASE WHEN event_id % 17 = 5 THEN 'gone' ELSE project_id END AS project_id,
    CASE event_type WHEN 'ACT' THEN 'action' WHEN 'GOAL' THEN 'predict' ELSE 'pulse' END AS api,
    CASE label WHEN '' THEN NULL WHEN 'L0' THEN 'k-open' WHEN 'L1' THEN 'k-locked' ELSE 'k-none' END AS api_key FROM ev"""

FINAL: dict[str, str] = {
    "ingest_validate": """SELECT request_id * 32 + idx AS event_id, p AS project_id, sid AS session_id,
        upper(type) AS event_type, name AS event_name, value, label, hint,
        CASE WHEN request_id % 7 = 3 THEN t ELSE t - 5000 END AS ts_ms, c AS session_conf FROM pulse_cut
        WHERE request_reason IS NULL AND (first_bad IS NULL OR idx < first_bad)""",
    "ingest_rejects": """SELECT DISTINCT request_id, CAST(NULL AS INTEGER) AS idx, request_reason AS reason FROM pulse_cut
        WHERE request_reason IS NOT NULL UNION ALL SELECT request_id, CAST(idx AS INTEGER), reason FROM pulse_cut
        WHERE request_reason IS NULL AND idx = first_bad""",
    "message_round_trip": """SELECT event_id, project_id, session_id, event_type, event_name, value, label, hint, ts_ms,
        session_conf FROM ev""",
    "message_quarantine": """SELECT event_id, substr('{"projectid":"' || project_id || '","id":"' || session_id || '","event":', 1, 20) AS raw
        FROM ev WHERE event_id % 7 = 2""",
    "admission": """SELECT c.*, CAST(CASE WHEN p.project_id IS NULL OR p.deleted = 'D' THEN 404
            WHEN NOT coalesce((api = 'pulse' AND p.pulse = 'T') OR (api = 'predict' AND p.predict = 'T')
                OR (api = 'action' AND p.action = 'T'), false) THEN 200
            WHEN k.locked IS NULL THEN 403 WHEN k.locked <> 'F' THEN 401 ELSE 200 END AS INTEGER) AS status,
        CASE WHEN p.deleted <> 'D' THEN p.conf END AS session_conf
        FROM calls c LEFT JOIN (VALUES ('p0', 'F', 'F', 'F', 'F', 'standard'), ('p1', 'T', 'T', 'F', 'F', 'lab'),
            ('p2', 'F', 'F', 'F', 'D', 'standard')) p(project_id, pulse, predict, action, deleted, conf) ON c.project_id = p.project_id
        LEFT JOIN (VALUES ('k-open', 'F'), ('k-locked', 'T')) k(key_string, locked) ON c.api_key = k.key_string""",
    "session_route": "SELECT event_id, CAST(gap_ms AS BIGINT) AS gap_ms FROM ev",
    "sessions": "SELECT * FROM session_list",
    "session_panes": """SELECT event_id, session_start, pane, CAST(place AS INTEGER) AS place, run_end FROM rows_of_three""",
    "event_totals": _keyed("event_counts"),
    "session_totals": _keyed("session_counts"),
    "goal_event_counts": _keyed("goal_counts"),
    "action_event_counts": _keyed("action_counts"),
    "goal_action_counts": _keyed("goal_action_counts"),
    "daily_counts": _keyed("all_counts"),
    "outcome_tally": """SELECT project_id, event_name, CAST(sum(CASE WHEN label <> '' THEN 1 ELSE 0 END) AS BIGINT) AS success,
        count(*) AS total FROM ev GROUP BY ALL""",
    "event_distribution": """SELECT project_id, CASE WHEN leaf LIKE 'EVENT#%' THEN '[EVT-DIST]' WHEN leaf LIKE 'ATR#%' THEN '[ATR-DIST]'
        ELSE '[OTH-DIST]' END AS kind, day, leaf, CAST(0 AS BIGINT) AS success, n AS total FROM all_counts
        WHERE goal = '[AL]' AND action = ''""",
    "window_counts": """SELECT w.* FROM windowed w JOIN (SELECT DISTINCT project_id, start_day, end_day FROM action_span) s
        ON w.project_id = s.project_id AND w.start_day = s.start_day AND w.end_day = s.end_day""",
    "context_states": """SELECT request_id, kind, string_agg(x, ',' ORDER BY back DESC) AS tokens FROM alive WHERE back <= 3
        GROUP BY request_id, kind""",
    "merged_states": "SELECT request_id, array_to_string(states, ',') AS states FROM states",
    "class_prior": _pairs("leaf = '[TS]' AND action = ''"),
    "event_likelihood": _pairs("leaf <> '[TS]' AND action = ''"),
    "action_likelihood": _pairs("leaf <> '[TS]' AND action <> ''"),
    "action_class_prior": """SELECT project_id, start_day, end_day, goal, action, s, b, round(lt, 6) AS log_true,
        round(lf, 6) + 0.0 AS log_false FROM judged_pairs WHERE leaf = '[TS]' AND action <> ''""",
    "predict": """SELECT s.request_id, CAST(s.item AS INTEGER) AS item, substr(i.goal, 6) AS goal, round(p, 6) AS probability,
        CASE WHEN NOT has_prior OR known = 0 THEN 1 ELSE 0 END AS code,
        CASE WHEN NOT has_prior THEN 'No Goal event can be referenced. Reason: 101'
            WHEN known = 0 THEN 'All predictor event(s) are not recognized. Reason: 102' ELSE '' END AS message
        FROM predict_scores s JOIN predict_items i ON s.request_id = i.request_id AND s.item = i.item""",
    "predict_detail": """SELECT request_id, CAST(item AS INTEGER) AS item, goal, CAST(place AS INTEGER) AS place, leaf AS predictor,
        round(coalesce(lt, -1.0), 6) AS log_true, round(CASE WHEN lt IS NULL THEN -1.0 ELSE lf END, 6) + 0.0 AS log_false
        FROM predict_evidence WHERE place >= 0""",
    "rank_predictors": """SELECT project_id, start_day, end_day, goal, leaf, ratio, CAST(row_number() OVER (
            PARTITION BY project_id, start_day, end_day, goal ORDER BY ratio DESC, leaf) AS INTEGER) AS rank FROM (
        SELECT *, round(lt - lf, 6) + 0.0 AS ratio FROM judged_pairs
        WHERE leaf <> '[TS]' AND action = '' AND lt IS NOT NULL)""",
    "action_scores": """SELECT request_id, CAST(item AS INTEGER) AS item, goal, action, round(baseline_prob, 6) AS baseline_prob,
        round(action_prob, 6) AS action_prob, round(lift, 6) + 0.0 AS lift, round(gain, 6) + 0.0 AS gain,
        round(expected_reward, 6) + 0.0 AS expected_reward, code, message FROM results""",
    "action_response": """SELECT request_id, CAST(item AS INTEGER) AS item, CASE WHEN baseline_ok THEN goal ELSE '' END AS goal,
        CASE WHEN baseline_ok THEN action ELSE '' END AS action, round(action_prob, 6) AS action_prob, code FROM results
        WHERE detail OR NOT baseline_ok""",
    **{f"policy_{n.lower()}": _chosen(*_policy(n)) for n in _NAMES},
    "policy_by_request": "SELECT * FROM chosen",
    "policy_strict_gain": _chosen(*_policy("G", strict=True)),
    "sticky_decisions": "SELECT * FROM decisions",
    "decision_feedback": """SELECT -d.request_id - 1 AS event_id, r.project_id, r.session_id, 'ACT' AS event_type,
        d.decision AS event_name, CAST(0 AS DOUBLE) AS value, r.label, '' AS hint, r.ts_ms, r.session_conf
        FROM decisions d JOIN req r ON d.request_id = r.request_id WHERE NOT d.repeated AND NOT r.mute""",
    "stream_sessions": "SELECT project_id, session_id, start_ms, end_ms, n_events FROM session_list",
    "request_rejects": """SELECT request_id, CASE WHEN goals NOT BETWEEN 1 AND 5 THEN 'goals' WHEN ctx < -1 THEN 'ctxlength' END AS reason,
        'predict' AS api FROM odd_requests WHERE goals NOT BETWEEN 1 AND 5 OR ctx < -1
        UNION ALL SELECT request_id, CASE WHEN no_goal THEN 'goal' WHEN actions NOT BETWEEN 1 AND 10 THEN 'actions' ELSE 'ctxlength' END,
        'action' FROM odd_requests WHERE no_goal OR actions NOT BETWEEN 1 AND 10 OR ctx < -1""",
}

STEPS["sent_bodies"] = """SELECT *, request_id % 13 = 6 OR request_id % 19 = 2 OR (request_id % 2 = 1 AND request_id % 23 = 4) AS bad,
    CAST(CASE WHEN request_id % 17 = 3 THEN 0 ELSE days END AS BIGINT) AS body_days,
    CAST(CASE WHEN request_id % 29 = 8 THEN -5 ELSE ctxlength END AS BIGINT) AS body_ctx,
    'event#view_' || (k % 4) || CASE WHEN k % 9 = 0 THEN ',EVENT#odd' ELSE '' END || ',atr#signup_' || (k % 4) AS body_states FROM req"""
FINAL["decoded_predicts"] = """SELECT request_id, body_days AS days, body_ctx AS ctxlength, body_states AS states,
    CASE WHEN request_id % 31 = 9 THEN 'g,g,g,g,g,g' ELSE 'purchase_0,purchase_' || (k % 4) || ',purchase_9' END AS goals FROM sent_bodies WHERE NOT bad"""
FINAL["decoded_actions"] = """SELECT request_id, body_days AS days, body_ctx AS ctxlength, body_states AS states,
    CASE WHEN request_id % 37 = 1 THEN '' ELSE 'click_0,click_1,click_2,click_3' END AS actions, CASE WHEN request_id % 31 = 9 THEN '' ELSE goal END AS goal,
    anchor_id, gainonly, explore, mute, label, detail, CAST(k % 4 AS DOUBLE) AS reward FROM sent_bodies WHERE NOT bad"""
FINAL["body_rejects"] = """SELECT * FROM (SELECT request_id, 'predict' AS api,
        CASE WHEN bad THEN 'bad-json' WHEN request_id % 31 = 9 THEN 'goals' WHEN body_ctx < -1 THEN 'ctxlength' END AS reason FROM sent_bodies
        UNION ALL SELECT request_id, 'action', CASE WHEN bad THEN 'bad-json' WHEN request_id % 31 = 9 THEN 'goal'
            WHEN request_id % 37 = 1 THEN 'actions' WHEN body_ctx < -1 THEN 'ctxlength' END FROM sent_bodies) WHERE reason IS NOT NULL"""
FINAL["stream_daily_counts"] = _keyed("all_counts")
_DOUBLED = """(SELECT * REPLACE (CASE WHEN day = DATE '2024-01-10' THEN 2 * n ELSE n END AS n) FROM all_counts)"""
FINAL["counts_upsert"] = _keyed(_DOUBLED)
FINAL["count_range_scan"] = _keyed("all_counts") + " WHERE day BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'"
FINAL["flat_view"] = f"""SELECT project_id, rec_key || '::' || strftime(day, '%Y%m%d') AS key, success, total FROM ({_keyed('all_counts')})
    UNION ALL SELECT project_id, CASE WHEN leaf LIKE 'EVENT#%' THEN '[EVT-DIST]' WHEN leaf LIKE 'ATR#%' THEN '[ATR-DIST]' ELSE '[OTH-DIST]' END
    || '::' || strftime(day, '%Y%m%d') || '::' || leaf, CAST(0 AS BIGINT), n FROM all_counts WHERE goal = '[AL]' AND action = ''"""
FINAL["daily_counts_paned"] = _keyed("all_counts")
FINAL["long_session_counts"] = _keyed("few_counts")
FINAL["long_session_goal_actions"] = _keyed("goal_action_counts")


def _merged_users(users: int) -> str:
    return f"""SELECT * REPLACE ('p' AS project_id, 's' || (CAST(substr(session_id, 2) AS BIGINT) % {users}) AS session_id,
        259200000 AS gap_ms) FROM ({STEPS['ev']})"""


_OTHER = "CASE WHEN event_id % 3 = 0 THEN CASE session_conf WHEN 'lab' THEN 'standard' ELSE 'lab' END ELSE session_conf END"
_MIXED = f"""SELECT * REPLACE (CASE {_OTHER} WHEN 'lab' THEN {GAP['lab']} ELSE {GAP['standard']} END AS gap_ms) FROM ({STEPS['ev']})"""
FINAL["mixed_sessions"] = "SELECT * FROM session_list"
FINAL["mixed_session_rows"] = "SELECT event_id, session_start, place, run_end FROM rows_"

# p0 is let in without a key, p1 with one that is not locked, p2 is deleted
_ADMITTED = f"""SELECT event_id, project_id, session_id, event_type, event_name, value, label, hint, ts_ms,
    CASE project_id WHEN 'p1' THEN {GAP['lab']} ELSE {GAP['standard']} END AS gap_ms FROM ({FINAL['ingest_validate']})
    WHERE project_id = 'p0' OR (project_id = 'p1' AND (event_id // 32) % 5 < 3)"""
FINAL["admitted_sessions"] = "SELECT * FROM session_list"
FINAL["published_sessions"] = "SELECT * FROM session_list"
FINAL["tokens_by_text"] = """SELECT event_name, row_number() OVER (ORDER BY event_name) - 1 AS text_place,
    row_number() OVER (ORDER BY length(event_name), event_name) - 1 AS length_place FROM (SELECT DISTINCT event_name FROM ev)"""
FINAL["list_dump"] = "SELECT request_id, kind, string_agg(x, ',' ORDER BY back DESC) AS tokens FROM alive GROUP BY request_id, kind"
FINAL["list_clear"] = FINAL["list_dump"]
_CLEARED = """ AND NOT EXISTS (SELECT 1 FROM ev c WHERE c.event_id % 20 = 9 AND c.project_id = r.project_id
    AND c.session_id = r.session_id AND c.ts_ms >= s.ts_ms AND c.ts_ms <= r.ts_ms) WINDOW"""
FINAL["predict_stored"] = FINAL["predict"]
FINAL["stream_late_rows"] = """SELECT event_id, project_id, session_id, ts_ms, event_id % 50 = 7 AND ts_ms + gap_ms - 1 <=
    (SELECT max(ts_ms) - 60000 FROM ev WHERE event_id % 50 <> 7) AS late FROM ev"""

# sessions of the second micro-batch are counted apart, under project ids of their own
_SECOND = "CAST(substr(session_id, 2) AS BIGINT) % 7 = 3"
_APART = f"SELECT * REPLACE (CASE WHEN {_SECOND} THEN project_id || '+' ELSE project_id END AS project_id) FROM ({STEPS['ev']})"
STEPS["sealed_parts"] = f"""SELECT rtrim(project_id, '+') AS project_id, day, goal, action, leaf, n,
    CASE WHEN ends_with(project_id, '+') AND epoch_ms(CAST(day + 1 AS TIMESTAMP)) + 14400000 <= (
        SELECT max(ts_ms) FROM ev WHERE NOT ({_SECOND})) THEN 'correction' ELSE 'total' END AS kind FROM all_counts"""
STEPS["sealed_counts"] = "SELECT project_id, day, goal, action, leaf, kind, CAST(sum(n) AS BIGINT) AS n FROM sealed_parts GROUP BY ALL"
FINAL["stored_refresh"] = _keyed("sealed_counts").replace("n AS total", "n AS total, kind")


def _again(text: str) -> str:
    """The steps from events to counts once more, over other events."""
    return re.sub(r"\b(FROM|JOIN)(\s+)(ev|ended|numbered|placed|rows_|goals|acts|\w+_leaves|all_counts)\b", r"\1\2\3_again", text)


for _name in ("ended", "numbered", "placed", "rows_", "goals", "acts", "all_leaves", "all_counts", *(f"{f}_leaves" for f in ("event", "session", "goal", "action", "goal_action"))):
    STEPS[f"{_name}_again"] = _again(STEPS[_name])
STEPS["ev_again"] = f"""SELECT event_id, project_id, session_id, event_type, event_name, label, hint, ts_ms, gap_ms FROM ev
    UNION ALL SELECT event_id, project_id, session_id, event_type, event_name, label, hint, ts_ms,
    CASE session_conf WHEN 'lab' THEN {GAP['lab']} ELSE {GAP['standard']} END FROM ({FINAL['decision_feedback']})"""
FINAL["decision_recount"] = _keyed("all_counts_again")


# steps that differ for some queries
VARIANTS = {
    "daily_counts_paned": {"rows_": STEPS["rows_of_three"]},
    "long_session_counts": {"ev": _merged_users(5)},
    "long_session_goal_actions": {"ev": _merged_users(30)},
    "list_clear": {"asked": re.sub(r"\s+WINDOW", _CLEARED, STEPS["asked"])},
    "mixed_sessions": {"ev": _MIXED},
    "mixed_session_rows": {"ev": _MIXED},
    "stored_refresh": {"ev": _APART},
    # the steps of ingest read the events as they are
    "admitted_sessions": {"ended": STEPS["ended"].replace("FROM ev", f"FROM ({_ADMITTED})")},
}


def _sql(final: str, steps: dict[str, str]) -> str:
    needed: list[str] = []

    def add(text: str) -> None:
        for name in steps:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                add(steps[name])
                if name not in needed:
                    needed.append(name)

    add(final)
    if not needed:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in needed) + "\n" + final


def oracle_sql() -> dict[str, str]:
    return {
        name: _sql(final, {**STEPS, **VARIANTS.get(name, {})})
        for name, final in FINAL.items()
    }
