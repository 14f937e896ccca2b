"""The registered queries, each over the whole ``events`` test table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftloom.config import SessionSettings, parse_gaps
from liftloom.functions import ordering
from liftloom.functions.ordering import rank_within
from liftloom.functions.tokens import ALL, NO_ACTION, SESSION_TOTAL
from liftloom.operators import actions, admission, context, conversion, counts, policies, scoring, sessions
from liftloom.schemas import PROJECT_KEYS, PROJECTS
from liftloom.session import shared_folder, tune, written
from liftloom.sources import counts_store, fixtures, pulses
from liftloom.streaming import jobs

# The test table is sparse, so gaps, hint and expiry are longer than the defaults.
SETTINGS = SessionSettings(gaps=parse_gaps("standard:21600, lab:3600"), local_hint_ms=7_200_000)
EXPIRY_MS = 43_200_000
KEPT = context.KEPT

Query = Callable[[SparkSession, str], DataFrame]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.load_events(tune(spark), folder)


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.requests(fixtures.load_raw(tune(spark), folder))


def _counts(spark: SparkSession, folder: str, *families: str) -> DataFrame:
    chosen = frozenset(families) or conversion.FAMILIES
    return counts.daily_counts(_events(spark, folder), SETTINGS, chosen)


def _flat(df: DataFrame) -> DataFrame:
    return counts.keyed(df)


# ingest


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return pulses.check_requests(pulses.decode_bodies(fixtures.pulse_log(_events(spark, folder))))


def ingest_validate(spark: SparkSession, folder: str) -> DataFrame:
    return pulses.accepted_events(_checked(spark, folder))


def ingest_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return pulses.rejects(_checked(spark, folder))


def message_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return pulses.split_messages(pulses.to_messages(_events(spark, folder)))[0]


def message_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that were cut off on the way go to quarantine."""
    messages = pulses.to_messages(_events(spark, folder))
    cut = messages.withColumn("value", F.expr("CASE WHEN event_id % 7 = 2 THEN substr(value, 1, 20) ELSE value END"))
    return pulses.split_messages(cut)[1]


def _admitted(spark: SparkSession, folder: str) -> DataFrame:
    projects = spark.createDataFrame(fixtures.PROJECT_ROWS, PROJECTS)
    keys = spark.createDataFrame(fixtures.PROJECT_KEY_ROWS, PROJECT_KEYS)
    return admission.admit(fixtures.call_log(_events(spark, folder)), projects, keys)


def admission_status(spark: SparkSession, folder: str) -> DataFrame:
    return _admitted(spark, folder)


# sessions and counts


def session_route(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.route(_events(spark, folder), SETTINGS).select("event_id", "gap_ms")


def session_list(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.sessions(_events(spark, folder), SETTINGS)


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Events of which every third has the other setting than its session."""
    other = "CASE WHEN event_id % 3 = 0 THEN CASE session_conf WHEN 'lab' THEN 'standard' ELSE 'lab' END ELSE session_conf END"
    return _events(spark, folder).withColumn("session_conf", F.expr(other))


def mixed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions whose rows have several settings: windows of different gaps that overlap are one session."""
    return sessions.sessions(_mixed(spark, folder), SETTINGS)


def mixed_session_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.session_rows(_mixed(spark, folder), SETTINGS).select("event_id", "session_start", "place", "run_end")


def admitted_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """From the request log to sessions: requests are let in by their project, and its setting is that of their events."""
    projects = spark.createDataFrame(fixtures.PROJECT_ROWS, PROJECTS)
    keys = spark.createDataFrame(fixtures.PROJECT_KEY_ROWS, PROJECT_KEYS)
    log = fixtures.pulse_log(_events(spark, folder)).withColumn("api_key", F.expr("CASE WHEN request_id % 5 < 3 THEN 'k-open' END"))
    let_in = pulses.admitted(log, projects, keys)
    return sessions.sessions(pulses.accepted_events(pulses.check_requests(pulses.decode_bodies(let_in))), SETTINGS)


def session_panes(spark: SparkSession, folder: str) -> DataFrame:
    small = SessionSettings(gaps=SETTINGS.gaps, local_hint_ms=SETTINGS.local_hint_ms, pane_rows=3)
    return sessions.session_rows(_events(spark, folder), small).select(
        "event_id", "session_start", "pane", "place", "run_end"
    )


def event_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_counts(spark, folder, conversion.EVENT))


def session_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_counts(spark, folder, conversion.SESSION))


def goal_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_counts(spark, folder, conversion.GOAL))


def action_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_counts(spark, folder, conversion.ACTION))


def goal_action_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_counts(spark, folder, conversion.GOAL_ACTION))


def daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_counts(spark, folder))


def daily_counts_paned(spark: SparkSession, folder: str) -> DataFrame:
    """Every three rows of a session counted as one of its own."""
    return _flat(counts.daily_counts(_events(spark, folder), replace(SETTINGS, pane_rows=3)))


# Users merged into few long sessions.
_LONG = replace(SETTINGS, gaps=parse_gaps("standard:259200, lab:259200"))


def _long_sessions(spark: SparkSession, folder: str, users: int) -> DataFrame:
    number = f"concat('s', cast(substr(session_id, 2) AS bigint) % {users})"
    return _events(spark, folder).withColumns({"project_id": F.lit("p"), "session_id": F.expr(number)})


def long_session_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of thousands of rows, without counts of goals after actions."""
    families = frozenset({conversion.EVENT, conversion.SESSION, conversion.GOAL, conversion.ACTION})
    return _flat(counts.daily_counts(_long_sessions(spark, folder, 5), _LONG, families))


def long_session_goal_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Goals after actions in sessions of hundreds of rows."""
    return _flat(counts.daily_counts(_long_sessions(spark, folder, 30), _LONG, frozenset({conversion.GOAL_ACTION})))


def request_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that are not answered: too many goals or actions, no goal, or a list length that is not valid."""
    asked = _requests(spark, folder).selectExpr(
        "request_id",
        "CASE WHEN request_id % 11 = 3 THEN array_repeat('g', cast(request_id % 8 AS int)) ELSE goals END AS goals",
        "CASE WHEN request_id % 13 = 4 THEN '' ELSE goal END AS goal",
        "CASE WHEN request_id % 17 = 5 THEN array_repeat('a', cast(request_id % 14 AS int)) ELSE transform(actions, a -> a.name) END AS actions",
        "CASE WHEN request_id % 7 = 2 THEN -(request_id % 5) ELSE ctxlength END AS ctxlength",
    )
    parts = [scoring.request_rejects(asked, api).withColumn("api", F.lit(api)) for api in ("predict", "action")]
    return parts[0].unionByName(parts[1])


def decoded_predicts(spark: SparkSession, folder: str) -> DataFrame:
    """Predict requests from their bodies."""
    asked = pulses.decode_predicts(fixtures.request_log(_requests(spark, folder), "predict"))
    return asked.selectExpr("request_id", "`window` AS days", "ctxlength", "concat_ws(',', goals) AS goals", _STATES)


def decoded_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Action requests from their bodies."""
    asked = pulses.decode_actions(fixtures.request_log(_requests(spark, folder), "action"))
    names = "concat_ws(',', transform(actions, a -> a.name)) AS actions"
    kept = ["goal", "anchor_id", "gainonly", "explore", "mute", "label", "detail", "reward"]
    return asked.selectExpr("request_id", "`window` AS days", "ctxlength", names, *kept, _STATES)


_STATES = "concat_ws(',', transform(states, s -> concat(s.type, '#', s.name))) AS states"


def body_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Every request of both kinds that is not answered, from its body on: not readable, or refused by a later check."""
    parts = []
    for api, decode in (("predict", pulses.decode_predicts), ("action", pulses.decode_actions)):
        log = fixtures.request_log(_requests(spark, folder), api)
        refused = pulses.refused_bodies(log, api).unionByName(scoring.request_rejects(decode(log), api))
        parts.append(refused.withColumn("api", F.lit(api)))
    return parts[0].unionByName(parts[1])


def _store(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """The counts, and a folder of days they are stored in."""
    counted = written(_counts(spark, folder), "counts")
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    counts_store.write_days(counted, path)
    return counted, path


def counts_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Store all days, then one of them again with other counts, and read them back."""
    counted, path = _store(spark, folder)
    twice = counted.where("day = date'2024-01-10'").withColumn("n", F.col("n") * 2)
    counts_store.write_days(twice, path)
    return _flat(counts_store.read_counts(spark, path))


def count_range_scan(spark: SparkSession, folder: str) -> DataFrame:
    _, path = _store(spark, folder)
    return _flat(counts_store.read_range(spark, path, "2024-01-08", "2024-01-12"))


def flat_view(spark: SparkSession, folder: str) -> DataFrame:
    _, path = _store(spark, folder)
    return counts_store.flat_view(counts_store.read_counts(spark, path))


#: sessions whose counts come in a second micro-batch
_SECOND = "cast(substr(session_id, 2) AS bigint) % 7 = 3"


def stored_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Two refreshes of the stored totals: the second brings sessions for all days, of which days ended four hours before the first's mark are sealed."""
    events = _events(spark, folder)
    base = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    first, second = events.where(f"NOT ({_SECOND})"), events.where(_SECOND)
    mark = first.agg(F.max("ts_ms")).first()[0]
    for batch_id, part in enumerate((first, second)):
        counts_store.write_increment(counts.daily_counts(part, SETTINGS), f"{base}/increments", batch_id)
        counts_store.refresh(spark, f"{base}/increments", f"{base}/store", mark)
    totals = _flat(counts_store.read_counts(spark, f"{base}/store")).withColumn("kind", F.lit("total"))
    return totals.unionByName(_flat(counts_store.read_corrections(spark, f"{base}/store")).withColumn("kind", F.lit("correction")))


def outcome_tally(spark: SparkSession, folder: str) -> DataFrame:
    """Successes and total of a yes/no outcome per key: did the event carry a label."""
    marked = _events(spark, folder).selectExpr("project_id", "event_name", "label <> '' AS hit")
    return counts.tally(marked, ["project_id", "event_name"], "hit")


def event_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return counts.distribution(_counts(spark, folder, conversion.EVENT, conversion.SESSION))


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return _requests(spark, folder).selectExpr("project_id", *scoring.day_span(scoring.ACTION_DAYS))


def window_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.window_counts(_counts(spark, folder), _spans(spark, folder))


# session context


def context_states(spark: SparkSession, folder: str) -> DataFrame:
    asking = _requests(spark, folder).withColumn("take", F.lit(3))
    return context.lists(_events(spark, folder), asking, EXPIRY_MS, KEPT).selectExpr(
        "request_id", "kind", "concat_ws(',', tokens) AS tokens"
    )


def _listed(spark: SparkSession, folder: str, clears: DataFrame | None) -> DataFrame:
    found = context.dump(_events(spark, folder), _requests(spark, folder), EXPIRY_MS, KEPT, clears)
    return found.selectExpr("request_id", "kind", "concat_ws(',', tokens) AS tokens")


def list_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Both lists, as a whole, at the time of every request."""
    return _listed(spark, folder, None)


def list_clear(spark: SparkSession, folder: str) -> DataFrame:
    """The same where some events clear the lists of their session."""
    clears = _events(spark, folder).where("event_id % 20 = 9").select("project_id", "session_id", "ts_ms")
    return _listed(spark, folder, clears)


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return context.merged_states(_events(spark, folder), _requests(spark, folder), EXPIRY_MS, KEPT)


def _states(spark: SparkSession, folder: str) -> DataFrame:
    """States as scoring takes them: a written table, as lookups and evidence both read it."""
    return written(_merged(spark, folder), "states")


def merged_states(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder).selectExpr("request_id", "concat_ws(',', states) AS states")


# scoring


def _likelihoods(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    """Likelihoods of every goal, action and leaf counted together, over every span asked for."""
    counted = written(_counts(spark, folder), "counts")
    pairs = counted.where(F.col("goal") != ALL).where(shape).select("project_id", "goal", "action", "leaf").distinct()
    return scoring.likelihoods(_asked_of(pairs, _spans(spark, folder)), counted)


def _asked_of(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every key of a project in every span asked for. Spans are written, as lookups are read several times and requests are many."""
    return pairs.join(written(spans.distinct(), "spans"), "project_id")


def _rounded_logs(df: DataFrame) -> DataFrame:
    return df.selectExpr(*scoring.LOOKUP, *"stab", "round(lt, 6) AS log_true", "round(lf, 6) AS log_false")


def class_prior(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_logs(_likelihoods(spark, folder, f"action = '{NO_ACTION}' AND leaf = '{SESSION_TOTAL}'"))


def event_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_logs(_likelihoods(spark, folder, f"action = '{NO_ACTION}' AND leaf LIKE '%#%'"))


def action_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_logs(_likelihoods(spark, folder, f"action <> '{NO_ACTION}' AND leaf LIKE '%#%'"))


def action_class_prior(spark: SparkSession, folder: str) -> DataFrame:
    counted = written(_counts(spark, folder, conversion.ACTION, conversion.GOAL_ACTION), "counts")
    pairs = counted.where((F.col("goal") != ALL) & (F.col("leaf") == SESSION_TOTAL))
    lookups = _asked_of(pairs.select("project_id", "goal", "action").distinct(), _spans(spark, folder))
    return scoring.action_priors(lookups, counted).selectExpr(
        *scoring.SPAN, "goal", "action", "s", "b", "round(lt, 6) AS log_true", "round(lf, 6) AS log_false"
    )


def predict(spark: SparkSession, folder: str) -> DataFrame:
    scored = scoring.predict(_requests(spark, folder), _states(spark, folder), _counts(spark, folder))
    return scored.withColumn("probability", F.round("probability", 6))


def predict_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same scores from stored counts: only the days that some request looks at are read."""
    _, path = _store(spark, folder)
    asked = _requests(spark, folder)
    held = counts_store.read_spans(spark, path, scoring.valid_predicts(asked).selectExpr("project_id", *scoring.day_span(scoring.PREDICT_DAYS)))
    return scoring.predict(asked, _states(spark, folder), held).withColumn("probability", F.round("probability", 6))


def predict_detail(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.predict_rows(_requests(spark, folder), _states(spark, folder), _counts(spark, folder))
    return scoring.score_detail(rows).drop("action").selectExpr(
        "request_id", "item", "goal", "place", "predictor", "round(log_true, 6) AS log_true",
        "round(log_false, 6) AS log_false",
    )


def rank_predictors(spark: SparkSession, folder: str) -> DataFrame:
    """Per goal and span, what speaks for it most: leaves by likelihood ratio."""
    known = _likelihoods(spark, folder, f"action = '{NO_ACTION}' AND leaf LIKE '%#%'").where("lt IS NOT NULL")
    ranked = known.withColumn("ratio", F.round(F.col("lt") - F.col("lf"), 6))
    return rank_within(ranked, [*scoring.SPAN, "goal"], F.col("ratio"), ["leaf"]).select(
        *scoring.SPAN, "goal", "leaf", "ratio", "rank"
    )


# actions


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return actions.score_actions(_requests(spark, folder), _states(spark, folder), _counts(spark, folder))


def action_scores(spark: SparkSession, folder: str) -> DataFrame:
    rounded = [f"round({c}, 6) AS {c}" for c in ("baseline_prob", "action_prob", "lift", "gain", "expected_reward")]
    return actions.action_results(_scored(spark, folder)).selectExpr(
        "request_id", "item", "goal", "action", *rounded, "code", "message"
    )


def action_response(spark: SparkSession, folder: str) -> DataFrame:
    """The results a response would list."""
    chosen = policies.choose(_scored(spark, folder))
    return actions.response_rows(chosen).selectExpr(
        "request_id", "item", "goal", "action", "round(action_prob, 6) AS action_prob", "code"
    )


def _policy(name: str | None) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return policies.choose(_scored(spark, folder), name).select("request_id", "picked", "decision", "mode")

    return query


def policy_strict_gain(spark: SparkSession, folder: str) -> DataFrame:
    return policies.choose(_scored(spark, folder), "G", strict_gain=True).select(
        "request_id", "picked", "decision", "mode"
    )


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    return actions.decide(
        _requests(spark, folder), _states(spark, folder), _counts(spark, folder), keep_ms=EXPIRY_MS
    )


def sticky_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder)


def decision_feedback(spark: SparkSession, folder: str) -> DataFrame:
    return actions.feedback_events(_requests(spark, folder), _decisions(spark, folder))


def decision_recount(spark: SparkSession, folder: str) -> DataFrame:
    """The closed loop: decisions become events, and the counts of the sessions they fall into are brought up to date."""
    events, asked = _events(spark, folder), _requests(spark, folder)
    counted = written(counts.daily_counts(events, SETTINGS), "counts")
    decided = actions.decide(asked, _states(spark, folder), counted, keep_ms=EXPIRY_MS)
    made = written(actions.feedback_events(asked, decided), "made")
    return _flat(counts.with_new_events(counted, events, made, SETTINGS))


def tokens_by_text(spark: SparkSession, folder: str) -> DataFrame:
    """The different names of events in text order, with their places in it and in order of length."""
    names = _events(spark, folder).select("event_name").distinct()
    placed = "cast(monotonically_increasing_id() AS bigint)"
    by_text = ordering.by_text(names, "event_name").coalesce(1).selectExpr("event_name", f"{placed} AS text_place")
    by_length = ordering.by_byte_length(names, "event_name").coalesce(1).selectExpr("event_name", f"{placed} AS length_place")
    return by_text.join(by_length, "event_name")


def published_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Events published as messages, read from their folder, and made sessions of."""
    queue = f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"
    pulses.publish(_events(spark, folder), queue)
    return sessions.sessions(pulses.split_messages(pulses.read_messages(spark, queue))[0], SETTINGS)


# streams

#: rows that come after all others
_HELD_BACK = "event_id % 50 = 7"


def stream_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every event once, and whether it came too late for the stream."""
    return jobs.drained_gate(tune(spark), folder, SETTINGS, _HELD_BACK)


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.drained_sessions(tune(spark), folder, SETTINGS)


def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(jobs.drained_counts(tune(spark), folder, SETTINGS))


QUERIES: dict[str, Query] = {
    "ingest_validate": ingest_validate,
    "ingest_rejects": ingest_rejects,
    "message_round_trip": message_round_trip,
    "message_quarantine": message_quarantine,
    "admission": admission_status,
    "session_route": session_route,
    "sessions": session_list,
    "session_panes": session_panes,
    "daily_counts_paned": daily_counts_paned,
    "long_session_counts": long_session_counts,
    "long_session_goal_actions": long_session_goal_actions,
    "request_rejects": request_rejects,
    "body_rejects": body_rejects,
    "decoded_predicts": decoded_predicts,
    "decoded_actions": decoded_actions,
    "counts_upsert": counts_upsert,
    "count_range_scan": count_range_scan,
    "flat_view": flat_view,
    "event_totals": event_totals,
    "session_totals": session_totals,
    "goal_event_counts": goal_event_counts,
    "action_event_counts": action_event_counts,
    "goal_action_counts": goal_action_counts,
    "daily_counts": daily_counts,
    "outcome_tally": outcome_tally,
    "event_distribution": event_distribution,
    "window_counts": window_counts,
    "context_states": context_states,
    "merged_states": merged_states,
    "class_prior": class_prior,
    "event_likelihood": event_likelihood,
    "action_likelihood": action_likelihood,
    "action_class_prior": action_class_prior,
    "predict": predict,
    "predict_detail": predict_detail,
    "rank_predictors": rank_predictors,
    "action_scores": action_scores,
    "action_response": action_response,
    **{f"policy_{p.lower()}": _policy(p) for p in policies.POLICIES},
    "policy_by_request": _policy(None),
    "policy_strict_gain": policy_strict_gain,
    "sticky_decisions": sticky_decisions,
    "decision_feedback": decision_feedback,
    "stream_sessions": stream_sessions,
    "stream_daily_counts": stream_daily_counts,
    "stream_late_rows": stream_late_rows,
    "stored_refresh": stored_refresh,
    "predict_stored": predict_stored,
    "decision_recount": decision_recount,
    "mixed_sessions": mixed_sessions,
    "mixed_session_rows": mixed_session_rows,
    "admitted_sessions": admitted_sessions,
    "published_sessions": published_sessions,
    "tokens_by_text": tokens_by_text,
    "list_dump": list_dump,
    "list_clear": list_clear,
}
