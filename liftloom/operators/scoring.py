"""Two-class naive Bayes over windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.functions.tokens import ALL, EVENT_TOTAL, NO_ACTION, SESSION_TOTAL
from liftloom.operators.counts import window_counts
from liftloom.session import written

# Smoothing terms, bounds, least number of sessions for a prior, default windows and request limits.
SMOOTH = 100
LEAST = 1e-9
MOST_PRIOR = 0.999
PRIOR_SESSIONS = 10
PREDICT_DAYS = 3
ACTION_DAYS = 7
MAX_GOALS = 5
MAX_ACTIONS = 10
#: longest window
MOST_DAYS = 36_525
# Status texts, by failing step.
NO_GOAL = {"predict": "No Goal event can be referenced. Reason: 101", "action": "No Goal event can be referenced. Reason: 201"}
NO_STATE = {
    "predict": "All predictor event(s) are not recognized. Reason: 102",
    "action": "All predictor event(s) are not recognized. Reason: 202",
}

SPAN = ["project_id", "start_day", "end_day"]
LOOKUP = [*SPAN, "goal", "action", "leaf"]


def day_span(default_days: int) -> list[str]:
    """Select list for the days a request looks at: ``window`` days up to and including ``as_of``.

    A negative window gives a span that ends before it starts, which has no counts; beyond a century either way a window
    is held at that.
    """
    days = f"CASE WHEN coalesce(`window`, 0) = 0 THEN {default_days} ELSE `window` END"
    return [f"date_sub(as_of, cast(greatest(least({days}, {MOST_DAYS}), -{MOST_DAYS}) AS int) - 1) AS start_day", "as_of AS end_day"]


def looked_up(lookups: DataFrame, counts: DataFrame) -> DataFrame:
    """The four counts behind every different lookup: ``s`` goal and leaf, ``t`` goal total, ``a`` leaf, ``b`` all.

    For leaf ``[TS]`` these are the sessions: ``s`` reached the goal, ``b`` in total. One join and one sum serve all
    four. Lookups are made distinct first, so their number is bounded by the vocabulary of tokens, not by requests.
    """
    distinct = lookups.select(*LOOKUP).distinct()
    total = f"CASE WHEN leaf = '{SESSION_TOTAL}' THEN leaf ELSE '{EVENT_TOTAL}' END"
    keys = distinct.selectExpr(
        *LOOKUP,
        f"""inline(array(
            named_struct('role', 's', 'k_goal', goal, 'k_action', action, 'k_leaf', leaf),
            named_struct('role', 't', 'k_goal', goal, 'k_action', action, 'k_leaf', {total}),
            named_struct('role', 'a', 'k_goal', '{ALL}', 'k_action', action, 'k_leaf', leaf),
            named_struct('role', 'b', 'k_goal', '{ALL}', 'k_action', action, 'k_leaf', {total})))""",
    )
    # only counts that somebody asks for are summed over days
    asked = keys.selectExpr("project_id", "k_goal AS goal", "k_action AS action", "k_leaf AS leaf").distinct()
    held = counts.join(asked, ["project_id", "goal", "action", "leaf"], "left_semi")
    windowed = window_counts(held, distinct).select(
        *SPAN, F.col("goal").alias("k_goal"), F.col("action").alias("k_action"), F.col("leaf").alias("k_leaf"), "n"
    )
    return (
        keys.join(windowed, [*SPAN, "k_goal", "k_action", "k_leaf"], "left")
        .groupBy(*LOOKUP)
        .agg(*[F.expr(f"coalesce(sum(CASE WHEN role = '{r}' THEN n END), 0L) AS {r}") for r in "stab"])
    )


def likelihoods(lookups: DataFrame, counts: DataFrame) -> DataFrame:
    """Log likelihoods ``lt`` and ``lf`` of every different lookup; both null when it cannot be judged.

    A lookup with leaf ``[TS]`` gives the prior. With an action, a likelihood of exactly 0 against the goal counts as
    certain (log minus infinity); without one it is raised to a small number. As counts are per goal instance, the
    complement terms can be zero or negative, and even their divisor can; these cases follow floating point rules.
    """
    infinity, nan = "double('Infinity')", "double('NaN')"
    against = f"""CASE
        WHEN den = 0 AND num > 0 THEN {infinity}
        WHEN den = 0 AND num = 0 THEN {nan}
        WHEN den = 0 THEN ln({LEAST}D)
        WHEN num = 0 AND action <> '{NO_ACTION}' THEN -{infinity}
        WHEN num / nullif(den, 0D) <= 0 THEN ln({LEAST}D)
        ELSE ln(num / nullif(den, 0D)) END"""
    prior = f"""CASE WHEN s = 0 THEN {LEAST}D WHEN s >= b THEN {MOST_PRIOR}D ELSE s / cast(b AS double) END"""
    is_prior = f"leaf = '{SESSION_TOTAL}'"
    return (
        looked_up(lookups, counts)
        .selectExpr(
            "*",
            "cast(a - s + 1 AS double) AS num",
            f"cast(b - t + {SMOOTH} AS double) AS den",
            f"CASE WHEN {is_prior} AND b > {PRIOR_SESSIONS} THEN {prior} END AS p",
        )
        .selectExpr(
            *LOOKUP,
            *"stab",
            f"""CASE WHEN {is_prior} THEN ln(p)
                WHEN t > 0 AND a > 0 THEN nullif(ln((s + 1D) / (t + {SMOOTH}D)), 0D) END AS lt""",
            f"CASE WHEN {is_prior} THEN ln(1 - p) WHEN t > 0 AND a > 0 THEN {against} END AS lf",
        )
    )


def with_answer(asked: DataFrame, question: list[str], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add the columns of an answer: each different question is answered once, however many requests ask it.

    :param question: select list of all that an answer depends on
    :param answer: makes one row of each question, which has its number as ``request_id``; columns of the question are not added again

    Questions and answers are written, so the size of what is joined to the requests is known.
    """
    asked = asked.withColumn("_question", F.struct(*[F.expr(column) for column in question]))
    numbered = asked.select("_question").distinct().selectExpr("monotonically_increasing_id() AS request_id", "_question")
    questions = written(numbered, "questions")
    found = answer(questions.select("request_id", "_question.*"))
    answers = written(questions.join(found, "request_id").drop("request_id"), "answers")
    return asked.join(answers, "_question").drop("_question")


def answered(asked: DataFrame, question: list[str], answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same for answers of several rows: adds ``answers``, an array of structs in order."""

    def gathered(questions: DataFrame) -> DataFrame:
        found = answer(questions)
        rest = ", ".join(column for column in found.columns if column != "request_id")
        return found.groupBy("request_id").agg(F.expr(f"sort_array(collect_list(struct({rest}))) AS answers"))

    return with_answer(asked, question, gathered)


def score_rows(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """The evidence rows of each score: one per state, and one for the prior (``place`` -1).

    ``asked`` has ``request_id, item, project_id, start_day, end_day, goal, action, states``; goal and action are
    tokens, the action is empty for a plain goal score. Priors are always those of the goal alone.

    The different lookups and their likelihoods are written, so requests are opened twice and no more, and the size of what is
    joined to them is known: where it is small their rows stay where they are, and :func:`posteriors` moves none either.
    """
    rows = asked.selectExpr(
        "request_id", "item", *SPAN, "goal",
        f"""posexplode(concat(array(named_struct('action', '{NO_ACTION}', 'leaf', '{SESSION_TOTAL}')),
            transform(states, x -> named_struct('action', action, 'leaf', x)))) AS (place, probe)""",
    ).selectExpr(
        "request_id", "item", *SPAN, "goal", "place - 1 AS place", "probe.action AS action", "probe.leaf AS leaf"
    )
    lookups = written(rows.select(*LOOKUP).distinct(), "lookups")
    found = written(likelihoods(lookups, counts).select(*LOOKUP, "lt", "lf"), "likelihoods")
    return rows.join(found, LOOKUP, "left")


def posteriors(rows: DataFrame, *also: str) -> DataFrame:
    """``(request_id, item, has_prior, known, probability)``; probability is -1 without a prior or a known state.

    ``also`` names columns that are the same in all rows of a score and are kept.

    Written as a ratio against 1 it equals e^T / (e^T + e^F) but does not underflow.
    """
    sums = rows.groupBy("request_id", "item", *also).agg(
        F.expr("count(CASE WHEN place = -1 AND lt IS NOT NULL THEN 1 END) > 0 AS has_prior"),
        F.expr("count(CASE WHEN place >= 0 AND lt IS NOT NULL THEN 1 END) AS known"),
        F.expr("sum(CASE WHEN lt IS NOT NULL THEN lt END) AS log_t"),
        F.expr("sum(CASE WHEN lt IS NOT NULL THEN lf END) AS log_f"),
    )
    return sums.selectExpr(
        "request_id", "item", *also, "has_prior", "known",
        "CASE WHEN has_prior AND known > 0 THEN 1 / (1 + exp(log_f - log_t)) ELSE -1D END AS probability",
    )


def status_columns(kind: str) -> list[str]:
    failed = "NOT has_prior OR known = 0"
    return [
        f"CASE WHEN {failed} THEN 1 ELSE 0 END AS code",
        f"CASE WHEN NOT has_prior THEN '{NO_GOAL[kind]}' WHEN known = 0 THEN '{NO_STATE[kind]}' ELSE '' END AS message",
    ]


def request_rejects(requests: DataFrame, api: str) -> DataFrame:
    """Requests that ``api`` (predict or action) does not answer, with the first reason: ``(request_id, reason)``."""
    checks = {
        "predict": [("goals", f"size(coalesce(goals, array())) NOT BETWEEN 1 AND {MAX_GOALS}")],
        "action": [("goal", "coalesce(goal, '') = ''"), ("actions", f"size(coalesce(actions, array())) NOT BETWEEN 1 AND {MAX_ACTIONS}")],
    }[api] + [("ctxlength", "ctxlength < -1")]
    reason = " ".join(f"WHEN {bad} THEN '{name}'" for name, bad in checks)
    return requests.selectExpr("request_id", f"CASE {reason} END AS reason").where("reason IS NOT NULL")


def valid_predicts(requests: DataFrame) -> DataFrame:
    return requests.where(f"size(coalesce(goals, array())) BETWEEN 1 AND {MAX_GOALS}")


def _asked_goals(requests: DataFrame, states: DataFrame) -> DataFrame:
    return valid_predicts(requests).selectExpr("request_id", "project_id", *day_span(PREDICT_DAYS), "goals").join(states, "request_id")


_GOALS = [*SPAN, "goals", "states"]
#: a score is a sum over its states, so their order does not make another question; repeats do
SORTED = "sort_array(states)"


def _goal_rows(questions: DataFrame, counts: DataFrame) -> DataFrame:
    asked = questions.selectExpr("request_id", *SPAN, "posexplode(goals) AS (item, name)", "states").selectExpr(
        "request_id", "item", *SPAN, "concat('GOAL#', name) AS goal", f"'{NO_ACTION}' AS action", "states"
    )
    return score_rows(asked, counts)


def predict_rows(requests: DataFrame, states: DataFrame, counts: DataFrame) -> DataFrame:
    """Evidence rows for requests ``(request_id, project_id, as_of, window, goals)``; item is the goal's place."""
    found = answered(
        _asked_goals(requests, states),
        _GOALS,
        lambda questions: _goal_rows(questions, counts).select("request_id", "item", "place", "goal", "action", "leaf", "lt", "lf"),
    )
    return found.selectExpr("request_id", *SPAN, "inline(answers)")


def predict(requests: DataFrame, states: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per (request, goal): probability, and code and message of a failure."""
    found = answered(
        _asked_goals(requests, states),
        [*SPAN, "goals", f"{SORTED} AS states"],
        lambda questions: posteriors(_goal_rows(questions, counts), "goal").selectExpr(
            "request_id", "item", "substr(goal, 6) AS goal", "probability", *status_columns("predict")
        ),
    )
    return found.selectExpr("request_id", "inline(answers)")


def score_detail(rows: DataFrame) -> DataFrame:
    """Log likelihoods per state, -1 where a state is not known."""
    return rows.where("place >= 0").selectExpr(
        "request_id", "item", "goal", "action", "place", "leaf AS predictor",
        "coalesce(CASE WHEN lt IS NOT NULL THEN lt END, -1D) AS log_true",
        "coalesce(CASE WHEN lt IS NOT NULL THEN lf END, -1D) AS log_false",
    )


def action_priors(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Prior of a goal after an action, over action instances. Reported only: scores use the prior of the goal."""
    lookups = pairs.selectExpr(*SPAN, "goal", "action", f"'{SESSION_TOTAL}' AS leaf")
    return likelihoods(lookups, counts).select(*SPAN, "goal", "action", "s", "b", "lt", "lf")
