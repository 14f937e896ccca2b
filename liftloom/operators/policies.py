"""Choosing one of a request's scored actions.

Input rows have ``request_id``, ``choices`` (at most ten structs ``name, learned, value`` in the order sent),
``baseline`` and ``gainonly``, and may have ``odds``. A choice is made inside the row. Draws are hashes of the request, so that
a rerun gives the same picks; all else a policy looks at depends on the choices alone (:func:`with_odds`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Exploration rate and temperature behind the policy names.
EPSILON = 0.05
TEMPERATURE = 0.1
POLICIES = ("E", "G", "EG", "S", "CEG", "CS")
DEFAULT_POLICY = "EG"

def _draw(salt: str) -> str:
    """:func:`hashed_uniform` of the request and a salt; only what the policy of the row looks at is drawn."""
    return f"(cast(conv(substring(md5(cast(concat_ws('|', cast(request_id AS string), '{salt}') AS binary)), 1, 8), 16, 10) AS double) / 4294967296D)"


def _pick(index: str, mode: str) -> str:
    return f"named_struct('i', cast({index} AS int), 'mode', {mode})"


def _epsilon_greedy(epsilon: float, strict_gain: bool) -> str:
    # as the service computes it, gainonly holds back a choice that does beat the baseline; strict_gain turns it round
    held_back = "odds.best <= baseline" if strict_gain else "odds.best > baseline"
    greedy = f"""CASE WHEN odds.place < 0 THEN {_pick('-1', "'error'")}
        WHEN gainonly AND {held_back} THEN {_pick('-1', "'suppress'")}
        ELSE {_pick("odds.place", "'exploit'")} END"""
    if epsilon <= 0:
        return greedy
    explore = _pick(f"floor({_draw('pick')} * size(choices))", "'explore'")
    return explore if epsilon >= 1 else f"CASE WHEN {_draw('gate')} < {epsilon}D THEN {explore} ELSE {greedy} END"


def _curious_epsilon_greedy(epsilon: float, strict_gain: bool) -> str:
    # the draw counts unlearned actions but points into the whole list
    learn = _pick(f"floor({_draw('fresh-pick')} * odds.fresh)", "'learn-action'")
    return f"""CASE WHEN {_draw('fresh')} < odds.fresh / cast(size(choices) AS double) THEN {learn}
        ELSE {_epsilon_greedy(epsilon, strict_gain)} END"""


def _softmax(odds: str) -> str:
    # the first running share above the draw wins; the draw is bound to a name, so it is made once and not once a share
    first = f"transform(array({_draw('softmax')}), u -> array_position(transform({odds}, r -> r > u AND NOT isnan(r)), true))[0]"
    return f"transform(array({first} - 1), i -> CASE WHEN i < 0 THEN {_pick('-1', _ERROR)} ELSE {_pick('i', _SOFT)} END)[0]"


_ERROR, _SOFT = "'error'", "'softmax'"


def _policy(name: str, strict_gain: bool) -> str:
    return {
        "E": lambda: _epsilon_greedy(1.0, strict_gain),
        "G": lambda: _epsilon_greedy(0.0, strict_gain),
        "EG": lambda: _epsilon_greedy(EPSILON, strict_gain),
        "CEG": lambda: _curious_epsilon_greedy(EPSILON, strict_gain),
        "S": lambda: _softmax("odds.soft"),
        "CS": lambda: _softmax("odds.curious"),
    }[name]()


def _shares(values: str) -> str:
    """Running softmax shares of an array; null where all weights vanish, not a number where they overflow."""
    sums = f"aggregate({values}, array(0D), (acc, v) -> concat(acc, array(element_at(acc, -1) + exp(v / {TEMPERATURE}D))))"
    return f"transform(array({sums}), s -> transform(slice(s, 2, size(s)), r -> try_divide(r, element_at(s, -1))))[0]"


def with_odds(scored: DataFrame) -> DataFrame:
    """Add ``odds``, all that the policies look at in ``choices``: the ``best`` value and its ``place``, how many are ``fresh`` (not learned), and
    running shares of a softmax over the values (``soft``), or with the best learned value for what is not learned (``curious``).
    """
    floor = "greatest(0D, array_max(transform(filter(choices, k -> k.learned), k -> k.value)))"
    curious = f"transform(array({floor}), f -> transform(choices, c -> CASE WHEN c.learned THEN c.value ELSE f END))[0]"
    best = "greatest(0D, array_max(choices.value))"
    return scored.selectExpr(
        "*",
        f"""named_struct('best', {best}, 'place', cast(array_position(choices.value, {best}) AS int) - 1,
            'fresh', size(filter(choices, c -> NOT c.learned)), 'soft', {_shares('choices.value')}, 'curious', {_shares(curious)}) AS odds""",
    )


def choose(scored: DataFrame, policy: str | None = None, strict_gain: bool = False) -> DataFrame:
    """Add ``picked`` (place in ``choices``, -1 for none), ``decision`` and ``mode``.

    Rows that come without ``odds`` get them here.

    :param policy: one policy for all rows; by default each row's own ``explore``, in any case, else ``EG``
    :param strict_gain: let ``gainonly`` hold back choices that do not beat the baseline, as its name says
    """
    known = ", ".join(f"'{p}'" for p in POLICIES)
    own = f"'{policy}'" if policy else f"CASE WHEN upper(explore) IN ({known}) THEN upper(explore) ELSE '{DEFAULT_POLICY}' END"
    branches = " ".join(f"WHEN '{p}' THEN {_policy(p, strict_gain)}" for p in POLICIES if policy in (None, p))
    learn = _pick(f"floor({_draw('pick')} * size(choices))", "'learn-goal'")
    rows = scored if "odds" in scored.columns else with_odds(scored)
    return (
        rows.withColumn("_name", F.expr(f"CASE WHEN baseline_ok THEN {own} END"))
        .selectExpr("*", f"CASE WHEN baseline_ok THEN CASE _name {branches} END ELSE {learn} END AS _choice")
        .selectExpr(
            *[c for c in scored.columns if c != "odds"],
            "_choice.i AS picked",
            "CASE WHEN _choice.i >= 0 THEN choices[_choice.i].name ELSE 'no-action' END AS decision",
            "_choice.mode AS mode",
        )
    )
