"""What preceded which goal and action: session rows to counts, for sessions of any length.

No session is ever held as one value, and rows are never paired with rows. A row knows its ``place`` in its session; an instance
of a goal or an action looks back over an interval of places, from ``lo`` (its marker, or the earliest time it looks back to) up to
``hi`` (the first row of its own time). How often a leaf occurs in an interval is the number of its rows before ``hi`` less that
before ``lo``. So every key of counts is a list of places with weights, and what has to be known of a leaf is how many of its rows
come before these places. The work is the different places instances look from, times the leaves of their session.

For goals after an action an interval ends at the action and is counted once per later goal. A labelled goal makes it begin at
the action's marker, a local one where it would begin for the goal alone, whichever is later. Ordered in time, goals and the actions of one token
both look back to ever later places, so how many goals see an action, from where, is again a number of rows before a place.

Sessions are scanned once, and the rows with all this are written once. What a session adds depends on nothing else, so sessions of
a project and day that look the same can be counted as one, times their number (:func:`alike`). Long sessions are cut into slots of
places in every step, so that no task sorts more than a slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.config import SessionSettings
from liftloom.functions.tokens import ALL, NO_ACTION, SESSION_TOTAL, day_of_ms
from liftloom.operators.scans import before, dealt, running
from liftloom.session import written

#: families of count keys; each can be left out when it is not asked for
EVENT, SESSION, GOAL, ACTION, GOAL_ACTION = "event", "session", "goal", "action", "goal_action"
FAMILIES = frozenset({EVENT, SESSION, GOAL, ACTION, GOAL_ACTION})

_PANE = ["project_id", "session_id", "session_start", "pane"]
_IN_PANE = ", ".join(_PANE)
_KEY = ["project_id", "day", "goal", "action", "leaf"]
_LOOK = ["day", "place", "kind", "x", "labelled", "local", "hi", "near", "reach"]
_STEP = [*_PANE, *_LOOK, "copies"]
#: where counting asks for less than is known of a row
_ASKED = {
    **{name: f"if(kind = 'GOAL', {name}, false)" for name in ("labelled", "local")},
    **{name: f"if(kind IN ('GOAL', 'ACT'), {name}, 0L)" for name in ("hi", "reach")},
    "near": "if(kind = 'GOAL' AND local, near, 0L)",
}
#: instances counted apart: without and with a label, and the same of local ones
_COUNTED = [("free", "!", "!"), ("cut", "!", ""), ("local_free", "", "!"), ("local_cut", "", "")]


def _tokens(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        *_PANE,
        "cast(place AS bigint) AS place",
        "ts_ms",
        "run_end",
        "event_type AS kind",
        "concat_ws('#', event_type, event_name) AS x",
        "coalesce(label, '') AS label",
        "coalesce(hint, '') = 'local' AS local",
    ).withColumn("marker", F.expr("CASE WHEN kind = 'ACT' THEN x WHEN kind IN ('EVENT', 'GOAL') THEN nullif(label, '') END"))


def steps(rows: DataFrame, hint_ms: int) -> DataFrame:
    """Session rows with their token and day, and how far back they look.

    ``hi`` is how many rows of the pane are earlier, ``near`` how many are further back than the hint, ``reach`` the place of the
    marker (0 for none): a labelled goal is cut at its label, an action at the event whose label names its token.
    """
    earlier = f"OVER (PARTITION BY {_IN_PANE} ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND"
    marked = f"OVER (PARTITION BY {_IN_PANE}, marker ORDER BY ts_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        _tokens(rows)
        .selectExpr(
            "*",
            f"max(run_end) {earlier} UNBOUNDED FOLLOWING) AS pane_end",
            f"rank() OVER (PARTITION BY {_IN_PANE} ORDER BY ts_ms) - 1L AS hi",
            f"count(1) {earlier} {hint_ms + 1} PRECEDING) AS near",
            f"if(marker IS NULL, 0L, coalesce(max(CASE WHEN kind = 'EVENT' THEN place END) {marked}, 0L)) AS reach",
        )
        .withColumns({"day": day_of_ms(F.col("pane_end")), "labelled": F.col("label") != "", "copies": F.lit(1).cast("bigint")})
        .select(*_STEP)
    )


def alike(prepared: DataFrame) -> DataFrame:
    """What :func:`steps` returned, with one pane for all of a project that are counted the same, and how many they are as ``copies``.

    Rows are compared by what counting asks of them: only goals and actions look back, and only local goals as far as the hint.
    A pane is known by two 64-bit hashes of its rows, each with its place and day, so it is nowhere held as one value. Rows are
    grouped whole, so a pane of any length that is like no other passes as it is.
    """
    seen = ", ".join(_LOOK)
    hashed = [f"bit_xor(xxhash64({seed}{seen})) OVER (PARTITION BY {_IN_PANE}) AS {name}" for name, seed in (("_one", ""), ("_two", "'two', "))]
    asked = prepared.selectExpr(*_PANE, *[f"{_ASKED.get(name, name)} AS {name}" for name in _LOOK], "copies")
    rows = asked.selectExpr("project_id", *_LOOK, "copies", *hashed)
    return (
        rows.groupBy("project_id", "_one", "_two", *_LOOK)
        .agg(F.sum("copies").alias("copies"))
        .selectExpr("project_id", "hex(_one) AS session_id", "_two AS session_start", "-1L AS pane", *_LOOK, "copies")
    )


def sliced_steps(rows: DataFrame, hint_ms: int, slot_rows: int) -> DataFrame:
    """The same as :func:`steps`, for sessions that are too long to be sorted in one task."""
    rows = written(_tokens(rows), "long")
    ends = rows.groupBy(*_PANE).agg(F.max("run_end").alias("pane_end"))
    times = written(rows.groupBy(*_PANE, "ts_ms").agg(F.min("place").alias("hi"), (F.max("place") + 1).alias("after")), "times")
    placed = rows.join(times.drop("after"), [*_PANE, "ts_ms"])

    # rows before a time: looked up in ranges of times
    asked = rows.where("kind = 'GOAL' AND local").selectExpr(*_PANE, f"ts_ms - {hint_ms} AS ts_ms", "0 AS tag", "cast(NULL AS bigint) AS after").distinct()
    line = dealt(times.selectExpr(*_PANE, "ts_ms", "1 AS tag", "after").union(asked), _PANE, ["ts_ms", "tag"], "line", slot_rows=slot_rows)
    near = running(line, _PANE, "ts_ms, tag", {"near": "after"}, function="max").where("tag = 0").selectExpr(*_PANE, f"ts_ms + {hint_ms} AS ts_ms", "near")

    marked = [*_PANE, "marker"]
    marks = rows.where("kind = 'EVENT' AND marker IS NOT NULL").selectExpr(*marked, "place AS pos")
    looking = placed.where("kind IN ('GOAL', 'ACT') AND marker IS NOT NULL").selectExpr(*marked, "hi AS pos").distinct()
    reach = before(marks, looking, marked, {"reach": "pos"}, slot_rows, "max").withColumnRenamed("pos", "hi")

    seen = placed.join(near, [*_PANE, "ts_ms"], "left").join(reach, [*marked, "hi"], "left").join(ends, _PANE)
    return seen.withColumns({"day": day_of_ms(F.col("pane_end")), "labelled": F.col("label") != "", "copies": F.lit(1).cast("bigint")}).selectExpr(
        *[f"coalesce({name}, 0L) AS {name}" if name in ("near", "reach") else name for name in _STEP]
    )


def _weights(rows: DataFrame, goal: str, action: str, *parts: tuple[str, str]) -> DataFrame:
    """Places of a key and their weights in all copies, as pairs of SQL expressions. Nothing comes before place 0, so it has no weight."""
    structs = ", ".join(f"struct({place} AS pos, {weight} * copies AS weight)" for place, weight in parts)
    return rows.selectExpr(*_PANE, "day", f"{goal} AS goal", f"{action} AS action", f"inline(array({structs}))").where("pos > 0 AND weight <> 0")


def _seen(prepared: DataFrame, weights: DataFrame, slot_rows: int | None) -> DataFrame:
    """Weights of places to counts of leaves."""
    merged = weights.groupBy(*_PANE, "day", "goal", "action", "pos").agg(F.sum("weight").alias("weight")).where("weight <> 0")
    # read for the places and for the sums
    merged = written(merged, "weights")
    rows = prepared.where("kind <> 'ATR'").selectExpr(*_PANE, "x AS leaf", "place AS pos")
    leaves = rows.groupBy(*_PANE, "leaf").agg(F.min("pos").alias("first"))
    asked = merged.select(*_PANE, "pos").distinct().join(leaves, _PANE).where("first < pos").drop("first")
    held = before(rows, asked, [*_PANE, "leaf"], {"held": "1L"}, slot_rows)
    return merged.join(held, [*_PANE, "pos"]).groupBy(*_KEY).agg(F.sum(F.expr("weight * held")).alias("n")).where("n > 0")


def _followed(prepared: DataFrame, slot_rows: int | None) -> DataFrame:
    """Actions with each goal token that follows them, and local goals with each action token before them, as ``(pane, day, goal, act)``.

    For an action: ``later`` goals, those ``seen`` by the rows before it, and how many of these begin only ``from_marker``, at ``reach``.
    For a local goal: how many actions' intervals begin ``from_near``, at ``near``. The other columns are null.
    """
    instances = prepared.where("kind IN ('GOAL', 'ACT')")
    # entries: every instance on the lines of its own token
    goal, act = "kind = 'GOAL'", "kind = 'ACT'"
    on = [(goal, 0, "-hi"), (f"{goal} AND local", 1, "-near"), (act, 2, "hi"), (act, 3, "reach")]
    # looks: actions at all goal tokens of the pane, local goals at all action tokens
    looks = [
        ("later", act, 0, "-hi"),
        ("far", f"{act} AND with_local", 1, "1 - hi"),
        ("beyond", f"{act} AND with_local", 1, "1 - reach"),
        ("earlier", goal, 2, "hi"),
        ("gone", goal, 2, "near + 1"),
        ("marked", f"{goal} AND labelled", 3, "near + 1"),
    ]
    own = ["kind", "x", "day", "place", "hi", "near", "reach", "labelled", "copies"]
    blank = [f"cast(NULL AS {dict(prepared.dtypes)[name]}) AS {name}" for name in own]
    entries = ", ".join(f"if({test}, struct({line} AS line, {pos} AS pos), NULL)" for test, line, pos in on)
    counted = [f"if(local {is_local}= true AND labelled {is_cut}= true, 1L, 0L) AS {name}" for name, is_local, is_cut in _COUNTED]
    entries = instances.selectExpr(*_PANE, "x AS token", "1 AS tag", "'' AS look", *counted, *blank, f"inline(filter(array({entries}), e -> e IS NOT NULL))")
    tokens = instances.groupBy(*_PANE, F.col("kind").alias("of"), F.col("x").alias("token")).agg(F.max("local").alias("with_local"))
    met = instances.where("kind = 'ACT' OR local").join(tokens, _PANE).where("kind <> of")
    asks = ", ".join(f"if({test}, struct('{look}' AS look, {line} AS line, {pos} AS pos), NULL)" for look, test, line, pos in looks)
    asked = met.selectExpr(*_PANE, "token", "0 AS tag", *own, *[f"0L AS {name}" for name, _, _ in _COUNTED], f"inline(filter(array({asks}), e -> e IS NOT NULL))")
    rows = entries.unionByName(asked)

    key = [*_PANE, "token"]
    # each line adds up alone; a line's rows come before those of the next
    sums = {f"{name}_{line}": f"if(line = {line}, {name}, 0L)" for line in range(4) for name, _, _ in _COUNTED if line < 2 or name == "free"}
    for line in (2, 3):
        sums[f"free_{line}"] = f"if(line = {line}, free + cut + local_free + local_cut, 0L)"
    if slot_rows is not None:
        added = running(dealt(rows, key, ["line", "pos", "tag"], "lines", slot_rows=slot_rows), key, "line, pos, tag", sums)
    else:
        over = f"OVER (PARTITION BY {', '.join(key)} ORDER BY line, pos, tag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        added = rows.selectExpr(*rows.columns, *[f"sum({expression}) {over} AS {name}" for name, expression in sums.items()])

    def at(look: str, name: str) -> str:
        return f"coalesce(max(CASE WHEN look = '{look}' THEN {name} END), 0L)"

    def less(all_of: str, look: str, name: str) -> str:
        return f"{at('later', all_of)} - least({at('later', all_of)}, {at(look, name)})"

    plain = f"{at('later', 'free_0')} + {at('later', 'cut_0')}"
    found = added.where("tag = 0").groupBy(*key, *own).agg(
        F.expr(f"{plain} + {at('later', 'local_free_0')} + {at('later', 'local_cut_0')} AS later"),
        F.expr(f"{plain} + {less('local_free_0', 'far', 'local_free_1')} + {less('local_cut_0', 'far', 'local_cut_1')} AS seen"),
        F.expr(f"{at('later', 'cut_0')} + {less('local_cut_0', 'beyond', 'local_cut_1')} AS from_marker"),
        F.expr(f"greatest(0L, if(labelled, least({at('earlier', 'free_2')}, {at('marked', 'free_3')}), {at('earlier', 'free_2')}) - {at('gone', 'free_2')}) AS from_near"),
    )
    return found.where("if(kind = 'ACT', later, from_near) > 0").selectExpr(
        *[*_PANE, "day", "copies", "hi", "reach", "near"],
        *["if(kind = 'ACT', token, x) AS goal", "if(kind = 'ACT', x, token) AS act"],
        *[f"if(kind = 'ACT', {name}, NULL) AS {name}" for name in ("later", "seen", "from_marker")],
        "if(kind = 'GOAL', from_near, NULL) AS from_near",
    )


def leaf_counts(prepared: DataFrame, settings: SessionSettings, families: frozenset[str] = FAMILIES, stored: bool = False) -> DataFrame:
    """What :func:`steps` or :func:`alike` returned to ``(project_id, day, goal, action, leaf, n)``, without the ``[TE]`` sums.

    :param stored: ``prepared`` is a table already and need not be written
    """
    every, none, whole = f"'{ALL}'", f"'{NO_ACTION}'", f"'{SESSION_TOTAL}'"
    slot_rows = None
    if families - {EVENT}:
        # read several times, so sessions are scanned and written once
        prepared = prepared if stored else written(prepared, "steps")
        longest = prepared.agg(F.max("place")).first()[0] or 0
        if settings.hot_keys is not None and longest >= settings.hot_keys.slot_rows:
            slot_rows = settings.hot_keys.slot_rows
    leaves = ["array(x)"] if EVENT in families else []
    if SESSION in families:
        leaves.append(f"if(place = 0, array({whole}), cast(array() AS array<string>))")
    parts = []
    if leaves:
        opened = f"explode(concat({', '.join(leaves)})) AS leaf"
        parts.append(prepared.selectExpr("project_id", "day", f"{every} AS goal", f"{none} AS action", opened, "copies AS n"))
    if not families - {EVENT}:
        return _summed(parts)

    goals, acts = prepared.where("kind = 'GOAL'"), prepared.where("kind = 'ACT'")
    many = [*_PANE, "day", "copies", "x"]
    weights: list[DataFrame] = []
    sums: list[DataFrame] = []
    if families & {SESSION, GOAL}:
        counted = goals.groupBy(*many).agg(F.count(F.lit(1)).alias("many"))
        once, by_trait = ("copies" if SESSION in families else "0L"), ("many * copies" if GOAL in families else "0L")
        sums.append(counted.selectExpr(*_PANE, "day", "x AS goal", f"{none} AS action", f"{once} AS total", f"{by_trait} AS by_trait"))
    if GOAL in families:
        looking = goals.selectExpr("*", "greatest(reach, if(local, near, 0L)) AS lo").where("lo < hi")
        weights.append(_weights(looking, "x", none, ("hi", "1"), ("lo", "-1")))
    if ACTION in families:
        weights.append(_weights(acts.where("reach < hi"), every, "x", ("hi", "1"), ("reach", "-1")))
        counted = acts.groupBy(*many).agg(F.count(F.lit(1)).alias("many"))
        sums.append(counted.selectExpr(*_PANE, "day", f"{every} AS goal", "x AS action", "many * copies AS total", "many * copies AS by_trait"))
    if GOAL_ACTION in families:
        pairs = written(_followed(prepared, slot_rows), "pairs")
        weights.append(_weights(pairs, "goal", "act", ("hi", "seen"), ("reach", "-from_marker"), ("near", "-from_near")))
        counted = pairs.where("later > 0").groupBy(*_PANE, "day", "copies", "goal", "act").agg(F.count(F.lit(1)).alias("many"), F.sum("later").alias("later"))
        sums.append(counted.selectExpr(*_PANE, "day", "goal", "act AS action", "many * copies AS total", "later * copies AS by_trait"))
    # one row per pane and key; read for totals and for attributes
    together = written(_union(sums), "together") if sums else None
    if families & {SESSION, ACTION, GOAL_ACTION}:
        parts.append(together.where("total > 0").selectExpr(*_KEY[:-1], f"{whole} AS leaf", "total AS n"))
    if weights:
        parts.append(_seen(prepared, _union(weights), slot_rows))
        traits = prepared.where("kind = 'ATR'").groupBy(*_PANE, F.col("x").alias("leaf")).agg(F.count(F.lit(1)).alias("held"))
        parts.append(together.where("by_trait > 0").join(traits, _PANE).selectExpr(*_KEY, "by_trait * held AS n"))
    return _summed(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return together


def _summed(parts: list[DataFrame]) -> DataFrame:
    return _union(parts).groupBy(*_KEY).agg(F.sum("n").alias("n"))
