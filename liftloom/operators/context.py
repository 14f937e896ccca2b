"""What a session did lately, as seen by a request.

Every session keeps two lists, plain events (``evt``) and attributes (``atr``), each of its last 50 tokens. A list is
gone once nothing was added for 30 minutes. A request sees what was added up to its own millisecond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.config import HotKeys
from liftloom.operators.chains import busiest_keys, gap_chains
from liftloom.operators.scans import before

# Length and life of the kept lists, default number of tokens asked for.
KEPT = 50
EXPIRY_MS = 1_800_000
DEFAULT_LENGTH = 10

_KEYS = ["project_id", "session_id", "kind"]


def _kept_steps(events: DataFrame) -> DataFrame:
    return events.where("event_type IN ('EVENT', 'ATR')").selectExpr(
        "project_id",
        "session_id",
        "CASE event_type WHEN 'EVENT' THEN 'evt' ELSE 'atr' END AS kind",
        "ts_ms",
        "event_id AS row_id",
        "concat_ws('#', event_type, event_name) AS x",
    )


def _since_clears(rows: DataFrame, clears: DataFrame, time: str, hot: HotKeys | None) -> DataFrame:
    """Add ``epoch``, how many clears of the row's session come before ``time``.

    Counted in the order of the session, where :func:`lists` needs its rows anyway. Told ``hot``, places are looked up in slots instead, for sessions
    that are too long to be sorted.
    """
    session = ["project_id", "session_id"]
    marks = clears.selectExpr(*session, "ts_ms AS pos")
    timed = rows.withColumn("pos", F.expr(time))
    if hot is None:
        both = _by_session(timed.withColumn("mark", F.lit(0)).unionByName(marks.withColumn("mark", F.lit(1)), allowMissingColumns=True))
        over = f"OVER (PARTITION BY {', '.join(session)} ORDER BY pos, mark ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return both.withColumn("epoch", F.expr(f"sum(cast(mark AS bigint)) {over}")).where("mark = 0").drop("pos", "mark")
    cleared = clears.select(*session).distinct()
    asked = timed.select(*session, "pos").join(cleared, session, "left_semi").distinct()
    counted = before(marks, asked, session, {"epoch": "1L"}, hot.slot_rows)
    return timed.join(counted, [*session, "pos"], "left").withColumn("epoch", F.coalesce("epoch", F.lit(0))).drop("pos")


def _by_session(rows: DataFrame) -> DataFrame:
    """Rows moved once, by session: all that follows is done where they are."""
    return rows.repartition("project_id", "session_id")


def _latest(part: DataFrame, keys: list[str], kept: int) -> DataFrame:
    """Asking rows with the last ``kept`` tokens of their list, as ``held``. Rows that ask add nothing to it."""
    over = f"OVER (PARTITION BY {', '.join(keys)}, chain_start ORDER BY chain_seq RANGE BETWEEN {kept - 1}L PRECEDING AND CURRENT ROW)"
    return part.withColumn("held", F.expr(f"collect_list(x) {over}")).where("take IS NOT NULL").drop("x", "chain_start", "chain_seq")


def _latest_in_blocks(part: DataFrame, keys: list[str], kept: int) -> DataFrame:
    """The same for sessions that are too long to be sorted in one task.

    The list history is stored in blocks of ``kept`` tokens; a request reads its own block and the one before, so no
    request ever touches a whole session.
    """
    blocks = part.where("take IS NULL").groupBy(*keys, "chain_start", F.expr(f"(chain_seq - 1) div {kept} AS block")).agg(
        F.expr("sort_array(collect_list(named_struct('seq', chain_seq, 'x', x))) AS read")
    )
    asks = part.where("take IS NOT NULL").drop("x")
    wanted = asks.where("chain_seq > 0").selectExpr(
        "row_id", *keys, "chain_start", "chain_seq",
        f"explode(sequence(greatest(chain_seq - {kept}, 0) div {kept}, (chain_seq - 1) div {kept})) AS block",
    )
    found = (
        wanted.join(blocks, [*keys, "chain_start", "block"])
        .selectExpr("row_id", "kind", f"filter(read, h -> h.seq <= chain_seq AND h.seq > chain_seq - {kept}) AS part")
        .groupBy("row_id", "kind")
        .agg(F.expr("transform(sort_array(flatten(collect_list(part))), h -> h.x) AS held"))
    )
    none = F.expr("cast(array() AS array<string>)")
    return asks.drop("chain_start", "chain_seq").join(found, ["row_id", "kind"], "left").withColumn("held", F.coalesce("held", none))


def _seen(events: DataFrame, asks: DataFrame, expiry_ms: int, kept: int, hot: HotKeys | None, clears: DataFrame | None) -> DataFrame:
    """``asks`` (``project_id, session_id, kind, ts_ms, row_id, take`` and more) with the ``tokens`` of their list, oldest first, or none."""
    keys, session = _KEYS, ["project_id", "session_id"]
    both = _kept_steps(events).unionByName(asks, allowMissingColumns=True)
    both = both.where("project_id IS NOT NULL AND session_id IS NOT NULL")
    # without a busy session no list of one is busy
    hot = hot if busiest_keys(both, session, hot) else None
    if clears is not None:
        keys = [*_KEYS, "epoch"]
        # a request at the time of a clear finds the lists empty
        both = _since_clears(both, clears, "if(take IS NULL, ts_ms, ts_ms + 1)", hot)
    columns = [*session, "kind", *[c for c in both.columns if c not in {*session, "kind"}]]

    def asked(part: DataFrame) -> DataFrame:
        return part.select(*columns, "chain_start", "chain_seq")

    busiest = busiest_keys(both, keys, hot)
    # a request neither extends a list (its end is its own time) nor counts as a step (weight 0)
    found = gap_chains(
        both if clears is not None else _by_session(both),
        keys,
        "ts_ms",
        f"CASE WHEN take IS NULL THEN ts_ms + {int(expiry_ms)} ELSE ts_ms END",
        "row_id",
        rank="CASE WHEN take IS NULL THEN 0 ELSE 1 END",
        weight="CASE WHEN take IS NULL THEN 1 ELSE 0 END",
        hot=hot if busiest else None,
        busiest=busiest,
        then=lambda part: _latest(asked(part), keys, int(kept)),
        then_sliced=lambda part: _latest_in_blocks(asked(part), keys, int(kept)).select(*[c for c in columns if c != "x"], "held"),
    )
    return found.withColumn("tokens", F.expr("slice(held, cast(greatest(size(held) - take, 0) + 1 AS int), size(held))")).drop("held")


def lists(
    events: DataFrame,
    requests: DataFrame,
    expiry_ms: int = EXPIRY_MS,
    kept: int = KEPT,
    hot: HotKeys | None = HotKeys(),
    clears: DataFrame | None = None,
) -> DataFrame:
    """``(request_id, kind, tokens)`` for the lists a request finds alive; ``tokens`` is oldest first.

    ``requests`` has ``request_id, project_id, session_id, ts_ms, take`` with ``take`` the number of tokens wanted.
    Events and requests move once, by session; a list is what the last ``kept`` steps before a request hold.

    ``clears`` has ``project_id, session_id, ts_ms``: at that time both lists are emptied, of what that very millisecond added as well.
    What is added later begins new lists.
    """
    asks = requests.where("take > 0").selectExpr(
        "project_id", "session_id", "explode(array('evt', 'atr')) AS kind", "ts_ms", "request_id AS row_id",
        f"cast(least(take, {int(kept)}) AS bigint) AS take",
    )
    seen = _seen(events, asks, expiry_ms, kept, hot, clears)
    return seen.where("size(tokens) > 0").selectExpr("row_id AS request_id", "kind", "tokens")


def dump(events: DataFrame, requests: DataFrame, expiry_ms: int = EXPIRY_MS, kept: int = KEPT, clears: DataFrame | None = None) -> DataFrame:
    """All that is kept in both lists of a session at the time of a request ``(request_id, project_id, session_id, ts_ms)``."""
    return lists(events, requests.withColumn("take", F.lit(kept)), expiry_ms, kept, clears=clears)


def request_states() -> str:
    """Tokens of the states sent along, up to the first with a bad type; later ones become blank and match nothing."""
    # only these four pass; upper() would look up the rules of all languages
    upper = "CASE s.type WHEN 'event' THEN 'EVENT' WHEN 'atr' THEN 'ATR' WHEN 'goal' THEN 'GOAL' ELSE 'ACT' END"
    bad = "array_position(transform(states, s -> coalesce(s.type, '') NOT IN ('event', 'atr', 'goal', 'act')), true)"
    return f"""transform(coalesce(states, cast(array() AS array<struct<name:string,type:string>>)),
        (s, i) -> CASE WHEN {bad} = 0 OR i + 1 < {bad} THEN concat_ws('#', {upper}, coalesce(s.name, '')) ELSE '' END)"""


def _held_together(events: DataFrame, asks: DataFrame, expiry_ms: int, kept: int) -> DataFrame:
    """``asks`` (``project_id, session_id, ts_ms, row_id, take`` and more), each with ``evt`` and ``atr``, the tokens of both lists.

    Both lists are read off one order of a session: a list is the last of its steps, as many as were added since it was last empty.
    """
    rows = _by_session(_kept_steps(events).where("project_id IS NOT NULL AND session_id IS NOT NULL").unionByName(asks, allowMissingColumns=True))
    session, order = "PARTITION BY project_id, session_id", "ORDER BY ts_ms, if(take IS NULL, 0, 1), row_id"
    until = f"OVER ({session} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    steps = {kind: f"kind <=> '{kind}'" for kind in ("evt", "atr")}
    # added so far, and the time of the step before
    rows = rows.selectExpr(
        "*",
        *[f"count_if({step}) {until} CURRENT ROW) AS {kind}_at" for kind, step in steps.items()],
        *[f"max(if({step}, ts_ms, NULL)) {until} 1 PRECEDING) AS {kind}_last" for kind, step in steps.items()],
    )
    rows = rows.selectExpr(
        "*",
        *[
            f"last(if({step} AND ({kind}_last IS NULL OR ts_ms >= {kind}_last + {int(expiry_ms)}), {kind}_at, NULL), true) {until} CURRENT ROW) AS {kind}_opened"
            for kind, step in steps.items()
        ],
    )
    for kind, step in steps.items():
        # a list is a partition of its own, so a window holds no more than can be asked for
        latest = f"OVER ({session}, {kind}_opened ORDER BY {kind}_at RANGE BETWEEN {kept - 1}L PRECEDING AND CURRENT ROW)"
        rows = rows.selectExpr("*", f"collect_list(if({step}, x, NULL)) {latest} AS {kind}_held")
    asked = rows.where("take IS NOT NULL")
    for kind in steps:
        long = f"if(ts_ms < {kind}_last + {int(expiry_ms)}, least(take, {kind}_at - {kind}_opened + 1, {kept}), 0)"
        asked = asked.withColumn(f"_{kind}", F.expr(f"cast(coalesce({long}, 0) AS int)")).withColumn(
            kind, F.expr(f"if(_{kind} > 0, slice({kind}_held, -_{kind}, _{kind}), cast(array() AS array<string>))")
        )
    return asked.select(*asks.columns, *steps)


def _held_apart(events: DataFrame, asks: DataFrame, expiry_ms: int, kept: int, hot: HotKeys, more: str) -> DataFrame:
    """The same for busy sessions, where each list is looked up in slots. ``more`` comes along with the first list."""
    each = asks.withColumn("kind", F.explode(F.array(F.lit("evt"), F.lit("atr")))).withColumn(more, F.expr(f"CASE WHEN kind = 'evt' THEN {more} END"))
    return _seen(events, each, expiry_ms, kept, hot, None).groupBy("row_id").agg(
        *[F.expr(f"max(CASE WHEN kind = '{kind}' THEN tokens END) AS {kind}") for kind in ("evt", "atr")],
        F.expr(f"max(CASE WHEN kind = 'evt' THEN {more} END) AS {more}"),
    )


def merged_states(
    events: DataFrame, requests: DataFrame, expiry_ms: int = EXPIRY_MS, kept: int = KEPT, hot: HotKeys | None = HotKeys()
) -> DataFrame:
    """``(request_id, states)``: event list, attribute list and sent states, first occurrence kept.

    ``ctxlength`` 0 takes ten of each list; -1 takes the sent states only, as they are. Other negative lengths are
    not valid and such requests are left out.
    """
    asking = requests.selectExpr(
        "request_id", "project_id", "session_id", "ts_ms", f"{request_states()} AS sent",
        f"CASE ctxlength WHEN 0 THEN {DEFAULT_LENGTH} ELSE ctxlength END AS take",
    ).where("take >= -1")
    listed = "coalesce(take > 0 AND session_id <> '' AND project_id IS NOT NULL, false)"
    asks = asking.where(listed).selectExpr("project_id", "session_id", "ts_ms", "request_id AS row_id", f"cast(least(take, {int(kept)}) AS bigint) AS take", "sent")
    session = ["project_id", "session_id"]
    # counted with all requests, as to tell which of them ask costs more than to count them
    found = busiest_keys(_kept_steps(events).select(*session).unionByName(requests.select(*session)).dropna(), session, hot)
    if found is None:
        held = _held_together(events, asks, expiry_ms, int(kept))
    else:
        parts = [[df.join(found.listed, session, how) for df in (events, asks)] for how in ("left_anti", "left_semi")]
        columns = ["row_id", "evt", "atr", "sent"]
        held = _held_together(*parts[0], expiry_ms, int(kept)).select(*columns).unionByName(_held_apart(*parts[1], expiry_ms, int(kept), hot, "sent").select(*columns))
    merged = held.selectExpr("row_id AS request_id", "array_distinct(concat(evt, atr, sent)) AS states")
    unlisted = "CASE WHEN take = -1 OR session_id = '' THEN sent ELSE array_distinct(sent) END AS states"
    return merged.unionByName(asking.where(f"NOT {listed}").selectExpr("request_id", unlisted))
