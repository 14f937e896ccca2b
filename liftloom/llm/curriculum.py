"""Mixing sources to target weights along a schedule.

Sources get a share of 150 % of all words by weight, twice their own words at most; what a source cannot use goes to the
others by weight. The weight of a source changes over training: its schedule is a line through equally spaced knots. The
documents of a source, in the order of a digest of their ids, form a stream of words that is read once, or once and a part of
it again. The integral of the schedule says what share of the stream has been asked for by a time; its inverse gives the
time at which each word of the stream is due, and so the position of a document in training. Documents are sorted by
position, range by range.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own, ordered last; all
sizes 0 give targets 0; rows that repeat an id are ordered by their size and, if alike in both, may swap; no rows give no
rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.llm.ranks import running_before
from liftloom.session import written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSettings:
    """How much is taken, and when."""

    #: weights of the sources in order, repeating
    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    #: a source's words are read so many times at most
    most_reads: int = 2
    #: schedule of each weight: multipliers at equally spaced times from the start to the end of training
    knots: dict[int, tuple[float, ...]] = field(default_factory=lambda: {5: (1.5, 1.2, 0.9, 0.4), 2: (1.0, 1.0, 1.0, 1.0), 1: (0.3, 0.8, 1.2, 1.7)})


def targets(sized: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """A row per source: ``source``, ``weight``, ``source_size``, ``target``.

    With sources sorted by how soon they are full, the water level of the mix is known from running sums: the first source
    that the level leaves unfilled sets it for all that follow.
    """
    places = " ".join(f"when {n} then {w}" for n, w in enumerate(settings.weights))
    full = f"{settings.most_reads} * source_size"
    ranked = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .selectExpr("*", "row_number() over (order by source nulls last) - 1 as place")
        .selectExpr("*", f"case place % {len(settings.weights)} {places} end as weight")
        .selectExpr("*", f"row_number() over (order by {full} / cast(weight as double), place) as fills")
        .selectExpr(
            "*",
            f"(sum(source_size) over () * {settings.percent} / 100.0d - {settings.most_reads} *"
            " coalesce(sum(source_size) over (order by fills rows between unbounded preceding and 1 preceding), 0))"
            " / sum(weight) over (order by fills rows between current row and unbounded following) as level",
        )
        .selectExpr("*", f"min(case when level * weight < {full} then fills end) over () as open_from")
        .selectExpr("*", "max(case when fills = open_from then level end) over () as water")
    )
    return ranked.selectExpr(
        "source", "weight", "source_size", f"cast(case when fills >= open_from then water * weight else {full} end as double) as target"
    )


def _time_due(share: str, knots: tuple[float, ...]) -> str:
    """SQL for the time, from 0 to 1, by which the given share of a source's demand has been asked for."""
    width = 1 / (len(knots) - 1)
    areas = [(low + high) / 2 * width for low, high in zip(knots, knots[1:], strict=False)]
    total, before, cases = sum(areas), 0.0, []
    for number, area in enumerate(areas):
        low, slope = knots[number], (knots[number + 1] - knots[number]) / width
        rest = f"greatest({share} * {total!r}d - {before!r}d, 0d)"
        root = f"sqrt(greatest({low * low!r}d + 2 * ({slope!r}d) * {rest}, 0d))"
        time = f"{number * width!r}d + least(coalesce(try_divide(2 * {rest}, {low!r}d + {root}), 0d), {width!r}d)"
        before += area
        cases.append(f"when {share} * {total!r}d <= {before!r}d or {number + 1 == len(areas)} then {time}")
    return f"case {' '.join(cases)} end"


def mix(docs: DataFrame, settings: MixSettings = MixSettings(), also: tuple[str, ...] = ()) -> DataFrame:
    """A row per document, sorted by position in training.

    Columns ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, then ``position`` and ``again``: the word
    of the training run at which the document, and its repetition, begin (null where not taken). Reads ``doc_id``, ``source``
    and ``text``; columns named in ``also`` come along, such as a number that tells rows with one id apart.
    """
    sized = written(
        docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("digest"),
            *also,
        ),
        "sizes",
    )
    # read back as a table of known size, so Spark broadcasts it only if it is small
    sources = written(targets(sized, settings), "sources").withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    rows = sized.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = running_before(rows, ["source"], "size", ["digest", "size"], sized.count(), "before")
    reads = range(settings.most_reads)
    taken = [f"greatest(least(goal - {n} * source_size - before, size), 0)" for n in reads]
    total = sources.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    due = []
    for n in reads:
        share = f"(({n} * source_size + before) / cast(goal as double))"
        by_weight = " ".join(f"when {w} then {_time_due(share, knots)}" for w, knots in settings.knots.items())
        due.append(f"case when {taken[n]} > 0 then floor({int(total)} * (case weight {by_weight} else {share} end)) end")
    found = placed.selectExpr(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        f"{' + '.join(taken)} as taken",
        *[f"cast({d} as long) as {('position', 'again')[n] if n < 2 else f'again_{n}'}" for n, d in enumerate(due)],
        *also,
    )
    return found.orderBy(F.col("position").asc_nulls_last(), "doc_id")
