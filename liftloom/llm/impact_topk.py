"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Components are whole numbers, ``floor(64 * x)``. A shard keeps, for each component, the postings of the vectors in which it is not
zero, in falling order of impact and cut into segments by powers of two; impacts below four form the last. A batch of queries adds
up the segments in falling order of impact. After each, what the remaining postings of a vector can still add is bounded, by
their largest impact and by their length; vectors whose upper bound is below the k-th best lower bound are out for good. A
query with few enough possible vectors left is settled, and these are scored exactly. Nothing but that proof ends the search, so
the result is exact.

Defined results: null vectors, empty ones, and those with a null or non-finite component take no part; zeros do; a null id
takes no part; rows that repeat an id and its vector count once; ties go to the smaller id; fewer candidates than k give all;
vectors are only compared with vectors of their length; impacts beyond 2**62 are held at that, scores beyond 64 bits at the largest or smallest number; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.llm.vectors import nearest_rows, search_shards

#: whole numbers up to here are exact in double precision
_EXACT = 2.0**53
_MOST = 2.0**62


@dataclass(frozen=True)
class ImpactSettings:
    """Size of a shard, and how many possible vectors of a query are few enough to score them one by one."""

    k: int = 20
    every: int = 20
    scale: int = 64
    shard_rows: int = 8192
    few: int = 200


@dataclass(frozen=True)
class Segment:
    """Postings of one level of impact: for each component that has any, its rows and impacts, the largest first.

    ``cap`` is the largest impact of what comes after the segment, ``lengths_left`` the length of that part of every row.
    """

    postings: tuple[tuple[int, np.ndarray, np.ndarray], ...]
    cap: float
    lengths_left: np.ndarray


@dataclass(frozen=True)
class ImpactIndex:
    """Segments in falling order of impact, and the vectors for exact scores."""

    whole: np.ndarray
    segments: tuple[Segment, ...]


def build_index(vectors: np.ndarray) -> ImpactIndex:
    """Cut the postings of some vectors of whole numbers into segments."""
    sizes = np.abs(vectors)
    level = int(np.floor(np.log2(max(float(sizes.max(initial=0)), 1.0))))
    segments, above = [], np.inf
    while level >= 0:
        # impacts below four are too many to bound well, so they form one segment
        least = 2.0**level if level > 1 else 1.0
        chosen = (sizes >= least) & (sizes < above)
        postings = []
        for component in np.flatnonzero(chosen.any(axis=0)):
            rows = np.flatnonzero(chosen[:, component])
            rows = rows[np.argsort(-sizes[rows, component], kind="stable")].astype(np.int32)
            postings.append((int(component), rows, vectors[rows, component]))
        if postings:
            left = np.where(sizes < least, sizes, 0.0)
            segments.append(Segment(tuple(postings), least - 1, np.sqrt((left * left).sum(axis=1))))
        above, level = least, level - 1 if level > 1 else -1
    return ImpactIndex(vectors, tuple(segments))


def search_index(index: ImpactIndex, queries: np.ndarray, settings: ImpactSettings, work: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of every row that can be among the ``k + 1`` best, at least.

    A query leaves the batch as soon as few enough rows are possible for it, and rows that are out for all queries left are
    no longer read. ``work`` counts ``postings`` added up, ``all_postings`` that there were, and rows ``rescored``.
    """
    want, rows = settings.k + 1, len(index.whole)
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(index.whole).max(initial=0)) * queries.shape[1]
    if most >= _EXACT:
        return _beyond_doubles(index.whole, queries, want)
    found = [np.arange(rows)] * len(queries)
    active, alive = np.arange(len(queries)), np.ones(rows, bool)
    totals = np.zeros((len(queries), rows))
    work = Counter() if work is None else work
    work["all_postings"] += len(queries) * sum(len(own) for segment in index.segments for _, own, _ in segment.postings)
    spread, length = np.abs(queries).sum(axis=1), np.sqrt((queries * queries).sum(axis=1))
    for number, segment in enumerate(index.segments):
        if rows <= want or not len(active):
            break
        # live postings of the components that are asked for, laid out by row, add up for all queries in one product
        asked = queries[active]
        live = [(c, own[alive[own]], impacts[alive[own]]) for c, own, impacts in segment.postings if asked[:, c].any()]
        held = np.zeros(rows, bool)
        for _, own, _ in live:
            held[own] = True
        place = np.cumsum(held) - 1
        block = np.zeros((len(live), int(held.sum())))
        for line, (_, own, impacts) in enumerate(live):
            block[line, place[own]] = impacts
        added = asked[:, [c for c, _, _ in live]] @ block
        if held.all():
            totals += added
        else:
            totals[:, held] += added
        work["postings"] += len(active) * sum(len(own) for _, own, _ in live)
        last = number + 1 == len(index.segments)
        if last:
            rest = np.zeros((1, 1))
        else:
            by_cap = spread[active] * segment.cap
            least_rest = np.minimum(length[active] * segment.lengths_left[alive].min(), by_cap)
            known = totals[:, alive]
            if (known.min(axis=1) + least_rest >= known.max(axis=1) - least_rest).all():
                continue  # no bound can put any row out yet
            rest = np.minimum(np.multiply.outer(length[active], segment.lengths_left), by_cap[:, None])
            rest += 1e-6 * (1 + rest)
        # what is out for good has no part in the bound
        lower = np.where(alive, totals - rest, -np.inf)
        floor = np.partition(lower, rows - want, axis=1)[:, rows - want]
        possible = (totals + rest >= floor[:, None]) & alive
        settled = possible.sum(axis=1) <= (rows if last else settings.few)
        for line in np.flatnonzero(settled):
            found[active[line]] = np.flatnonzero(possible[line])
        active, totals = active[~settled], totals[~settled]
        alive &= possible[~settled].any(axis=0)
    width = max((len(own) for own in found), default=0)
    ids = np.full((len(queries), width), -1)
    values = np.zeros((len(queries), width), np.int64)
    for query, own in enumerate(found):
        ids[query, : len(own)] = own
        values[query, : len(own)] = (index.whole[own] @ queries[query]).astype(np.int64)
        work["rescored"] += len(own)
    return ids, values


def _beyond_doubles(whole: np.ndarray, queries: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows at or above the score of the last wanted one, in whole numbers of any size, held to 64 bits."""
    exact = np.array([[int(x) for x in row] for row in whole], dtype=object).reshape(whole.shape)
    scores = np.empty((len(queries), len(whole)), np.int64)
    for place, query in enumerate(queries):
        own = exact @ np.array([int(x) for x in query], dtype=object)
        scores[place] = np.clip(own, -(2**63) + 1, 2**63 - 1).astype(np.int64)
    ids = np.tile(np.arange(len(whole)), (len(queries), 1))
    if len(whole) > want:
        floor = np.sort(scores, axis=1)[:, -want]
        ids = np.where(scores >= floor[:, None], ids, -1)
    return ids, scores


def exact_top(embeddings: DataFrame, settings: ImpactSettings = ImpactSettings()) -> DataFrame:
    """Columns ``query_id``, ``rank``, ``vec_id``, ``score``. Reads ``vec_id`` and ``embedding``."""

    def impacts(rows: DataFrame) -> DataFrame:
        held = f"floor(greatest(least({settings.scale}d * x, {_MOST!r}d), -{_MOST!r}d))"
        return rows.select("vec_id", F.expr(f"transform(v, x -> cast({held} as double))").alias("v"))

    def find(kept: DataFrame, wanted: DataFrame) -> DataFrame:
        return search_shards(kept, wanted, settings.shard_rows, settings.k, build_index, lambda i, q: search_index(i, q, settings), "long")

    return nearest_rows(embeddings, settings.k, settings.every, True, impacts, find)
