"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Every shard of the vectors gets a graph. A vector is put in by a greedy search from the middle of the graph: what the search
meets is proposed as its neighbours, and relaxed distance pruning keeps a proposal only if no kept neighbour is closer to it
by the factor ``relax``, so that edges point in diverse directions. Kept neighbours get an edge back, and are pruned again when
they have too many. A query runs a beam search on the graph of each shard; scores are the exact inner products in double
precision, and the best of all shards are ranked.

Largest inner product becomes smallest distance by one more component that gives all indexed vectors of a shard the same
length. Vectors go in by batches, searched with numpy side by side; the members of a batch are proposed to one another as
well.

Defined results: null vectors, empty and zero ones, and those with a null or non-finite component take no part, nor does a null
id; rows that repeat an id and its vector count once; equal vectors share one place in the graph and are all returned; ties go
to the smaller id; fewer candidates than k give all; vectors are only compared with vectors of their length; other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from liftloom.llm.vectors import nearest_rows, search_shards


@dataclass(frozen=True)
class GraphSettings:
    """Shape of the graphs and width of the searches."""

    k: int = 20
    every: int = 20
    shard_rows: int = 8192
    degree: int = 32
    relax: float = 1.2
    build_beam: int = 64
    query_beam: int = 112
    #: nodes opened in each step of a beam search
    opened: int = 4
    batch: int = 256


@dataclass(frozen=True)
class Graph:
    """Vectors as compared and as given, neighbours of each (-1 for none), and the node where searches start."""

    placed: np.ndarray
    given: np.ndarray
    edges: np.ndarray
    start: int


def beam_search(placed: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, width: int, opened: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes found for each query, nearest first, and their distances (less the query's own square)."""
    count, rows = len(queries), np.arange(len(queries))[:, None]
    squares = (placed * placed).sum(axis=1)
    seen = np.zeros((count, len(placed) + 1), bool)
    ids = np.full((count, width), -1)
    far = np.full((count, width), np.inf, dtype=placed.dtype)
    done = np.ones((count, width), bool)
    ids[:, 0], far[:, 0], done[:, 0] = start, squares[start] - 2 * (queries @ placed[start]), False
    seen[:, start] = True
    live = np.arange(count)
    while len(live):
        waiting = np.where(done[live], np.inf, far[live])
        picks = np.argpartition(waiting, opened - 1, axis=1)[:, :opened] if width > opened else np.argsort(waiting, axis=1)
        at = live[:, None]
        going = np.isfinite(np.take_along_axis(waiting, picks, axis=1))
        keep = going.any(axis=1)
        live, at, picks, going = live[keep], at[keep], picks[keep], going[keep]
        if not len(live):
            break
        done[at, picks] = True
        nodes = np.where(going, ids[at, picks], -1)
        next_ids = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(live), -1)
        next_ids.sort(axis=1)
        fresh = next_ids >= 0
        fresh[:, 1:] &= next_ids[:, 1:] != next_ids[:, :-1]
        fresh &= ~seen[at, next_ids]
        seen[at, np.where(fresh, next_ids, len(placed))] = True
        owner, column = np.nonzero(fresh)
        found = next_ids[owner, column]
        away = np.full(next_ids.shape, np.inf, dtype=placed.dtype)
        away[owner, column] = squares[found] - 2 * np.einsum("ij,ij->i", placed[found], queries[live[owner]])
        all_far = np.concatenate([far[live], away], axis=1)
        order = np.argpartition(all_far, width - 1, axis=1)[:, :width]
        all_ids = np.concatenate([ids[live], next_ids], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        far[live] = np.take_along_axis(all_far, order, axis=1)
        ids[live] = np.take_along_axis(all_ids, order, axis=1)
        done[live] = np.take_along_axis(all_done, order, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, axis=1)
    return np.where(np.isfinite(far), np.take_along_axis(ids, order, axis=1), -1), far


def prune(placed: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Of the proposals (-1 for none) of each node, at most ``degree`` nearest ones that no kept one stands in front of."""
    proposed = np.sort(proposed, axis=1)
    none = proposed < 0
    none[:, 1:] |= proposed[:, 1:] == proposed[:, :-1]
    none |= proposed == nodes[:, None]
    points = placed[np.where(none, 0, proposed)]
    squares = np.einsum("ijk,ijk->ij", points, points)
    own = placed[nodes]
    away = squares - 2 * np.einsum("ijk,ik->ij", points, own) + (own * own).sum(axis=1)[:, None]
    away = np.where(none, np.inf, np.maximum(away, 0))
    alive = ~none
    kept = np.full((len(nodes), degree), -1)
    rows = np.arange(len(nodes))
    factor = relax * relax
    for place in range(degree):
        left = np.where(alive, away, np.inf)
        best = left.argmin(axis=1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        kept[some, place] = proposed[rows[some], best[some]]
        chosen = points[rows, best]
        between = squares - 2 * np.einsum("ijk,ik->ij", points, chosen) + squares[rows, best][:, None]
        alive &= factor * np.maximum(between, 0) > away
        alive[rows, best] = False
    return kept


def build_graph(given: np.ndarray, settings: GraphSettings) -> Graph:
    """The graph of some vectors, put in by batches that double in size up to the setting."""
    lengths = (given * given).sum(axis=1)
    scale = np.sqrt(lengths.max(initial=1e-300))
    lifted = np.sqrt(np.maximum(1 - lengths / (scale * scale), 0))
    placed = np.concatenate([given / scale, lifted[:, None]], axis=1).astype(np.float32)
    count, degree = len(placed), settings.degree
    order = np.random.default_rng(5).permutation(count)
    middle = placed.mean(axis=0)
    start = int(((placed - middle) ** 2).sum(axis=1).argmin())
    order = np.concatenate([[start], order[order != start]])
    edges = np.full((count, degree), -1)
    begin, size = 1, 8
    while begin < count:
        nodes = order[begin : begin + size]
        found, _ = beam_search(placed, edges, start, placed[nodes], settings.build_beam, settings.opened)
        near = placed[nodes] @ placed[nodes].T
        peers = nodes[np.argsort(-near, axis=1)[:, : degree + 1]]
        edges[nodes] = prune(placed, nodes, np.concatenate([found, peers], axis=1), degree, settings.relax)
        _link_back(placed, edges, nodes, settings)
        begin += size
        size = min(2 * size, settings.batch)
    return Graph(placed, given, edges, start)


def _link_back(placed: np.ndarray, edges: np.ndarray, nodes: np.ndarray, settings: GraphSettings) -> None:
    """Give the neighbours of new nodes an edge back, and prune those that then have too many."""
    sources = np.repeat(nodes, edges.shape[1])
    ends = edges[nodes].ravel()
    sources, ends = sources[ends >= 0], ends[ends >= 0]
    by_end = np.argsort(ends, kind="stable")
    sources, ends = sources[by_end], ends[by_end]
    targets, first, counts = np.unique(ends, return_index=True, return_counts=True)
    wide = np.full((len(targets), edges.shape[1] + int(counts.max(initial=0))), -1)
    wide[:, : edges.shape[1]] = edges[targets]
    wide[np.repeat(np.arange(len(targets)), counts), edges.shape[1] + np.arange(len(ends)) - np.repeat(first, counts)] = sources
    for begin in range(0, len(targets), 1024):
        some = slice(begin, begin + 1024)
        edges[targets[some]] = prune(placed, targets[some], wide[some], settings.degree, settings.relax)


def search_graph(graph: Graph, queries: np.ndarray, settings: GraphSettings) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the best rows found (-1 for none), and their exact scores."""
    norms = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
    turned = np.concatenate([queries / norms, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    found, _ = beam_search(graph.placed, graph.edges, graph.start, turned, settings.query_beam, settings.opened)
    scores = np.einsum("ijk,ik->ij", graph.given[found], queries)
    scores = np.where(found >= 0, scores, -np.inf)
    best = np.argsort(-scores, axis=1, kind="stable")[:, : settings.k + 1]
    return np.take_along_axis(found, best, axis=1), np.take_along_axis(scores, best, axis=1)


def nearest(embeddings: DataFrame, settings: GraphSettings = GraphSettings()) -> DataFrame:
    """Columns ``query_id``, ``rank``, ``vec_id``, ``score``. Reads ``vec_id`` and ``embedding``."""

    def find(kept: DataFrame, wanted: DataFrame) -> DataFrame:
        return search_shards(
            kept, wanted, settings.shard_rows, settings.k, lambda v: build_graph(v, settings), lambda g, q: search_graph(g, q, settings), "double"
        )

    return nearest_rows(embeddings, settings.k, settings.every, False, lambda rows: rows, find)
