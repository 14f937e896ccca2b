"""What the two vector searches share: clean rows, classes of equal vectors, shards, and ranking rows from classes.

Equal vectors are searched once. A class keeps its ``k + 1`` smallest ids, as no query can return more rows of it, so a
vector that a third of all rows share costs one entry in the index. Every shard holds a bounded number of classes. A shard's
index is built in one task, then all query vectors stream through that task in batches; neither side is ever held whole by
the driver or gathered as one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.session import written

QUERY_BATCH = 256


def usable(embeddings: DataFrame, with_zero: bool) -> DataFrame:
    """Columns ``vec_id`` and ``v`` of the rows that take part, as doubles, each row once.

    Left out: a null id, a null or empty vector, one with a null or non-finite component, and unless ``with_zero`` one of
    zeros.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < double('infinity') and not isnan(x))")
    return rows if with_zero else rows.where("exists(v, x -> x <> 0)")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Columns ``cid`` (smallest id of the equal vectors), ``vec_id``, ``v``, ``place``: the ``k + 1`` smallest ids of each vector.

    Spark limits groups before it shuffles them, so a common vector does not travel row by row.
    """
    ranked = rows.selectExpr("vec_id", "v", "dense_rank() over (partition by v order by vec_id) as place").where(f"place <= {k + 1}").distinct()
    return ranked.selectExpr("first(vec_id) over (partition by v order by place) as cid", "vec_id", "v", "place")


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def search_shards(
    kept: DataFrame,
    wanted: DataFrame,
    shard_rows: int,
    k: int,
    build: Callable[[np.ndarray], Any],
    search: Callable[[Any, np.ndarray], tuple[np.ndarray, np.ndarray]],
    score_type: str,
) -> DataFrame:
    """The ``k + 1`` best classes of every shard for every query class: ``qid``, ``cid``, ``score``.

    :param kept: classes as :func:`classes` gives them
    :param wanted: query classes, columns ``qid`` and ``v``
    :param build: makes the index of a shard from its vectors, one per row
    :param search: gives row numbers (-1 for none) and scores of the best rows for a batch of query vectors

    Vectors of another length than the query's are no candidates.
    """
    index = kept.where("place = 1").selectExpr("cid as id", "v")
    shards = max(1, -(-index.count() // shard_rows))
    numbered = "cast(size(v) as long) * 4294967296"
    rows = index.selectExpr(f"{numbered} + pmod(xxhash64(v), {shards}) as shard", "0 as kind", "id", "v")
    asked = wanted.selectExpr(f"explode(transform(sequence(0, {shards - 1}), s -> {numbered} + s)) as shard", "1 as kind", "qid as id", "v")
    most = k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors, index_of = None, [], [], None
        for batch in batches:
            keys = batch.column("shard").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin == end:
                    continue
                shard, kind = int(keys[begin]) // 2, int(keys[begin]) % 2
                if shard != current:
                    current, ids, vectors, index_of = shard, [], [], None
                part = batch.slice(begin, end - begin)
                if kind == 0:
                    ids.append(part.column("id").to_numpy())
                    vectors.append(_matrix(part, "v"))
                    continue
                if not ids:
                    continue
                if index_of is None:
                    named = np.concatenate(ids)
                    index_of = build(np.concatenate(vectors))
                    vectors = []
                for first in range(0, part.num_rows, QUERY_BATCH):
                    some = part.slice(first, QUERY_BATCH)
                    found, scores = search(index_of, _matrix(some, "v"))
                    hit = found >= 0
                    queries = np.repeat(some.column("id").to_numpy(), hit.sum(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(named[found[hit]]), pa.array(scores[hit])], names=["qid", "cid", "score"])

    # a task for each shard; hashing the shard's number would put several in one
    spread = rows.union(asked).repartitionById(shards, F.expr(f"cast(shard % {shards} as int)")).sortWithinPartitions("shard", "kind")
    found = spread.mapInArrow(run, f"qid long, cid long, score {score_type}")
    return found.selectExpr("*", "row_number() over (partition by qid order by score desc, cid) as nth").where(f"nth <= {most}").drop("nth")


def nearest_rows(
    embeddings: DataFrame,
    k: int,
    every: int,
    with_zero: bool,
    prepare: Callable[[DataFrame], DataFrame],
    find: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Rank rows for every query row: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``prepare`` turns usable vectors into the ones compared, ``find`` searches classes. Queries are the rows whose id is
    divisible by ``every``; a query's own id is no candidate.
    """
    rows = prepare(usable(embeddings, with_zero))
    kept = written(classes(rows, k), "classes")
    asking = rows.where(f"vec_id % {every} = 0").distinct()
    queries = written(asking.join(kept.where("place = 1").select("cid", "v"), "v").selectExpr("vec_id as query_id", "cid as qid", "v"), "queries")
    wanted = queries.select("qid", "v").dropDuplicates(["qid"])
    found = find(kept, wanted)
    members = found.join(kept.select("cid", "vec_id"), "cid")
    best = members.selectExpr("qid", "vec_id", "score", "row_number() over (partition by qid order by score desc, vec_id) as nth").where(f"nth <= {k + 1}")
    answers = queries.select("query_id", "qid").join(best, "qid").where("vec_id <> query_id")
    ranked = answers.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score")
    return ranked.where(f"rank <= {k}")
