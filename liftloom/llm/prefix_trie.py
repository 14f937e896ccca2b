"""The trie of all conversations' prefixes, with what sharing them would save.

Identical conversations collapse into one weighted sequence first, so a conversation that a third of the corpus repeats is
expanded once. A sequence that is a proper prefix of another is found by an anti-join with the inner prefixes of all; what is left are the leaves.
Then every prefix of every different sequence is aggregated with its weight.

A prefix is known by its length and two sums of 64-bit hashes, one hash per turn and place. Sums can be taken in slots, so a
conversation of any number of turns is spread over tasks. Texts never move: a turn is its SHA-256 and its number of words.

No tree is walked: of all tokens below a node, each member sequence counts what it has left (times its weight); of these, each different
node is to be kept once, by the sequence of its smallest member. Along a sequence the nodes it keeps are always its last ones,
so one place per sequence says which.

Rows without ``conv_id`` take no part. Null turns come first; rows of one turn are ordered by digest of role and text, so
the result does not depend on how rows come in. Repeated rows are turns of their own. Null role or text is empty. An empty table
gives no nodes; a table whose rebuilt conversations are all turnless gives the root alone. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.operators.scans import SLOT_ROWS, dealt, running
from liftloom.session import written

#: conversations whose head others take over have an id that this divides
HEAD_EVERY = 20
#: heads are of fewer turns than this
HEAD_TURNS = 4
#: ids of one stretch of an end list differ in their last bits only, so a stretch has 4,096 ids at most
STRETCH_BITS = 12

_NODE = ["depth", "one", "two"]
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, turn_sha, words)`` with places from 1; a conversation of any length is numbered slot by slot."""
    brief = conversations.where("conv_id IS NOT NULL").selectExpr(
        "cast(conv_id AS bigint) AS conv_id",
        "turn",
        "sha2(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')), 256) AS turn_sha",
        r"cast(regexp_count(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS bigint) AS words",
    )
    ranged = dealt(brief, ["conv_id"], ["turn", "turn_sha"], "turns")
    return running(ranged, ["conv_id"], "turn NULLS FIRST, turn_sha", {"place": "1L"}).select("conv_id", "place", "turn_sha", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of another: ``(conv_id, depth, turn_sha, words)``, and a row of depth 0 for each."""
    ids = turns.select("conv_id").distinct().selectExpr("conv_id", f"cast(crc32(cast(cast(conv_id AS string) AS binary)) % {HEAD_TURNS} AS int) AS h")
    heads = (
        turns.where(f"conv_id % {HEAD_EVERY} = 0 AND place < {HEAD_TURNS}")
        .groupBy(F.col("conv_id").alias("head_of"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "turn_sha", "words"))).alias("head"))
    )
    plan = ids.selectExpr("*", f"conv_id - conv_id % {HEAD_EVERY} AS head_of").join(heads, "head_of", "left").selectExpr(
        "conv_id", "h", "if(head IS NULL OR h = 0, cast(array() AS array<struct<place: bigint, turn_sha: string, words: bigint>>), slice(head, 1, h)) AS head"
    )
    plan = written(plan, "heads")
    taken = plan.selectExpr("conv_id", "inline(head)").selectExpr("conv_id", "place AS depth", "turn_sha", "words")
    own = turns.join(plan.selectExpr("conv_id", "h", "size(head) - h AS shift"), "conv_id").where("place > h")
    starts = plan.selectExpr("conv_id", "0L AS depth", "'' AS turn_sha", "0L AS words")
    return starts.union(taken).union(own.selectExpr("conv_id", "place + shift", "turn_sha", "words"))


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of ids in order, sequence by sequence, to one hash per sequence; only one running hash is held."""
    now, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"rep": [now], "ends_sha256": [digest.hexdigest()]}, pa.schema([("rep", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if rep == now:
                digest.update(b",")
            else:
                if now is not None:
                    yield done()
                now, digest = rep, hashlib.sha256()
            digest.update(ids.encode())
    if now is not None:
        yield done()


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node, as the module says; ``conv_id`` is the smallest member, and with ``depth`` names the node.

    Columns: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    placed = written(turns_of(conversations), "placed")
    hashed = rebuilt(placed).selectExpr(
        "*",
        # sums of decimals, which do not overflow
        "if(depth = 0, 0BD, cast(xxhash64(depth, turn_sha) AS decimal(20, 0))) AS part_one",
        "if(depth = 0, 0BD, cast(xxhash64(turn_sha, depth, 'two') AS decimal(20, 0))) AS part_two",
    )
    turns = written(hashed.select("conv_id", "depth", "words", "part_one", "part_two"), "rebuilt")

    # identical conversations, as one sequence named by its smallest member
    whole = turns.groupBy("conv_id").agg(
        F.max("depth").alias("depth"), F.sum("part_one").alias("one"), F.sum("part_two").alias("two"), F.sum("words").alias("all_words")
    )
    stretches = whole.groupBy(*_NODE, F.expr(f"shiftright(conv_id, {STRETCH_BITS}) AS stretch")).agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids"), F.max("all_words").alias("all_words")
    )
    stretches = written(stretches, "stretches")
    sequences = written(
        stretches.groupBy(*_NODE).agg(F.min(F.expr("ids[0]")).alias("rep"), F.sum(F.expr("cast(size(ids) AS bigint)")).alias("weight"), F.max("all_words").alias("all_words")),
        "sequences",
    )
    listed = stretches.join(sequences.select(*_NODE, "rep"), _NODE).selectExpr("rep", "stretch", "array_join(ids, ',') AS ids")
    ends = listed.repartition("rep").sortWithinPartitions("rep", "stretch").select("rep", "ids").mapInArrow(_end_hashes, "rep bigint, ends_sha256 string")

    # all prefixes of the different sequences
    length = sequences.selectExpr("rep", "depth AS length", "weight", "all_words")
    chosen = turns.withColumnRenamed("conv_id", "rep").join(length, "rep").withColumn("_slot", F.expr(f"depth div {SLOT_ROWS}"))
    paths = running(chosen, ["rep"], "depth", {"one": "part_one", "two": "part_two", "words_to": "words"})
    paths = written(paths.drop("_slot"), "paths")

    inner = paths.where("depth < length").select(*_NODE).distinct()
    leaves = sequences.join(inner, _NODE, "left_anti").selectExpr("rep", "1L AS leaf")
    weighed = paths.join(leaves, "rep", "left").groupBy(*_NODE).agg(
        F.min("rep").alias("conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.expr("weight * (all_words - words_to + words)")).alias("read_tokens"),
        F.max("part_one").alias("part_one"),
        F.max("part_two").alias("part_two"),
    )
    nodes = written(weighed, "nodes")

    # the nodes that a sequence keeps are its last ones: from where on, and how many words lie before
    kept = (
        paths.join(nodes.selectExpr("conv_id AS rep", "depth"), ["rep", "depth"])
        .groupBy("rep")
        .agg(F.min("depth").alias("keeps_from"), F.min(F.expr("words_to - words")).alias("words_before"))
    )
    held = paths.join(kept, "rep", "left").groupBy(*_NODE).agg(
        F.sum(F.expr("CASE WHEN keeps_from IS NULL THEN 0L WHEN depth >= keeps_from THEN all_words - words_to + words ELSE all_words - words_before END")).alias("kept_tokens")
    )

    children = (
        nodes.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), (F.col("one") - F.col("part_one")).alias("one"), (F.col("two") - F.col("part_two")).alias("two"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    # same types on both sides of the joins by sums
    wide = [F.col("depth"), F.col("one").cast("decimal(38,0)").alias("one"), F.col("two").cast("decimal(38,0)").alias("two")]
    full = (
        nodes.withColumns({"one": wide[1], "two": wide[2]})
        .join(held.select(*wide, "kept_tokens"), _NODE)
        .join(children.select(*wide, "n_children"), _NODE, "left")
        .join(ends.join(sequences.select("rep", *wide), "rep").select(*_NODE, "ends_sha256"), _NODE, "left")
    )
    full = written(full, "full")
    above = ["up_depth", "up_one", "up_two"]
    lower = full.selectExpr("*", "depth - 1 AS up_depth", "cast(one - part_one AS decimal(38,0)) AS up_one", "cast(two - part_two AS decimal(38,0)) AS up_two")
    parents = full.selectExpr("depth AS up_depth", "one AS up_one", "two AS up_two", "conv_id AS parent_conv_id")
    # most nodes of depth 1 share the root; it is one row
    first = lower.where("depth <= 1").join(F.broadcast(parents.where("up_depth = 0")), above, "left")
    joined = first.unionByName(lower.where("depth > 1").join(parents, above))
    empty = hashlib.sha256(b"").hexdigest()
    return joined.selectExpr(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "coalesce(n_children, 0L) AS n_children",
        "n_leaves",
        "read_tokens - kept_tokens AS saved_tokens",
        f"coalesce(ends_sha256, '{empty}') AS ends_sha256",
    ).select(*_COLUMNS)
