"""Near-duplicate groups of documents by SetSketch registers.

Each document becomes the set of its five-word shingles. A register keeps the smallest of as many exponentially spread
hash values as the set has members, on a logarithmic scale and cut to sixteen bits, so the sketch of a union is the
larger value of each register. Bands of registers propose pairs, the likelihood of the registers' order estimates their
similarity, and full shingle sets decide.

A bucket of documents that share a band is never turned into all its pairs. First each bucket tests its members against one
of them. Then the components found so far are looked up, and only members outside the largest component of their bucket
are compared with the other components' members, by their shingles folded to 32 bits, inside the join: for sets of up to
4,096 shingles that is a proof, larger ones are sampled by hash, so a pair that is no link hardly ever leaves the join. Of the
pairs that do, those most alike for their two components are verified first, then more of them round by round, until each pair
is verified or its ends are joined by a chain of confirmed links.

Defined results: a null or empty text, or one of white space, has no shingles, stands alone and is kept; repeated rows and
rows with equal sets form one class; a null ``doc_id`` never names a component unless its class has no other, and ``kept``
is then true; no rows give no rows; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.llm import words as W
from liftloom.llm.links import components
from liftloom.session import written


@dataclass(frozen=True)
class SketchSettings:
    """How similar documents are told.

    With 40 bands of 4 registers a pair at similarity 0.75 is missed about once in four million.
    """

    bands: int = 40
    band_registers: int = 4
    base: float = 1.02
    #: links need ``100 * intersection >= percent * union``
    percent: int = 75
    #: pairs estimated this many standard deviations below the limit are not verified
    deviations: float = 5.0
    #: sets of up to so many shingles are compared whole inside the join, larger ones by a sample of about this size
    whole_set: int = 4096
    #: so many ids are sent to all tasks at most to pick the texts to verify
    broadcast_ids: int = 200_000

    @property
    def registers(self) -> int:
        return self.bands * self.band_registers


_FINISH = np.uint32(0x85EBCA6B)
_TOP = np.iinfo(np.uint16).max
_BLOCK = 2048


def _register_codes(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(77)
    factors = random.integers(0, 2**31, (count, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors, random.integers(0, 2**32, (count, 1), dtype=np.uint32)


def sketch_of(members: np.ndarray, settings: SketchSettings) -> np.ndarray:
    """The registers of a non-empty set of 64-bit hashes. Larger means a smaller minimum."""
    factors, shifts = _register_codes(settings.registers)
    low = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(settings.registers, 2**32 - 1, dtype=np.uint32)
    for begin in range(0, len(low), _BLOCK):
        values = low[None, begin : begin + _BLOCK] * factors
        values += shifts
        values ^= values >> np.uint32(16)
        values *= _FINISH
        np.minimum(least, values.min(axis=1), out=least)
    waits = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    steps = np.floor(1 - np.log(waits) / np.log(settings.base))
    return np.clip(steps + 64, 0, _TOP).astype(np.uint16)


_SKETCHES = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sketch binary"


def sketches(docs: DataFrame, settings: SketchSettings) -> DataFrame:
    """A row per document: a hash of its text, size of its set, two digests that together identify the set, and the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                sizes, first, second, registers = [], [], [], []
                for members in W.shingle_sets(*W.word_hashes(*W.buffer_of(batch.column("text")))):
                    sizes.append(len(members))
                    one, two = _digests(members)
                    first.append(one)
                    second.append(two)
                    registers.append(sketch_of(members, settings).tobytes() if len(members) else b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(registers, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "sketch"],
                )

    return _identified(docs).mapInArrow(run, _SKETCHES)


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _digests(members: np.ndarray) -> tuple[int, int]:
    one = members.sum(dtype=np.uint64)
    two = W.mixed(members ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _buckets(classes: DataFrame, settings: SketchSettings) -> DataFrame:
    """A row per class and band: ``bucket`` and ``cid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16)
            bands = values.reshape(batch.num_rows, settings.bands, settings.band_registers).astype(np.uint64)
            keys = np.zeros(bands.shape[:2], np.uint64) + np.arange(settings.bands, dtype=np.uint64)
            for place in range(settings.band_registers):
                keys = W.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, place])
            ids = np.repeat(batch.column("cid").to_numpy(), settings.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["bucket", "cid"])

    return classes.where("n_shingles > 0").select("cid", "sketch").mapInArrow(run, "bucket long, cid long")


def _folded(sets: DataFrame, settings: SketchSettings) -> DataFrame:
    """What the join compares of each class: ``cid``, ``n`` (the set's size), ``level``, ``ids`` and ``lost``.

    ``ids`` are the members at the level, folded to 32 bits: all at level 0, and at each level half of those at the one below.
    ``lost`` counts the members of level 0 that fold to the value of another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, levels, ids, lost = [], [], [], []
            for packed in batch.column("members").to_pylist():
                members = np.frombuffer(packed, np.uint64)
                level = max(0, int(np.ceil(np.log2(len(members) / settings.whole_set))))
                low = members.astype(np.uint32)
                kept = np.unique(low[low < 2 ** (32 - level)])
                sizes.append(len(members))
                levels.append(level)
                ids.append(kept.view(np.int32))
                lost.append(len(members) - len(kept) if level == 0 else 0)
            columns = [batch.column("cid"), pa.array(sizes, pa.int64()), pa.array(levels, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "n", "level", "ids", "lost"])

    return sets.mapInArrow(run, "cid long, n long, level int, ids array<int>, lost long")


def _least_alike(settings: SketchSettings) -> float:
    """The similarity below which registers speak against a link."""
    limit = settings.percent / 100
    return limit - settings.deviations * float(np.sqrt(limit * (1 - limit) / settings.registers))


def estimate_similarity(one: np.ndarray, two: np.ndarray, size_one: np.ndarray, size_two: np.ndarray, base: float) -> np.ndarray:
    """The similarity that makes the order of the registers of each pair likeliest, given both set sizes."""
    above = (one > two).sum(axis=1)[:, None]
    below = (one < two).sum(axis=1)[:, None]
    equal = one.shape[1] - above - below
    u = (size_one / (size_one + size_two))[:, None]
    v = 1 - u
    tries = np.minimum(u / v, v / u) * np.linspace(0, 1, 201)[None, :]

    def chance(share: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(share, 0, 1) * (base - 1) / base) / np.log(base)

    over, under = chance(u - v * tries), chance(v - u * tries)
    tiny = 1e-12
    likelihood = above * np.log(over + tiny) + below * np.log(under + tiny) + equal * np.log(np.maximum(1 - over - under, tiny))
    return np.take_along_axis(tries, likelihood.argmax(axis=1)[:, None], axis=1)[:, 0]


def _likely(pairs: DataFrame, classes: DataFrame, settings: SketchSettings) -> DataFrame:
    """The pairs whose sizes and registers do not speak against a link, with their estimated similarity ``alike``."""
    side = classes.select("cid", "n_shingles", "sketch")
    sized = (
        pairs.join(side.toDF("a", "na", "sa"), "a")
        .join(side.toDF("b", "nb", "sb"), "b")
        .where(f"100 * least(na, nb) >= {settings.percent} * greatest(na, nb)")
    )
    floor = _least_alike(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                shape = (part.num_rows, settings.registers)
                one, two = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(shape) for c in ("sa", "sb"))
                sizes = (part.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
                alike = estimate_similarity(one, two, *sizes, settings.base)
                found = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(alike)], names=["a", "b", "alike"])
                yield found.filter(pa.array(alike >= floor))

    return sized.mapInArrow(run, "a long, b long, alike double")


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, settings: SketchSettings) -> DataFrame:
    """The shingle set of each of the classes ``ids`` (a column ``cid``), written once: ``cid`` and the sorted hashes, ``members``."""
    needed = written(classes.join(ids.distinct(), "cid", "left_semi").select("cid", "rep", "rep_hash", "d1", "d2"), "needed")
    total = needed.count()
    if total <= settings.broadcast_ids:
        needed = F.broadcast(needed)
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))
    own = _identified(docs).join(needed, same).select("cid", "d1", "d2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                digests = zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True)
                sets = W.shingle_sets(*W.word_hashes(*W.buffer_of(batch.column("text"))))
                # texts of one id and hash may differ: only the one with the class's digests counts
                packed = [members.tobytes() if _digests(members) == digest else None for members, digest in zip(sets, digests, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(packed, pa.binary())], names=["cid", "members"])

    found = written(own.mapInArrow(run, "cid long, members binary").where("members is not null"), "sets")
    # a row that repeats both id and text brings its set again
    return found if found.count() == total else written(found.groupBy("cid").agg(F.first("members").alias("members")), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: SketchSettings) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    joined = pairs.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "set_a", "b", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for packed_a, packed_b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                of_a, of_b = (np.frombuffer(packed.as_buffer(), np.uint64) for packed in (packed_a, packed_b))
                both = len(np.intersect1d(of_a, of_b, assume_unique=True))
                linked.append(100 * both >= settings.percent * (len(of_a) + len(of_b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that no chain of links joins yet, with the roots of both ends."""
    return (
        pairs.join(roots.toDF("a", "root_a"), "a", "left")
        .join(roots.toDF("b", "root_b"), "b", "left")
        .withColumns({"root_a": F.coalesce("root_a", "a"), "root_b": F.coalesce("root_b", "b")})
        .where("root_a <> root_b")
    )


def class_components(docs: DataFrame, classes: DataFrame, settings: SketchSettings) -> DataFrame:
    """Columns ``node`` and ``root`` over linked classes."""
    buckets = _buckets(classes, settings)
    # the hub is drawn anew in each bucket, so that documents that share many bands meet many hubs
    drawn = F.struct(F.xxhash64("cid", "bucket").alias("draw"), F.col("cid").alias("cid"))
    hubs = buckets.groupBy("bucket").agg(F.min(drawn).alias("low"), F.max(drawn).alias("high")).where("low.cid <> high.cid")
    rows = written(buckets.join(hubs.selectExpr("bucket", "low.cid as hub"), "bucket"), "buckets")
    tested = rows.where("cid <> hub").select(F.greatest("cid", "hub").alias("a"), F.least("cid", "hub").alias("b")).distinct()
    likely = written(_likely(tested, classes, settings), "likely")
    sets = _sets(likely.selectExpr("explode(array(a, b)) as cid"), classes, docs, settings)
    # the likeliest pair of each end goes first: it joins up most groups, and pairs inside a joined group need no proof
    of_a = likely.groupBy("a").agg(F.max(F.struct("alike", "b")).alias("best")).select("a", "best.b")
    of_b = likely.groupBy("b").agg(F.max(F.struct("alike", "a")).alias("best")).select("best.a", "b")
    first = written(of_a.union(of_b).distinct(), "first")
    roots = written(components(_confirmed(first, sets, settings)), "roots")
    rest = _with_roots(likely, roots).select("a", "b").join(first, ["a", "b"], "left_anti")
    roots = _joined_up(roots, written(_confirmed(rest, sets, settings), "confirmed"))

    rooted = rows.join(roots, rows.cid == roots.node, "left").select("bucket", "cid", F.coalesce("root", "cid").alias("root"))
    counts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = counts.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    mixed = largest.where("roots > 1").selectExpr("bucket", "most.root as most")
    apart = written(rooted.join(mixed, "bucket"), "apart")
    sets = _sets(apart.select("cid"), classes, docs, settings)
    apart = written(apart.join(_folded(sets, settings), "cid"), "apart")
    # each member outside the largest component meets the other components' members; of two such, the smaller is hub
    hubs = apart.where("root <> most").selectExpr("bucket", "cid as hub", *(f"{c} as hub_{c}" for c in ("root", "n", "level", "ids", "lost")))
    limit = settings.percent
    scale = "pow(2.0d, greatest(level, hub_level))"
    asked = f"{limit} * (n + hub_n) / {scale}"
    slack = f"if(greatest(level, hub_level) = 0, least(lost, hub_lost), {settings.deviations} * sqrt({asked} / {100 + limit}))"
    shared = "size(array_intersect(ids, hub_ids))"
    met = apart.join(hubs, "bucket").where(
        "root <> hub_root and (root = most or cid > hub)"
        f" and 100 * least(n, hub_n) >= {limit} * greatest(n, hub_n)"
        f" and {100 + limit} * ({shared} + {slack}) >= {asked}"
    )
    met = met.selectExpr("greatest(cid, hub) as a", "least(cid, hub) as b", f"{shared} * {scale} / (n + hub_n) as alike")
    pool = written(met.dropDuplicates(["a", "b"]).join(likely, ["a", "b"], "left_anti"), "pool")
    most = 1
    while not pool.isEmpty():
        ranked = pool.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
        ends = "least(coalesce(root_a, a), coalesce(root_b, b)), greatest(coalesce(root_a, a), coalesce(root_b, b))"
        ranked = ranked.selectExpr("a", "b", "alike", f"row_number() over (partition by {ends} order by alike desc, a, b) as nth")
        now = written(ranked, "ranked")
        new = written(_confirmed(now.where(f"nth <= {most}"), sets, settings), "confirmed")
        if not new.isEmpty():
            roots = _joined_up(roots, new)
        pool = written(_with_roots(now.where(f"nth > {most}").select("a", "b", "alike"), roots).select("a", "b", "alike"), "pool")
        most *= 8
    return roots


def _joined_up(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after some more links, which are followed from root to root only."""
    ends = _with_roots(links, roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    moved = components(ends).toDF("old", "new")
    known = roots.join(moved, roots.root == moved.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    single = moved.join(roots, moved.old == roots.node, "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return written(known.union(single), "roots")


def near_duplicates(docs: DataFrame, settings: SketchSettings = SketchSettings()) -> DataFrame:
    """A row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``. Reads ``doc_id`` and ``text``."""
    rows = written(sketches(docs, settings), "sketches")
    keys = ["n_shingles", "d1", "d2"]
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least")
    grouped = rows.groupBy(*keys).agg(least, F.first("sketch").alias("sketch"))
    named = grouped.select(*keys, F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_hash"), "sketch")
    classes = written(named.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = class_components(docs, classes, settings)
    names = classes.select(*keys, "cid", "rep").join(roots, F.col("cid") == F.col("node"), "left")
    names = names.select(*keys, "rep", F.coalesce("root", "cid").alias("root"))
    least = names.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_set = names.join(least, "root").select(*keys, "component_id").where("n_shingles > 0")
    return rows.join(by_set, keys, "left").select(
        "doc_id",
        "n_shingles",
        F.expr("if(n_shingles > 0, component_id, doc_id)").alias("component_id"),
        F.expr("n_shingles = 0 or doc_id <=> component_id").alias("kept"),
    )
