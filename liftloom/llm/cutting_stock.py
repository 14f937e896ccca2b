"""Packing token sequences by cutting-stock column generation.

Documents are tokenized, and cut into full sequences and a rest. The rests are counted by length; the histogram has fewer
rows than a sequence has tokens, however many documents there are. Over it a linear program chooses how often to use each
pattern, a set of lengths that fills a sequence exactly. Patterns are columns, made one at a time: a knapsack over the
program's prices finds the pattern that would gain most. The rounded patterns are then dealt out to the documents, which
carry a rank within their length, so no list of documents is ever gathered. Rests that no pattern takes, such as those of one length that many
share, are laid end to end and cut where a sequence is full, so each is cut once at most. Only what is left at the very
end falls short of a full sequence, and is split into sequences of lengths that are powers of two, which need no padding.

Token ids are those of the vocabulary file with special strings parsed as its library does; id 0 ends each document.

Defined results: a null or empty text has the one token 0; rows that repeat a document are packed each; a null ``doc_id`` is
kept; equal lengths are ranked by a digest of the id; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.llm.ranks import running_before
from liftloom.llm.words import slices
from liftloom.session import written

END_ID = 0


@dataclass(frozen=True)
class PackSettings:
    """Sequence length, vocabulary, and how long the linear program is worked on."""

    #: a power of two
    tokens: int = 1024
    #: vocabulary file of the tokenizers library; None takes the public byte-level one of 50,257 ids
    vocabulary: str | None = None
    #: exchanges of the linear program; its best solution so far is used then, which costs cuts, never rows or padding
    most_exchanges: int = 1000


class Encoder:
    """Ids of a vocabulary file. The same ranks, where the faster library has them beside the file, give the same ids."""

    def __init__(self, vocabulary: str | None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = Path(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        self.plain = Tokenizer.from_file(str(path))
        self.special = [token.content for token in self.plain.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = path.with_suffix(".tiktoken")
        if ranks.exists():
            entries = (line.split() for line in ranks.read_bytes().splitlines() if line)
            merges = {base64.b64decode(token): int(rank) for token, rank in entries}
            self.fast = tiktoken.Encoding(path.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text and the end id, as little-endian unsigned 32-bit numbers."""
        if self.fast is None or any(token in text for token in self.special):
            found = np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")
        else:
            found = self.fast.encode_to_numpy(text).astype("<u4", copy=False)
        return np.append(found, np.array([END_ID], "<u4"))


_encoders: dict[str | None, Encoder] = {}


def _encoder(vocabulary: str | None) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def _powers(length: int) -> list[int]:
    """The powers of two that add up to a length, largest first."""
    return [1 << bit for bit in range(length.bit_length() - 1, -1, -1) if length >> bit & 1]


_TOKENS = "doc_id long, digest string, doc_tokens long, full_crcs array<long>, rest int, rest_crc long, rest_ids binary"


def tokenized(docs: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """A row per document: its number of tokens, and checksums of its full pieces and its rest, and the ids of the rest."""
    size, vocabulary = settings.tokens, settings.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                totals, fulls, rests, rest_crcs, rest_ids = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    ids = memoryview(encoder.ids(text or "")).cast("B")
                    total = len(ids) // 4
                    full = total // size
                    rest = ids[full * size * 4 :]
                    fulls.append([zlib.crc32(ids[n * size * 4 : (n + 1) * size * 4]) for n in range(full)])
                    totals.append(total)
                    rests.append(total % size)
                    rest_crcs.append(zlib.crc32(rest))
                    rest_ids.append(bytes(rest))
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("digest"), pa.array(totals, pa.int64()), pa.array(fulls, lists), pa.array(rests, pa.int32()), pa.array(rest_crcs, pa.int64()), pa.array(rest_ids, pa.binary())],
                    names=["doc_id", "digest", "doc_tokens", "full_crcs", "rest", "rest_crc", "rest_ids"],
                )

    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("digest")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest, F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, _TOKENS)


@dataclass(frozen=True)
class Pattern:
    """Lengths that fill a sequence, with how often each occurs, and how many sequences use it."""

    lengths: tuple[tuple[int, int], ...]
    copies: int


def choose_patterns(histogram: dict[int, int], size: int, most_exchanges: int) -> list[Pattern]:
    """Patterns that fill sequences exactly and never use more pieces of a length than there are.

    The linear program gains, for every piece it takes whole, the cuts that the piece would need otherwise. It starts from
    complementary pairs of lengths and is improved by the revised simplex method; a new column comes from a pair if one gains,
    else from the knapsack.
    """
    lengths = np.array(sorted(length for length, count in histogram.items() if 0 < length < size and count > 0))
    if not len(lengths):
        return []
    counts = np.array([histogram[length] for length in lengths.tolist()], dtype=np.float64)
    gains = np.array([bin(length).count("1") - 1 + 0.01 for length in lengths.tolist()])
    row_of = np.full(size + 1, -1)
    row_of[lengths] = np.arange(len(lengths))
    partner = row_of[size - lengths]
    paired = np.flatnonzero(partner >= 0)
    rows = len(lengths)
    inverse = np.eye(rows)
    basis: list[dict[int, int] | None] = [None] * rows
    worth = np.zeros(rows)
    values = counts.copy()
    for row in paired.tolist():
        other = int(partner[row])
        if row == other:
            basis[row], worth[row] = {row: 2}, 2 * gains[row]
            values[row], inverse[row, row] = counts[row] / 2, 0.5
        elif (counts[row], row) < (counts[other], other):
            basis[row], worth[row] = {row: 1, other: 1}, gains[row] + gains[other]
            values[other], inverse[other, row] = counts[other] - counts[row], -1.0
    for _ in range(most_exchanges):
        prices = worth @ inverse
        net = gains - prices
        column = None
        if len(paired):
            sums = net[paired] + net[partner[paired]]
            best = int(sums.argmax())
            if sums[best] > 1e-7:
                first, second = int(paired[best]), int(partner[paired[best]])
                column = {first: 2} if first == second else {first: 1, second: 1}
        slack = int(prices.argmin())
        entering_slack = column is None and prices[slack] < -1e-7
        if column is None and not entering_slack:
            column = _knapsack(lengths, net, size)
            if column is None:
                break
        if entering_slack:
            move, gain = inverse[:, slack].copy(), 0.0
        else:
            move = sum(inverse[:, row] * many for row, many in column.items())
            gain = sum(gains[row] * many for row, many in column.items())
        rising = move > 1e-9
        if not rising.any():
            break
        ratios = np.full(rows, np.inf)
        ratios[rising] = np.maximum(values[rising], 0) / move[rising]
        leaving = int(ratios.argmin())
        step = ratios[leaving]
        values -= step * move
        values[leaving] = step
        pivot = inverse[leaving] / move[leaving]
        moved, across = np.flatnonzero(np.abs(move) > 1e-12), np.flatnonzero(pivot)
        inverse[np.ix_(moved, across)] -= np.outer(move[moved], pivot[across])
        inverse[leaving] = pivot
        basis[leaving] = None if entering_slack else column
        worth[leaving] = gain

    left = counts.astype(np.int64)
    chosen: dict[int, tuple[dict[int, int], int]] = {}
    used = [n for n in range(rows) if basis[n] is not None and values[n] > 1e-6]
    for number in used:
        column = basis[number]
        whole = min(int(np.floor(values[number] + 1e-6)), *(int(left[row]) // many for row, many in column.items()))
        chosen[number] = (column, max(whole, 0))
        for row, many in column.items():
            left[row] -= many * chosen[number][1]
    for number in sorted(used, key=lambda n: np.floor(values[n] + 1e-6) - values[n]):
        column, whole = chosen[number]
        more = min(1, *(int(left[row]) // many for row, many in column.items()))
        chosen[number] = (column, whole + more)
        for row, many in column.items():
            left[row] -= many * more
    found = [Pattern(tuple(sorted(((int(lengths[r]), many) for r, many in column.items()), reverse=True)), copies) for column, copies in chosen.values() if copies]
    return sorted(found, key=lambda p: p.lengths)


def _knapsack(lengths: np.ndarray, net: np.ndarray, size: int) -> dict[int, int] | None:
    """The multiset of lengths that adds up to ``size`` exactly and gains most, if it gains anything."""
    best = np.full(size + 1, -np.inf)
    best[0] = 0.0
    choice = np.full(size + 1, -1)
    fits = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for total in range(int(lengths[0]), size + 1):
        found = net[: fits[total]] + best[total - lengths[: fits[total]]]
        row = int(found.argmax())
        best[total], choice[total] = found[row], row
    if not best[size] > 1e-7:
        return None
    column: dict[int, int] = {}
    while size:
        row = int(choice[size])
        column[row] = column.get(row, 0) + 1
        size -= int(lengths[row])
    return column


def _placements(patterns: list[Pattern]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Which ranks of a length go where: (rest, from, to, first sequence, pieces a sequence, offset); sequences used."""
    taken: dict[int, int] = {}
    entries, sequence = [], 0
    for pattern in patterns:
        offset = 0
        for length, many in pattern.lengths:
            begin = taken.get(length, 0)
            taken[length] = begin + many * pattern.copies
            entries.append((length, begin, taken[length], sequence, many, offset))
            offset += length * many
        sequence += pattern.copies
    return entries, sequence


def pack(docs: DataFrame, settings: PackSettings = PackSettings()) -> DataFrame:
    """A row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Reads ``doc_id`` and ``text``.
    """
    size = settings.tokens
    spark = docs.sparkSession
    # rows are told apart by a number of their own, as ids may be null or repeated; ids of tokens are only read for rests that are cut
    tokens = written(tokenized(docs, settings).withColumn("row", F.monotonically_increasing_id()), "tokens")
    rows = tokens.drop("rest_ids")
    counted = rows.groupBy("rest").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("full_crcs")).alias("fulls")).collect()  # a row per length
    histogram = {r["rest"]: r["docs"] for r in counted if r["rest"]}
    many = sum(r["docs"] for r in counted)
    fulls = sum(r["fulls"] for r in counted)
    entries, patterned = _placements(choose_patterns(histogram, size, settings.most_exchanges))
    # at most as many patterns as lengths, each with at most as many lengths as fit: a bounded table
    where = F.broadcast(spark.createDataFrame(entries, "of int, lo long, hi long, base long, each long, at long"))

    order = ["digest", "doc_tokens", "rest_crc"]
    placed = running_before(rows, [], "size(full_crcs)", order, many, "fulls_before")
    placed = running_before(placed, ["rest"], "1", order, many, "rank")
    placed = placed.join(where, (F.col("rest") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    placed = written(placed.drop("fulls_before_all", "rank_all", "of", "hi"), "placed")

    whole = placed.selectExpr(
        "doc_id",
        "doc_tokens",
        f"inline(concat(transform(full_crcs, (c, i) -> struct(cast(i * {size} as long) as start, {size}L as length, c as ids_crc32, fulls_before + i as sequence_id, 0L as offset)),"
        f" if(base is null, array(), array(struct(cast(size(full_crcs) * {size} as long) as start, cast(rest as long) as length, rest_crc as ids_crc32,"
        f" {fulls} + base + floor((rank - lo) / each) as sequence_id, at + (rank - lo) % each * rest as offset)))))",
    )
    loose = placed.where("base is null and rest > 0")
    # rests end to end: cut where a sequence is full, and at the very end where a power of two is
    total = loose.agg(F.sum("rest")).first()[0] or 0
    laid = running_before(loose.select("row", "doc_id", "digest", "doc_tokens", "rest_crc", "rest"), [], "rest", [*order, "row"], many, "spot").drop("spot_all")
    ends = [total - total % size]
    for power in _powers(total % size):
        ends.append(ends[-1] + power)
    last = ", ".join(f"{end}L" for end in ends)
    cuts = f"array_sort(array_distinct(filter(array(spot - spot % {size} + {size}, {last}), e -> e > spot and e < spot + rest and (e <= {ends[0]} or array_contains(array({last}), e)))))"
    pieces = (
        laid.selectExpr("*", f"{cuts} as cuts")
        .selectExpr(
            *["row", "doc_id", "doc_tokens", "rest", "spot"],
            "inline(zip_with(concat(array(spot), cuts), concat(cuts, array(spot + rest)), (b, f) -> struct(b as begin, f as finish)))",
        )
        .selectExpr("*", f"{ends[0] // size} + size(filter(array({last}), e -> e <= begin)) - 1 as late")
        .selectExpr(
            "row",
            "doc_id",
            "doc_tokens",
            "doc_tokens - rest + begin - spot as start",
            "finish - begin as length",
            "begin - spot as skip",
            f"{fulls + patterned} + if(begin < {ends[0]}, begin div {size}, late) as sequence_id",
            f"if(begin < {ends[0]}, begin % {size}, begin - array_max(filter(array({last}), e -> e <= begin))) as offset",
        )
    )
    cut = pieces.join(tokens.select("row", "rest_ids"), "row").selectExpr(
        "doc_id", "doc_tokens", "start", "length", "crc32(substring(rest_ids, cast(4 * skip + 1 as int), cast(4 * length as int))) as ids_crc32", "sequence_id", "offset"
    )
    return whole.unionByName(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
