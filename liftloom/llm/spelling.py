"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under the form used most.

Words are counted in one pass over whole texts. Then every word stands in a block of words of its length with the same numbers of
letters of four classes. One inserted letter raises one of these numbers by one; a replaced one leaves all of them or moves one letter from class to
class. So a block has to meet itself and the few blocks next to it, of the same or the next length, and no others. Blocks are cut
into tiles of bounded size and each pair of tiles is a row, so common lengths are spread over many tasks and no task holds more than two tiles.
For a pair of tiles a product of the matrices of letter counts gives all squared distances at once; a pair at most two apart is verified
letter by letter. Words of any number keep all their links; the work of products grows with the pairs of words of neighbouring blocks.

Null texts have no words; a null doc_id is hashed as empty text. Repeated rows count as often as they come. No words give no rows. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftloom.session import written

#: one in so many runs loses a code point, which plants misspellings
PLANTED = 199
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: how much more often a form is used than its variant
FORM_RATIO = 5
#: words and code points of a tile
TILE_WORDS, TILE_CHARS = 1024, 1 << 20
#: pairs that are verified at once
VERIFIED = 1 << 16
#: different words a task gathers before it hands them on
HELD_WORDS = 200_000
#: characters that are searched at once
SEGMENT = 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_NO_LETTER = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {n: n + 32 for n in range(65, 91)}
#: classes of letters about as frequent as each other; all other letters are in the last one
CLASSES = ("aeiou", "nrts", "lhdcm")


def _segments(text: str) -> Iterator[str]:
    """A text in stretches that end where no run goes on."""
    begin = 0
    while begin < len(text):
        end = begin + SEGMENT
        if end < len(text):
            stop = _NO_LETTER.search(text, end)
            end = stop.start() if stop else len(text)
        yield text[begin:end]
        begin = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({"word": pa.array(list(total.keys()), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
        total.clear()
        return batch

    for batch in batches:
        for doc_id, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            text = value.as_py()
            if not text:
                continue
            start = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
            for segment in _segments(text):
                lower = segment.lower() if segment.isascii() else segment.translate(_LOWER)
                for word, n in Counter(_RUN.findall(lower)).items():
                    if len(word) < LEAST_LETTERS:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % PLANTED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    total[word] += n
                if len(total) > HELD_WORDS:
                    yield out()
    if total:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: words of six letters or more that occur five times or more."""
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _tiles(words: DataFrame) -> DataFrame:
    """``(block, tile, words)``: the words of a tile are of one block. A block's first number is the length."""
    inner = [F.length("word") - F.length(F.regexp_replace("word", f"[{letters}]", "")) for letters in CLASSES]
    blocked = words.select("word", F.array(F.length("word"), *inner).alias("block"))
    # words are dealt by hash, so a block of any size is numbered without being sorted as a whole
    per_tile = F.greatest(F.lit(1), F.least(F.lit(TILE_WORDS), F.lit(TILE_CHARS) / F.col("block")[0])).cast("bigint")
    sizes = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.ceil(F.col("n") / per_tile).alias("tiles"))
    dealt = blocked.join(sizes, "block").select("block", F.pmod(F.xxhash64("word"), "tiles").alias("tile"), "word")
    return dealt.groupBy("block", "tile").agg(F.sort_array(F.collect_list("word")).alias("words"))


def _met(block: Column) -> Column:
    """The blocks a block meets: itself; those with a letter moved from class to class, of which only larger ones; the next length's."""
    n = len(CLASSES)
    length = block[0]
    inner = [block[i + 1] for i in range(n)]

    def moved(by_length: int, change: dict[int, int]) -> Column:
        return F.array(length + by_length, *[inner[i] + change.get(i, 0) for i in range(n)])

    others = [moved(0, {}), moved(1, {}), *[moved(1, {i: 1}) for i in range(n)]]
    # class n is the rest, which the length implies
    moves = [{a: 1, b: -1} for a in range(n) for b in range(n) if a < b] + [{a: 1} for a in range(n)]
    return F.array(*others, *[moved(0, change) for change in moves])


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row per word, and counts of 32 letters: a-z, and six for all others together."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
    kinds = np.where((codes >= 97) & (codes < 123), codes - 97, 26 + codes % 6).astype(np.int64)
    exact = np.float32 if codes.shape[1] < 2000 else np.float64
    flat = kinds + 32 * np.arange(len(words))[:, None]
    return codes, np.bincount(flat.ravel(), minlength=32 * len(words)).reshape(-1, 32).astype(exact)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row and row differ by one edit; rows of ``b`` are as long or one longer."""
    short = a.shape[1]
    same = a == b[:, :short]
    if b.shape[1] == short:
        return same.sum(axis=1) == short - 1
    front = np.where(same.all(axis=1), short, same.argmin(axis=1))
    back = (a == b[:, 1:])[:, ::-1]
    rear = np.where(back.all(axis=1), short, back.argmin(axis=1))
    return front + rear >= short


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two tiles, the second of words as long or one longer, to their near pairs."""
    for batch in batches:
        for mine, other, same in ([batch.column(name)[row].as_py() for name in ("words", "others", "same")] for row in range(batch.num_rows)):
            codes_a, counts_a = _letters(mine)
            codes_b, counts_b = _letters(other)
            norms_b = (counts_b * counts_b).sum(axis=1)
            rows = max(1, (1 << 22) // len(other))
            for begin in range(0, len(mine), rows):
                part = counts_a[begin : begin + rows]
                distances = (part * part).sum(axis=1)[:, None] + norms_b[None, :] - 2 * (part @ counts_b.T)
                close = distances <= 2.5
                if same:
                    close &= np.arange(len(other))[None, :] > (begin + np.arange(len(part)))[:, None]
                left, right = np.nonzero(close)
                left += begin
                step = max(1, min(VERIFIED, (1 << 24) // codes_b.shape[1]))
                for first in range(0, len(left), step):
                    x, y = left[first : first + step], right[first : first + step]
                    sure = _one_edit(codes_a[x], codes_b[y])
                    if sure.any():
                        yield pa.RecordBatch.from_pydict(
                            {"a": pa.array([mine[i] for i in x[sure]], pa.string()), "b": pa.array([other[i] for i in y[sure]], pa.string())}
                        )


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of different words of one edit, once: ``(a, b)``. ``words`` has a column ``word`` without repeats."""
    tiles = written(_tiles(words), "tiles")
    asked = tiles.select(F.col("block").alias("from_block"), F.col("tile").alias("from_tile"), F.col("words"), F.explode(_met(F.col("block"))).alias("block"))
    met = asked.join(tiles.select("block", "tile", F.col("words").alias("others")), "block")
    same_block = F.col("from_block") == F.col("block")
    met = met.where(~same_block | (F.col("from_tile") <= F.col("tile"))).select(
        "words", "others", (same_block & (F.col("from_tile") == F.col("tile"))).alias("same"), F.xxhash64("from_block", "from_tile", "block", "tile").alias("pair")
    )
    spark = words.sparkSession
    # products cost time and not bytes, so adaptive execution must not put them together
    tasks = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return met.repartition(tasks, "pair").select("words", "others", "same").mapInArrow(_near, "a string, b string")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    The form is the near word of the largest count, the first in code-point order among equals, if it is used five times as often or
    more. The root is the last form of the chain of forms. Counts grow along a chain, so it ends; it is followed in doubling steps.
    """
    counts = written(word_counts(docs), "words")
    pairs = near_pairs(counts.select("word"))
    both = _both(written(pairs, "near"))
    best = both.join(counts.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    judged = counts.join(best, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", f"if(-best.less >= {FORM_RATIO} * n, best.other, NULL) AS form", f"if(-best.less >= {FORM_RATIO} * n, -best.less, NULL) AS form_n"
    )
    judged = written(judged.withColumn("root", F.coalesce("form", "word")), "judged")
    # a chain has at most log5 of the largest count steps
    top = counts.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(2.0, math.log(top, FORM_RATIO) + 1)))):
        ends = judged.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        judged = judged.join(ends, "root", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("further", "root").alias("root"))
        judged = written(judged, "judged")
    return judged.select("word", "form", "root", "n", "n_near", "form_n")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
