"""Words of many texts at once, with numpy over the byte buffer of an Arrow column.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. A-Z count
as a-z. Null and empty texts have no words. Texts of any length are worked through whole, in segments of about a megabyte
that end between words, so memory stays small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SEGMENT_BYTES = 1 << 20
SHINGLE_WORDS = 5

_random = np.random.default_rng(20240611)
_BYTE_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_CODE[65:91] = _BYTE_CODE[97:123]
_PLACE_CODE = _random.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = int(_random.integers(1, 2**62)) * 2 + 1
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = max(SEGMENT_BYTES + 4096, 1 << int(length).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            tables.append(np.cumprod(factors, dtype=np.uint64))
        _powers.clear()
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand rows to Python in small batches: texts are long, and a batch is held on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all bits."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each text starts in them (one entry more than rows)."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = filled.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if len(filled) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2 * SEGMENT_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most so many bytes of text, one row at least."""
    _, starts = buffer_of(batch.column(column))
    first = 0
    while first < batch.num_rows:
        after = int(np.searchsorted(starts, starts[first] + most_bytes, side="right")) - 1
        after = min(max(after, first + 1), batch.num_rows)
        yield batch.slice(first, after - first)
        first = after


def _segments(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    begin, size = 0, len(data)
    while begin < size:
        end = min(size, begin + SEGMENT_BYTES)
        while end < size and not _WHITE[data[end]]:
            stretch = data[end : end + 4096]
            step = int(np.argmax(_WHITE[stretch])) if _WHITE[stretch].any() else len(stretch)
            following = starts[np.searchsorted(starts, end, side="left")]
            if following <= end + step:
                end = int(following)
                break
            end += step
        yield begin, end
        begin = end


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, in order, and where each text starts among them (one entry more than texts)."""
    hashes, places = [], []
    for begin, end in _segments(data, starts):
        piece = data[begin:end]
        inside = ~_WHITE[piece]
        heads = inside.copy()
        heads[1:] &= ~inside[:-1]
        tails = inside.copy()
        tails[:-1] &= ~inside[1:]
        cuts = starts[np.searchsorted(starts, begin) : np.searchsorted(starts, end)] - begin
        heads[cuts] = inside[cuts]
        cuts = cuts[cuts > 0] - 1
        tails[cuts] = inside[cuts]
        first, last = np.flatnonzero(heads), np.flatnonzero(tails)
        powers, inverse = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[piece] * powers[: len(piece)], out=sums[1:])
        hashes.append(mixed((sums[last + 1] - sums[first]) * inverse[first]))
        places.append(first + begin)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), starts).astype(np.int64)


def shingle_sets(words: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: five words, or the whole text where it has one to four."""
    size = max(0, len(words) - SHINGLE_WORDS + 1)
    rows = np.zeros(size, np.uint64)
    for place in range(SHINGLE_WORDS):
        rows += words[place : place + size] * _PLACE_CODE[place]
    rows = mixed(rows)
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        count = end - begin
        if count >= SHINGLE_WORDS:
            yield np.unique(rows[begin : end - SHINGLE_WORDS + 1])
        elif count:
            whole = words[begin:end] * _PLACE_CODE[:count]
            yield mixed(whole.sum(dtype=np.uint64, keepdims=True) + np.uint64(count))
        else:
            yield np.zeros(0, np.uint64)
