"""Language identification with one bit-sliced Bloom filter for all languages.

A position of the filter holds a bit for every language. Four-byte n-grams that are common in a language set its bit at
several hashed positions; to look an n-gram up, the masks at its positions are and-ed, which gives all languages that
contain it at once. A text adds up the bits of all its n-grams per language, takes off what the filter's fill says are
false positives, and takes the language that explains the largest share.

Texts are read whole. A-Z and the Latin letters of two bytes count as lower case, other ASCII as white space.

Defined results: a text that is null, empty or has no letter is ``und`` with score 0; letters without any known n-gram give
the commonest language with score 0; equal shares go to the language with more training documents, then the smaller name;
no training rows give ``und`` for all; a null ``doc_id`` counts as the empty string for the fold; repeated rows are
predicted one by one; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from liftloom.llm import words as W

UNKNOWN = "und"


@dataclass(frozen=True)
class BloomSettings:
    """Bounds of training, and the size of the filter."""

    #: documents of a language that n-grams are counted in, at most about this many (chosen by hashed id and text)
    sample_per_language: int = 3000
    #: n-grams kept of a language: those in the most documents
    grams_per_language: int = 20_000
    #: an n-gram must be in so many sampled documents of the language, and in such a share of them
    least_documents: int = 2
    least_share: float = 0.003
    bits: int = 18
    hashes: int = 2


_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))
_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_PAD = 4


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the texts as numbers, and the row of each."""
    data, starts = W.buffer_of(column)
    lengths = np.diff(starts)
    rows = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + _PAD)
    spread = np.full(len(data) + _PAD * (len(lengths) + 1), 32, dtype=np.uint8)
    text = _LETTER[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    text[capital] += 32
    spread[_PAD:][np.arange(len(data)) + _PAD * np.repeat(np.arange(len(lengths)), lengths)] = text
    wide = spread[1:].astype(np.uint32)
    grams = wide[: len(rows)].copy()
    for place in range(1, 4):
        grams |= wide[place : place + len(rows)] << np.uint32(8 * place)
    real = grams != 0x20202020
    return grams[real], rows[real]


def _positions(grams: np.ndarray, settings: BloomSettings) -> Iterator[np.ndarray]:
    for factor in _FACTORS[: settings.hashes]:
        values = grams * factor
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        yield values >> np.uint32(32 - settings.bits)


@dataclass(frozen=True)
class LanguageFilter:
    """Languages in order of preference, one array of byte masks per eight of them, and each one's false-positive rate."""

    languages: tuple[str, ...]
    slices: tuple[np.ndarray, ...]
    false_rates: np.ndarray
    settings: BloomSettings

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        rows = len(column)
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        grams, owners = _grams(column)
        positions = list(_positions(grams, self.settings))
        total = np.bincount(owners, minlength=rows).astype(np.float64)
        best, most = np.zeros(rows, np.int64), np.full(rows, -1.0)
        bits = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1
        for number, table in enumerate(self.slices):
            masks = table[positions[0]]
            for more in positions[1:]:
                masks &= table[more]
            counts = np.bincount(owners.astype(np.int64) * 256 + masks, minlength=rows * 256).reshape(rows, 256)
            rates = self.false_rates[8 * number : 8 * number + 8]
            hits = (counts @ bits)[:, : len(rates)]
            true = np.clip((hits - rates[None, :] * total[:, None]) / (1 - rates[None, :]), 0, None)
            place = true.argmax(axis=1)
            here = true[np.arange(rows), place]
            # equal shares stay with the language before
            best = np.where(here > most, place + 8 * number, best)
            most = np.maximum(most, here)
        share = np.clip(most / np.maximum(total, 1), 0, 1)
        lettered = _has_letters(column)
        names = [self.languages[b] if known else UNKNOWN for b, known in zip(best.tolist(), lettered, strict=True)]
        return names, np.where(lettered, share, 0.0)


def _has_letters(column: pa.Array) -> list[bool]:
    data, starts = W.buffer_of(column)
    folded = data | 32
    before = np.concatenate([[0], np.cumsum((folded >= 97) & (folded <= 122) & (data < 128))])
    plain = (before[starts[1:]] > before[starts[:-1]]).tolist()
    return [known or any(map(str.isalpha, column[row].as_py() or "")) for row, known in enumerate(plain)]


def train(labelled: DataFrame, settings: BloomSettings = BloomSettings()) -> LanguageFilter:
    """The filter of the languages in ``lang`` from the texts in ``text``; rows with a null in either teach nothing.

    Every language is learnt. Counting and hashing run on the executors; a row per language reaches the driver, with its bits of
    the filter (32 kB, compressed on the way).
    """
    named = labelled.where("lang is not null and text is not null and lang <> 'und'")
    sizes = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return LanguageFilter((), (), np.zeros(0), settings)
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(r["lang"], settings.sample_per_language / r["count"]) for r in sizes], "lang string, share double")
    chosen = (
        named.select("doc_id", "lang", "text")
        .join(F.broadcast(shares), "lang")
        .where("pmod(xxhash64(doc_id, text, 'language'), 1000000) < share * 1000000")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                grams, owners = _grams(batch.column("text"))
                seen = np.unique((owners.astype(np.uint64) << np.uint64(32)) | grams)
                langs = batch.column("lang").dictionary_encode()
                codes = langs.indices.to_numpy()[(seen >> np.uint64(32)).astype(np.int64)].astype(np.uint64)
                pairs, counts = np.unique((codes << np.uint64(32)) | (seen & np.uint64(0xFFFFFFFF)), return_counts=True)
                names = langs.dictionary.take(pa.array((pairs >> np.uint64(32)).astype(np.int64)))
                found = pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([names, found, pa.array(counts.astype(np.int64))], names=["lang", "gram", "docs"])

    counted = chosen.select("lang", "text").mapInArrow(run, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    sampled = {r["lang"]: min(r["count"], settings.sample_per_language) for r in sizes}
    least = {lang: float(max(settings.least_share * n, min(settings.least_documents, n))) for lang, n in sampled.items()}
    languages = tuple(r["lang"] for r in sizes)
    bounds = spark.createDataFrame([(lang, number, least[lang]) for number, lang in enumerate(languages)], "lang string, number int, least double")
    ranked = counted.join(F.broadcast(bounds), "lang").where("docs >= least")
    top = ranked.selectExpr("number", "gram", "row_number() over (partition by number order by docs desc, gram) as place")

    def row_of(number: int, bits: np.ndarray) -> pa.RecordBatch:
        packed = zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], names=["number", "bits"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the ranking leaves the rows of a language side by side
        last, bits = -1, np.zeros(0, bool)
        for batch in batches:
            numbers, grams = batch.column("number").to_numpy(), batch.column("gram").to_numpy().astype(np.uint32)
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for begin, end in zip(edges, edges[1:], strict=False):
                if begin == end:
                    continue
                if numbers[begin] != last:
                    if last >= 0:
                        yield row_of(last, bits)
                    last, bits = int(numbers[begin]), np.zeros(1 << settings.bits, bool)
                for positions in _positions(grams[begin:end], settings):
                    bits[positions] = True
        if last >= 0:
            yield row_of(last, bits)

    rows = top.where(f"place <= {settings.grams_per_language}").select("number", "gram").mapInArrow(hashed, "number int, bits binary").collect()
    slices = tuple(np.zeros(1 << settings.bits, np.uint8) for _ in range(-(-len(languages) // 8)))
    rates = np.zeros(len(languages))
    for row in rows:
        number, packed = row["number"], np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        slices[number // 8][:] |= np.unpackbits(packed, count=1 << settings.bits, bitorder="little") << np.uint8(number % 8)
    for number in range(len(languages)):
        rates[number] = float((slices[number // 8] & np.uint8(1 << (number % 8)) != 0).mean()) ** settings.hashes
    return LanguageFilter(languages, slices, rates, settings)


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text", added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` with the predicted language and its score, named as ``added``, behind them."""
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField(added[0], StringType()), StructField(added[1], DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, text):
                langs, shares = model.predict(batch.column(text))
                columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(shares, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.mapInArrow(run, schema)


def fold(modulus: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def identify(docs: DataFrame, settings: BloomSettings = BloomSettings()) -> DataFrame:
    """Predict every document with a filter trained on those outside the held-out fold.

    Columns ``doc_id``, ``held_out``, ``lang_pred``, ``score``. Reads ``doc_id``, ``text`` and, for training, ``lang``.
    """
    model = train(docs.where(fold(4) != 2), settings)
    tested = docs.select("doc_id", (fold(4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(tested, model).select("doc_id", "held_out", "lang_pred", "score")
