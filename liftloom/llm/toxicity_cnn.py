"""Toxicity of documents by a convolutional text classifier, with thresholds calibrated by language.

Words are known by 64-bit hashes; those that enough sampled documents hold have embeddings, all others share one. Filters of several widths run over the words of a document, each keeps its largest response, and a
logistic layer weighs these. All is trained in numpy from a bounded, hashed sample of the labelled documents. A part of the
sample is set aside: on it, each language gets the threshold that splits its labels best, and a score is the distance of a
document's response from the threshold of its language, so that 0.5 is the decision for all. The language is guessed from the
text alone.

Filters are linear in each word, so for whole corpora their responses are looked up per word and added, block by block; a
text of any length is read whole.

Defined results: a null or empty text, or one without letters, has the score of no words; repeated rows are scored one by one;
a null ``doc_id`` counts as the empty string for the fold; without labels of both kinds every score is the share of label 1,
0 without any; an id labelled more than once is toxic if any label says so; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.llm import langid_bloom
from liftloom.llm import words as W
from liftloom.llm.langid_bloom import LanguageFilter, fold
from liftloom.llm.tagger import Adam


@dataclass(frozen=True)
class CnnSettings:
    """Bounds of training and shape of the classifier."""

    #: labelled documents of each label that are sampled, at most about this many (chosen by hashed id)
    sample_each: int = 4000
    #: longer documents are not trained on
    most_words: int = 20_000
    #: words with an embedding: those in the most sampled documents, in so many and in such a share of them at least
    words: int = 40_000
    least_documents: int = 6
    least_share: float = 0.001
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    epochs: int = 8
    #: small samples are gone through more often, up to so many steps
    least_steps: int = 600
    rate: float = 0.005
    #: slows the embeddings of rare words, which would otherwise be learnt by heart
    floor: float = 1e-4
    #: share of words that a training step does not see
    unseen: float = 0.4
    batch: int = 32
    #: how much worse a share of clean documents called toxic is than one of toxic documents missed
    false_alarms: float = 3.0
    #: documents of a language that are set aside before it gets a threshold of its own
    least_calibration: int = 40


_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_BLOCK = 1 << 15


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of each text, of letters only, and where each text starts among them."""
    data, starts = W.buffer_of(column)
    return W.word_hashes(_LETTERS[data], starts)


def known_words(documents: list[np.ndarray], settings: CnnSettings) -> np.ndarray:
    """The sorted hashes of the words that get an embedding."""
    if not documents:
        return np.zeros(0, np.uint64)
    words, counts = np.unique(np.concatenate([np.unique(words) for words in documents]), return_counts=True)
    enough = counts >= max(settings.least_documents, settings.least_share * len(documents))
    words, counts = words[enough], counts[enough]
    return np.sort(words[np.argsort(-counts, kind="stable")[: settings.words]])


def word_ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each word among the known ones; the number of these for any other word."""
    if not len(known):
        return np.zeros(len(hashes), np.int32)
    places = np.searchsorted(known, hashes)
    places[places == len(known)] = 0
    return np.where(known[places] == hashes, places, len(known)).astype(np.int32)


@dataclass
class Classifier:
    """Weights, and thresholds by language."""

    weights: dict[str, np.ndarray]
    known: np.ndarray
    settings: CnnSettings
    thresholds: dict[str, float]
    common: float = 0.0
    trained: bool = True
    share: float = 0.0

    def _tables(self) -> list[list[np.ndarray]]:
        """Per width and place in the filter, the response to each word; the last row is of no word."""
        words = np.concatenate([self.weights["words"], np.zeros((1, self.settings.size), np.float32)])
        return [[words @ self.weights[f"filter_{width}"][place] for place in range(width)] for width in self.settings.widths]

    def responses(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The logistic layer's input for each document."""
        if not hasattr(self, "_kept"):
            self._kept = self._tables()
        settings, documents = self.settings, len(starts) - 1
        most = max(settings.widths) - 1
        none = len(self.known) + 1
        spaced = np.full(len(ids) + most * documents, none, np.int32)
        counts = np.diff(starts)
        owners = np.repeat(np.arange(documents), counts)
        spaced[np.arange(len(ids)) + most * owners] = ids
        begins = starts[:-1] + most * np.arange(documents)
        features = np.zeros((documents, len(settings.widths) * settings.filters), np.float32)
        for begin in range(0, len(spaced), _BLOCK):
            end = min(begin + _BLOCK, len(spaced))
            first, last = np.searchsorted(begins, begin, side="right") - 1, np.searchsorted(begins, end, side="left")
            cuts = np.maximum(begins[first:last] - begin, 0)
            piece = np.concatenate([spaced[begin : end + most], np.full(most, none, np.int32)])[: end - begin + most]
            gaps = piece[: end - begin] == none  # a filter that began here would read the next document
            for number, width in enumerate(settings.widths):
                found = self._kept[number][0][piece[: end - begin]]
                for place in range(1, width):
                    found = found + self._kept[number][place][piece[place : place + end - begin]]
                found = np.maximum(found + self.weights[f"shift_{width}"], 0)
                found[gaps] = 0
                columns = slice(number * settings.filters, (number + 1) * settings.filters)
                features[first:last, columns] = np.maximum(features[first:last, columns], np.maximum.reduceat(found, cuts, axis=0))
        features[counts == 0] = 0
        return features @ self.weights["last"] + self.weights["bias"][0]

    def scores(self, column: pa.Array, languages: LanguageFilter) -> np.ndarray:
        """The calibrated score of each text."""
        if not self.trained:
            return np.full(len(column), self.share)
        hashes, starts = hashed_words(column)
        raw = self.responses(word_ids(hashes, self.known), starts)
        limits = np.array([self.thresholds.get(lang, self.common) for lang in languages.predict(column)[0]])
        return 1 / (1 + np.exp(-np.clip(raw - limits, -40, 40).astype(np.float64)))


def _step(weights: dict[str, np.ndarray], documents: list[np.ndarray], labels: np.ndarray, settings: CnnSettings) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss over some documents."""
    most = max(settings.widths) - 1
    none = len(weights["words"])
    spaced = np.concatenate([np.concatenate([ids, np.full(most, none, np.int32)]) for ids in documents])
    ends = np.cumsum([len(ids) + most for ids in documents])
    begins = ends - [len(ids) + most for ids in documents]
    table = np.concatenate([weights["words"], np.zeros((1, settings.size), np.float32)])
    points = table[spaced]
    pooled, spots = [], []
    for width in settings.widths:
        found = points @ weights[f"filter_{width}"][0]
        for place in range(1, width):
            found[: len(found) - place] += (points @ weights[f"filter_{width}"][place])[place:]
        found += weights[f"shift_{width}"]
        at = np.stack([b + found[b : e - most].argmax(axis=0) if e - most > b else np.full(settings.filters, b) for b, e in zip(begins, ends, strict=True)])
        pooled.append(np.maximum(np.take_along_axis(found, at, axis=0), 0))
        spots.append(at)
    features = np.concatenate(pooled, axis=1)
    raw = features @ weights["last"] + weights["bias"][0]
    off = (1 / (1 + np.exp(-raw)) - labels) / len(labels)
    found = {"last": features.T @ off + 1e-4 * weights["last"], "bias": np.array([off.sum()], np.float32)}
    by_words = np.zeros_like(table)
    for number, width in enumerate(settings.widths):
        columns = slice(number * settings.filters, (number + 1) * settings.filters)
        slope = (off[:, None] * weights["last"][columns]) * (pooled[number] > 0)
        found[f"shift_{width}"] = slope.sum(axis=0)
        by_filter = np.empty_like(weights[f"filter_{width}"])
        for place in range(width):
            at = np.minimum(spots[number] + place, len(spaced) - 1)
            by_filter[place] = np.einsum("bfd,bf->df", points[at], slope)
            np.add.at(by_words, spaced[at].ravel(), (weights[f"filter_{width}"][place].T[None] * slope[:, :, None]).reshape(-1, settings.size))
        found[f"filter_{width}"] = by_filter
    found["words"] = by_words[:-1] + 1e-4 * weights["words"]
    return {name: value.astype(np.float32) for name, value in found.items()}


def fit(documents: list[np.ndarray], labels: np.ndarray, languages: list[str], settings: CnnSettings = CnnSettings()) -> Classifier:
    """A classifier of hashed documents. One in five is set aside, to choose the epoch and the thresholds by."""
    random = np.random.default_rng(8)
    known = known_words(documents, settings)
    documents = [word_ids(words, known) for words in documents]
    weights = {
        "words": random.normal(0, 0.1, (len(known) + 1, settings.size)).astype(np.float32),
        "last": random.normal(0, 0.3, len(settings.widths) * settings.filters).astype(np.float32),
        "bias": np.zeros(1, np.float32),
    }
    for width in settings.widths:
        weights[f"filter_{width}"] = random.normal(0, 1 / np.sqrt(width * settings.size), (width, settings.size, settings.filters)).astype(np.float32)
        weights[f"shift_{width}"] = np.zeros(settings.filters, np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Classifier(weights, known, settings, {}, trained=False, share=share)
    aside = np.arange(len(labels)) % 5 == 4
    if not 0 < labels[aside].sum() < aside.sum():
        aside[:] = False
    learn = np.flatnonzero(~aside)
    judged = np.flatnonzero(aside) if aside.any() else learn
    starts = np.concatenate([[0], np.cumsum([len(documents[n]) for n in judged])])
    judged_ids = np.concatenate([documents[n] for n in judged])
    steps, best, least = Adam(weights, settings.rate, settings.floor), weights, np.inf
    epochs = max(settings.epochs, -(-settings.least_steps * settings.batch // len(learn)))
    for epoch in range(epochs):
        steps.rate = settings.rate * (1 - 0.8 * epoch / epochs)
        order = random.permutation(learn)
        for begin in range(0, len(order), settings.batch):
            some = order[begin : begin + settings.batch]
            seen = [documents[n][random.random(len(documents[n])) >= settings.unseen] for n in some]
            steps.update(_step(weights, seen, labels[some], settings))
        raw = Classifier(weights, known, settings, {}).responses(judged_ids, starts)
        loss = float(np.mean(np.logaddexp(0, raw) - labels[judged] * raw))
        if loss < least:
            best, least = {name: value.copy() for name, value in weights.items()}, loss
    model = Classifier(best, known, settings, {})
    raw = model.responses(judged_ids, starts)
    model.common = _threshold(raw, labels[judged], settings.false_alarms)
    of = np.array([languages[n] for n in judged])
    for lang in sorted(set(of)):
        own = of == lang
        if own.sum() >= settings.least_calibration and 0 < labels[judged][own].sum() < own.sum():
            model.thresholds[lang] = _threshold(raw[own], labels[judged][own], settings.false_alarms)
    return model


def _threshold(raw: np.ndarray, labels: np.ndarray, false_alarms: float) -> float:
    """The response that splits the labels at the least cost in shares of errors; of equal ones, the middle."""
    order = np.argsort(raw, kind="stable")
    raw, labels = raw[order], labels[order]
    between = np.concatenate([[raw[0] - 1], (raw[1:] + raw[:-1]) / 2, [raw[-1] + 1]])
    missed = np.concatenate([[0], np.cumsum(labels)]) / labels.sum()
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - labels)]) / (1 - labels).sum()
    cost = missed + false_alarms * wrong
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(between[best].mean() if len(best) == best[-1] - best[0] + 1 else between[best[len(best) // 2]])


def train(docs: DataFrame, labels: DataFrame, languages: LanguageFilter, settings: CnnSettings = CnnSettings()) -> Classifier:
    """A classifier from ``labels.toxic`` of the documents outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(5) != 0).select("doc_id", "toxic")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = " ".join(f"when {toxic} then {settings.sample_each / count!r}d" for toxic, count in sizes.items())
    if not shares:
        return fit([], np.zeros(0), [], settings)
    chosen = known.where(f"pmod(xxhash64(doc_id, 'toxic'), 1000000) < 1000000 * case toxic {shares} end")
    # about two samples' worth of ids: the limit only guards against ids labelled many times
    chosen = F.broadcast(chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).limit(4 * settings.sample_each))
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                hashes, starts = hashed_words(batch.column("text"))
                langs, _ = languages.predict(batch.column("text"))
                short = np.diff(starts) <= settings.most_words
                rows = [hashes[a:b].tobytes() for a, b, ok in zip(starts[:-1], starts[1:], short, strict=True) if ok]
                keep = pa.array(short)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").filter(keep), batch.column("toxic").cast(pa.int32()).filter(keep), pa.array(langs, pa.string()).filter(keep), pa.array(rows, pa.binary())],
                    names=["doc_id", "toxic", "lang", "words"],
                )

    rows = joined.mapInArrow(run, "doc_id long, toxic int, lang string, words binary").limit(4 * settings.sample_each).toPandas()
    rows = rows.sort_values(["doc_id", "words"], kind="stable")
    # no document order by id may leak into batches or the part set aside
    rows = rows.iloc[np.random.default_rng(21).permutation(len(rows))]
    documents = [np.frombuffer(words, np.uint64) for words in rows.words]
    return fit(documents, rows.toxic.to_numpy().astype(np.float64), rows.lang.tolist(), settings)


def score(docs: DataFrame, model: Classifier, languages: LanguageFilter) -> DataFrame:
    """Columns ``doc_id``, ``held_out``, ``score``, ``predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                scores = model.scores(batch.column("text"), languages)
                predicted = pa.array((scores >= 0.5).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores), predicted], names=["doc_id", "held_out", "score", "predicted"])

    chosen = docs.select("doc_id", (fold(5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, settings: CnnSettings = CnnSettings()) -> DataFrame:
    """Train outside the held-out fold, and score all documents. Reads ``doc_id``, ``text``, ``lang`` and the labels."""
    languages = langid_bloom.train(docs.where(fold(5) != 0))
    return score(docs, train(docs, labels, languages, settings), languages)
