"""Personal data by exact patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns find e-mail addresses, IP addresses, card numbers and telephone numbers in their usual forms. The tagger, trained
from labelled spans, adds those written in other forms: ``name [at] host dot com``, ``10[.]0[.]0[.]1``, card numbers with other
separators, telephone numbers without a plus. It is trained on windows of sampled documents, labelled where the patterns
match, and on windows with made-up spans put in, both in usual and in other forms, and numbers that are none of these.

All kinds hold a digit, an ``@`` or a bracketed or spaced ``at``, so the tagger reads every stretch of the text that lies near one
of these, in overlapping windows. The scores of a character are averaged over its windows, heavier where it is in their
middle, and the CRF decodes each whole stretch at once, so that no span is cut or decided twice. A found span must hold a
plausible value of its kind, and is dropped where it overlaps a span of the patterns.

Defined results: a null or empty text has no spans; texts are read whole; starts and ends count code points; repeated rows are
searched one by one; a null ``doc_id`` is kept; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.llm.tagger import Adam, Tagger, classes_of
from liftloom.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]


@dataclass(frozen=True)
class PiiSettings:
    """Bounds of training and shape of the windows."""

    #: documents that training windows come from, at most about this many (chosen by hashed id), and windows of each
    sample_documents: int = 2000
    windows_each: int = 3
    made_up: int = 3000
    hidden: int = 20
    epochs: int = 6
    window: int = 64
    stride: int = 32
    #: characters read on either side of a cue
    margin: int = 40


# The patterns that results depend on. They match what the plain forms in the comments match; the plain forms
# would try every digit of a long run anew.
# ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
# card [0-9]([\x20-]?[0-9])+
# phone \+[0-9][\x20().0-9-]+[0-9]
# email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PLAIN_CUE = re.compile(r"[0-9@]")
_CUE = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]|\sat\s(?=\S{1,60}\sdot\s)")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start and then kind."""
    if not _PLAIN_CUE.search(text):
        return []
    found: list[Span] = []
    after, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > after and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at) if begin < at else None
        if domain:
            found.append(("email", begin, domain.end()))
            after = domain.end()
        at = text.find("@", max(at + 1, after))
    for match in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (part.lstrip("0") for part in match.group().split("."))):
            found.append(("ip", match.start(), match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match.group()) if match.end() - match.start() <= 60 else ""
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", match.start(), match.end()))
    for match in _PHONE.finditer(text):
        if 9 <= len(_digits(match.group())) <= 15:
            found.append(("phone", match.start(), match.end()))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def plausible(kind: str, text: str) -> bool:
    """Whether a span that the tagger found holds a value of its kind."""
    digits = _digits(text)
    if kind == "email":
        plain = re.sub(r"\s?[\[({]\s?at\s?[\])}]\s?|\sat\s", "@", text)
        plain = re.sub(r"\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\sdot\s", ".", plain)
        return _EMAIL.fullmatch(plain) is not None
    if kind == "ip":
        parts = re.sub(r"[\[\](){}\s]", "", text).split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", part) and int(part) <= 255 for part in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and re.fullmatch(r"[0-9 .\-/]+", text) is not None and _luhn(digits)
    return 9 <= len(digits) <= 15 and re.fullmatch(r"[0-9 ().\-+/]+", text) is not None and len(text) > len(digits)


def _made_up(random: np.random.Generator) -> tuple[str, str]:
    """A made-up span: its kind (empty for a number that is none), and its text."""
    pick = lambda *options: options[int(random.integers(len(options)))]
    number = lambda count: "".join(map(str, random.integers(0, 10, count)))
    word = lambda: "".join(map(chr, random.integers(97, 123, int(random.integers(2, 9)))))
    kind = pick("email", "ip", "card", "phone", "")
    if kind == "email":
        at, dot = pick(("@", "."), ("@", "."), (" [at] ", "."), ("(at)", "."), (" at ", " dot "), (" [at] ", " [dot] "))
        return kind, word() + pick("", ".", "_", ".") + word() + pick("", number(2)) + at + word() + pick("", number(1)) + pick("", f"{dot}example") + dot + pick("com", "org", "net", "de")
    if kind == "ip":
        return kind, pick(".", ".", "[.]", "(.)", " . ").join(str(n) for n in random.integers(0, 256, 4))
    if kind == "card":
        return kind, pick("", "", " ", "-", ".", "  ", " - ").join(number(4) for _ in range(4))
    if kind == "phone":
        area, rest = number(3), pick(" ", "-", ".") .join([number(3), number(4)])
        return kind, pick("+1 ", "+49 ", "001 ", "", "") + pick(f"({area}) ", f"{area}-", f"{area} ", f"{area}.") + rest
    return kind, pick(
        "".join(f"{n:x}" for n in random.integers(0, 16, 40)), f"{random.integers(0, 30)}.{random.integers(0, 30)}", number(int(random.integers(1, 7))),
        f"{random.integers(1900, 2040)}-{random.integers(1, 13):02d}-{random.integers(1, 29):02d}", f"{random.integers(1, 100)},{number(3)}", f"{random.integers(1, 24)}:{number(2)}",
    )


def _labels(text: str, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for kind, start, end in spans:
        tags[start:end] = KINDS.index(kind) + 1
    return tags


def training_windows(texts: list[str], settings: PiiSettings) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tags of windows: those of the texts as labelled by the patterns, and some with made-up spans."""
    random = np.random.default_rng(11)
    size = settings.window
    contexts = [text for text in texts if text] or ["the of and to in is that it was for on as with by"]
    chars, tags = [], []

    def add(text: str, labels: np.ndarray, begin: int) -> None:
        part = text[begin : begin + size].ljust(size)
        row = np.zeros(size, np.int64)
        row[: len(labels[begin : begin + size])] = labels[begin : begin + size]
        chars.append(classes_of(part))
        tags.append(row)

    for text in contexts:
        spans = base_spans(text)
        labels = _labels(text, spans)
        # a number with a wrong check digit looks like a card; such windows would teach the tagger nothing it can see
        if any(m.end() - m.start() >= 12 and not labels[m.start()] for m in _CARD.finditer(text)):
            continue
        add(text, labels, int(random.integers(0, max(1, len(text) - size))))
    for _ in range(settings.made_up):
        text = contexts[int(random.integers(len(contexts)))]
        text = _PLAIN_CUE.sub("", text)
        cut = int(random.integers(0, len(text) + 1))
        kind, span = _made_up(random)
        before, after = text[:cut].rstrip()[-size:] + " ", (" ", ", ", ". ", "\n")[int(random.integers(4))] + text[cut:].lstrip()[:size]
        whole = before + span + after
        labels = _labels(whole, [(kind, len(before), len(before) + len(span))] if kind else [])
        add(whole, labels, max(0, len(before) - int(random.integers(0, size - 10))))
    return np.array(chars), np.array(tags)


def train(docs: DataFrame, settings: PiiSettings = PiiSettings()) -> Tagger:
    """A tagger from a bounded sample of the documents, chosen by hashed id and text. Reads ``doc_id`` and ``text``."""
    count = docs.count()
    share = settings.sample_documents / max(count, 1)
    chosen = docs.where(f"text is not null and pmod(xxhash64(doc_id, text, 'personal'), 1000000) < {share * 1000000}").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in batch.column("text").to_pylist():
                cues = [m.start() for m in _PLAIN_CUE.finditer(text)]
                spots = [*cues[:: max(1, len(cues) // settings.windows_each)][: settings.windows_each - 1], len(text) // 2]
                parts += [text[max(0, spot - settings.window) : spot + settings.window] for spot in spots]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["part"])

    # the sample's size is bounded by its setting; the limit only guards against many rows with one id
    parts = chosen.mapInArrow(run, "part string").limit(2 * settings.sample_documents * settings.windows_each).collect()
    chars, tags = training_windows(sorted(r["part"] for r in parts), settings)
    model = Tagger.fresh(len(KINDS) + 1, settings.hidden, 3)
    steps, random = Adam(model.weights, 0.01), np.random.default_rng(4)
    for epoch in range(settings.epochs):
        steps.rate = 0.01 * (1 - epoch / settings.epochs)
        order = random.permutation(len(chars))
        for begin in range(0, len(order), 128):
            some = order[begin : begin + 128]
            steps.update(model.gradients(chars[some], tags[some])[1])
    return model


def _stretches(text: str, settings: PiiSettings) -> list[tuple[int, int]]:
    """The parts of a text near a cue, joined where they meet."""
    found: list[list[int]] = []
    for match in _CUE.finditer(text):
        begin, end = max(0, match.start() - settings.margin), min(len(text), match.end() + settings.margin)
        if found and begin <= found[-1][1]:
            found[-1][1] = end
        else:
            found.append([begin, end])
    return [(begin, end) for begin, end in found]


def tagged_spans(texts: list[str], model: Tagger, settings: PiiSettings = PiiSettings()) -> list[list[Span]]:
    """What the tagger finds in each text, whether or not the patterns find it too."""
    found: list[list[Span]] = [[] for _ in texts]
    stretches = [(row, begin, end) for row, text in enumerate(texts) for begin, end in _stretches(text, settings)]
    size = settings.window
    middle = 1 + np.minimum(np.arange(size), np.arange(size)[::-1]).astype(np.float32)
    # stretches of like length are decoded together
    stretches.sort(key=lambda s: s[2] - s[1])
    for first in range(0, len(stretches), 64):
        group = stretches[first : first + 64]
        lengths = np.array([end - begin for _, begin, end in group])
        longest = int(lengths.max())
        windows, homes = [], []
        for number, (row, begin, end) in enumerate(group):
            chars = classes_of(texts[row][begin:end])
            for at in range(0, max(1, len(chars) - size + settings.stride), settings.stride):
                part = np.full(size, 32, np.int16)
                part[: len(chars[at : at + size])] = chars[at : at + size]
                windows.append(part)
                homes.append((number, at))
        sums = np.zeros((len(group), longest + size, len(KINDS) + 1), np.float32)
        weights = np.zeros((len(group), longest + size, 1), np.float32)
        for begin in range(0, len(windows), 1024):
            scores = model.scores(np.array(windows[begin : begin + 1024]))
            for (number, at), score in zip(homes[begin : begin + 1024], scores, strict=True):
                sums[number, at : at + size] += score * middle[:, None]
                weights[number, at : at + size] += middle[:, None]
        paths = model.best((sums / np.maximum(weights, 1))[:, :longest], lengths)
        for (row, begin, _), path in zip(group, paths, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], path, [0]])))
            for start, end in zip(edges, edges[1:], strict=False):
                if path[start]:
                    found[row].append((KINDS[path[start] - 1], begin + int(start), begin + int(end)))
    return found


def _trimmed(text: str, span: Span) -> Span:
    kind, start, end = span
    while start < end and not (text[start].isalnum() or text[start] in "(+"):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return kind, start, end


def all_spans(texts: list[str], model: Tagger, settings: PiiSettings = PiiSettings()) -> list[tuple[list[Span], list[Span]]]:
    """The spans of the patterns, and all spans, of each text."""
    results = []
    for text, tagged in zip(texts, tagged_spans(texts, model, settings), strict=True):
        base = base_spans(text)
        added = []
        for span in tagged:
            kind, start, end = _trimmed(text, span)
            apart = all(end <= other or start >= last for _, other, last in base)
            if start < end and apart and plausible(kind, text[start:end]):
                added.append((kind, start, end))
        results.append((base, sorted([*base, *added], key=_order)))
    return results


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping ones, replaced by the kind of its first."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, model: Tagger, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """A row per document: ``doc_id``, counts and digest of the patterns' spans, ``spans`` (all), ``n_added``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [text or "" for text in batch.column("text").to_pylist()]
                both = all_spans(texts, model, settings)
                counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in both], pa.int64()) for kind in KINDS]
                digests = [hashlib.sha256(written_out(base).encode()).hexdigest() for base, _ in both]
                spans = [written_out(every) for _, every in both]
                added = pa.array([len(every) - len(base) for base, every in both], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()), added],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, {_FOUND}")


def redact(docs: DataFrame, model: Tagger, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """The same rows and columns with all spans in ``text`` replaced by their kinds. A null text stays null."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                both = all_spans([text or "" for text in texts], model, settings)
                clean = [None if text is None else redacted(text, every) for text, (_, every) in zip(texts, both, strict=True)]
                columns = list(batch.columns)
                columns[place] = pa.array(clean, batch.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def detect(docs: DataFrame, settings: PiiSettings = PiiSettings()) -> DataFrame:
    """Train on the documents and search them all."""
    return find(docs, train(docs, settings), settings)
