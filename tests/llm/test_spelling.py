"""Spelling variants against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
from shapes import ODD, documents

from liftloom.llm import spelling
from liftloom.llm.spelling import variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def plain_variants(rows):
    counts = plain_counts(rows)
    forms, out = {}, []
    for word, n in counts.items():
        near = sorted((-m, other) for other, m in counts.items() if other != word and one_edit(word, other))
        forms[word] = near[0][1] if near and -near[0][0] >= 5 * n else None
        out.append((word, n, len(near)))

    def last(word):
        while forms[word]:
            word = forms[word]
        return word

    return sorted((w, forms[w], last(w), n, near, counts.get(forms[w])) for w, n, near in out)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def many(word, n):
    return " ".join([word] * n)


def test_variants(spark):
    rows = [
        (100, many("Colour", 400) + "," + many("COLOR", 9) + many(" colours", 60) + many(" coloür", 6) + many(" colourz", 5)),
        (101, many("walking", 700) + " " + many("walkin", 120) + " " + many("walkiñ", 20) + " " + many("wakling", 8) + " " + many("talking", 700)),
        (102, many("abcdefgh", 30) + "1" + many("bcdefgh", 5) + " " + many("abcdefg", 6) + " " + many("abcdxefgh", 6) + " " + many("hgfedcba", 40)),
        (103, many("zzzzzz", 30) + " " + many("zzzzzzz", 6) + " " + many("ÀÁÂÃÄÅ", 30) + " " + many("ÀÁÂÃÄà", 5) + " " + many("short", 50)),
        *[row for row in ODD if row[0] != 5],
        *[(5, "x" * 200_000)] * 5,
        (7, "x" * 200_001 + " " + many("x" * 200_001, 4)),
        *[(300 + n, f"planted misspelling number nothing{'abc'[n % 3]} everywhere {'walking ' * 3}") for n in range(60)],
    ]
    got = found(variants(documents(spark, rows)))
    assert got == plain_variants(rows)
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of forms


def test_many_words_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE_WORDS", 16)
    monkeypatch.setattr(spelling, "SEGMENT", 50)
    draw = np.random.default_rng(3)
    words = {"".join(draw.choice(list("abcß"), draw.integers(6, 9))) for _ in range(700)}
    rows = [(n, " ".join(sorted(words)[n % 2 :: 1 + n % 2])) for n in range(9)]
    got = found(variants(documents(spark, rows)))
    assert got == plain_variants(rows) and sum(r[4] for r in got) > 500


def test_nothing(spark):
    assert found(variants(documents(spark, []))) == [] == found(variants(documents(spark, [(1, None), (2, "few words")])))


def test_lower_case_of_ascii_only(spark):
    assert found(variants(documents(spark, [(1, many("ÀBCDEFG", 5)), (2, many("àbcdefg", 6))]))) == plain_variants([(1, many("ÀBCDEFG", 5)), (2, many("àbcdefg", 6))])
