"""License notices in documents, by patience alignment with templates.

A template is a list of words. Where a stretch of a document holds enough of them, the two are aligned: words that are unique to
both sides anchor the alignment, the longest increasing subsequence of the anchors is kept, and the gaps between anchors are
aligned in the same way, after what agrees at their ends. The share of the template's words that are matched is its
coverage, so a notice is found with words changed, left out or put in.

A document is gone through whole, in windows of twice the template's length, one from each word of the template in it, so what
is found does not depend on where a notice starts. A notice lies in at most that many words. A window can only be aligned well
enough if it holds that many words of the template, and only such windows are.

The words that tell a license from its relatives (by, nc, sa, Lesser, the version) have to be among the matches, and none may
be put in between; a notice that is part of one of another license which matches more words is left out.

Defined results: words are longest runs of letters and digits, A-Z lower-cased; a null or empty text, or one without words, has
no notice; a notice that occurs more than once gives one row, its best place (coverage, then fewest words between), the first of equals; repeated rows give a row
each; a null ``doc_id`` is kept; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftloom.llm import words as W

# The wording of notices in common use.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable"
        " law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use,"
        " copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
}


# What else is looked for in the same way: name of the row, text, and the words that tell it from its relatives.
TEXTS = (
    ("GPL-2.0-header", TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"), "GNU 2"),
    ("AGPL-3.0-header", TEMPLATES["GPL-3.0-header"].replace("GNU", "GNU Affero"), "GNU Affero 3"),
    ("LGPL-2.0-header", TEMPLATES["GPL-3.0-header"].replace("program", "library").replace("GNU", "GNU Library").replace("version 3", "version 2"), "GNU Library 2"),
    ("LGPL-2.1-header", TEMPLATES["GPL-3.0-header"].replace("program", "library").replace("GNU", "GNU Lesser").replace("version 3", "version 2.1"), "GNU Lesser 2 1"),
    ("LGPL-3.0-header", TEMPLATES["GPL-3.0-header"].replace("GNU", "GNU Lesser"), "GNU Lesser 3"),
    (
        "MPL-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla 2 0",
    ),
    ("MPL-1.1-header", "The contents of this file are subject to the Mozilla Public License Version 1.1", "Mozilla 1 1"),
    (
        "EPL-2.0-header",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0",
        "Eclipse 2 0",
    ),
    (
        "EPL-1.0-header",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
        "Eclipse v1 0",
    ),
    (
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies",
        "provided permission notice appear",
    ),
    (
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED"
        " \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
        "provided permission notice appear",
    ),
    (
        "0BSD-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
        "granted THE SOFTWARE IS PROVIDED",
    ),
    (
        "Zlib-text",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and"
        " redistribute it freely, subject to the following restrictions",
        "anyone alter redistribute freely",
    ),
    (
        "BSL-1.0-text",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying"
        " documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the"
        " Software",
        "organization reproduce display",
    ),
    (
        "Unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,"
        " sell, or distribute this software",
        "unencumbered",
    ),
)
_FURNISHED = TEMPLATES["MIT-text"] + ", and to permit persons to whom the Software is furnished to do so"
_AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"
_CONDITIONS = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
    " substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution."
)
_ADVERTISING = (
    " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product"
    " includes software developed by the"
)
_ENDORSING = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
    " this software without specific prior written permission."
)
TEXTS += (
    ("MIT-text", _FURNISHED + _CONDITIONS + _AS_IS, "hereby granted"),
    ("MIT-0-text", _FURNISHED + "." + _AS_IS, "hereby granted furnished PROVIDED"),
    ("BSD-2-Clause-text", _BSD, "binary reproduce"),
    ("BSD-3-Clause-text", _BSD + _ENDORSING, "binary reproduce endorse promote"),
    ("BSD-4-Clause-text", _BSD + _ADVERTISING + _ENDORSING, "binary reproduce advertising endorse promote"),
)


def _spoken() -> dict[str, tuple[str, ...]]:
    """How each license is named in running text."""
    names = {
        "MIT": ("MIT License",),
        "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
        "ISC": ("ISC License",),
        "0BSD": ("Zero-Clause BSD License", "0BSD License"),
        "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"),
        "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "BSD-3-Clause License"),
        "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License", "Original BSD License"),
        "BSD-3-Clause-Clear": ("Clear BSD License", "BSD-3-Clause-Clear License"),
        "BSD": ("BSD License", "BSD-style License"),
        "Unlicense": ("Unlicense",),
        "Zlib": ("zlib License",),
        "BSL-1.0": ("Boost Software License",),
        "CC0-1.0": ("CC0 1.0", "CC0", "Creative Commons Zero"),
    }
    versions = {
        "Apache": (("Apache",), ("Apache",), ("1.1", "2.0")),
        "MPL": (("Mozilla Public",), ("MPL",), ("1.0", "1.1", "2.0")),
        "EPL": (("Eclipse Public",), ("EPL",), ("1.0", "2.0")),
        "EUPL": (("European Union Public",), ("EUPL",), ("1.1", "1.2")),
        "GPL": (("GNU General Public",), ("GPL",), ("1.0", "2.0", "3.0")),
        "LGPL": (("GNU Lesser General Public", "Lesser General Public", "GNU Library General Public"), ("LGPL",), ("2.0", "2.1", "3.0")),
        "AGPL": (("GNU Affero General Public", "Affero General Public"), ("AGPL",), ("1.0", "3.0")),
        "GFDL": (("GNU Free Documentation",), ("GFDL",), ("1.1", "1.2", "1.3")),
    }
    for short, (longs, letters, numbers) in versions.items():
        for number in numbers:
            # a version that ends in 0 is written without it as well
            ways = {number, number.removesuffix(".0")}
            named = {f"{long} License{between}{way}" for long in longs for way in ways for between in (" version ", " v ", " v", " ")}
            named |= {f"{letter}{between}{way}" for letter in letters for way in ways for between in (" version ", " v ", " v", "v", " ")}
            names[f"{short}-{number}"] = tuple(sorted(named))
        names[short] = tuple(f"{long} License" for long in longs) + (letters if short != "Apache" else ())
    terms = {
        "": [""],
        "-NC": ["-NonCommercial", "-Non-Commercial"],
        "-ND": ["-NoDerivatives", "-NoDerivs", "-No-Derivatives"],
        "-SA": ["-ShareAlike", "-Share-Alike"],
    }
    for kinds in ((), ("-NC",), ("-SA",), ("-ND",), ("-NC", "-SA"), ("-NC", "-ND")):
        written_out = [""]
        for kind in kinds:
            written_out = [before + after for before in written_out for after in terms[kind]]
        joined = "".join(kinds)
        for number in ("", "1.0", "2.0", "2.5", "3.0", "4.0"):
            named = [f"CC BY{joined} {number}", *(f"Creative Commons Attribution{words} {number}" for words in written_out)]
            named += [f"Creative Commons Attribution{words} License {number}" for words in written_out]
            names[f"CC-BY{joined}-{number}".removesuffix("-")] = tuple(named)
    return names


# Words that say nothing of which license it is, or of which version.
_FILLERS = frozenset("license version the v public general".split())
# Words that make another license of one when they are put into its name.
MARKS = tuple("affero lesser library documentation nc nd sa noncommercial non sharealike share noderivatives noderivs derivatives zero clear".split())
_DIGITS = (*"0123456789", *(f"v{digit}" for digit in range(10)))


def _telling(name: str) -> str:
    """The words of a name that have to be matched: all but License, or all but fillers where it has a version."""
    words = [w for w in re.findall("[A-Za-z0-9]+", name) if w != "License"]
    return " ".join(w for w in words if w.lower() not in _FILLERS) if words[-1][-1].isdigit() else " ".join(words)


def common_templates() -> tuple[tuple[str, str, str], ...]:
    """All templates: name, text, and the words of it that have to be matched. Several may have one name."""
    needed = {
        "Apache-2.0": "Apache 2 0",
        "Apache-2.0-header": "Apache Version 2 0",
        "CC-BY-NC-4.0": "CC BY NC 4 0",
        "GPL-3.0": "GNU 3",
        "GPL-3.0-header": "GNU 3",
        "MIT": "MIT",
        "MIT-text": "hereby granted",
    }
    found = [(name, text, needed[name]) for name, text in TEMPLATES.items()] + list(TEXTS)
    for name, ways in _spoken().items():
        for way in ways:
            found += [(name, f"{before} {way}", _telling(way)) for before in ("under", "under the")]
        found.append((name, f"SPDX-License-Identifier: {name}", f"SPDX {name}"))
    return tuple(found)


@dataclass(frozen=True)
class LicenseSettings:
    """Templates (name, text, words that have to be matched), and the coverage that counts as a notice."""

    templates: tuple[tuple[str, str, str], ...] = common_templates()
    least_coverage: float = 0.85


_WORDS = np.full(256, 32, dtype=np.uint8)
_WORDS[48:58] = np.arange(48, 58)
_WORDS[65:91] = np.arange(97, 123)
_WORDS[97:123] = np.arange(97, 123)
_WORDS[128:] = np.arange(128, 256)


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, starts = W.buffer_of(column)
    return W.word_hashes(_WORDS[data], starts)


def patience_matches(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched places (in the text, in the template), in order."""
    matches: list[tuple[int, int]] = []
    open_gaps = [(0, len(text), 0, len(template))]
    while open_gaps:
        begin, end, first, last = open_gaps.pop()
        while begin < end and first < last and text[begin] == template[first]:
            matches.append((begin, first))
            begin, first = begin + 1, first + 1
        while begin < end and first < last and text[end - 1] == template[last - 1]:
            end, last = end - 1, last - 1
            matches.append((end, last))
        anchors = _anchors(text, begin, end, template, first, last)
        if not anchors:
            continue
        matches += anchors
        edges = [(begin - 1, first - 1), *anchors, (end, last)]
        for (a, b), (c, d) in zip(edges, edges[1:], strict=False):
            if c - a > 1 and d - b > 1:
                open_gaps.append((a + 1, c, b + 1, d))
    return sorted(matches)


def _anchors(text: list[int], begin: int, end: int, template: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """The longest run, increasing on both sides, of words that occur once in either stretch."""
    here, there = Counter(text[begin:end]), Counter(template[first:last])
    at = {word: place for place, word in enumerate(text[begin:end], begin) if here[word] == 1 and there.get(word) == 1}
    places = [(at[word], place) for place, word in enumerate(template[first:last], first) if word in at]
    piles: list[int] = []
    tops: list[int] = []
    before: list[int] = []
    for number, (place, _) in enumerate(places):
        pile = bisect_left(piles, place)
        before.append(tops[pile - 1] if pile else -1)
        if pile == len(piles):
            piles.append(place)
            tops.append(number)
        else:
            piles[pile], tops[pile] = place, number
    run, number = [], tops[-1] if tops else -1
    while number >= 0:
        run.append(places[number])
        number = before[number]
    return run[::-1]


def _placed(template: list[int], needed: list[int]) -> list[int]:
    """Where the needed words stand in the template, in order."""
    places, at = [], 0
    for word in needed:
        at = template.index(word, at)
        places.append(at)
        at += 1
    return places


def license_of(name: str) -> str:
    """The license a template belongs to."""
    return re.sub("-(header|text)$", "", name)


def _dotted(text: str) -> set[int]:
    """Numbers of the words that a dot and a digit follow, as in a version."""
    data = text.encode()
    found = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data))
    return {n for n, m in enumerate(found) if m[0][-1:].isdigit() and re.match(rb"\.[0-9]", data[m.end() : m.end() + 2])}


def scan_texts(column: pa.Array, settings: LicenseSettings) -> list[tuple[int, str, float, int, int]]:
    """Notices in some texts: row, name, coverage, and the first and last matched word of the text."""
    names = [name for name, _, _ in settings.templates]
    known = [text for _, text, _ in settings.templates] + [needed for _, _, needed in settings.templates] + [*MARKS, *_DIGITS]
    of_known, edges = _hashes(pa.array(known, pa.string()))
    vocabulary, known_ids = np.unique(of_known, return_inverse=True)
    word_lists = [known_ids[begin:end].tolist() for begin, end in zip(edges, edges[1:], strict=False)]
    digits = [words[0] for words in word_lists[-len(_DIGITS) :]]
    marks = {words[0] for words in word_lists[2 * len(names) : -len(_DIGITS)]}
    hashes, starts = _hashes(column)
    ids = np.searchsorted(vocabulary, hashes)
    ids[ids == len(vocabulary)] = 0
    ids = np.where(vocabulary[ids] == hashes, ids, len(vocabulary))
    # rows of each known word, so that only rows with all needed words of a template are looked at
    places = np.flatnonzero(ids < len(vocabulary))
    rows_of_places = np.searchsorted(starts, places, side="right") - 1
    pairs = np.unique(ids[places] * len(column) + rows_of_places)
    bounds = np.searchsorted(pairs, np.arange(len(vocabulary) + 1) * len(column))

    def rows_with(word: int) -> np.ndarray:
        return pairs[bounds[word] : bounds[word + 1]] - word * len(column)

    rows_of = [rows_with(word) for word in range(len(vocabulary))]
    found: dict[int, list[tuple[str, int, float, tuple[int, ...], list[int]]]] = {}
    dotted: dict[int, set[int]] = {}
    for number, name in enumerate(names):
        template, needed = word_lists[number], word_lists[len(names) + number]
        if not template:
            continue
        rarest = sorted(set(needed), key=lambda word: len(rows_of[word]))
        rows = rows_of[rarest[0]] if rarest else np.arange(len(column))
        for word in rarest[1:]:
            if len(rows):
                rows = np.intersect1d(rows, rows_of[word], assume_unique=True)
        needed_places = _placed(template, needed)
        for row in rows.tolist():
            text = ids[starts[row] : starts[row + 1]]
            for begin, end in _windows(text, template, settings.least_coverage):
                stretch = text[begin:end].tolist()
                matches = patience_matches(stretch, template)
                coverage = len(matches) / len(template)
                if coverage < settings.least_coverage:
                    continue
                if row not in dotted:
                    dotted[row] = _dotted(column[row].as_py() or "")
                told = _told_apart(stretch, template, matches, needed_places, marks, digits, {n - begin for n in dotted[row]})
                if told is not None:
                    matched = [begin + place for place, _ in matches]
                    found.setdefault(row, []).append((name, len(matches), coverage, tuple(begin + place for place in told), matched))
    return [(row, *notice) for row, notices in sorted(found.items()) for notice in _best(notices)]


def _told_apart(
    text: list[int], template: list[int], matches: list[tuple[int, int]], needed: list[int], marks: set[int], digits: list[int], dotted: set[int]
) -> list[int] | None:
    """Where the text has the needed words of the template; None if one is missing or the words around make another license of it."""
    at = {there: here for here, there in matches}
    if any(place not in at for place in needed):
        return None
    if not needed:
        return [here for here, _ in matches]
    told = [at[place] for place in needed]
    matched = {here for here, _ in matches}
    unmatched = {text[here] for here in range(told[0], told[-1]) if here not in matched}
    if unmatched & marks:
        return None
    for place, here in zip(needed, told, strict=True):
        if template[place] not in digits:
            continue
        follows = here > 0 and place > 0 and text[here - 1] == template[place - 1]
        if not follows and (unmatched & set(digits)):
            return None
        # 2.1 is not version 2, but 2.0 is
        if here in dotted and here + 1 not in matched and here + 1 < len(text) and (text[here + 1] != digits[0] or here + 1 in dotted):
            return None
    return told


def _best(notices: list[tuple[str, int, float, tuple[int, ...], list[int]]]) -> list[tuple[str, float, int, int]]:
    """The best place of each name, without notices whose telling words are part of a better one of another license."""
    kept: dict[str, tuple[float, int, int, int, int]] = {}
    better: dict[int, list[tuple[str, set[int]]]] = {}
    for name, words, coverage, told, matched in sorted(notices, key=lambda n: (-n[1], -n[2], n[4][-1] - n[4][0], n[4][0])):
        if any(other != license_of(name) and places.issuperset(told) for other, places in better.get(told[0], ())):
            continue
        whole = (license_of(name), set(matched))
        for place in matched:
            better.setdefault(place, []).append(whole)
        place = (-coverage, -words, matched[-1] - matched[0], matched[0], matched[-1])
        kept[name] = min(place, kept.get(name, place))
    return [(name, -place[0], place[3], place[4]) for name, place in sorted(kept.items())]


def _windows(text: np.ndarray, template: list[int], least_coverage: float) -> list[tuple[int, int]]:
    """Windows of twice the template's length, from each of its words in the text, that hold enough of its words.

    A word counts at most as often as the template has it. So a word at a place counts for the windows that begin behind its
    last place but that many, and a running sum over begins and ends of such stretches counts the words of every window.
    """
    size = len(template)
    kinds, often = np.unique(template, return_counts=True)
    places = np.flatnonzero(np.isin(text, kinds))
    words = np.searchsorted(kinds, text[places])
    order = np.argsort(words, kind="stable")
    sorted_words, sorted_places = words[order], places[order]
    before = np.arange(len(order)) - often[sorted_words]
    same = (before >= 0) & (sorted_words[before] == sorted_words)
    low = np.where(same, sorted_places[before] + 1, 0)
    low = np.maximum(low, sorted_places - 2 * size + 1)
    change = np.bincount(low, minlength=len(text) + 1) - np.bincount(sorted_places + 1, minlength=len(text) + 1)
    begins = places[np.cumsum(change)[places] >= least_coverage * size]
    return [(begin, min(begin + 2 * size, len(text))) for begin in begins.tolist()]


def scan(docs: DataFrame, settings: LicenseSettings = LicenseSettings()) -> DataFrame:
    """A row per document and notice: ``doc_id``, ``license``, ``coverage``, ``first_word``, ``last_word``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text"):
                found = scan_texts(batch.column("text"), settings)
                rows = pa.array([f[0] for f in found], pa.int64())
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                columns = [pa.array([f[n + 1] for f in found], kind) for n, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), *columns], names=["doc_id", "license", "coverage", "first_word", "last_word"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long")
