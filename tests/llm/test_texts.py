"""Language, personal data, toxicity and licenses on small texts."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from shapes import ODD, documents, prose

from liftloom.llm import langid_bloom, license_patience, pii_crf, toxicity_cnn
from liftloom.llm.langid_bloom import BloomSettings
from liftloom.llm.pii_crf import PiiSettings
from liftloom.llm.tagger import Tagger

EN = "the quick brown fox jumps over the lazy dog while the weather was fine and they were with us"
DE = "der schnelle braune fuchs springt über den faulen hund während das wetter schön war und sie waren"
FR = "le renard brun rapide saute par dessus le chien paresseux tandis que le temps était beau et eux"


def shuffled(text, seed):
    words = text.split()
    return " ".join(words[(n * 5 + seed) % len(words)] for n in range(12 + seed % 7))


def test_languages(spark):
    rows = [(n, shuffled((EN, DE, FR)[n % 3], n), ("en", "de", "fr")[n % 3]) for n in range(100, 190)]
    rows += [(300, EN.upper(), None), (301, "12 + 34 = 46", "en"), (302, "日本語", None), *ODD]
    out = {}
    for r in langid_bloom.identify(documents(spark, rows)).collect():
        out.setdefault(r.doc_id, r)
        assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    assert all(out[n].lang_pred == ("en", "de", "fr")[n % 3] for n in range(100, 190))
    assert out[300].lang_pred == "en"
    assert {out[n].lang_pred for n in (301, 1, 2, 3, 4)} == {"und"}
    assert out[302].lang_pred in ("en", "de", "fr") and out[302].score == 0
    assert langid_bloom.identify(documents(spark, [])).isEmpty()
    assert [r.lang_pred for r in langid_bloom.identify(documents(spark, [(1, "some text", None)])).collect()] == ["und"]


def test_filter_against_sets(spark):
    """Without false positives the filter counts what plain sets of n-grams would."""
    rows = [(n, shuffled((EN, DE)[n % 2], n), ("en", "de")[n % 2]) for n in range(40)]
    docs = documents(spark, rows)
    model = langid_bloom.train(docs, BloomSettings(bits=22, least_share=0, least_documents=1))
    sets = {}
    for _, text, lang in rows:
        padded = "   " + text + "   "
        raw = padded.encode()
        sets.setdefault(lang, set()).update(raw[n : n + 4] for n in range(len(raw) - 3))
    text = shuffled(EN, 3)
    raw = ("   " + text + "   ").encode()
    grams = [raw[n : n + 4] for n in range(len(raw) - 3) if raw[n : n + 4].strip()]
    _, score = model.predict(pa.array([text]))
    share = max(sum(g in s for g in grams) / len(grams) for s in sets.values())
    assert abs(score[0] - share) < 0.01


def test_every_language_is_learnt(spark):
    """Languages beyond any fixed number, rare ones included; the commonest has most of the documents."""
    random = np.random.default_rng(4)
    words = [["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)] for _ in range(300)]
    rows = [(n * 1000 + m, " ".join(random.permutation(words[n])), f"l{n:03d}") for n in range(300) for m in range(2 if n else 40)]
    model = langid_bloom.train(documents(spark, rows))
    assert sorted(model.languages) == [f"l{n:03d}" for n in range(300)] and model.languages[0] == "l000"
    names, shares = model.predict(pa.array([" ".join(w) for w in words]))
    assert names == [f"l{n:03d}" for n in range(300)] and shares.min() > 0.5


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(reversed(digits))) % 10 == 0
            fits = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], list(PLAIN).index(s[0])))


@pytest.mark.parametrize("seed", range(300))
def test_patterns(seed):
    random = np.random.default_rng(seed)
    pieces = ["a.b@c.d", "@", "x@y.z@w.v", "é", "1.2.3.4", ".5.6", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", " ", "-", "0", "12", "a@b", "٣"]
    text = "".join(pieces[int(n)] for n in random.integers(0, len(pieces), 14))
    assert pii_crf.base_spans(text) == plain_spans(text)


def test_long_runs_of_digits():
    assert pii_crf.base_spans("1" * 300_000) == [] and pii_crf.base_spans("a" * 300_000 + "@") == []


def test_gradients_of_the_tagger():
    model = Tagger.fresh(3, 4, 1)
    model.weights = {name: value.astype(np.float64) for name, value in model.weights.items()}
    random = np.random.default_rng(2)
    chars, tags = random.integers(0, 131, (3, 6)), random.integers(0, 3, (3, 6))
    _, gradients = model.gradients(chars, tags)
    for name, value in model.weights.items():
        spots = np.argwhere(np.abs(gradients[name]) > 1e-4)[:3]
        for spot in map(tuple, spots):
            kept = value[spot]
            value[spot] = kept + 1e-2
            up = model.gradients(chars, tags)[0]
            value[spot] = kept - 1e-2
            down = model.gradients(chars, tags)[0]
            value[spot] = kept
            assert abs((up - down) / 2e-2 - gradients[name][spot]) < 2e-2 * max(1, abs(gradients[name][spot]))


def test_best_path_is_the_likeliest():
    model = Tagger.fresh(3, 4, 1)
    random = np.random.default_rng(3)
    model.weights["moves"] = random.normal(0, 1, (3, 3)).astype(np.float32)
    scores, lengths = random.normal(0, 1, (4, 5, 3)).astype(np.float32), np.array([1, 3, 4, 5])
    for row, path in enumerate(model.best(scores, lengths)):
        size = int(lengths[row])

        def worth(tags):
            steps = sum(model.weights["moves"][a, b] for a, b in zip(tags, tags[1:]))
            return steps + sum(scores[row, n, t] for n, t in enumerate(tags))

        every = max(np.ndindex(*[3] * size), key=worth)
        assert tuple(path) == every


def test_personal_data(spark):
    settings = PiiSettings()
    rows = [(n, f"{shuffled(EN, n)} reach me at jo{n}@mail.example.com or +1 (555) 123-4{n:03d} ok") for n in range(20, 60)]
    rows += [(200, "write to anna.bell [at] mail.example.com please"), (201, shuffled(EN, 3)), *ODD]
    docs = documents(spark, rows)
    model = pii_crf.train(docs, settings)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, text)
    for r in pii_crf.find(docs, model, settings).collect():
        base = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == kind for s in base) for kind in PLAIN]
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(spans) and len(spans) == len(base) + r.n_added
    # forms that the patterns do not know are learnt from the made-up spans
    random, hits, total = np.random.default_rng(77), 0, 0
    for number in range(200):
        kind, span = pii_crf._made_up(random)
        if kind:
            text = f"{shuffled(EN, number)} {span} {shuffled(EN, number + 1)}"
            begin = text.index(span)
            total += 1
            hits += (kind, begin, begin + len(span)) in pii_crf.tagged_spans([text], model, settings)[0]
    assert hits >= 0.5 * total
    clean = {r.doc_id: r.text for r in pii_crf.redact(docs, model, settings).collect()}
    assert "@" not in clean[20] and "[EMAIL]" in clean[20] and "[PHONE]" in clean[20]
    assert clean[1] is None and clean[2] == "" and clean[5] == "x" * 200_000
    assert pii_crf.find(documents(spark, []), model).isEmpty()


BAD = ["rotten", "vile", "nasty", "trash"]


def test_toxicity(spark):
    random = np.random.default_rng(9)
    rows, labels = [], []
    for n in range(1000, 1600):
        toxic = n % 4 == 0
        words = [f"{w}" for w in (EN, DE)[n % 2].split()]
        text = [words[int(i)] for i in random.integers(0, len(words), 40)]
        if toxic:
            for _ in range(2):
                text[int(random.integers(0, 40))] = BAD[int(random.integers(0, 4))]
        rows.append((n, " ".join(text), ("en", "de")[n % 2]))
        labels.append((n, int(toxic)))
    labels += [(None, 1), (1, None), (2, 0), (7777, 1)]
    docs = documents(spark, rows + ODD)
    marks = spark.createDataFrame([(i, None, t, "clash") for i, t in labels], "doc_id long, quality int, toxic int, text string")
    out = toxicity_cnn.toxicity(docs, marks).collect()
    assert len(out) == len(rows) + len(ODD)
    held = [r for r in out if r.doc_id and 1000 <= r.doc_id < 1600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    right = np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held])
    assert right >= 0.9
    none = toxicity_cnn.toxicity(docs, marks.where("toxic = 0")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity_cnn.toxicity(documents(spark, []), marks).isEmpty()


def test_responses_do_not_depend_on_blocks():
    settings = toxicity_cnn.CnnSettings()
    random = np.random.default_rng(5)
    documents_ = [random.integers(0, 2**63, int(n), dtype=np.uint64) for n in (0, 1, 2, 70_000, 5, 0, 40_000)]
    model = toxicity_cnn.fit(documents_, np.array([0, 1, 0, 1, 0, 0, 1.0]), ["en"] * 7, toxicity_cnn.CnnSettings(epochs=1, least_steps=1, least_documents=1))
    ids = [toxicity_cnn.word_ids(d, model.known) for d in documents_]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    together = model.responses(np.concatenate(ids), starts)
    alone = [model.responses(i, np.array([0, len(i)]))[0] for i in ids]
    assert np.allclose(together, alone, atol=1e-5)
    words = np.concatenate([model.weights["words"], np.zeros((1, settings.size), np.float32)])
    features = []
    for width in settings.widths:
        padded = np.concatenate([ids[4], np.full(width - 1, len(words) - 1)])
        rows = [sum(words[padded[n + p]] @ model.weights[f"filter_{width}"][p] for p in range(width)) for n in range(len(ids[4]))]
        features.append(np.maximum(np.max(rows, axis=0) + model.weights[f"shift_{width}"], 0))
    assert np.allclose(np.concatenate(features) @ model.weights["last"] + model.weights["bias"][0], together[4], atol=1e-4)


def longest_common(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for n, x in enumerate(a):
        for m, y in enumerate(b):
            table[n + 1, m + 1] = table[n, m] + 1 if x == y else max(table[n, m + 1], table[n + 1, m])
    return table[-1, -1]


@pytest.mark.parametrize("seed", range(40))
def test_alignment(seed):
    random = np.random.default_rng(seed)
    template = random.integers(0, 30, 25).tolist()
    text = [w for w in template if random.random() > 0.1] + random.integers(30, 50, 5).tolist()
    matches = license_patience.patience_matches(text, template)
    assert all(text[a] == template[b] for a, b in matches)
    assert all(a < c and b < d for (a, b), (c, d) in zip(matches, matches[1:]))
    assert len(matches) <= longest_common(text, template)
    if len(set(template)) == len(template):
        assert len(matches) == longest_common(text, template)


def test_licenses(spark):
    notice = license_patience.TEMPLATES["MIT-text"]
    words = notice.split()
    mended = " ".join([*words[:20], "and", *words[21:40], *words[42:]])
    rows = [
        (10, prose(1, 300) + " " + notice.upper() + " " + prose(2, 300)),
        (11, prose(3, 40) + "\n" + mended),
        (12, " ".join(words[: len(words) // 2])),
        (13, "Released under the MIT License. " * 3),
        (14, "under the License Released MIT"),
        *ODD,
    ]
    got = {(r.doc_id, r.license): r for r in license_patience.scan(documents(spark, rows)).collect()}
    assert set(got) == {(10, "MIT-text"), (11, "MIT-text"), (13, "MIT")}
    assert got[10, "MIT-text"].coverage == 1.0 and got[10, "MIT-text"].first_word == 300
    assert 0.9 < got[11, "MIT-text"].coverage < 1
    assert license_patience.scan(documents(spark, [])).isEmpty()


NOTICES = {
    "Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0",
    "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "Licensed under CC BY 4.0": "CC-BY-4.0",
    "Licensed under CC BY-NC-SA 3.0": "CC-BY-NC-SA-3.0",
    "Licensed under CC BY-ND 7.0": "CC-BY-ND",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "This work is licensed under the GNU General Public License, version 3": "GPL-3.0",
    "This work is licensed under the GNU General Public License, version 2": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 2 (see section 3)": "GPL-2.0",
    "This work is licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
    "This work is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0",
    "This work is licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    "Released under the GPLv2": "GPL-2.0",
    "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    "Licensed under the Apache License, Version 1.1": "Apache-1.1",
    "Released under the MIT License": "MIT",
    "Distributed under the MIT license": "MIT",
    "Released under the BSD 3-Clause License": "BSD-3-Clause",
    "Released under the BSD License": "BSD",
    "Released under the ISC License": "ISC",
    "Subject to and under the Mozilla Public License, v. 2.0": "MPL-2.0",
    "Dedicated under CC0 1.0": "CC0-1.0",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
    license_patience._BSD: "BSD-2-Clause-text",
    license_patience._BSD + license_patience._ENDORSING: "BSD-3-Clause-text",
    license_patience._BSD + license_patience._ADVERTISING + license_patience._ENDORSING: "BSD-4-Clause-text",
}


def test_licenses_are_told_apart(spark):
    rows = [(n, f"{prose(n, 30)} {text}. {prose(n + 1, 30)}") for n, text in enumerate(NOTICES)]
    rows.append((900, "Licensed under the MIT License or the Apache License, Version 2.0"))
    got = {}
    for r in license_patience.scan(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got.pop(900) == {"MIT", "Apache-2.0"}
    assert got == {n: {name} for n, name in enumerate(NOTICES.values())}


def test_each_template_finds_its_license():
    templates = license_patience.common_templates()
    found = {}
    for row, name, *_ in license_patience.scan_texts(pa.array([text for _, text, _ in templates]), license_patience.LicenseSettings()):
        found.setdefault(row, set()).add(license_patience.license_of(name))
    assert found == {n: {license_patience.license_of(name)} for n, (name, _, _) in enumerate(templates)}


def test_inserted_words_at_every_offset():
    header = re.findall("[A-Za-z0-9]+", license_patience.TEMPLATES["GPL-3.0-header"])
    cases = [
        ("MIT", "Released under the terms of the MIT License".split(), 5),
        ("GPL-3.0-header", [w for n, word in enumerate(header) for w in ((word, f"put{n}") if n % 2 else (word,))][:-1], len(header)),
        ("GPL-2.0", "under the terms of the GPLv2".split(), 3),
    ]
    for name, notice, size in cases:
        offsets = range(2 * size + 1)
        column = pa.array([" ".join([*(f"x{n}" for n in range(offset)), *notice, *(f"y{n}" for n in range(50))]) for offset in offsets])
        found = license_patience.scan_texts(column, license_patience.LicenseSettings())
        rows = {row: place for row, kind, *place in found if kind == name}
        assert rows == {offset: [1.0, offset, offset + len(notice) - 1] for offset in offsets}


@pytest.mark.parametrize("seed", range(30))
def test_windows_hold_what_they_are_said_to(seed):
    random = np.random.default_rng(seed)
    template = random.integers(0, 6, 7).tolist()
    text = random.integers(0, 12, 60)
    expected = []
    for begin in range(60):
        window = text[begin : begin + 14].tolist()
        if text[begin] in template and sum(min(window.count(w), template.count(w)) for w in set(template)) >= 0.85 * 7:
            expected.append((begin, begin + len(window)))
    assert license_patience._windows(text, template, 0.85) == expected


def test_leading_zeros_of_an_address_of_any_length():
    text = "0" * 5000 + "1.2.3.4 and 1." + "0" * 5000 + "255.0.0 and 1.0256.1.1"
    assert [span[0] for span in pii_crf.base_spans(text)] == ["ip", "ip"]


def test_languages_are_learnt_from_rows_without_ids(spark):
    """The sample is drawn by id and text, so rows without an id are not all in or out of it."""
    words = {"aa": "alpha beta gamma delta", "bb": "omega sigma kappa theta"}
    rows = [(None, f"{text} {n} {text.split()[n % 4]}", lang) for lang, text in words.items() for n in range(300)]
    model = langid_bloom.train(documents(spark, rows), BloomSettings(sample_per_language=100))
    judged = langid_bloom.predict(documents(spark, rows), model, added=("guess", "share")).select("lang", "guess").collect()
    assert all(r.lang == r.guess for r in judged)
