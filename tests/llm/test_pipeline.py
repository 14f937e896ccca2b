"""Stages of the pipeline on small rows."""

from collections import Counter

from shapes import ODD, documents, prose

import corpus_pipeline
from liftloom.llm import curriculum


def test_one_row_of_each_group_stays(spark):
    one, two, three = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, one), (1, two), (1, one), (5, two), (None, three), (None, three), (None, prose(4, 60)), (None, one), (None, ""), (8, None), (8, None), (9, prose(5, 60))]
    docs = documents(spark, rows)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    expected = [(1, one), (1, two), (None, three), (None, prose(4, 60)), (None, ""), (8, None), (8, None), (9, prose(5, 60))]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(expected)
    assert corpus_pipeline.near_dedup(spark, documents(spark, []), "").isEmpty()


def test_mixed_rows_come_in_order_of_the_schedule(spark):
    docs = documents(spark, [(n, prose(n, 30 + n % 7), "en", f"s{n % 3}") for n in range(60)])
    due = []
    for r in curriculum.mix(docs).collect():
        if r.taken > 0:
            due.append((r.position, r.doc_id))
        if r.taken > r["size"]:
            due.append((r.again, r.doc_id))
    out = corpus_pipeline.mix(spark, docs, "")
    assert out.columns == docs.columns
    assert [r.doc_id for r in out.collect()] == [doc_id for _, doc_id in sorted(due)]


def test_rows_with_one_id_take_their_own_amounts(spark):
    rows = [(None, prose(n, 9), "en", "s0") for n in range(300)] + [(7, prose(5, 20), "en", "s1")] * 200 + [(n, prose(n, 30), "en", "s2") for n in range(100)]
    docs = documents(spark, rows)
    goals = {r.source: r.target for r in curriculum.mix(docs).select("source", "target").distinct().collect()}
    words = Counter()
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[source] - goal) <= 1 for source, goal in goals.items())
    assert corpus_pipeline.mix(spark, documents(spark, []), "").isEmpty()


def test_all_stages_on_odd_rows(spark, tmp_path):
    said = {"en": "the cat and the dog went to the house with a friend of mine", "de": "der hund und die katze gingen mit einem freund zum haus"}
    rows = [(100 + n, f"{prose(n, 40)} {said[lang]} mail me at joe{n}@site.org", lang, f"s{n % 3}") for n in range(40) for lang in said]
    docs = documents(spark, [*ODD, *rows, (100, rows[0][1]), (None, rows[2][1] + " once more")])

    spoken = corpus_pipeline.language_id(spark, docs, "")
    assert spoken.columns == docs.columns
    letters = [text for _, text, *_ in rows] + [rows[0][1], rows[2][1] + " once more"]
    kept = Counter(r.text for r in spoken.collect())
    assert all(kept[text] == many for text, many in Counter(letters).items())
    assert not any(text is None or not any(c.isalpha() for c in text) for text in kept)

    clean = corpus_pipeline.pii(spark, spoken, "")
    assert clean.columns == docs.columns and clean.count() == spoken.count()
    assert not any("@site.org" in r.text or r.n_chars != len(r.text) for r in clean.collect())

    pieces = corpus_pipeline.pack(spark, docs, "").collect()
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and sum(r.start == 0 for r in pieces) == docs.count()

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == corpus_pipeline.pack(spark, documents(spark, []), "").columns and out.count() > 0
