"""Near-duplicate groups against all pairs."""

import itertools

import numpy as np
import pyarrow as pa
from shapes import ODD, documents, prose
from test_words import plain_set

from liftloom.llm import words as W
from liftloom.llm.links import components
from liftloom.llm.setsketch_dedup import SketchSettings, estimate_similarity, near_duplicates, sketch_of


def by_pairs(rows):
    """Smallest id reachable by links, for each row."""
    sets = [plain_set(text) for _, text in rows]
    group = list(range(len(rows)))

    def top(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            group[top(a)] = top(b)
    least = {}
    for n, (doc_id, _) in enumerate(rows):
        least.setdefault(top(n), []).append(doc_id)
    best = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return sorted((str(rows[n][0]), len(sets[n]), str(best[top(n)])) for n in range(len(rows)))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def changed(text, place, width=1):
    words = text.split()
    return " ".join([*words[:place], *(f"new{place}{n}" for n in range(width)), *words[place + width :]])


def test_groups(spark):
    base, other = prose(1, 120), prose(2, 40)
    rows = [(10 + n, changed(base, (n * 13) % 120, 1 + n % 4)) for n in range(24)]  # many near the base, fewer near each other
    rows += [(50, base), (51, base), (52, base.upper()), (60, other), (61, changed(other, 20)), (62, changed(other, 5, 8))]
    rows += [(70 + n, prose(20 + n, 30)) for n in range(5)]
    rows += [row for row in ODD if row[0] != 6] + [(6, "a"), (8, "a"), (9, "a b c d"), (90, "a b c d"), (91, "b a c d")]
    assert found(near_duplicates(documents(spark, rows))) == by_pairs(rows)


def test_bucket_mates_that_are_no_links(spark):
    base = [f"w{n}" for n in range(130)]
    random = np.random.default_rng(5)

    def edited(share):
        return " ".join(w if random.random() > share else f"e{random.integers(10**9)}" for w in base)

    # linked ones near the base, and others whose likeness to all of them lies around the limit or below
    rows = [(n, edited(0.01)) for n in range(60)] + [(100 + n, edited(0.03)) for n in range(40)] + [(200 + n, edited(0.07)) for n in range(40)]
    docs = documents(spark, rows)
    assert found(near_duplicates(docs)) == by_pairs(rows)
    # sets above the size compared whole are sampled, and lose no link
    assert found(near_duplicates(docs, SketchSettings(whole_set=40))) == by_pairs(rows)


def test_many_null_ids(spark):
    rows = [(None, prose(n, 20)) for n in range(30)] + [(None, prose(3, 20)), (4, changed(prose(7, 60), 30)), (None, prose(7, 60))]
    assert found(near_duplicates(documents(spark, rows))) == by_pairs(rows)


def test_rows_that_repeat_and_empty_tables(spark):
    out = near_duplicates(documents(spark, [(6, "a"), (6, "a"), (7, None), (7, None)]))
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out.collect()) == [(6, 6, True)] * 2 + [(7, 7, True)] * 2
    empty = near_duplicates(documents(spark, []))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.isEmpty()


def test_estimates_are_near_the_truth():
    settings = SketchSettings()
    random = np.random.default_rng(1)
    for shared, own in ((900, 50), (600, 200), (100, 400)):
        pool = random.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
        one, two = pool[: shared + own], np.concatenate([pool[:shared], pool[shared + own :]])
        sketches = [sketch_of(s, settings)[None] for s in (one, two)]
        got = estimate_similarity(*sketches, np.array([len(one)]), np.array([len(two)]), settings.base)[0]
        assert abs(got - shared / len(pool)) < 0.15
        # registers of a union are the larger of both
        assert (np.maximum(*sketches) == sketch_of(pool, settings)).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 9), (9, 8), (20, 21), (21, 20), (5, 5), *[(100, n) for n in range(101, 140)], (139, 300)]
    got = sorted(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    roots = {**dict.fromkeys([1, 2, 3, 8, 9], 1), 20: 20, 21: 20, **dict.fromkeys([*range(100, 140), 300], 100)}
    assert got == sorted(roots.items())


def test_sets_do_not_depend_on_the_batch():
    texts = [prose(n, 30) for n in range(5)]
    together = list(W.shingle_sets(*W.word_hashes(*W.buffer_of(pa.array(texts)))))
    for text, whole in zip(texts, together):
        assert (next(W.shingle_sets(*W.word_hashes(*W.buffer_of(pa.array([text]))))) == whole).all()
