"""Mixing, packing, URL rules and running sums against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from shapes import ODD, documents, prose

from liftloom.llm import curriculum, cutting_stock, url_rules
from liftloom.llm.cutting_stock import PackSettings, choose_patterns, pack
from liftloom.llm.ranks import running_before


def plain_targets(sizes):
    """Targets by sharing out the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {name: (5, 2, 1)[n % 3] for n, name in enumerate(names)}
    open_, left, target = set(names), 1.5 * sum(sizes.values()), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] >= 2 * sizes[s]]
        if not full:
            return target | {s: share * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix(spark):
    rows = [(n, prose(n, 5 + n * n % 90), "en", ("web", "books", "code", None, "mail")[n * n % 5]) for n in range(20, 120)]
    rows += [(n, t, "en", "odd") for n, t in ODD]
    out = curriculum.mix(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    size = {n: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for n, t, *_ in rows}
    sizes = Counter()
    for n, t, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    took = Counter()
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        took[r.source] += r.taken
    assert all(abs(took[s] - want[s]) <= 1 for s in want)
    positions = [r.position for r in out if r.position is not None]
    assert positions == sorted(positions) and {r.position is None for r in out if not r.taken} == {True}
    again = curriculum.mix(documents(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert curriculum.mix(documents(spark, [])).isEmpty()
    nothing = curriculum.mix(documents(spark, [(1, ""), (2, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("knots", [(1.5, 1.2, 0.9, 0.4), (1.0, 1.0, 1.0), (0.3, 0.8, 1.2, 1.7), (0.0, 2.0)])
def test_schedule_is_inverted(spark, knots):
    times = np.linspace(0, 1, 20_001)
    demand = np.interp(times, np.linspace(0, 1, len(knots)), knots)
    total = np.concatenate([[0], np.cumsum((demand[1:] + demand[:-1]) / 2)])
    shares = [n / 20 for n in range(21)]
    rows = spark.createDataFrame([(s,) for s in shares], "s double").selectExpr("s", f"{curriculum._time_due('s', knots)} as t").collect()
    for r in rows:
        assert abs(np.interp(r.t, times, total / total[-1]) - r.s) < 1e-4


def test_running_sums(spark):
    df = spark.range(500).selectExpr("id", "if(id % 7 = 0, null, id % 3) as k", "id % 5 as w", "md5(cast(cast(id as string) as binary)) as d")
    got = running_before(df, ["k"], "w", ["d"], 10_000_000, "upto").collect()
    for key in (None, 0, 1, 2):
        before = 0
        own = sorted((r for r in got if r.k == key), key=lambda r: r.d)
        for r in own:
            assert (r.upto, r.upto_all) == (before, sum(o.w for o in own))
            before += r.w


@pytest.mark.parametrize("seed", range(6))
def test_patterns_fill_exactly(seed):
    random = np.random.default_rng(seed)
    size = (16, 32, 64)[seed % 3]
    histogram = {int(n): int(c) for n, c in zip(range(1, size), random.integers(0, 40, size - 1))}
    used = Counter()
    for pattern in choose_patterns(histogram, size, 300):
        assert sum(n * many for n, many in pattern.lengths) == size and pattern.copies > 0
        for n, many in pattern.lengths:
            used[n] += many * pattern.copies
    assert all(used[n] <= histogram[n] for n in used)
    # on a full histogram of lengths few pieces are left that must be cut
    cuts = {n: bin(n).count("1") - 1 for n in histogram}
    assert sum(cuts[n] * used[n] for n in used) >= 0.5 * sum(cuts[n] * c for n, c in histogram.items())
    assert choose_patterns({}, size, 10) == [] and choose_patterns({3: 5}, 16, 10) == []


def test_pack(spark):
    rows = [(n, prose(n, n * 37 % 700)) for n in range(100, 160)] + [(200, "tail <|endoftext|> head"), (201, "é" * 3000), (202, prose(1, 4000))]
    rows += ODD
    out = pack(documents(spark, rows)).collect()
    encoder = cutting_stock.Encoder(None)
    texts = Counter((n, t or "") for n, t in rows)
    held: dict = {}
    for r in out:
        held.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (doc_id, text), many in texts.items():
        ids = np.array([*encoder.plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(held.pop((doc_id, len(ids))), key=lambda r: r.start)
        covered = Counter()
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.length > 0
            covered.update(range(r.start, r.start + r.length))
        assert set(covered.values()) == {many} and len(covered) == len(ids)
    assert not held
    sequences: dict = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0
    assert pack(documents(spark, [])).isEmpty()


def test_ids_are_those_of_the_tokenizers_file():
    encoder = cutting_stock.Encoder(None)
    random = np.random.default_rng(1)
    pool = [chr(c) for c in range(1, 0x2100) if not 0xD800 <= c < 0xE000] + list(" \n'stre09é") * 100
    for _ in range(300):
        text = "".join(pool[int(n)] for n in random.integers(0, len(pool), 30))
        assert encoder.ids(text).tolist() == [*encoder.plain.encode(text, add_special_tokens=False).ids, 0]


URLS = [
    "http://Example.ORG/es/1?x=/en/1", "https://a.example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/", "http://org/", "http://org",
    "https://x.com/fr/a", "https://x.com/de", "https://x.com/de/", "ftp://com/de/x#y", "no scheme", None, "", "://", "http://www.spam-farm.example.net/a",
    "http://my-spam-farm.example.net", "https://casino-win.example.net/x", "http://spam-farm.example.org/es/3", "http://x.com?/de/", "a://b://com/de/", "http://É.com/fr/É",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(n, u, "clash", "clash") for n, u in enumerate(URLS)] + [(None, URLS[0], "", ""), (0, URLS[0], "", "")], "page_id long, url string, rule string, tokens string")
    out = url_rules.judge(pages).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        url = URLS[r.page_id or 0] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        sites = [(len(h + p), h + p, v) for h, p, v in url_rules.SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if sites:
            _, rule, verdict = max(sites)
        else:
            labels = [f"{label}." for label in host.split(".")]
            blocked = any(l in ("spam-farm.", "cheap-pills.", "free-bets.", "ads-track.") or l.startswith(("casino-", "adult-")) for l in labels[:-1])
            rule, verdict = None, "block" if blocked else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), url
    assert url_rules.judge(pages.where("false")).isEmpty()


def test_only_rules_of_a_token_run(spark):
    many = tuple((f"||site{n}.example^", "block") for n in range(500))
    pages = spark.createDataFrame([(1, "http://site7.example/"), (2, "http://other.test/")], "page_id long, url string")
    out = {r.page_id: r for r in url_rules.judge(pages, (), (*many, ("*tracker*", "block"))).collect()}
    assert (out[1].verdict, out[1].rules_run) == ("block", 2) and (out[2].verdict, out[2].rules_run) == ("allow", 1)


def test_native_plan(spark):
    pages = spark.createDataFrame([(1, "http://org/")], "page_id long, url string")
    plan = url_rules.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange|Join", plan)


@pytest.mark.parametrize("words", [63, 117])
def test_rests_of_one_length_are_cut_once_at_most(spark, words):
    """Many documents of one length that does not divide a sequence."""
    settings = PackSettings(tokens=128)
    rows = [(n, " a" * (words - 1)) for n in range(300)]
    out = pack(documents(spark, rows), settings).collect()
    assert {r.doc_tokens for r in out} == {words}
    used = {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 128
    assert sum(at < 128 for at in (sum(n for _, n in p) for p in used.values())) <= 7
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
    encoder = cutting_stock._encoder(None)
    for doc_id, pieces in by_doc.items():
        ids, at = encoder.ids(rows[doc_id][1]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == words
    assert len(out) <= 2 * 300 + 8
