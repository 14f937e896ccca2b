"""URL verdicts by pattern rules that are indexed by their rarest literal token.

A pattern is plain text in which ``||`` at the front stands for the start of the host or of one of its parent domains, ``|``
at the front for the start of the host, ``*`` for anything and ``^`` for one of ``/ ? # : . -`` or the end. Each rule is
filed under one of its whole literal tokens, the one that fewest URLs of the table hold. A URL looks up its own tokens, and
only the rules found there run their regular expression. Rules without a whole token are run on every URL; there should be
few. The index is an array of hash buckets in the plan, so judging is one pass without any shuffle or Python, and its
size is that of the rule list, which ``MOST_RULES`` bounds.

Of the rules that match, a site rule (host and path) comes before a pattern, the longest site rule first, then patterns in
the order they are listed. Without a match a URL is allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path and is allowed with a null rule; repeated rows
are judged one by one; no rows give no rows; a null ``page_id`` is kept; other columns are not read.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 50_000

# The site rules that results depend on, as (host, path, verdict).
SITE_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

PATTERN_RULES = (
    ("||spam-farm.", "block"),
    ("||casino-", "block"),
    ("||adult-", "block"),
    ("||cheap-pills.", "block"),
    ("||free-bets.", "block"),
    ("||ads-track.", "block"),
)

_SEPARATOR = r"(?:[/?#:.\-]|$)"


@dataclass(frozen=True)
class Rule:
    """One rule: ``rank`` orders rules that match, smaller first; ``text`` is what is reported (null for a pattern)."""

    rank: int
    text: str | None
    regex: str
    tokens: tuple[str, ...]
    verdict: str


def compile_pattern(pattern: str) -> tuple[str, tuple[str, ...]]:
    """The regular expression of a pattern, and the literal tokens that any URL it matches holds as whole tokens."""
    if pattern.startswith("||"):
        front, body = r"^(?:[^/?#]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        front, body = "^", pattern[1:]
    else:
        front, body = "", pattern
    parts = {"*": "(?s:.*)", "^": _SEPARATOR}
    regex = front + "".join(parts.get(c) or (c if re.match(r"[A-Za-z0-9]", c) else "\\x{%x}" % ord(c)) for c in body)
    whole = []
    for found in re.finditer(r"[A-Za-z0-9]+", body):
        left_open = not front if found.start() == 0 else body[found.start() - 1] == "*"
        right_open = found.end() == len(body) or body[found.end()] == "*"
        if not left_open and not right_open:
            whole.append(found.group())
    return regex, tuple(dict.fromkeys(whole))


def rules_of(sites: tuple[tuple[str, str, str], ...], patterns: tuple[tuple[str, str], ...]) -> list[Rule]:
    """Site rules and patterns as one ranked list."""
    rules = []
    for host, path, verdict in sites:
        regex, tokens = compile_pattern(f"||{host}{path}")
        rules.append(Rule(-len(host + path), host + path, regex, tokens, verdict))
    for place, (pattern, verdict) in enumerate(patterns):
        regex, tokens = compile_pattern(pattern)
        rules.append(Rule(place + 1, None, regex, tokens, verdict))
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules do not fit the plan")
    return rules


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host with A-Z lower-cased, path, and what follows the path. All empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    behind = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(behind, "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path, F.substr(behind, F.length(path) + 1)


def _subjects(pages: DataFrame) -> DataFrame:
    host, path, tail = host_and_path(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), tail.alias("tail"))
    parsed = parsed.select("page_id", "host", "path", F.concat("host", "path", "tail").alias("subject"))
    return parsed.withColumn("tokens", F.array_distinct(F.expr("regexp_extract_all(subject, '[A-Za-z0-9]+', 0)")))


def _index(subjects: DataFrame, rules: list[Rule]) -> tuple[str, int]:
    """The rules in hash buckets of their rarest token, as JSON, and the number of buckets."""
    spark = subjects.sparkSession
    tokens = sorted({token for rule in rules for token in rule.tokens})
    size = 1 << max(4, (2 * len(rules)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    known = spark.createDataFrame([(token,) for token in tokens], "token string")
    counts = (
        subjects.select(F.explode("tokens").alias("token"))
        .join(F.broadcast(known), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("urls"))
    )
    found = known.join(counts, "token", "left").select("token", F.coalesce("urls", F.lit(0)).alias("urls"), F.expr(f"pmod(hash(token), {size})").alias("place"))
    frequency = {r["token"]: (r["urls"], r["token"], r["place"]) for r in found.collect()}  # a row per token of a rule
    for rule in rules:
        if rule.tokens:
            _, token, place = min(frequency[t] for t in rule.tokens)
            buckets[place].append({"token": token, "rank": rule.rank, "rule": rule.text, "verdict": rule.verdict, "regex": rule.regex})
    return json.dumps(buckets), size


_ENTRY = "struct<token: string, rank: int, rule: string, verdict: string, regex: string>"


def judge(
    pages: DataFrame,
    sites: tuple[tuple[str, str, str], ...] = SITE_RULES,
    patterns: tuple[tuple[str, str], ...] = PATTERN_RULES,
) -> DataFrame:
    """Columns ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``rules_run``. Reads ``page_id`` and ``url``."""
    rules = rules_of(sites, patterns)
    subjects = _subjects(pages)
    index, size = _index(subjects, rules)
    always = [{"token": "", "rank": r.rank, "rule": r.text, "verdict": r.verdict, "regex": r.regex} for r in rules if not r.tokens]
    filed = subjects.withColumn("index", F.from_json(F.lit(index), f"array<array<{_ENTRY}>>"))
    filed = filed.withColumn("always", F.from_json(F.lit(json.dumps(always)), f"array<{_ENTRY}>"))
    candidates = filed.selectExpr(
        "page_id",
        "host",
        "path",
        "subject",
        "concat(always, flatten(transform(tokens, t ->"
        f" filter(element_at(index, cast(pmod(hash(t), {size}) as int) + 1), r -> r.token = t)))) as candidates",
    )
    matched = candidates.selectExpr(
        "page_id",
        "host",
        "path",
        "size(candidates) as rules_run",
        "array_min(transform(filter(candidates, r -> rlike(subject, r.regex)),"
        " r -> struct(r.rank as rank, r.rule as rule, r.verdict as verdict))) as best",
    )
    return matched.selectExpr("page_id", "host", "path", "best.rule as rule", "coalesce(best.verdict, 'allow') as verdict", "rules_run")
