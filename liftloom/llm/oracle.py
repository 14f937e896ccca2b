"""The same results as plain SQL, where SQL can express them on whole tables.

Trained models, approximate search, alignments, schedules and linear programs have none; tests hold them against brute force.
"""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# written out by hand, so that they do not come from the code that they are held against
_URL_RULES = rf"""WITH parsed AS (SELECT row_number() OVER () AS nr, page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    rules(site, front, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    best AS (SELECT nr, max_by(site || front, length(site || front)) AS rule, max_by(rules.verdict, length(site || front)) AS verdict
        FROM parsed JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, front) GROUP BY nr),
    patterns AS (SELECT *, regexp_matches('.' || host, '[.](spam-farm[.]|casino-|adult-|cheap-pills[.]|free-bets[.]|ads-track[.])') AS blocked FROM parsed)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
    FROM patterns LEFT JOIN best USING (nr)"""


# the table of CRC-32, and its value for a list of bytes; DuckDB has no function for it
_CRC_TABLE = "SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS tab FROM range(256) r(n)"


def _crc(text: str) -> str:
    """For texts of code points below 2048."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"


_WORD_COUNT = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

_VARIANTS = f"""WITH RECURSIVE crc AS ({_CRC_TABLE}),
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
        unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
    counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
    hashed AS (SELECT run, n, {_crc("id || ':' || run")} AS h FROM counted, crc),
    lost AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM lost WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
    cuts AS (SELECT word, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
    near AS (SELECT a.word, b.word AS other FROM cuts a JOIN cuts b ON a.hole = b.hole AND a.word <> b.word
        UNION SELECT word, rest FROM cuts JOIN (SELECT word AS rest FROM words) USING (rest)
        UNION SELECT rest, word FROM cuts JOIN (SELECT word AS rest FROM words) USING (rest)),
    ranked AS (SELECT near.word, other, m.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
        row_number() OVER (PARTITION BY near.word ORDER BY m.n DESC, other) AS nr FROM near JOIN words m ON m.word = other),
    judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
        CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND nr = 1),
    chain AS (SELECT word, word AS now FROM judged UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.now WHERE j.form IS NOT NULL),
    roots AS (SELECT c.word, c.now AS root FROM chain c JOIN judged j ON j.word = c.now WHERE j.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)"""

_TRIE = f"""WITH crc AS ({_CRC_TABLE}),
    said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (SELECT conv_id, sha256(length(role) || ':' || role || text) AS sha, {_WORD_COUNT.format("text")} AS words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS place FROM said),
    ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
    heads AS (SELECT i.conv_id, t.place AS d, sha, words FROM ids i JOIN turns t ON t.conv_id = base AND place <= h),
    shifts AS (SELECT i.conv_id, h, count(d) AS given FROM ids i LEFT JOIN heads USING (conv_id) GROUP BY ALL),
    built AS (FROM heads UNION ALL SELECT conv_id, place - h + given, sha, words FROM turns JOIN shifts USING (conv_id) WHERE place > h),
    paths AS (SELECT conv_id, d, words, string_agg(sha, ',') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM built
        UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
    lengths AS (SELECT conv_id, max(d) AS len FROM paths GROUP BY ALL),
    nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = len), '')) AS ends_sha256
        FROM paths JOIN lengths USING (conv_id) GROUP BY ALL),
    kids AS (SELECT u.path, u.d, count(v.path) AS n_children FROM nodes u LEFT JOIN nodes v ON v.d = u.d + 1 AND starts_with(v.path, u.path) GROUP BY ALL),
    below AS (SELECT u.path, u.d, sum((v.n_convs - 1) * v.words) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
        FROM nodes u JOIN nodes v ON starts_with(v.path, u.path) JOIN kids k ON k.path = v.path AND k.d = v.d GROUP BY ALL)
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN kids USING (path, d) JOIN below USING (path, d) LEFT JOIN nodes p ON p.d = n.d - 1 AND starts_with(n.path, p.path)"""

_ESCAPED = (
    r"regexp_replace(regexp_replace({}, '(<)(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>))', '\1\\\2', 'g'),"
    r" '(\[)(\\*(?:/?INST\]))', '\1\\\2', 'g')"
)

_CHATS = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
    marked AS (SELECT *, {_ESCAPED.format("text")} AS safe, {_ESCAPED.format("replace(replace(role, chr(92), chr(92) || 'b'), chr(10), chr(92) || 'n')")} AS safe_role FROM said)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(safe_role) + length(safe) + length('<|im_start|>') + 1 + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id"""

STATEMENTS: dict[str, str] = {
    "op11_spelling_gram": _VARIANTS,
    "op12_prefix_collapse": _TRIE,
    "op13_chat_events": _CHATS,
    "op6_url_rules": _URL_RULES,
    "op8_setsketch_dedup": f"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        places AS (SELECT doc_id, words, unnest(range(1, CASE WHEN len(words) >= 5 THEN len(words) - 3 ELSE 2 END)) AS i
            FROM texts WHERE len(words) > 0),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s FROM places),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)""",
    "op9_impact_topk": """WITH whole AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20""",
}
