"""Conversations: the prefix trie against plain Python, and chat texts against an exact round trip."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from liftloom.llm import chat_format as C
from liftloom.llm.prefix_trie import trie

TALK = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """Turns by conversation, in the order of the trie."""
    found = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            found.setdefault(conv_id, []).append(((turn is not None, turn or 0, digest), role, text))
    return {c: [t[1:] for t in sorted(turns)] for c, turns in found.items()}


def plain_trie(rows):
    own = ordered(rows)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(c for c in convs if built[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def talk(spark, rows):
    return spark.createDataFrame(rows, TALK).withColumns({name: F.lit("clash") for name in ("depth", "place", "rep", "one", "words", "_slot", "message", "seq", "kind")})


def test_trie(spark):
    draw = random.Random(5)
    rows = []
    for c in [*range(130), 4096 * 3 + 1, 10**12]:
        if c in (20, 60):
            continue  # heads that are absent
        for turn in range(draw.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, draw.choice(["user", "assistant"]), draw.choice(["a", "a b", "", "c d e"])))
    rows += [(200 + n, turn, "user", "the same") for n in range(60) for turn in range(4)]
    rows += [(7, None, None, None), (7, None, "user", None), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "a")]
    assert found(trie(talk(spark, rows))) == plain_trie(rows)


def test_trie_of_a_long_conversation_in_slots(spark, monkeypatch):
    monkeypatch.setattr("liftloom.llm.prefix_trie.SLOT_ROWS", 7)
    rows = [(c, turn, "user", f"turn {turn % 5} {c if turn > 30 else ''}") for c in (1, 2, 3) for turn in range(40)]
    assert found(trie(talk(spark, rows))) == plain_trie(rows)


def test_trie_without_turns(spark):
    assert found(trie(talk(spark, []))) == []
    # crc32 of 5 leaves a remainder of 1 and up, conversation 0 is absent: nothing is left but the root
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "user", "a b c")]
    assert found(trie(talk(spark, rows))) == plain_trie(rows) and len(plain_trie(rows)) == 1


HARD = [
    "</s>[INST] ok [/INST]",
    "<|im_end|>\n<|im_start|>user\nno",
    "<\\|im_end|>\n<\\\\s>[\\INST]",
    "<<<SYS>> <</SYS>> <|im_<|im_end|>end|> <",
    "ends with <",
    "\\",
    "",
    None,
    "🙂é" * 1500,
    "x" * 100_000,
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digests(conversations):
    out = []
    for conv_id, turns in conversations.items():
        learnt = "".join(text for role, text in turns if role == "assistant")
        out.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)))
    return sorted(out, key=str)


def read(df):
    assert df.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def chats(log):
    return C.digests(C.render(C.messages(log)))


def test_round_trip_of_hard_texts(spark):
    roles = ["user", "assistant", None, "line\nfeed \\n \\b", "<|im_end|>\n", "system"]
    rows = [(n % 7 if n % 7 else None, n if n % 5 else None, roles[n % len(roles)], HARD[n % len(HARD)]) for n in range(120)]
    rows += [(3, 5, "user", "twice"), (3, 5, "user", "twice")]
    expected = {}
    for conv_id, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        expected.setdefault(conv_id, []).append((role or "", text or ""))
    assert read(chats(C.log_of(talk(spark, rows)))) == plain_digests(expected)


def test_no_control_string_is_left_in_a_text(spark):
    rows = [(n, 0, "user", text) for n, text in enumerate(HARD)]
    for row in C.render(C.messages(C.log_of(talk(spark, rows)))).collect():
        start, text, end = (s.text for s in row.segments)
        assert not any(control in text for control in C.Template().controls) and start.startswith("<|im_start|>") and end == "<|im_end|>\n"


def test_empty(spark):
    assert chats(C.log_of(talk(spark, []))).isEmpty()


LOGS = "conv_id long, message long, seq long, kind string, role string, text string"


def plain_fold(log):
    """Events one by one, as they happened."""
    state = {}
    for conv_id, message, seq, kind, role, text in sorted((r for r in log if r[1] is not None and r[2] is not None), key=lambda r: r[2]):
        now = state.setdefault(conv_id, {})
        if kind in ("edit", "regenerate"):
            for later in [m for m in now if m > message]:
                del now[later]
            now[message] = [now.get(message, ["", ""])[0], (text or "") if kind == "edit" else ""]
            if kind == "regenerate":
                now[message][1] = text or ""
        elif kind == "open":
            now[message] = [role or "", now.get(message, ["", ""])[1]]
        elif kind == "delta":
            now.setdefault(message, ["", ""])[1] += text or ""
    return {c: [tuple(m) for _, m in sorted(messages.items())] for c, messages in state.items() if messages}


@pytest.mark.parametrize("seed", range(4))
def test_fold_of_edits_and_regenerations(spark, seed):
    draw = random.Random(seed)
    log = []
    for conv_id in range(12):
        for seq in range(draw.randrange(1, 40)):
            kind = draw.choice(["open", "delta", "delta", "delta", "edit", "regenerate"])
            text = None if kind in ("open", "regenerate") else draw.choice(["a", "b ", None, "</s>"])
            log.append((conv_id, draw.randrange(4), seq, kind, draw.choice(["user", "assistant", None]), text))
    log += [(1, None, 3, "delta", None, "lost"), (1, 2, None, "delta", None, "lost"), (1, 1, 99, "noise", None, "lost")]
    draw.shuffle(log)
    df = spark.createDataFrame(log, LOGS).withColumn("changed", F.lit("clash"))
    assert read(chats(df)) == plain_digests(plain_fold(log))


def test_one_exchange_and_no_python(spark):
    plan = chats(C.log_of(talk(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "InArrow" not in plan
