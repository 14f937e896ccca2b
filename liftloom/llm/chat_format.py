r"""Training text of conversations, from logs of what happened in them.

A log has rows ``(conv_id, message, seq, kind, role, text)``. ``seq`` orders a conversation's events; ``message`` numbers its messages:

- ``open``: the message begins, with its role;
- ``delta``: text is appended to it;
- ``edit``: its text so far is replaced;
- ``regenerate``: its text so far is dropped, and deltas that follow make a new one.

An edit or a new answer also takes back all later messages known by then; what comes after it builds them anew. So an event counts
unless a later edit or regeneration is on the same or an earlier message (a message's own opening stays). A message of which nothing
counts is not there; one without an opening has an empty role; of several openings the last counts. Rows without ``message`` or
``seq``, or of another kind, take no part; rows of one ``seq`` are taken in order of their text; null text or role is empty; rows without
``conv_id`` make one conversation. Repeated rows of messages are messages of their own. Empty tables give no rows. Further columns are not read.

Events move once, by conversation; folding, rendering and reading back follow in that partitioning, with SQL functions alone. What a
conversation is rendered to is one value, so it has to fit into a row.

The template puts ``<|im_start|>role``, a line feed, the text and ``<|im_end|>`` with a line feed. A control string inside a role or text gets a
backslash after its first character, and one more if it had some there, so reading back takes exactly that one off again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = ["conv_id", "message", "seq", "kind", "role", "text"]
#: characters of a delta, where a log is made of whole messages
DELTA_CHARS = 1000
#: texts of this role are learnt
LEARNT = "assistant"


@dataclass(frozen=True)
class Template:
    """Marks around a message, and what else must not stand in a text as it is."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    # fixed values: control strings of public chat formats
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

    def patterns(self) -> tuple[str, str]:
        """Regular expressions of the first character of a control string, and of the backslash that was put after it."""
        rests: dict[str, list[str]] = {}
        for control in self.controls:
            rests.setdefault(control[0], []).append(control[1:])
        found, put = [], []
        for head, tails in rests.items():
            tail = rf"(?=\\*(?:{'|'.join(re.escape(t) for t in tails)}))"
            found.append(re.escape(head) + tail)
            put.append(rf"(?<={re.escape(head)})\\{tail}")
        return "|".join(found), "|".join(put)

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self.patterns()[0]})", r"$1\\")

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, self.patterns()[1], "")

    def role_out(self, role: Column) -> Column:
        """A role on one line."""
        return self.escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))

    def role_back(self, role: Column) -> Column:
        return F.replace(F.replace(self.plain(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def log_of(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as the log of a stream: each opens a message and sends its text in deltas.

    Messages are in order of ``turn``, null first; rows of one turn in order of role and text.
    """
    whole = conversations.selectExpr("conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
    numbered = whole.selectExpr("*", "cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS bigint) AS message")
    deltas = F.transform(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0)),
        lambda part: F.struct(F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), part.alias("text")),
    )
    opening = F.array(F.struct(F.lit("open").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text")))
    events = numbered.select("conv_id", "message", F.posexplode(F.concat(opening, deltas)).alias("nr", "event"))
    return events.selectExpr("conv_id", "message", "message * 1000000000 + nr AS seq", "event.kind", "event.role", "event.text")


def messages(log: DataFrame) -> DataFrame:
    """The final messages: ``(conv_id, message, role, text)``."""
    known = log.select(*LOG).where("message IS NOT NULL AND seq IS NOT NULL AND kind IN ('open', 'delta', 'edit', 'regenerate')")
    reset = "max(CASE WHEN kind IN ('edit', 'regenerate') THEN seq END) OVER (PARTITION BY conv_id ORDER BY message RANGE BETWEEN UNBOUNDED PRECEDING AND"
    counted = known.selectExpr("*", f"{reset} CURRENT ROW) AS changed", f"{reset} 1 PRECEDING) AS changed_above").where(
        "seq >= coalesce(CASE WHEN kind = 'open' THEN changed_above ELSE changed END, seq)"
    )
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") != "open", F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))))
    folded = counted.groupBy("conv_id", "message").agg(
        F.expr("max(CASE WHEN kind = 'open' THEN struct(seq, coalesce(role, '') AS role) END).role").alias("role"), parts.alias("parts")
    )
    return folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join("parts.text", "").alias("text"))


def render(folded: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: ``segments``, an array of ``(text, loss)``. Their texts joined are the formatted conversation."""
    shown = folded.select(
        "conv_id",
        F.struct("message", F.expr("role").alias("own_role"), template.role_out(F.col("role")).alias("role"), template.escaped(F.col("text")).alias("text")).alias("m"),
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(m: Column) -> Column:
        off = F.lit(False)
        return F.array(
            segment(F.concat(F.lit(template.start), m["role"], F.lit("\n")), off), segment(m["text"], m["own_role"] == LEARNT), segment(F.lit(template.end), off)
        )

    ordered = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ordered"))
    return ordered.select("conv_id", F.flatten(F.transform("ordered", segments)).alias("segments"))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template = Template()) -> Column:
    """Formatted text to an array of ``(role, text)``."""
    pieces = F.split(text, re.escape(template.end))
    begins = len(template.start) + 1

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        return F.struct(
            template.role_back(F.substring(role, begins, 2**31 - 1)).alias("role"), template.plain(piece.substr(F.length(role) + 2, F.length(piece))).alias("text")
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def digests(rendered: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted conversations say when read back."""
    read = rendered.select(
        "conv_id",
        formatted(F.col("segments")).alias("formatted"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.plain(s["text"])), "").alias("learnt"),
    ).select("*", read_back(F.col("formatted"), template).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
