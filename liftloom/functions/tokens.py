"""Column helpers for event tokens, count keys, days and hashed draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers used in count keys.
ALL = "[AL]"
EVENT_TOTAL = "[TE]"
SESSION_TOTAL = "[TS]"
NO_ACTION = ""

# Accepted event types, as clients write them.
CLIENT_TYPES = ("event", "atr", "goal", "act")


def token(event_type: Column, event_name: Column) -> Column:
    """``TYPE#name``"""
    return F.concat_ws("#", F.upper(event_type), event_name)


def goal_token(name: Column) -> Column:
    return F.concat(F.lit("GOAL#"), name)


def action_token(name: Column) -> Column:
    return F.concat(F.lit("ACT#"), name)


def has_text(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def rec_key(goal: Column, action: Column, leaf: Column) -> Column:
    """The flat form of a structured count key."""
    return F.concat_ws("::", goal, F.when(action != NO_ACTION, action), leaf)


def day_of_ms(ms: Column) -> Column:
    """UTC day of epoch milliseconds, whatever the session time zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / F.lit(86_400_000)).cast("int"))



def hashed_uniform(seed: Column, salt: str) -> Column:
    """A repeatable draw from [0, 1): the first 32 bits of an MD5 over seed and salt."""
    digest = F.md5(F.concat_ws("|", seed.cast("string"), F.lit(salt)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
