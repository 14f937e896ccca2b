"""Settings shared by the batch and streaming jobs."""

from __future__ import annotations

from dataclasses import dataclass, field


def parse_gaps(text: str) -> dict[str, int]:
    """Read ``name:seconds,name:seconds``.

    White space is ignored anywhere, and so is an entry that does not have exactly two parts.
    """
    gaps: dict[str, int] = {}
    for entry in "".join((text or "").split()).split(","):
        parts = entry.split(":")
        if len(parts) == 2:
            gaps[parts[0]] = int(parts[1])
    return gaps


@dataclass(frozen=True)
class HotKeys:
    """How grouping keys that hold very many rows are spread over tasks.

    A key with more than ``min_rows`` rows is hot. Hot keys are cut into slots of about ``slot_rows`` consecutive rows.
    """

    min_rows: int = 2_000_000
    slot_rows: int = 500_000


# Session settings and hint that results depend on.
DEFAULT_GAPS = "standard:1800,lab:120"
DEFAULT_CONF = "standard"
LOCAL_HINT_MS = 60_000


@dataclass(frozen=True)
class SessionSettings:
    """Session gaps by name, and how sessions turn into counts."""

    gaps: dict[str, int] = field(default_factory=lambda: parse_gaps(DEFAULT_GAPS))
    default_conf: str = DEFAULT_CONF
    local_hint_ms: int = LOCAL_HINT_MS
    #: count every run of so many rows as a session of its own, as early output of a stream would; None counts whole sessions
    pane_rows: int | None = None
    hot_keys: HotKeys | None = HotKeys()

    def __post_init__(self) -> None:
        if self.default_conf not in self.gaps:
            raise ValueError(f"default session setting {self.default_conf!r} has no gap")
        if any(seconds <= 0 for seconds in self.gaps.values()):
            raise ValueError("session gaps must be positive")
        if self.pane_rows is not None and self.pane_rows < 1:
            raise ValueError("pane_rows must be positive or None")
