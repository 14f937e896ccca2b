import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from liftloom.session import build

    session = build("tests", shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from short tuples (ts_ms, type, name, label, hint[, session, conf, project])."""
    from liftloom.schemas import EVENTS

    def make(rows):
        full = []
        for number, row in enumerate(rows):
            ts, kind, name, label, hint, session, conf, project = (*row, "s", "standard", "p")[:8] if len(row) == 5 else (
                *row, *("s", "standard", "p")[len(row) - 5 :]
            )
            full.append((number, project, session, kind, name, 0.0, label, hint, ts, conf))
        return spark.createDataFrame(full, EVENTS)

    return make
