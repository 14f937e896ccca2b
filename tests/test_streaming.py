"""Drained streams against the batch jobs."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from liftloom.config import SessionSettings
from liftloom.operators import conversion
from liftloom.operators.counts import daily_counts
from liftloom.operators.sessions import sessions
from liftloom.session import dropped_after, shared_folder, written
from liftloom.sources import counts_store, pulses
from liftloom.streaming import jobs

DAY = 1_704_067_200_000


def history(n=400, sessions_=5):
    rng = random.Random(2)
    t, rows = DAY, []
    for _ in range(n):
        t += rng.choice([0, 1000, 20_000, 60_000, 400_000, 1_900_000])
        rows.append((t, rng.choice(["EVENT", "GOAL", "ACT", "ATR"]), f"n{rng.randrange(3)}", rng.choice(["", "L0", "ACT#n1"]),
                     rng.choice(["", "local"]), f"s{rng.randrange(sessions_)}", rng.choice(["lab", "standard"]), "p"))
    return rows


def feed(events, folder, cuts, extra=None):
    """Message files that arrive one after the other, each holding one stretch of time, out of order inside."""
    bounds = [events.agg(F.min("ts_ms")).first()[0] + c for c in cuts]
    for low, high in zip([0, *bounds], [*bounds, 2**60]):
        part = events.where((F.col("ts_ms") >= low) & (F.col("ts_ms") < high)).orderBy(F.hash("event_id")).coalesce(1)
        pulses.publish(part, folder)


def last_bell(make_events):
    """One event far in the future, of a project of its own, that lets every session end."""
    return make_events([(DAY + 10**10, "EVENT", "bell", "", "", "bell", "lab", "bell")])


def as_set(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("pane_rows", [3, 500])
def test_counts_of_a_drained_stream(spark, make_events, tmp_path, pane_rows):
    settings = SessionSettings(pane_rows=pane_rows)
    events = make_events(history())
    queue, out, store = (str(tmp_path / n) for n in ("queue", "out", "store"))
    span = 400 * 400_000
    feed(events, queue, [span // 6, span // 3, span // 2])

    def run():
        messages = pulses.stream_messages(spark, queue, files_per_batch=1)
        incoming = pulses.from_messages(messages).where("sound").drop("sound", "raw")
        jobs.start_counts(incoming, settings, out, str(tmp_path / "checkpoint"), drain=True).awaitTermination()

    run()
    early = as_set(counts_store.read_increments(spark, out).agg(F.sum("n")))[0][0]
    pulses.publish(last_bell(make_events), queue)
    run()  # goes on from the checkpoint
    expected = as_set(daily_counts(events, settings))
    got = counts_store.read_increments(spark, out).where("project_id <> 'bell'")
    assert as_set(got) == expected
    assert 0 < early < sum(r[-1] for r in expected)
    jobs.compact(spark, out, store)
    assert as_set(counts_store.read_counts(spark, store).where("project_id <> 'bell'")) == expected


def test_sessions_and_late_rows(spark, make_events, tmp_path):
    settings = SessionSettings()
    rows = history(120)
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    pulses.publish(make_events(rows).coalesce(1), queue)
    pulses.publish(last_bell(make_events).coalesce(1), queue)
    late = make_events([(DAY, "EVENT", "late", "", "", "late", "lab", "p")])
    pulses.publish(late.coalesce(1), queue)
    pulses.publish(make_events([(DAY, "EVENT", "late2", "", "", "late", "lab", "p")]).coalesce(1), queue)
    messages = pulses.stream_messages(spark, queue, files_per_batch=1)
    incoming = pulses.from_messages(messages).where("sound").drop("sound", "raw")
    jobs.start_sessions(incoming, settings, out, str(tmp_path / "checkpoint"), drain=True).awaitTermination()
    got = (
        spark.read.option("basePath", out).parquet(f"{out}/batch_id=*").where("session_id NOT IN ('bell', 'late')")
        .groupBy("project_id", "session_id", "session_start").agg(F.max("end_ms"), F.sum("n_events"))
    )
    assert as_set(got) == as_set(sessions(make_events(rows), settings))
    assert spark.read.parquet(f"{out}/batch_id=*").where("session_id = 'late' AND n_events > 1").count() == 0


def test_sessions_that_look_alike_are_counted_once(spark, make_events, tmp_path, monkeypatch):
    """Copies of sessions add nothing to the rows that a micro-batch counts from, and all of them are counted."""
    settings, one = SessionSettings(), history(200)
    found = []
    for copies in (1, 4):
        sizes = {}

        def recorded(df, name, **more):
            table = written(df, name, **more)
            sizes[name] = sizes.get(name, 0) + table.count()
            return table

        monkeypatch.setattr(jobs, "written", recorded)
        monkeypatch.setattr(conversion, "written", recorded)
        queue, out = str(tmp_path / f"queue{copies}"), str(tmp_path / f"out{copies}")
        pulses.publish(make_events([(*row[:5], f"{row[5]}-{k}", *row[6:]) for row in one for k in range(copies)]), queue)
        pulses.publish(last_bell(make_events), queue)
        incoming = pulses.from_messages(pulses.stream_messages(spark, queue, files_per_batch=100)).where("sound").drop("sound", "raw")
        jobs.start_counts(incoming, settings, out, str(tmp_path / f"checkpoint{copies}"), drain=True).awaitTermination()
        found.append((sizes, as_set(counts_store.read_increments(spark, out).where("project_id <> 'bell'"))))
    (once, counted), (often, counted_often) = found
    assert often == once and min(once[name] for name in ("weights", "together", "pairs")) > 0
    assert counted_often == [(*row[:-1], 4 * row[-1]) for row in counted]


def test_micro_batches_leave_only_increments(spark):
    """Tables written inside a block are gone after it, also after an error; a drained stream leaves none."""
    shared = Path(shared_folder(spark))
    with pytest.raises(ValueError), dropped_after(spark):
        outer = written(spark.range(3), "outer")
        with dropped_after(spark):
            assert written(spark.range(5), "inner").count() == 5
        assert not list(shared.glob("inner-*")) and outer.count() == 3
        raise ValueError
    assert not list(shared.glob("outer-*"))
    kept = written(spark.range(2), "kept")
    before = {p.name for p in shared.iterdir()}
    out = jobs.drained_counts(spark, "/root/testdata/sf0.001", SessionSettings())
    left = {p.name.rsplit("-", 1)[0] for p in shared.iterdir() if p.name not in before}
    assert left <= {"counts", "last"} and out.count() > 0 and kept.count() == 2
