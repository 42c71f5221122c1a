"""Marks of a stream, snapshots under readers, reply trees."""

from __future__ import annotations

import datetime as dt
import random
import threading

import pytest

from tidemark.operators import trees
from tidemark.sources import files
from tidemark.sources.snapshots import Conflict, Snapshots
from tidemark.streaming import ingest, marks


def test_marks_survive_a_restart(spark, tmp_path):
    """The last marks equal those of the whole table, whatever came late, twice or without a time; a row that is older moves nothing."""
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    schema = "user string, created_at string"
    every = []
    for n in range(3):
        rows = [(rng.choice(["a", "b", None, "late"]), rng.choice([None, "bad", (base + dt.timedelta(hours=rng.randrange(500) - (400 if n else 0))).isoformat()])) for _ in range(60)]
        every += rows
        spark.createDataFrame(rows, schema).write.mode("append").json(f"{tmp_path}/in")
        for _ in range(2):  # the second start finds nothing
            stream = ingest.read_posts(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
            marks.drain_marks(marks.high_water_marks(stream), f"{tmp_path}/out", f"{tmp_path}/state")
        got = {r.source: r.latest for r in marks.current_marks(spark, f"{tmp_path}/out").collect()}
        want = {r.user: r.latest for r in files.high_water_mark(spark.createDataFrame(every, schema)).where("user is not null and latest is not null").collect()}
        assert got == want
    rows = spark.read.schema(marks.MARKS).parquet(f"{tmp_path}/out").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r.latest)
    assert all(len(v) == len(set(v)) <= 3 for v in by.values())  # a row only where a mark moved
    assert marks.current_marks(spark, f"{tmp_path}/none").count() == 0


def test_state_and_timer_of_one_source():
    """The function that tasks run: a mark moves forward only, and a silent source is told of once for each wait."""
    import pandas as pd

    class State:
        exists = hasTimedOut = False
        value = None

        def __init__(self):
            self.waits = []

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.value, self.exists = value, True

        def setTimeoutDuration(self, ms):  # noqa: N802
            self.waits.append(ms)

    class Posts:
        """Catches the function."""

        def select(self, *_):
            return self

        where = groupBy = select  # noqa: N815

        def applyInPandasWithState(self, run, *_):  # noqa: N802
            return run

    import unittest.mock as mock

    with mock.patch.object(marks, "F", mock.MagicMock()):
        run = marks.high_water_marks(Posts(), dt.timedelta(hours=1))
    state = State()
    frame = lambda *days: iter([pd.DataFrame({"at": pd.to_datetime(list(days))})])
    (first,) = run(("a",), frame("2024-01-02", "2024-01-01"), state)
    assert first.values.tolist() == [["a", "mark", pd.Timestamp("2024-01-02", tz="UTC")]]
    assert not list(run(("a",), frame("2023-05-05"), state)) and len(list(run(("a",), frame("2024-01-03"), state))) == 1
    state.hasTimedOut = True
    (silent,) = run(("a",), iter([]), state)
    assert silent.values.tolist() == [["a", "silent", pd.Timestamp("2024-01-03", tz="UTC")]] and set(state.waits) == {3_600_000} and len(state.waits) == 4


def test_a_reader_never_misses_the_table(spark, tmp_path):
    """A reader in a loop while versions are published and old ones deleted."""
    book = Snapshots(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        book.read()
    rows = lambda n: spark.range(5).selectExpr(f"{n}L AS version", "id").coalesce(1)
    book.publish(rows(1), None)
    stop, seen, failed = threading.Event(), [], []

    def loop():
        while not stop.is_set():
            try:
                seen.append({r.version for r in Snapshots(spark, f"file://{tmp_path}/t").read().collect()})
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=loop)
    reader.start()
    try:
        for n in range(2, 101):
            assert book.publish(rows(n), None) == n
            if n % 25 == 0:
                book.vacuum(age=60)
    finally:
        stop.set()
        reader.join()
    assert not failed and all(len(v) == 1 for v in seen) and [min(v) for v in seen] == sorted(min(v) for v in seen) and len(seen) > 3
    assert book.version() == 100 and book.vacuum(age=-60) == 99 and {r.version for r in book.read().collect()} == {100}
    assert book.publish(rows(101), None) == 101


def test_stale_writers_are_refused(spark, tmp_path):
    a, b = (Snapshots(spark, f"{tmp_path}/t") for _ in range(2))
    one = spark.range(3).selectExpr("id", "id AS created_at")
    assert a.publish(one, expected=0) == 1 and b.publish(one, expected=1) == 2
    with pytest.raises(Conflict):
        a.publish(one, expected=1)
    assert a.version() == 2 and a.read(1).count() == 3
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2  # the refused one is gone


def brute(rows):
    up = {}
    for i, p in rows:
        if i is not None:
            up.setdefault(i, []).append(p)
    up = {i: None if None in ps else min(ps) for i, ps in up.items()}
    out = []
    for i in up:
        at, depth, seen = i, 0, set()
        while True:
            if at not in up:
                out.append((i, at, depth, "orphan"))
            elif up[at] is None:
                out.append((i, at, depth, "rooted"))
            elif at in seen:
                out.append((i, None, None, "cycle"))
            else:
                seen.add(at)
                at, depth = up[at], depth + 1
                continue
            break
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_reply_trees(spark, seed):
    rng = random.Random(seed)
    rows = [("r", None), ("self", "self"), (None, "r"), ("x", "gone"), ("twice", "r"), ("twice", "x"), ("both", None), ("both", "x"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d")]
    rows += [(f"n{i}", f"n{rng.randrange(i)}" if i and rng.random() < 0.95 else rng.choice([None, "gone"])) for i in range(150)]
    rows += [(f"l{i}", f"l{i - 1}" if i else "r") for i in range(70)]
    df = spark.createDataFrame(rows, "id string, in_reply_to_id string")
    assert sorted((tuple(r) for r in trees.reply_trees(df).collect()), key=str) == brute(rows)


def test_no_replies(spark):
    assert trees.reply_trees(spark.createDataFrame([], "id string, in_reply_to_id string")).count() == 0
