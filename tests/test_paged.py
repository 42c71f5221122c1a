"""Paged sources and their ledger against filters and caps on the same rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ledger, paged
from tidemark.sources.paged import LandedPages, timeline

POSTS = "id string, user string, created_at string, page long, text string"


def made(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = rng.randrange(1, 29)
        user = rng.choice(["ann", "ann", "b o/b", "=%é", "one"]) if i else "single"
        rows.append((f"{i:04d}", user, f"2024-01-{day:02d}T{rng.randrange(24):02d}:00:00Z", day, f"text {i}\nline"))
    return rows


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('pages')}/x"
    paged.land(spark.createDataFrame(made(), POSTS), root)
    return root


def brute(rows, since, until, cap):
    out = set()
    for user in {r[1] for r in rows}:
        own = sorted(sorted((r for r in rows if r[1] == user and since <= r[2][:10] <= until)), key=lambda r: r[2], reverse=True)
        out |= {(user, r[0]) for r in own[:cap]}
    return out


@pytest.mark.parametrize(("since", "until", "cap"), [("2024-01-05", "2024-01-20", None), ("2024-01-01", "2024-01-31", 7), ("2024-01-10", "2024-01-12", 150), ("2025-01-01", "2025-01-02", 3)])
def test_batch_equals_filter_and_cap(spark, landed, since, until, cap):
    df = paged.read_pages(spark, root=landed, since=since, until=until, cap=cap)
    rows = df.collect()
    assert {(r.source, r.id) for r in rows} == brute(made(), since, until, cap) and len(rows) == len({(r.source, r.id) for r in rows})
    assert df.rdd.getNumPartitions() == 5  # a source each
    text = {r[0]: r[4] for r in made()}
    assert all(text[r.id] == t for r, t in zip(rows, [x[0] for x in df.select(F.get_json_object("body", "$.text")).collect()], strict=True))


def test_pages_behind_the_window_are_not_read():
    class Counting:
        """Pages of ten rows, one a day, with a page token."""

        def __init__(self):
            self.asked = []

        def page(self, source, token, size):
            self.asked.append((token, size))
            n = int(token or 0)
            return [{"id": str(n * 10 + i), "created_at": f"2024-01-{30 - n:02d}T{23 - i:02d}:00:00Z"} for i in range(min(10, size))], str(n + 1)

    c = Counting()
    assert len(list(timeline(c, "s", "2024-01-28", "2024-01-29", None))) == 20 and [t for t, _ in c.asked] == [None, "1", "2", "3"]
    c = Counting()
    assert len(list(timeline(c, "s", None, None, 12))) == 12 and c.asked == [(None, 12), ("1", 5)]
    c = Counting()
    assert [r["id"] for r in timeline(c, "s", None, None, 3)] == ["0", "1", "2"] and c.asked == [(None, 5)]


def test_tokens_within_a_page(spark, tmp_path):
    root = f"file://{tmp_path}/p"
    paged.land(spark.createDataFrame([(f"{i:03d}", "u", "2024-01-01T00:00:00Z", 1, "") for i in range(250)], POSTS), root)
    client = LandedPages({"root": root})
    rows, token = client.page("u", None, 100)
    more, last = client.page("u", token, 100)
    assert len(rows) == len(more) == 100 and len(client.page("u", last, 100)[0]) == 50 and client.page("u", last, 100)[1] is None
    assert client.page("nobody", None, 5) == ([], None) and not LandedPages({"root": f"file://{tmp_path}/none"}).sources()


def test_stream_reads_each_page_once(spark, tmp_path):
    """Pages land between two runs of one checkpoint; a third run finds nothing."""
    root, out, state = f"file://{tmp_path}/pages", str(tmp_path / "out"), str(tmp_path / "state")
    rows = made(120, 4)

    def drain():
        stream = paged.read_pages(spark, stream=True, root=root)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return Counter((r.source, r.id) for r in spark.read.parquet(out).collect())

    for upto in (10, 20, 31, 31):
        paged.land(spark.createDataFrame([r for r in rows if upto - 10 <= r[3] < upto and upto < 31 or upto == 31 and r[3] >= 20 and not (tmp_path / "done").exists()] or [], POSTS), root)
        if upto == 31:
            (tmp_path / "done").touch()
        got = drain()
        assert set(got.values()) <= {1}
    assert set(got) == {(r[1], r[0]) for r in rows}


class Flaky(LandedPages):
    """Fails half way for one source, answers another with nothing, until a file says otherwise."""

    def __init__(self, options):
        super().__init__(options)
        self.well = options["well"] == "yes"

    def page(self, source, token, size):
        if not self.well and source == "ann" and token:
            raise TimeoutError("gone")
        if not self.well and source == "one":
            return [], None
        return super().page(source, token, 20)


def test_ledger(spark, landed, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    windows = ledger.windows_of(spark, ["ann", "b o/b", "one", "nobody"], "2024-01-01", "2024-01-31")
    options = {"client": "tests.test_paged:Flaky", "root": landed, "well": "no"}
    size = Counter(r[1] for r in made())
    first = {r.source: (r.state, r.n, r.error) for r in book.run("a", windows, options).collect()}
    assert first == {"ann": ("failed", 0, "TimeoutError: gone"), "b o/b": ("collected", size["b o/b"], None), "one": ("empty", 0, None), "nobody": ("empty", 0, None)}
    assert {r.source for r in book.posts().collect()} == {"b o/b"}  # what a failed source gave goes
    assert {r.source for r in book.open_windows(windows).collect()} == {"ann", "one", "nobody"}  # empty is not collected
    assert {r.source: (r.state, r.n) for r in book.run("a", windows, {**options, "well": "yes"}).collect()} == {k: v[:2] for k, v in first.items()}  # the same run again
    second = {r.source: (r.state, r.n) for r in book.run("b", windows, {**options, "well": "yes"}).collect()}
    assert second == {"ann": ("collected", size["ann"]), "one": ("collected", size["one"]), "nobody": ("empty", 0)}
    got = Counter((r.source, r.id) for r in book.posts().collect())
    assert set(got.values()) == {1} and set(got) == {(r[1], r[0]) for r in made() if r[1] in ("ann", "one", "b o/b")}
    assert {r.source: (r.state, r.tries, r.n) for r in book.status(windows).collect()} == {"ann": ("collected", 2, size["ann"]), "one": ("collected", 2, size["one"]), "b o/b": ("collected", 1, size["b o/b"]), "nobody": ("empty", 2, 0)}
    assert book.run("c", windows, options, force=True).count() == 4


def test_a_broken_run_leaves_nothing(spark, landed, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    windows = ledger.windows_of(spark, ["ann"], "2024-01-01", "2024-01-31")
    real = ledger._files

    def broken(*a):
        raise OSError("stopped")

    monkeypatch.setattr(ledger, "_files", lambda *a: broken())
    with pytest.raises(OSError):
        book.run("a", windows, {"root": landed})
    monkeypatch.setattr(ledger, "_files", real)
    assert book.attempts().count() == 0 and book.posts().count() == 0
    assert [r.state for r in book.run("a", windows, {"root": landed}).collect()] == ["collected"]


def parsed(monkeypatch):
    """Counts the lines that are read."""
    lines, real = [], paged.json.loads

    def loads(s, *a, **k):
        lines.append(s)
        return real(s, *a, **k)

    monkeypatch.setattr(paged.json, "loads", loads)
    return lambda: sum(b"created_at" in x if isinstance(x, bytes) else "created_at" in x for x in lines)


def test_a_page_of_many_requests_is_read_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/p"
    paged.land(spark.createDataFrame([(f"{i:04d}", "u", f"2024-01-01T{i % 24:02d}:00:00Z", 1, "") for i in range(2000)], POSTS), root)
    count = parsed(monkeypatch)
    rows = list(timeline(LandedPages({"root": root}), "u", None, None, None))
    assert [r["id"] for r in rows] == [r["id"] for r in sorted(sorted(rows, key=lambda r: r["id"]), key=lambda r: r["created_at"], reverse=True)]
    assert len({r["id"] for r in rows}) == 2000 and count() < 3000


def test_shares_of_a_source_make_up_its_window(spark, tmp_path, monkeypatch):
    """Several runs and a file in no order, in files of few rows: each row of the window in one share, none lost."""
    monkeypatch.setattr(paged, "FILE_ROWS", 7)
    root, rows = f"file://{tmp_path}/p", made(600, 3)
    rows = [(i, "u", t, page // 9, x) for i, _, t, page, x in rows]
    for part in (rows[:250], rows[250:500]):
        paged.land(spark.createDataFrame(part, POSTS), root)
    for page in {r[3] for r in rows[500:]}:
        own = [paged.json.dumps({"id": r[0], "created_at": r[2], "text": r[4]}) for r in rows[500:] if r[3] == page]
        (tmp_path / "p" / "source=u" / f"page={page}" / "other.json").write_text("\n".join(own) + "\n\n")
    client = LandedPages({"root": root, "share": "2000"})
    for since, until in ((None, None), ("2024-01-05", "2024-01-20"), ("2024-01-09", "2024-01-09"), ("2023-01-01", "2023-01-02"), ("2025-01-01", "2025-01-02"), (None, "2024-01-18"), ("2024-01-18", None)):
        want = [r for r in rows if (since or "") <= r[2][:10] <= (until or "9")]
        shares = client.shares("u", since, until)
        got = [r["id"] for tokens in shares for t in tokens for r in timeline(client, "u", since, until, None, t)]
        assert sorted(got) == sorted(r[0] for r in want)
        assert len(shares) > 3 or len(want) < 60
        order = [r[0] for r in sorted(sorted(want), key=lambda r: r[2], reverse=True)]
        assert [r["id"] for r in timeline(client, "u", since, until, None)] == order
        assert [r["id"] for r in timeline(client, "u", since, until, 9, client.start("u", until))] == order[:9]
    df = paged.read_pages(spark, root=root, since="2024-01-05", until="2024-01-20", cap=11)
    assert {(r.source, r.id) for r in df.collect()} == brute(rows, "2024-01-05", "2024-01-20", 11)


def test_ledger_shares(spark, tmp_path, monkeypatch):
    """A window in many shares is one attempt; where a share fails, the window fails and its posts go."""
    monkeypatch.setattr(paged, "FILE_ROWS", 50)
    root = f"file://{tmp_path}/p"
    paged.land(spark.createDataFrame([(f"{i:04d}", u, "2024-01-01T00:00:00Z", 1, "") for i in range(1000) for u in ("a", "b")], POSTS), root)
    # One share of b can't be read.
    bad = sorted((tmp_path / "p" / "source=b").rglob("*.json"))[-1]
    bad.write_text("{broken\n")
    (bad.parent / f".{bad.name}.crc").unlink(missing_ok=True)
    options = {"root": root, "share": "1000"}
    windows = ledger.windows_of(spark, ["a", "b"], "2024-01-01", "2024-01-31")
    rows = ledger.fetched(windows, options)
    assert rows.rdd.getNumPartitions() > 20  # what is few bytes isn't put into few tasks
    book = ledger.Ledger(spark, str(tmp_path / "book"))
    told = {r.source: (r.state, r.n) for r in book.run("one", windows, options).collect()}
    assert told == {"a": ("collected", 1000), "b": ("failed", 0)}
    assert Counter(r.source for r in book.posts().collect()) == {"a": 1000}
    assert {r.source: r.tries for r in book.status(windows).collect()} == {"a": 1, "b": 1}
    assert [r.source for r in book.open_windows(windows).collect()] == ["b"]


def test_a_capped_window_begins_at_its_end(spark, tmp_path, monkeypatch):
    """Days after the window are not read through, within a page neither."""
    monkeypatch.setattr(paged, "FILE_ROWS", 50)
    root = f"file://{tmp_path}/p"
    rows = [(f"{i:04d}", "u", f"2024-01-{1 + i // 100:02d}T00:00:00Z", i // 1000, "") for i in range(2000)]
    paged.land(spark.createDataFrame(rows, POSTS), root)
    count = parsed(monkeypatch)
    reader = paged.PagedReader({"root": root, "since": "2024-01-02", "until": "2024-01-06", "cap": "20"})
    got = [r[1] for p in reader.partitions() for r in reader.read(p)]
    assert got == [f"{i:04d}" for i in range(500, 520)] and count() < 200
