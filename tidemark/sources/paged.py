"""Paged sources as Spark data sources: timelines that come page by page, newest first, one partition or more for each source.

A client knows the sources and gives a page for a token, with the token of the next (older) page: a page token of a search API, or a
max_id. The batch reader walks back until it is before *since*, at the cap, or at the end, and skips what is after *until*;
each source is read by a task of its own, or by several where the client can begin at several places of a timeline (LandedPages can)
and there is no cap, so many sources are read at once and a task holds a row at a time.
The stream reader's offset is each source's newest page. Spark keeps the offsets in the checkpoint, and a batch is the pages
between two of them, so after a restart each page is read once.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("client", "package.module:name").option("root", "landed/pages").load()

*client* names a class that is built with the options. LandedPages reads pages that are landed as files (source=.../page=<number>/)
in any file system that Arrow reads; remote APIs take a client of the caller's own with the same methods.
"""

from __future__ import annotations

import functools
import heapq
import importlib
import io
import json
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from typing import Protocol
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Rows of a request: what remote timelines take at least and at most.
LEAST, MOST = 5, 100
#: Rows of a landed file at most, and bytes of landed files that a task reads.
FILE_ROWS, SHARE = 50_000, 16_000_000
#: Folder of a landed run.
RUN = "in_order="
SCHEMA = "source string, id string, created_at string, body string"


class Client(Protocol):
    """A page's rows are dictionaries with id, created_at (ISO-8601, UTC) and anything else, newest first.

    A client that can begin elsewhere than at the newest page may also have shares() and start(), as LandedPages does."""

    def sources(self) -> list[str]: ...

    def page(self, source: str, token: str | None, size: int) -> tuple[list[dict], str | None]:
        """The page at *token* (None: the newest) and the token of the next, None at the end."""

    def newest(self) -> dict[str, int]:
        """The number of each source's newest page, for streams."""

    def numbered(self, source: str, after: int, upto: int) -> Iterator[dict]:
        """Rows of the pages with after < number <= upto, oldest page first, for streams."""


def _later(a: dict, b: dict) -> int:
    """Order of a timeline: newest first, then by id."""
    x, y = (b["created_at"], a["id"]), (a["created_at"], b["id"])
    return (x > y) - (x < y)


NEWEST_FIRST = functools.cmp_to_key(_later)


class _Reading:
    """Rows that are still to come, with a look at the next one."""

    def __init__(self, rows: Iterator[dict]):
        self.rows, self.ahead = rows, next(rows, None)

    def take(self, size: int) -> list[dict]:
        out = []
        while self.ahead is not None and len(out) < size:
            out.append(self.ahead)
            self.ahead = next(self.rows, None)
        return out


class LandedPages:
    """Pages as files: <root>/source=<name>/page=<number>/, JSON with one row a line; higher numbers are newer.

    Each land() adds a run to a page: a folder in_order=<name> whose files are in order, newest row first, and go on in the order of their
    names. Runs are merged as streams, one file of each at a time; a run's files are found by their first rows. Files
    that lie in the page's folder itself may be in any order: a page's are sorted in memory.
    """

    def __init__(self, options: dict[str, str]):
        self.files, self.root = fs.FileSystem.from_uri(options["root"])
        self.share = int(options.get("share", SHARE))
        #: Folder of each source; Spark's writer escapes names as URLs do.
        self.folders = {unquote(name.removeprefix("source=")): name for name in self._names(self.root, "source=")}
        #: Where the last request stopped: a client that goes on from there doesn't read the page again.
        self.reading: tuple[tuple[str, str], _Reading] | None = None

    def _names(self, path: str, prefix: str) -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.startswith(prefix))

    def _pages(self, source: str) -> list[int]:
        folder = self.folders.get(source)
        return sorted(int(n.removeprefix("page=")) for n in self._names(f"{self.root}/{folder}", "page=")) if folder else []

    def _runs(self, source: str, number: int) -> list[tuple[bool, list[fs.FileInfo]]]:
        """The files of a page by run, and whether they are in order."""
        runs: dict[str, list[fs.FileInfo]] = {}
        for f in self.files.get_file_info(fs.FileSelector(f"{self.root}/{self.folders[source]}/page={number}", recursive=True)):
            if f.base_name.endswith(".json") and f.size:
                runs.setdefault(f.path.split("/")[-2], []).append(f)
        # Numbers in names may outgrow their zeros.
        number_in = lambda f: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", f.base_name)]
        return [(at.startswith(RUN), sorted(found, key=number_in)) for at, found in sorted(runs.items())]

    def _lines(self, path: str) -> Iterator[dict]:
        with io.BufferedReader(self.files.open_input_stream(path), 1 << 18) as file:
            for line in file:
                if line != b"\n":
                    yield json.loads(line)

    def _sorted(self, paths: Iterable[str]) -> Iterator[dict]:
        rows = sorted((r for p in paths for r in self._lines(p)), key=lambda r: r["id"])
        return iter(sorted(rows, key=lambda r: r["created_at"], reverse=True))

    def _day(self, rows: Iterator[dict]) -> str:
        return next(rows)["created_at"][:10]

    def _first(self, run: list[fs.FileInfo], until: str | None) -> int:
        """The first file of a run that may hold rows of *until* or before."""
        later = bisect_left(run, True, key=lambda f: self._day(self._lines(f.path)) <= until) if until is not None else 0
        return max(0, later - 1)

    def _behind(self, run: list[fs.FileInfo], since: str | None) -> int:
        """The first file of a run that is all before *since*."""
        return len(run) if since is None else bisect_left(run, True, key=lambda f: self._day(self._lines(f.path)) < since)

    def _rows(self, source: str, number: int, until: str | None = None) -> Iterator[dict]:
        """A page's rows, newest first; files that are all after *until* are left out."""
        streams = []
        for in_order, run in self._runs(source, number):
            if in_order:
                streams.append(chain.from_iterable(self._lines(f.path) for f in run[self._first(run, until) :]))
            else:
                streams.append(self._sorted(f.path for f in run))
        return streams[0] if len(streams) == 1 else heapq.merge(*streams, key=NEWEST_FIRST)

    def _span(self, source: str, pages: list[int], since: str | None, until: str | None) -> tuple[int, int]:
        """The first and last of *pages* that may hold rows of the window; all rows of a page are older than those of the next."""
        day = functools.cache(lambda n: self._day(self._rows(source, n)))
        first = bisect_left(pages, True, key=lambda n: day(n) >= since) if since is not None else 0
        last = bisect_left(pages, True, key=lambda n: day(n) > until) if until is not None else len(pages) - 1
        return first, min(last, len(pages) - 1)

    def sources(self) -> list[str]:
        return list(self.folders)

    def page(self, source: str, token: str | None, size: int) -> tuple[list[dict], str | None]:
        """Tokens are [page number, rows of it that were given, the only file that is read or null, until or null]."""
        if token is None:
            pages = self._pages(source)
            if not pages:
                return [], None
            token = json.dumps([pages[-1], 0, None, None])
        number, given, file, until = json.loads(token)
        if self.reading and self.reading[0] == (source, token):
            reading = self.reading[1]
        else:
            path = f"{self.root}/{self.folders[source]}/{file}"
            rows = self._rows(source, number, until) if file is None else self._lines(path) if f"/{RUN}" in file else self._sorted([path])
            reading = _Reading(islice(rows, given, None))
        rows, self.reading = reading.take(size), None
        if reading.ahead is not None:
            after = json.dumps([number, given + len(rows), file, until])
            self.reading = (source, after), reading
            return rows, after
        older = [n for n in self._pages(source) if n < number] if file is None else []
        return rows, json.dumps([older[-1], 0, None, None]) if older else None

    def start(self, source: str, until: str | None) -> str | None:
        """The token from which rows of *until* and before follow, after a file's rows of later days at most."""
        pages = self._pages(source)
        return json.dumps([pages[self._span(source, pages, None, until)[1]], 0, None, until]) if pages and until is not None else None

    def shares(self, source: str, since: str | None = None, until: str | None = None, after: int = -1, upto: int | None = None) -> list[list[str]]:
        """Tokens of all files that may hold rows of the window (and of the pages after < number <= upto), each of which
        ends with its file, in lists of about the option *share* (bytes): what a task reads."""
        pages = [n for n in self._pages(source) if n > after and (upto is None or n <= upto)]
        first, last = self._span(source, pages, since, until)
        out, size = [], self.share
        for at in range(last, first - 1, -1):
            for in_order, run in self._runs(source, pages[at]):
                if in_order:  # pages within the window are whole
                    run = run[self._first(run, until if at == last else None) : self._behind(run, since if at == first else None)]
                for f in run:
                    if size >= self.share:
                        out.append([])
                        size = 0
                    out[-1].append(json.dumps([pages[at], 0, f.path[len(self.root) + len(self.folders[source]) + 2 :], None]))
                    size += f.size
        return out

    def newest(self) -> dict[str, int]:
        return {s: pages[-1] for s in self.sources() if (pages := self._pages(s))}

    def numbered(self, source: str, after: int, upto: int) -> Iterator[dict]:
        for n in self._pages(source):
            if after < n <= upto:
                yield from self._rows(source, n)


def client_of(options: dict[str, str]) -> Client:
    module, _, name = options.get("client", f"{__name__}:LandedPages").partition(":")
    return getattr(importlib.import_module(module), name)(dict(options))


def shares(client: Client, source: str, since: str | None, until: str | None, cap: int | None) -> list[list[str | None]]:
    """The tokens at which timelines of a source begin that make up its window, in lists for a task each; an empty one where nothing is.

    With a cap, or a client that knows only the next page, it is one timeline, if possible from *until* on."""
    if cap is None and hasattr(client, "shares"):
        return client.shares(source, since, until) or [[]]
    return [[client.start(source, until) if hasattr(client, "start") else None]]


def timeline(client: Client, source: str, since: str | None, until: str | None, cap: int | None, token: str | None = None) -> Iterator[dict]:
    """Rows of a source with since <= day <= until, newest first from *token* on, *cap* at most. The first row before *since* ends it."""
    taken = 0
    while cap is None or taken < cap:
        size = MOST if cap is None else max(LEAST, min(MOST, cap - taken))
        rows, token = client.page(source, token, size)
        for row in rows:
            day = row["created_at"][:10]
            if since is not None and day < since:
                return
            if until is None or day <= until:
                yield row
                taken += 1
                if taken == cap:
                    return
        if token is None:
            return


def record(source: str, row: dict) -> tuple[str, str, str, str]:
    return source, str(row["id"]), row["created_at"], json.dumps(row, ensure_ascii=False, separators=(",", ":"))


class OneSource(InputPartition):
    """A source, or what timelines from *tokens* on give of it."""

    def __init__(self, source: str, tokens: list[str | None] | None = None, after: int = -1, upto: int = -1):
        self.source, self.tokens, self.after, self.upto = source, tokens, after, upto


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.since, self.until, cap = options.get("since"), options.get("until"), options.get("cap")
        self.cap = int(cap) if cap else None

    def partitions(self) -> list[OneSource]:
        client, wanted = client_of(self.options), self.options.get("sources")
        return [OneSource(s, t) for s in (json.loads(wanted) if wanted else client.sources()) for t in shares(client, s, self.since, self.until, self.cap)]

    def read(self, partition: OneSource) -> Iterator[tuple]:
        client = client_of(self.options)
        for token in partition.tokens:
            for row in timeline(client, partition.source, self.since, self.until, self.cap, token):
                yield record(partition.source, row)


class PagedStream(DataSourceStreamReader):
    """Offsets: {source: number of its newest page}. They grow with the sources, not with what was read."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return client_of(self.options).newest()

    def partitions(self, start: dict, end: dict) -> list[OneSource]:
        client, new = client_of(self.options), [(s, start.get(s, -1), n) for s, n in sorted(end.items()) if n > start.get(s, -1)]
        if hasattr(client, "shares"):
            return [OneSource(s, t) for s, after, n in new for t in client.shares(s, after=after, upto=n)]
        return [OneSource(s, None, after, n) for s, after, n in new]

    def read(self, partition: OneSource) -> Iterator[tuple]:
        client = client_of(self.options)
        if partition.tokens is None:
            rows = client.numbered(partition.source, partition.after, partition.upto)
        else:
            rows = chain.from_iterable(timeline(client, partition.source, None, None, None, t) for t in partition.tokens)
        for row in rows:
            yield record(partition.source, row)

    def commit(self, end: dict) -> None:
        """Pages stay where they landed; what was read is in Spark's checkpoint."""


class PagedSource(DataSource):
    """Options: client (package.module:name), since and until (days), cap (rows of a source), sources (a JSON list), and the client's own."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:  # noqa: N802
        return PagedStream(self.options)


def read_pages(spark: SparkSession, stream: bool = False, **options: str) -> DataFrame:
    """source, id, created_at and body (the row as JSON) of paged sources; a streaming frame with *stream*."""
    spark.dataSource.register(PagedSource)
    reader = (spark.readStream if stream else spark.read).format("paged")
    return reader.options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def land(posts: DataFrame, root: str, source: str = "user", page: str = "page") -> None:
    """Write posts as LandedPages reads them: rows of one source and one page number (newer rows have higher ones) are a page.
    Posts without a source are left out."""
    own = [c for c in posts.columns if c not in (source, page)]
    rows = posts.where(F.col(source).cast("string") != "").select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(page).alias("page"), *own)
    # A page's rows may be many: they are dealt out by time, and their files follow each other. The writer sorts by its folders unless
    # rows are so already; that sort need not keep the rest, so the folders come first here.
    order = [F.col("source"), F.col("page"), F.col("in_order"), F.desc("created_at"), F.col("id")]
    run = rows.withColumn("in_order", F.lit(uuid.uuid4().hex)).repartitionByRange(*order).sortWithinPartitions(*order)
    run.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy("source", "page", "in_order").json(root)
