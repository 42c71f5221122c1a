"""An append-only ledger of what was fetched: source, window, outcome and attempts.

A run fetches the open windows, each in a task of its own or in several (the client's shares of it), and commits its posts and outcomes in one step: a folder that is
written aside and then moved into place. A run that breaks off leaves nothing behind, one that is tried again under its name does nothing.
A window is done once a run collected rows for it. An empty answer is not taken for a collected window (a blocked or
rate-limited source looks like that), and neither is a failed one; both stay open and count 0 rows, and no source's failure ends the run.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import written
from tidemark.sources.files import exists
from tidemark.sources.paged import client_of, record, shares, timeline
from tidemark.sources.sinks import _files

#: What a window came to.
COLLECTED, EMPTY, FAILED = "collected", "empty", "failed"
WINDOW = ("source", "since", "until")
ROWS = "source string, since string, until string, state string, error string, n long, id string, created_at string, body string"
#: Most tasks of a run.
TASKS = 10_000
ATTEMPTS = "run string, source string, since string, until string, state string, error string, n long"


def fetched(windows: DataFrame, options: dict[str, str], cap: int | None = None) -> DataFrame:
    """ROWS: posts of windows (state null), and the outcome of each share of a window. Posts of a window that failed half way are to be dropped."""
    options = dict(options)
    columns = [f.split()[0] for f in ROWS.split(", ")]

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for part in parts:
            for source, since, until in part[list(WINDOW)].itertuples(index=False):
                found, error = [[]], None
                try:
                    client = client or client_of(options)
                    found = shares(client, source, since, until, cap)
                except Exception as e:  # noqa: BLE001  one source must not end the run
                    error = _told(e)
                yield pd.DataFrame([(source, since, until, json.dumps(tokens), error) for tokens in found], columns=[*WINDOW, "tokens", "error"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for part in parts:
            for source, since, until, tokens, error in part[[*WINDOW, "tokens", "error"]].itertuples(index=False):
                n, rows = 0, []
                try:
                    client = client or client_of(options)
                    for token in json.loads(tokens):
                        for row in timeline(client, source, since, until, cap, token):
                            rows.append((source, since, until, None, None, None, *record(source, row)[1:]))
                            n += 1
                            if len(rows) == 1000:
                                yield pd.DataFrame(rows, columns=columns)
                                rows = []
                except Exception as e:  # noqa: BLE001
                    error = error or _told(e)
                state = FAILED if error else COLLECTED if n else EMPTY
                rows.append((source, since, until, state, error, 0 if error else n, None, None, None))
                yield pd.DataFrame(rows, columns=columns)

    # Windows and shares are few bytes and much work. Spark would put them into few tasks if it chose the number.
    spark = windows.sparkSession
    keyed = windows.select(*(F.col(c).cast("string").alias(c) for c in WINDOW)).distinct()
    listed = keyed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(deal, "source string, since string, until string, tokens string, error string")
    dealt = written(listed, "ledger-shares")
    return dealt.repartition(max(1, min(dealt.count(), TASKS))).mapInPandas(run, ROWS)


def _told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


class Ledger:
    """A folder with one subfolder for each run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        if not exists(self.spark, f"{self.path}/run=*"):
            return self.spark.createDataFrame([], "run string, " + ROWS)
        # Names that look like numbers stay as they are.
        return self.spark.read.schema(ROWS + ", run string").parquet(self.path).select("run", *(f.split()[0] for f in ROWS.split(", ")))

    def attempts(self) -> DataFrame:
        """ATTEMPTS: one row for each window that a run fetched. It failed if a share of it did."""
        told = self._rows().where("state is not null").groupBy("run", *WINDOW)
        told = told.agg(F.max(F.col("state") == FAILED).alias("failed"), F.min("error").alias("error"), F.sum("n").alias("n"))
        state = F.when(F.col("failed"), FAILED).when(F.col("n") > 0, COLLECTED).otherwise(EMPTY)
        rows = told.withColumns({"state": state, "n": F.when(F.col("failed"), 0).otherwise(F.col("n"))})
        return rows.select(*(f.split()[0] for f in ATTEMPTS.split(", ")))

    def status(self, windows: DataFrame) -> DataFrame:
        """Each window with its state (the last but 'collected' if any was; null: never fetched), tries and rows."""
        keyed = windows.select(*(F.col(c).cast("string").alias(c) for c in WINDOW)).distinct()
        best = F.max_by("state", F.struct((F.col("state") == COLLECTED).alias("done"), "run"))
        told = self.attempts().groupBy(*WINDOW).agg(best.alias("state"), F.count("*").alias("tries"), F.max("n").alias("n"))
        return keyed.join(told, list(WINDOW), "left").select(*WINDOW, "state", F.coalesce("tries", F.lit(0)).alias("tries"), F.coalesce("n", F.lit(0)).alias("n"))

    def open_windows(self, windows: DataFrame) -> DataFrame:
        """Windows that no run has collected."""
        done = self.attempts().where(F.col("state") == COLLECTED).select(*WINDOW).distinct()
        keyed = windows.select(*(F.col(c).cast("string").alias(c) for c in WINDOW)).distinct()
        return keyed.join(done, list(WINDOW), "left_anti")

    def run(self, name: str, windows: DataFrame, options: dict[str, str], cap: int | None = None, force: bool = False) -> DataFrame:
        """Fetch what is open (with *force* all) under a run's name and return its outcomes; done before, it only returns them."""
        target = f"{self.path}/run={name}"
        if not exists(self.spark, f"{target}/_SUCCESS"):
            fs, at = _files(self.spark, target)
            aside = f"{self.path}.{name}.writing"
            fetched(windows if force else self.open_windows(windows), options, cap).write.mode("overwrite").parquet(aside)
            fs.mkdirs(at(self.path))
            if not fs.rename(at(aside), at(target)) or not exists(self.spark, f"{target}/_SUCCESS"):
                raise OSError(f"run {name} was committed by another process")
        return self.attempts().where(F.col("run") == name)

    def posts(self) -> DataFrame:
        """source, id, created_at, body of all windows that were collected; the first run's row of each source and id stays."""
        done = self.attempts().where(F.col("state") == COLLECTED).select("run", *WINDOW)
        kept = self._rows().where("state is null").join(done, ["run", *WINDOW], "left_semi")
        first = kept.groupBy("source", "id").agg(F.min(F.struct("run", "since", "until", "created_at", "body")).alias("r"))
        return first.select("source", "id", "r.created_at", "r.body")


def windows_of(spark: SparkSession, sources: list[str], since: str, until: str) -> DataFrame:
    return spark.createDataFrame([(s, since, until) for s in sources], "source string, since string, until string")


def body_field(name: str):
    """A field of a row's JSON."""
    return F.get_json_object("body", f"$.{json.dumps(name)[1:-1]}")
