"""High-water marks of sources as keyed state of a stream, with the lateness floor, gaps and a timer for silent sources."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.time import fetch_end, fetch_gap, next_fetch_start
from tidemark.sources.files import exists

#: Microseconds since 1970 are the state: one number for each source, however much it posts.
STATE = "latest long"
MARKS = "source string, kind string, latest timestamp"
EPOCH = pd.Timestamp(0, tz="UTC")


def _micros(x: pd.Timestamp) -> int:
    return int((x.tz_localize("UTC") if x.tzinfo is None else x.tz_convert("UTC")).value // 1000)


def _row(source: str, kind: str, latest: int) -> pd.DataFrame:
    return pd.DataFrame({"source": [source], "kind": [kind], "latest": pd.to_datetime([latest], unit="us", utc=True)})


def high_water_marks(posts: DataFrame, quiet: dt.timedelta | None = None, key: str = "user", time: str = "created_at") -> DataFrame:
    """MARKS of a stream of posts: a row 'mark' for each source whose newest time has moved, and with *quiet* a row 'silent' for one that
    brought nothing for so long (processing time): before its window falls behind the lateness floor, say after six days of seven.

    *quiet* is for streams that run on: Spark never ends a run of what is available while timers are set. State is a number for each source and is never dropped: a mark that was forgotten would fetch the whole window anew.
    """
    wait = int(quiet.total_seconds() * 1000) if quiet else 0

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (source,) = group
        old = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.setTimeoutDuration(wait)
            yield _row(source, "silent", old)
            return
        seen = [part["at"].max() for part in parts]
        new = max((_micros(x) for x in seen if not pd.isna(x)), default=None)
        if wait:
            state.setTimeoutDuration(wait)
        if new is not None and (old is None or new > old):
            state.update((new,))
            yield _row(source, "mark", new)

    # Only the two columns that are needed are shuffled, and rows without a readable time or a source not at all.
    at = F.try_to_timestamp(F.col(time).cast("string"))
    rows = posts.select(F.col(key).cast("string").alias("source"), at.alias("at")).where("source is not null and at is not null")
    return rows.groupBy("source").applyInPandasWithState(run, MARKS, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout)


def drain_marks(marks: DataFrame, path: str, checkpoint: str) -> None:
    """Write the updates that are there (of marks without timers), a folder for each batch; a batch that is retried replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    marks.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_marks(spark: SparkSession, path: str) -> DataFrame:
    """source, latest: the last mark of each source; batches are added up, so folders may be read in any order."""
    if not exists(spark, f"{path}/batch=*"):
        return spark.createDataFrame([], "source string, latest timestamp")
    return spark.read.schema(MARKS).parquet(path).where("kind = 'mark'").groupBy("source").agg(F.max("latest").alias("latest"))


def next_fetches(marks: DataFrame, now) -> DataFrame:
    """source, latest, start, stop, gap: where the next read of each source begins and ends, and the seconds before it that no read reaches."""
    return marks.select("source", "latest", next_fetch_start(F.col("latest"), now).alias("start"), fetch_end(now).alias("stop"), fetch_gap(F.col("latest"), now).alias("gap"))
