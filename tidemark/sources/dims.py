"""Small dimensions from the user: accounts by tier, events, tracked posts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import ACCOUNT_DIM, EVENT_DIM, TRACKED_DIM

#: Rows up to which a dimension is broadcast; above it Spark joins by shuffle.
SMALL = 10_000


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """With a broadcast hint if it has at most *limit* rows, which is counted."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def accounts(spark: SparkSession, tiers: Mapping[str, Sequence[str]], platform: str = "x") -> DataFrame:
    return spark.createDataFrame([(platform, t, h) for t, handles in tiers.items() for h in handles], ACCOUNT_DIM)


def flatten_accounts(nested: DataFrame) -> DataFrame:
    """(tier, handle) from a column *tiers* of map<string, array<string>>."""
    return nested.select(F.explode("tiers").alias("tier", "handles")).select("tier", F.explode("handles").alias("handle"))


def events(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), EVENT_DIM)


def tracked(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), TRACKED_DIM)


def event_markers(events: DataFrame, since: str, until: str, colours: Mapping[str, str], default: str = "gray") -> DataFrame:
    """Events inside the analysis window with their category's colour."""
    table = F.create_map(*(F.lit(x) for kv in colours.items() for x in kv)) if colours else None
    colour = F.coalesce(F.try_element_at(table, F.col("category")), F.lit(default)) if colours else F.lit(default)
    return events.where(F.col("date").between(F.lit(since).cast("date"), F.lit(until).cast("date"))).select("date", "label", "category", colour.alias("colour"))
