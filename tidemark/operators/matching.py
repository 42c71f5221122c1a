"""Tracked posts to their ids: keyword search and the nearest date.

Keywords are searched all at once: each task holds an automaton of them and reads a text once, however many there are. Their matches
meet the tracked posts by an equi-join on the keyword's number. The nearest match is found by order: matches become one row for
each keyword and day, both sides are sorted by day, and each tracked post takes the last day before and the first day after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import has_keyword
from tidemark.sources.dims import small

FAR = 10**9
#: Most keywords of one automaton: bounds what tasks hold and the driver sends. More are searched in several passes.
KEYWORDS = 200_000


def keyword_match(posts: DataFrame, keyword: str) -> DataFrame:
    return posts.where(has_keyword(F.col("text"), F.lit(keyword)))


@lru_cache(maxsize=4)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, i)
    out.make_automaton()
    return out


def _searched(posts: DataFrame, words: list[str], first: int) -> DataFrame:
    """posts with number: one row for each of *words* (lower case) that the text holds; numbers go up from *first*."""
    held = tuple(w for w in words if w)
    numbers = tuple(first + i for i, w in enumerate(words) if w)
    blank = [first + i for i, w in enumerate(words) if not w]  # every text holds the empty word

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(held) if held else None
        for texts in parts:
            yield pd.Series([sorted({numbers[i] for _, i in automaton.iter(t)} if automaton else ()) + blank if t is not None else [] for t in texts], dtype=object)

    return posts.withColumn("number", F.explode(run(F.lower("text"))))


def search(posts: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(posts with number, (number, keyword)): one row for each post and keyword that its text holds, whatever its case.

    *keywords* has a column keyword; null ones match nothing. Posts are read once for each KEYWORDS keywords.
    """
    spark = posts.sparkSession
    words = keywords.select(F.lower("keyword").alias("keyword")).where("keyword is not null").distinct()
    shards = max(1, -(-words.count() // KEYWORDS))
    out, known, first = None, [], 0
    for i in range(shards):
        own = [r[0] for r in words.where(F.pmod(F.xxhash64("keyword"), F.lit(shards)) == i).orderBy("keyword").collect()]
        found = _searched(posts, own, first)
        out = found if out is None else out.unionByName(found)
        known += enumerate(own, first)
        first += len(own)
    schema = T.StructType([T.StructField("number", T.IntegerType()), T.StructField("keyword", T.StringType())])
    return out, spark.createDataFrame(known, schema)


def nearest(events: DataFrame, hits: DataFrame, key: str, day: str, order: tuple[str, ...]) -> DataFrame:
    """Each event with found and n_matches: the id of the hit of its *key* whose day is nearest, and how many hits there are.

    *events*: key, day, other columns; *hits*: key, day, id and *order*. Ties go by *order*, whichever side they are on; hits without a
    day are farthest, and for an event without one all hits are equally far. Hits become a row for each key and day before the
    shuffle; both sides are then sorted once in each direction, and each event takes the last row of the other side.
    """
    best = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col("id").alias("id"))
    days = hits.groupBy(key, F.col(day).alias("_day")).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    whole = days.groupBy(key).agg(F.min("best").alias("any"), F.min(F.when(F.col("_day").isNull(), F.col("best"))).alias("undated"), F.sum("n").alias("n_matches"))
    own = [c for c in events.columns if c != key]
    left = days.where("_day is not null").select(key, "_day", F.lit(0).alias("_side"), F.struct(F.col("_day").alias("d"), "best").alias("hit"), *(F.lit(None).cast(events.schema[c].dataType).alias(c) for c in own))
    right = events.select(key, F.col(day).alias("_day"), F.lit(1).alias("_side"), F.lit(None).cast(left.schema["hit"].dataType).alias("hit"), *own)
    both = left.unionByName(right)
    run = Window.partitionBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("before", F.last("hit", ignorenulls=True).over(run.orderBy("_day", "_side")))
    both = both.withColumn("after", F.last("hit", ignorenulls=True).over(run.orderBy(F.col("_day").desc(), "_side")))
    far = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.datediff("_day", f"{side}.d")).alias("dist"), F.col(f"{side}.best").alias("best")))
    near = F.when(F.col("_day").isNotNull(), F.least(far("before"), far("after")))
    out = both.where("_side = 1").join(whole, key, "left")
    found = F.when(F.col("_day").isNull(), F.col("any")).otherwise(F.coalesce(near["best"], F.col("undated")))
    return out.select(key, *own, found["id"].alias("found"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def resolve(tracked: DataFrame, posts: DataFrame, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """slug, post_id, n_matches: the given id, or that of the match nearest to the event's date.

    Posts without a readable date are farthest; ties go by *order*.
    """
    open_ = tracked.where("post_id is null and match_keyword is not null").select("slug", "event_date", F.lower("match_keyword").alias("keyword"))
    day = F.to_date(F.try_to_timestamp(F.col("created_at").cast("string")))
    rows = posts.select("text", day.alias("event_date"), *dict.fromkeys(("id", *order)))
    hits, numbers = search(rows, open_)
    events = open_.join(small(numbers), "keyword").select("slug", "event_date", "number")
    best = nearest(events, hits.drop("text"), "number", "event_date", order)
    return tracked.join(best.select("slug", "found", "n_matches"), "slug", "left").select("slug", F.coalesce("post_id", "found").alias("post_id"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
