"""The driver's tables in the roles of posts, replies and dimensions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.score import label

#: Event dimension of the catalogue: two inside the data, one at its edge, one outside.
EVENTS = (
    (dt.date(2024, 1, 5), "first strike", "", "military", "high"),
    (dt.date(2024, 1, 12), "talks", "", "diplomacy", "medium"),
    (dt.date(2024, 1, 30), "ceasefire", "", "diplomacy", "high"),
    (dt.date(2025, 6, 1), "later", "", "other", "low"),
)
#: Tracked posts of the catalogue: slug, label, event_date, category, description, match_keyword, post_id.
TRACKED = (
    ("alpha", "Alpha", dt.date(2024, 1, 2), "c", "", "THOUND", None),
    ("beta", "Beta", dt.date(2024, 1, 20), "c", "", "que", None),
    ("gamma", "Gamma", dt.date(2024, 1, 3), "c", "", "no such words here", None),
    ("given", "Given", dt.date(2024, 1, 3), "c", "", None, "777"),
)
SOURCES = ("click", "error", "purchase", "signup", "view", "absent")
KEYWORDS = ("tion", "the", "ing", "ver", "ouqu", "osa", "lich", "ent", "reth")
AS_OF = "2024-06-01 00:00:00"
COLOURS = {"military": "red", "diplomacy": "blue"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored posts; the type is both tier and tracked post."""
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 50))
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_id"), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("tier"), F.col("event_type").alias("tracked_slug"), F.col("ts").alias("created_at"), score.alias("score"), "props")
    return e.withColumn("label", label(F.col("score")))


def posts(spark: SparkSession, sf_dir: str, **made: Column) -> DataFrame:
    """documents as raw posts, with the time of the event of the same number where there is one. *made* are further columns of
    the documents, made before the join, through which texts then need not pass."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("user"), "text", "lang", *(c.alias(n) for n, c in made.items()))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"))
    return d.join(e, "doc_id", "left")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a reply tree: each turn answers the one before, all belong to turn 0."""
    key = lambda t: F.concat_ws(":", F.col("conv_id"), t)
    c = table(spark, sf_dir, "conversations")
    return c.select(key(F.col("turn")).alias("id"), key(F.col("turn") - 1).alias("in_reply_to_id"), key(F.lit(0)).alias("parent_id"), F.col("role").alias("user"), "text")


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a stance by number; one number in eleven is an error."""
    from tidemark.operators.stance import CATEGORIES

    names = F.array(*(F.lit(c) for c in CATEGORIES))
    stance = F.when(F.col("event_id") % 11 == 0, "error").otherwise(F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")))
    return scored(spark, sf_dir).withColumn("stance", stance)


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored posts, those of one type as search rows."""
    s = scored(spark, sf_dir)
    hit = F.col("tier") == "view"
    return s.withColumns({"user": F.when(hit, F.concat(F.lit("search:"), "tier")).otherwise(F.col("user")), "tier": F.when(hit, "search").otherwise(F.col("tier"))})
