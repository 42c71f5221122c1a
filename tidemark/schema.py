"""Explicit schemas: nothing is inferred, every score column is always there and nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


KINDS = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "counts": T.MapType(T.StringType(), T.LongType())}


def _struct(text: str) -> T.StructType:
    """A struct from "name kind, ..." that needs no session, unlike DDL."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (f.split() for f in text.split(", "))])


POST = _struct("id string, user string, author_id string, tier string, text string, created_at string, metrics counts, lang string, platform string, source string")
ACCOUNT = _struct("id string, username string, display_name string, bio string, created_at string, followers_count bigint, following_count bigint, statuses_count bigint, verified boolean")
REPLY = T.StructType([*POST, *_struct("parent_id string, in_reply_to_id string, tracked_slug string"), T.StructField("account", ACCOUNT)])
SCORES = _struct("score_vader double, label_vader string, score_transformer double, label_transformer string, score_llm double, label_llm string, empty_text boolean")
EVENT_DIM = _struct("date date, label string, description string, category string, impact string")
TRACKED_DIM = _struct("slug string, label string, event_date date, category string, description string, match_keyword string, post_id string")
ACCOUNT_DIM = _struct("platform string, tier string, handle string")

#: Score and label columns from the most to the least preferred. Fixed values of the data model.
SCORE_COLUMNS = ("score_llm", "score_transformer", "score_vader")
LABEL_COLUMNS = ("label_llm", "label_transformer", "label_vader")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """*df* with all columns of *schema*: missing ones are null, NaN counts as null; other columns stay behind."""

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        return (F.when(F.isnan(c), None).otherwise(c) if isinstance(f.dataType, T.DoubleType) else c).alias(f.name)

    return df.select(*map(column, schema.fields))


def scored_schema(base: T.StructType = POST) -> T.StructType:
    """*base* with a real timestamp and the score columns."""
    fields = [T.StructField("created_at", T.TimestampType()) if f.name == "created_at" else f for f in base]
    return T.StructType([*fields, *SCORES])
