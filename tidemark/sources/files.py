"""Landed files as DataFrames: JSONL of posts and replies, Parquet of scored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import POST, REPLY, conform

REPLIES = "replies_"


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything under the path (globs allowed), in whatever file system it is?"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = POST, bad_lines: str = "fail", ordered: bool = False) -> DataFrame:
    """JSON lines with an explicit schema. Blank lines are skipped; corrupt ones raise ("fail") or go ("drop"). A
    missing path is an empty frame. *ordered* adds file, block and line, a total order over the files' lines."""
    if not exists(spark, path):
        out = spark.createDataFrame([], schema)
        return out.selectExpr("*", "'' AS file", "0L AS block", "0L AS line") if ordered else out
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED"}[bad_lines]
    df = spark.read.schema(schema).option("mode", mode).json(path)
    if not ordered:
        return df
    return df.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def first_wins(df: DataFrame, key: str = "id", order: tuple[str, ...] = ("file", "block", "line")) -> DataFrame:
    """The first row of each key in the given order; rows without a key go.

    min_by of the row's struct is a partial aggregate: each task sorts its own rows by key (structs have no hash
    aggregate) and shuffles one row per key, however often a key repeats, where a window would shuffle all.
    """
    names = [c for c in df.columns if c not in order]
    rows = df.where(F.col(key).isNotNull())
    if isinstance(df.schema[key].dataType, T.StringType):
        rows = rows.where(F.col(key) != "")
    best = rows.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("row"))
    return best.select("row.*")


def load_posts(spark: SparkSession, folder: str, replies: bool = False, bad_lines: str = "fail") -> DataFrame:
    """All cached posts of a folder, reply files left out, deduplicated by id in file and line order."""
    rows = read_jsonl(spark, f"{folder}/*.jsonl", POST, bad_lines, ordered=True)
    if not replies:
        rows = rows.where(~F.startswith("file", F.lit(REPLIES)))
    return first_wins(rows)


def load_replies(spark: SparkSession, folder: str, slug: str | None = None, unique: bool = False) -> DataFrame:
    """Replies of one tracked post or of all, each with the slug of its file; *unique* keeps one per slug and id."""
    rows = read_jsonl(spark, f"{folder}/{REPLIES}{slug or '*'}.jsonl", REPLY, ordered=True)
    rows = rows.withColumn("tracked_slug", F.regexp_extract("file", rf"^{REPLIES}(.*)\.jsonl$", 1))
    if unique:
        rows = rows.withColumn("_key", F.concat_ws("\x1f", "tracked_slug", "id"))
        return first_wins(rows.where("id is not null and id <> ''"), "_key").drop("_key")
    return rows.drop("file", "block", "line")


def direct_replies(replies: DataFrame) -> DataFrame:
    return replies.where(F.col("in_reply_to_id") == F.col("parent_id"))


def reply_record(status: DataFrame, parent_id: str, platform: str) -> DataFrame:
    """Raw statuses with a nested account as reply rows: flattened, renamed, with null-safe counts."""
    metric = lambda k: F.coalesce(F.col(f"{k}_count").cast("long"), F.lit(0))
    return conform(
        status.select(
            "id", F.col("account.username").alias("user"), F.col("content").alias("text"), "created_at",
            F.create_map(*(x for k in ("reblogs", "favourites", "replies") for x in (F.lit(k), metric(k)))).alias("metrics"),
            F.lit(parent_id).alias("parent_id"), "in_reply_to_id", F.lit(platform).alias("platform"), F.lit("reply").alias("source"), "account",
        ),
        REPLY,
    )


def in_window(posts: DataFrame, since: str, until: str) -> DataFrame:
    """Posts with since <= day <= until; the filter reaches the scan."""
    return posts.where(F.to_date("created_at").between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def newest_per_user(posts: DataFrame, cap: int) -> DataFrame:
    """At most *cap* newest posts of each user (rank limits are pushed below the shuffle by Spark)."""
    from pyspark.sql import Window

    w = Window.partitionBy("user").orderBy(F.col("created_at").desc(), F.col("id"))
    return posts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def high_water_mark(posts: DataFrame) -> DataFrame:
    """Newest time per user; times that can't be parsed are left out."""
    return posts.groupBy("user").agg(F.max(F.try_to_timestamp(F.col("created_at").cast("string"))).alias("latest"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows, first frame first: an ordinal column keeps the order for first_wins()."""
    out = frames[0].withColumn("branch", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("branch", F.lit(i)), allowMissingColumns=True)
    return out


def load_or_compute(spark: SparkSession, path: str, compute, force: bool = False) -> DataFrame:
    """The table at *path*; computed and written first where it is missing (or *force*)."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def line_counts(spark: SparkSession, pattern: str) -> DataFrame:
    """file, lines, bytes of each file, also in other file systems."""
    if not exists(spark, pattern):
        return spark.createDataFrame([], "file string, lines long, bytes long")
    rows = spark.read.text(pattern).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.max("bytes").alias("bytes"))
