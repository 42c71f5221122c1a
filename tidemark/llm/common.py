"""Shared plumbing of the training-data operators: table access and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of one Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, because one text may be very long. A tighter bound stays, and so do the session's
    rows of a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, done: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with small batches; *fn* turns one batch into one, its columns in the order of *schema*.

    Columns go by place, so their names may hold dots or repeat. *done* runs as each task ends: Spark goes on using a
    worker, and what it still holds is held beside the steps that follow.
    """
    small_batches(df.sparkSession)
    names = df.columns
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    places = T.StructType([T.StructField(f"o{i}", f.dataType) for i, f in enumerate(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    out = fn(batch.rename_columns(names))
                    yield out.rename_columns([f"o{i}" for i in range(out.num_columns)])
        finally:
            if done is not None:
                done()

    return df.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, places).toDF(*schema.names)


def plain(docs: DataFrame, *keep: str) -> DataFrame:
    """The documents with all columns but *keep* named by place, so that no name clashes or needs quotes."""
    return docs.toDF(*(c if c in keep else f"c{i}" for i, c in enumerate(docs.columns)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one on one machine (tests).

    On a cluster the setting is needed: a folder of the driver's own would take each executor's files to another disk.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = sc._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors share (master {sc.master})")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write *df* as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


#: Spark's switch for deleting a query's shuffle files when the query ends, and not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> DataFrame:
    """written(), with the shuffle files of the write deleted once it is done: nothing reads them any more, and steps
    that follow would find executors' disks full of them. The session's setting is put back."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEAN_UP, before)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete the files behind frames made by written(), once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Most rows of a side that is broadcast; each such side has a few short columns.
BROADCAST_ROWS = 4096


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where *df* has at most *limit* rows (counted), else *df* as it is: Spark then joins by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: A key with more than one in HOT of a table's rows is hot; so there are fewer than HOT of them. Tables of up to
#: HOT_ROWS rows are joined as they are.
HOT, HOT_ROWS = 512, 100_000


def join_hot(big: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join *big* with *side*, which has one row for each key, on one column, whatever share of rows a key holds.

    Hot keys are counted; their rows meet side's by broadcast (fewer than HOT rows) and stay where they are, all others
    by shuffle. In a left join rows with a null key find nothing and stay where they are, too. *big* is read up to
    three times, so it should be a table or close to one.
    """
    rows = big.count()
    if rows <= HOT_ROWS:
        return big.join(side, key, how)
    spark = big.sparkSession
    counted = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > rows // HOT)
    hot = counted.select(key).collect()  # fewer than HOT
    whole = big.where(F.col(key).isNotNull())
    if not hot:
        out = whole.join(side, key, how)
    else:
        keys = F.broadcast(spark.createDataFrame(hot, T.StructType([big.schema[key]])))
        own = F.broadcast(side.join(keys, key, "left_semi"))
        out = whole.join(keys, key, "left_anti").join(side, key, how).unionByName(whole.join(keys, key, "left_semi").join(own, key, how))
    if how == "left":
        lost = big.where(F.col(key).isNull())
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema if f.name != key]
        out = out.unionByName(lost.select(*(F.col(f"`{c}`") for c in big.columns), *empty))
    return out
