"""Writers: JSONL, Parquet published at once, partial results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_jsonl(df: DataFrame, path: str, append: bool = False, skip_empty: bool = True) -> bool:
    """Write JSON lines; an empty frame writes nothing unless told to."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode("append" if append else "overwrite").json(path)
    return True


def write_replies(df: DataFrame, path: str) -> None:
    """Replies by tracked post, so that one post's replies are read alone."""
    df.write.mode("overwrite").partitionBy("tracked_slug").parquet(path)


def publish(df: DataFrame, path: str, order: str | None = "created_at", checkpoint: str | None = None) -> None:
    """Write to a staging folder and then move it to *path*; the old table is moved aside before and deleted after.

    At each moment one of the two is whole: where *path* is missing because a run broke off between the two moves,
    recover() puts back the new table, or else the old one. Rows are range-partitioned and sorted by *order*, which lets
    later scans skip row groups. *checkpoint* is a folder of partial results that the table makes superfluous.
    """
    recover(df.sparkSession, path)
    staging, old = f"{path}.staging", f"{path}.old"
    (df.repartitionByRange(order).sortWithinPartitions(order) if order else df).write.mode("overwrite").parquet(staging)
    fs, at = _files(df.sparkSession, path)
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        _move(fs, at, path, old)
    _move(fs, at, staging, path)
    fs.delete(at(old), True)
    if checkpoint:
        fs.delete(at(checkpoint), True)


def recover(spark: SparkSession, path: str) -> None:
    """Complete a publish() that broke off between its two moves."""
    fs, at = _files(spark, path)
    if fs.exists(at(path)):
        return
    for left in (f"{path}.staging", f"{path}.old"):
        if fs.exists(at(f"{left}/_SUCCESS")):
            _move(fs, at, left, path)
            return


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _move(fs, at, source: str, target: str) -> None:
    if not fs.rename(at(source), at(target)):
        raise OSError(f"can't move {source} to {target}")


def append_partial(df: DataFrame, path: str, batch: int) -> None:
    """One batch's results in a folder of its own: writing a batch again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
