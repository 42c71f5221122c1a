"""Structured Streaming: incremental reads, deduplication and tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATENESS = "7 days"


def read_posts(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """New files as they land; the checkpoint of the writer remembers which were read."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def deduplicated(posts: DataFrame, key: str = "id", time: str = "created_at", lateness: str = LATENESS) -> DataFrame:
    """First arrival of each id within the lateness; state older than that is dropped."""
    return posts.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def tumbling(posts: DataFrame, every: str = "1 day", by: tuple[str, ...] = (), score: str = "score", time: str = "created_at", lateness: str = LATENESS) -> DataFrame:
    """Mean and count per window, final once the watermark has passed it."""
    window = F.window(time, every)
    out = posts.withWatermark(time, lateness).groupBy(window, *by).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
    return out.select(F.col("window.start").alias("period"), *by, "mean", "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append all that is there to Parquet and stop; running again takes up where it ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drain_partials(stream: DataFrame, path: str, checkpoint: str, every: str = "day", by: tuple[str, ...] = (), score: str = "score") -> None:
    """Additive sums per period and batch. A batch that is retried replaces its folder, so sums count once; unlike
    tumbling() the open windows are there too."""

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(*by, F.date_trunc(every, "created_at").alias("period")).agg(F.sum(score).alias("total"), F.count(score).alias("n"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def totals(spark: SparkSession, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and count per period over all batches of drain_partials()."""
    sums = spark.read.parquet(path).groupBy(*by, "period").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select(*by, "period", F.try_divide("total", "n").alias("mean"), "n")
