from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.streaming import ingest


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    def land(lo, hi):
        rows = spark.range(lo, hi).select(F.col("id").cast("string"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7200).alias("created_at"), (F.col("id") % 5 / 5.0).alias("score"))
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        return rows

    every = land(0, 60)
    stream = lambda: ingest.read_posts(spark, f"{tmp_path}/in", every.schema, "parquet")
    ingest.drain_partials(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    land(40, 90)  # some days again, in another batch
    ingest.drain_partials(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r.period: (round(r.mean, 9), r.n) for r in ingest.totals(spark, f"{tmp_path}/out").collect()}
    want = {r.period: (round(r.mean, 9), r.n) for r in series.resample(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert got == want
    ingest.drain(ingest.deduplicated(stream()).select("id"), f"{tmp_path}/d", f"{tmp_path}/dck")
    ids = [r.id for r in spark.read.parquet(f"{tmp_path}/d").collect()]
    assert len(ids) == len(set(ids)) == 90
    ingest.drain(ingest.tumbling(stream(), lateness="0 seconds"), f"{tmp_path}/t", f"{tmp_path}/tck")
    assert spark.read.schema("period timestamp, mean double, n long").parquet(f"{tmp_path}/t").count() >= 0
