"""Quality classifier by importance resampling with hashed n-gram models.

Byte n-grams of orders 1 to ORDERS, and pairs of echoes (whether a word equals the one before it), are hashed
to BUCKETS buckets. Two bag-of-n-grams models are counted: target (up to TARGET_DOCS documents labelled good)
and raw (all documents). A document's log weight is the sum
of log target/raw over its n-grams. It is tempered by the root of their number: a sum's spread grows so, and by bare sums
a document's length would decide and noise never. Gumbel noise from a hash of doc_id is added, and the k largest keys are
a sample of k documents without replacement in proportion to their tempered weights (Gumbel top-k).

k is given, or else the number of documents whose tempered log weight reaches the FLOOR quantile of the documents that the
target model is fitted on, so that the sample has room for every document like the target. The k-th largest key is found
by refining histograms over all rows, so no row is sorted or gathered in one task.

Edge cases: a null or empty text has no n-grams and log weight 0. Without any label that is good, nothing
is known of the target and all documents are kept, unless k is given. Labels repeated or in conflict: the least quality of a
doc_id holds. Rows without doc_id share one noise. Repeated rows have the same key and are kept or rejected together where
the cut falls among them (ties at the cut are kept). Texts are counted whole. An empty table gives no rows. Columns may
have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_arrow, plain, small_batches, written

ORDERS, BUCKETS = 3, 1 << 16
#: Labelled good documents that the target model is fitted on: the bound of what is broadcast.
TARGET_DOCS = 20_000
FLOOR = 0.002
BINS, REFINE = 1024, 6
SLAB = 1 << 20
#: Odd multipliers of the n-gram hash.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def buckets(raw: bytes, orders: int = ORDERS, size: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of all n-grams, slab by slab."""
    shift = np.uint32(32 - (size.bit_length() - 1))
    for at in range(0, len(raw), SLAB):
        b = np.frombuffer(raw[at : at + SLAB + orders - 1], np.uint8).astype(np.uint32) + np.uint32(1)
        own = min(SLAB, len(raw) - at)
        for n in range(1, orders + 1):
            m = min(own, len(b) - n + 1)
            if m <= 0:
                break
            h = np.full(m, n * 0x3C6EF35F & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h ^= b[i : i + m] * np.uint32(MULTIPLIERS[i % len(MULTIPLIERS)])
                h *= np.uint32(0x2C1B3C6D)
            yield (h * np.uint32(0x9E3779B1)) >> shift
    words = raw.split()
    if len(words) > 2:
        echo = np.fromiter(map(eq, words, words[1:]), np.uint32, len(words) - 1)
        yield ((echo[:-1] * np.uint32(2) + echo[1:] + np.uint32(1)) * np.uint32(0x61C88647)) >> shift


def counts(docs: DataFrame) -> DataFrame:
    """target (boolean), bucket, n: n-gram counts over all rows of (text, target), added up per task first."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        held: tuple[list, list] = ([], [])
        waiting = [0, 0]

        def count(good: int) -> None:
            if held[good]:
                total[good] += np.bincount(np.concatenate(held[good]), minlength=BUCKETS)
                held[good].clear()
                waiting[good] = 0

        for batch in batches:
            for text, good in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                good = int(bool(good))
                for h in buckets(text or b""):
                    held[good].append(h)
                    waiting[good] += len(h)
                if waiting[good] > SLAB:  # many documents are counted at once
                    count(good)
        count(0)
        count(1)
        for good in (0, 1):
            at = np.flatnonzero(total[good])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), bool(good))), pa.array(at.astype(np.int32)), pa.array(total[good][at])], names=["target", "bucket", "n"])

    parts = docs.select("text", "target").mapInArrow(run, "target boolean, bucket int, n long")
    return parts.groupBy("target", "bucket").agg(F.sum("n").alias("n"))


def ratios(counted: DataFrame) -> np.ndarray | None:
    """log target/raw of each bucket (BUCKETS numbers, whatever the input), smoothed by one n-gram a bucket."""
    n = np.zeros((2, BUCKETS))
    for r in counted.collect():  # 2 * BUCKETS rows at most
        n[int(r["target"]), r["bucket"]] = r["n"]
    if not n[1].any():
        return None
    target, raw = n[1] + 1, n.sum(0) + 1
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def good_labels(labels: DataFrame) -> DataFrame:
    """doc_id of every document labelled good: its least quality is 1."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return rows.where("quality = 1").select("doc_id")


def with_labels(docs: DataFrame, labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """doc_id, text, target: whether a document is among those that the target model is fitted on.

    These are the *most* labelled good documents whose ids hash lowest, so their ids are a broadcast of a fixed
    size and no text is shuffled. The raw model counts all documents.
    """
    fit = good_labels(labels).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most).select("doc_id", F.lit(True).alias("target"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.join(F.broadcast(fit), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def log_weight(raw: bytes, table: np.ndarray) -> tuple[float, int]:
    """The sum of log ratios over all n-grams, and their number."""
    total, n = 0.0, 0
    for h in buckets(raw):
        total += float(table[h].sum())
        n += len(h)
    return total, n


def tempered(weight: Column, n: Column) -> Column:
    return weight / F.sqrt(n + 1)


def weighed(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """The documents with the further columns __weight and __n."""
    held = docs.sparkSession.sparkContext.broadcast(table.astype(np.float64))  # BUCKETS numbers
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, n = zip(*(log_weight(t or b"", held.value) for t in batch.column(at).cast(pa.binary()).to_pylist()), strict=True)
        return batch.append_column("__weight", pa.array(w, pa.float64())).append_column("__n", pa.array(n, pa.int64()))

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("__weight", T.DoubleType()), T.StructField("__n", T.LongType())]))


def kth_largest(keys: DataFrame, k: int) -> float:
    """A lower bound, exact to the keys' spread over BINS ** REFINE, of the k-th largest of the column *key*."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return -math.inf if low is None else math.inf
    above = 0  # rows above *high*
    for _ in range(REFINE):
        width = (high - low) / BINS
        if not width > 0 or low + width <= low:
            break
        bin_ = F.least(F.greatest(F.floor((F.col("key") - low) / width), F.lit(0)), F.lit(BINS - 1)).cast("int")
        rows = keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(bin_.alias("bin")).count().collect()  # BINS rows at most
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["count"] >= k:
                low, high = low + r["bin"] * width, high if r["bin"] == BINS - 1 else low + (r["bin"] + 1) * width
                break
            above += r["count"]
    return low


def gumbel() -> Column:
    """Noise of a document, from the hash of its doc_id."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("gumbel"), F.col("doc_id").cast("long").cast("string"))), 1, 13), 16, 10)
    return -F.log(-F.log((digits.cast("double") + 0.5) / F.lit(float(1 << 52))))


def fitted(docs: DataFrame, labels: DataFrame, floor: float = FLOOR, k: int | None = None) -> tuple[np.ndarray, float, DataFrame]:
    """The models' log ratios, the k-th largest key (-inf: all are kept), and doc_id, log_weight, n_grams, key of all."""
    told = with_labels(docs, labels)
    table = ratios(counts(told))
    known = table is not None
    table = table if known else np.zeros(BUCKETS)
    scored = weighed(told, table).select("doc_id", F.col("__weight").alias("log_weight"), F.col("__n").alias("n_grams"), "target")
    scored = written(scored.withColumn("fit", tempered(F.col("log_weight"), F.col("n_grams"))), "op7-scores")
    keyed = scored.withColumn("key", F.col("fit") + gumbel())
    if k is None and known:
        # Of TARGET_DOCS rows at most, so the quantile is exact.
        edge = scored.where("target").agg(F.percentile("fit", F.lit(floor))).first()[0]
        k = keyed.where(F.col("fit") >= edge).count()
    out = keyed.select("doc_id", "log_weight", "n_grams", "key")
    return table, -math.inf if k is None else kth_largest(keyed, k), out


def classify(docs: DataFrame, labels: DataFrame, floor: float = FLOOR, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, n_grams, key, kept of every document."""
    _, cut, keyed = fitted(docs, labels, floor, k)
    return keyed.withColumn("kept", F.col("key") >= cut)


def accepted(docs: DataFrame, labels: DataFrame, floor: float = FLOOR, k: int | None = None) -> DataFrame:
    """The documents that are kept, with their columns as they are. A row's key follows from its text, its id and the
    models, so it is made again where the text is and nothing is joined."""
    table, cut, _ = fitted(docs, labels, floor, k)
    rows = plain(docs, "doc_id", "text")
    kept = weighed(rows, table).where(tempered(F.col("__weight"), F.col("__n")) + gumbel() >= cut)
    return kept.select(*rows.columns).toDF(*docs.columns)
