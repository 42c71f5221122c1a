"""How filters interact: which of five failure conditions removes, repeats or misses what, in every order.

Scan. Texts are read as Arrow buffers, a group of documents at a time. A table classes each byte (white space, A-Z,
symbol, continuation of a code point); prefix sums of the classes, read at the documents' ends, give their counts.
A word's hash is a difference of a prefix sum of byte * base^place; sorting (document, hash) brings equal words of
a document together. Neighbours of equal hash are compared byte by byte, so that distinct counts are exact: a document with a
collision is counted from its words. Texts of over LONG bytes are counted from their words, too, a slice at a time.

Masks. A document becomes five bits and two flags. Rows of one text meet as (text, part, flags) counts, so a text
that a third of all rows share costs each task one row; then only counts by mask are left, and each of the 120 orders
reads them.

Edge cases: a null or empty text has no words, fails A alone, and is identical to any other such text. A row without doc_id has
no place among ids: it never fails E and makes no other row fail it. Rows with one doc_id and one text are not smaller than each other.
Repeated rows count as often as they stand. A null lang is the part ''. A document is good (toxic) if any row of labels
for its doc_id says so. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import join_hot, map_arrow, written

FILTERS = "ABCDE"
#: Bytes of one group of documents, and of the longest text that is scanned by buffer.
LONG = 1 << 20
#: Limits of the filters: words, distinct words and capitals in percent.
LEAST_WORDS, DISTINCT, CAPITALS = 100, 80, 10
SYMBOLS = "#$%&*|"
SPACE, CAPITAL, SYMBOL, INNER = 1, 2, 4, 8
BASE = 0x9E3779B97F4A7C15
SCHEMA = "doc_id long, part string, sha binary, mask int"


def byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[0x20, *range(9, 14)]] |= SPACE
    out[0x41:0x5B] |= CAPITAL
    out[[ord(c) for c in SYMBOLS]] |= SYMBOL
    out[0x80:0xC0] |= INNER
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64, by doubling."""
    out, k = np.ones(n, np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


CLASSES = byte_classes()
_tables: list[np.ndarray] = []


def tables() -> list[np.ndarray]:
    if not _tables:
        _tables.extend((powers(BASE, LONG + 1), powers(pow(BASE, -1, 1 << 64), LONG + 1)))
    return _tables


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words, word by word."""
    n, seen = 0, set()
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", text):
        n += 1
        seen.add(m[0])
    return n, len(seen)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def same_words(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each i: the size[i] bytes at a[i] equal those at b[i]."""
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    differ = data[np.repeat(a, size) + within] != data[np.repeat(b, size) + within]
    return np.add.reduceat(differ, first) == 0 if len(size) else np.zeros(0, bool)


def scan_group(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and points of each document between *offsets* (at most LONG bytes in all)."""
    start, docs = int(offsets[0]), len(offsets) - 1
    part, ends = data[start : int(offsets[-1])], offsets - start
    kinds = CLASSES[part]

    def per_doc(hit: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(part) + 1, np.int32)
        np.cumsum(hit, out=sums[1:])
        return (sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64)

    out = {"capitals": per_doc(kinds & CAPITAL != 0), "symbols": per_doc(kinds & SYMBOL != 0), "points": per_doc(kinds & INNER == 0)}
    ink = kinds & SPACE == 0
    fresh = np.zeros(len(part) + 1, bool)
    fresh[ends] = True  # a document's first byte follows no word
    first = ink & (~np.concatenate(([False], ink[:-1])) | fresh[:-1])
    last = ink & (~np.concatenate((ink[1:], [False])) | fresh[1:])
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - begin
    doc = np.searchsorted(ends, begin, "right") - 1
    out["words"] = np.bincount(doc, minlength=docs)
    up, down = tables()
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
    mixed = (sums[end] - sums[begin]) * down[begin]
    bits = np.uint64(max(1, docs - 1).bit_length())
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(BASE)
    key = (doc.astype(np.uint64) << (np.uint64(64) - bits)) | (mixed >> bits)
    order = np.argsort(key)
    twin = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[twin], order[twin + 1]
    doubt = size[a] != size[b]
    ok = ~doubt
    doubt[ok] = ~same_words(part, begin[a[ok]], begin[b[ok]], size[a[ok]])
    out["distinct"] = out["words"] - np.bincount(doc[a], minlength=docs)
    for d in np.unique(doc[a[doubt]]).tolist():
        out["distinct"][d] = word_counts(part[ends[d] : ends[d + 1]].tobytes())[1]
    return out


def scan_long(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
    """The same for one long text, a slice at a time."""
    text, at = data[int(offsets[0]) : int(offsets[1])], 0
    out = dict.fromkeys(("capitals", "symbols", "points"), 0)
    for at in range(0, len(text), LONG):
        kinds = CLASSES[text[at : at + LONG]]
        for name, hit in (("capitals", kinds & CAPITAL != 0), ("symbols", kinds & SYMBOL != 0), ("points", kinds & INNER == 0)):
            out[name] += int(np.count_nonzero(hit))
    out["words"], out["distinct"] = word_counts(memoryview(text))
    return {k: np.array([v], np.int64) for k, v in out.items()}


def groups(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents of at most LONG bytes in all, or one document."""
    out, begin = [], 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + LONG, "right")) - 1)
        out.append((begin, end))
        begin = end
    return out


def counted(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a string column without nulls."""
    offsets, data = buffers(column)
    parts = [(scan_long if offsets[b] - offsets[a] > LONG else scan_group)(offsets[a : b + 1], data) for a, b in groups(offsets)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, the text's SHA-256 and the bits of A to D (A is the lowest)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = counted(batch.column(3))
        fails = (n["words"] < LEAST_WORDS, 100 * n["distinct"] < DISTINCT * n["words"], 100 * n["capitals"] > CAPITALS * n["points"], n["symbols"] > 0)
        mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(mask, pa.int32())], names=["doc_id", "part", "sha", "mask"])

    return map_arrow(rows, run, SCHEMA)


def flags(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic: one row for each labelled document."""
    said = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality")("good"), said("toxic")("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (with E), good, toxic, n."""
    seen = join_hot(written(masks(docs), "op13-masks"), flags(labels), "doc_id", "left")
    group = [F.col("sha"), F.col("part"), F.col("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    # Rows of one id are added up first, so that the smallest id of a text comes with its number of rows.
    ids = seen.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    names = ["sha", "part", "mask", "good", "toxic"]
    known = F.col("doc_id").isNotNull()
    texts = ids.groupBy(*names).agg(
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null")
    )
    # A text has at most four rows for each part here.
    texts = texts.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("sha")))
    original = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0) + F.col("n_null")
    split = texts.select(*names[1:], F.explode(F.array(F.struct(original.alias("n"), F.lit(0).alias("e")), F.struct((F.col("n") + F.col("n_null") - original).alias("n"), F.lit(16).alias("e")))).alias("x"))
    return split.select("part", (F.col("mask") + F.col("x.e")).alias("mask"), "good", "toxic", F.col("x.n").alias("n")).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = [(o, k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(c) for c in o[:k])) for o in orders for k in range(len(FILTERS))]
    places = [F.element_at(F.lit([s[i] for s in steps]), F.col("at") + 1).alias(name) for i, name in enumerate(("filter_order", "step", "bit", "before"))]
    rows = mask_counts(docs, labels).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("at")).select("part", "mask", "good", "toxic", "n", *places)
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    add = lambda hit, name: F.sum(F.when(hit, F.col("n")).otherwise(F.lit(0))).cast("long").alias(name)
    removed = fails & ~earlier
    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        add(~fails & ~earlier, "kept"), add(removed, "removed"), add(fails & earlier, "redundant"), add(F.col("mask") == F.col("bit"), "unique_fails"),
        add(removed & (F.col("good") == 1), "good_lost"), add(removed & (F.col("toxic") == 1), "toxic_lost"),
    )
    # 120 rows for each part and filter, whatever the number of documents.
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
