"""Multinomial resampling of groups of any size: each replicate of n rows draws exactly n of them, in many tasks.

Equal values of a group are counted first, so a group of a few distinct values is a few rows, however many it had. What is
left is dealt into leaves of about BLOCK rows by a hash of the value; a value with more rows than that is a leaf of its own, which
needs no draws. A binary tree over the leaves splits each replicate's n draws: a node passes Binomial(draws, left weight / weight)
to its left child and the rest to its right one. The generator of a node is seeded by the group and the node, so every leaf
walks from the root to itself alone and all agree without talking to each other; together the leaves hold exactly n draws.
Within a leaf draws are uniform over its rows. Leaves' sums of all replicates meet in partial aggregates.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Rows of an average leaf, and drawn rows that are held at once.
BLOCK, CELLS = 65_536, 2_000_000
#: Most tasks that leaves are dealt to.
TASKS = 10_000


def leaves(values: DataFrame, block: int) -> DataFrame:
    """g, score, k, leaf: *values* (g, score, k) dealt out."""
    sizes = values.groupBy("g").agg(F.sum(F.when(F.col("k") <= block, F.col("k"))).alias("small"))
    at = values.join(sizes, "g").withColumn("few", F.ceil(F.coalesce("small", F.lit(0)) / block))
    small = at.where(F.col("k") <= block).select("g", "score", "k", F.pmod(F.xxhash64("score"), "few").alias("leaf"))
    # At most one such value for each BLOCK rows of the group.
    rank = F.row_number().over(Window.partitionBy("g").orderBy("score")) - 1
    large = at.where(F.col("k") > block).select("g", "score", "k", (F.col("few") + rank).alias("leaf"))
    return small.unionByName(large)


def paths(dealt: DataFrame) -> DataFrame:
    """g, leaf, path: the weights of the leaf and of all nodes above it, up to the root."""
    weights = dealt.groupBy("g", "leaf").agg(F.sum("k").alias("w"))
    depth = weights.groupBy("g").agg(F.ceil(F.log2(F.max("leaf") + 1)).cast("int").alias("depth"))
    steps = weights.join(depth, "g").select("g", "leaf", "w", F.explode(F.sequence(F.lit(0), "depth")).alias("level"))
    steps = steps.withColumn("node", F.expr("shiftright(leaf, level)"))
    nodes = steps.groupBy("g", "level", "node").agg(F.sum("w").alias("weight"))
    return steps.drop("w").join(nodes, ["g", "level", "node"]).groupBy("g", "leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "weight"))), lambda x: x["weight"]).alias("path"))


def draws_of(g: str, leaf: int, path: list[int], resamples: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws fall to the leaf."""
    n, group = np.full(resamples, path[-1], np.int64), zlib.crc32(g.encode())
    for level in range(len(path) - 1, 0, -1):
        node, child = leaf >> level, leaf >> (level - 1)
        left = path[level - 1] if child % 2 == 0 else path[level] - path[level - 1]
        first = np.random.default_rng([seed, group, level, node]).binomial(n, left / path[level])
        n = first if child % 2 == 0 else n - first
    return n


def leaf_totals(g: str, leaf: int, path: list[int], scores: np.ndarray, k: np.ndarray, resamples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws and sums of a leaf in all replicates."""
    n = draws_of(g, leaf, path, resamples, seed)
    if len(scores) == 1:
        return n, n * scores[0]
    order = np.argsort(scores)
    rows, rng = np.repeat(scores[order], k[order]), np.random.default_rng([seed, zlib.crc32(g.encode()), leaf])
    out, at = np.zeros(resamples), 0
    while at < resamples:
        end = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), CELLS, "right")) + at)
        some = n[at:end]
        drawn = np.concatenate((rows[rng.integers(0, len(rows), int(some.sum()))], [0.0]))
        out[at:end] = np.where(some > 0, np.add.reduceat(drawn, np.cumsum(some) - some), 0.0)
        at = end
    return n, out


def totals(dealt: DataFrame, resamples: int, seed: int) -> DataFrame:
    """g, n, total: draws and sums of each leaf in all replicates.

    A leaf is few bytes (its values are counted) and much work, so Spark, left to choose, would give all of them to a few tasks."""

    def run(key: tuple, own: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        n, total = leaf_totals(key[0], int(key[1]), [int(x) for x in path["path"].iloc[0]], own["score"].to_numpy(float), own["k"].to_numpy(np.int64), resamples, seed)
        return pd.DataFrame({"g": [key[0]], "n": [n], "total": [total]})

    above = paths(dealt).toDF("of", "at", "path")
    tasks = max(1, min(dealt.select("g", "leaf").distinct().count(), TASKS))
    own, over = dealt.repartition(tasks, "g", "leaf"), above.repartition(tasks, "of", "at")
    return own.groupBy("g", "leaf").cogroup(over.groupBy("of", "at")).applyInPandas(run, "g string, n array<long>, total array<double>")


def replicate_means(rows: DataFrame, resamples: int, seed: int = 0, block: int | None = None) -> DataFrame:
    """g, b, n, mean: the mean of each group's replicate b, and its draws. *rows*: g (a string), score, both not null."""
    block = block or BLOCK
    values = written(rows.groupBy("g", "score").agg(F.count("*").alias("k")), "resample-values")
    dealt = written(leaves(values, block), "resample-leaves")
    sums = totals(dealt, resamples, seed)
    each = sums.select("g", F.posexplode(F.arrays_zip("n", "total")).alias("b", "x"))
    return each.groupBy("g", "b").agg(F.sum("x.n").alias("n"), F.sum("x.total").alias("total")).select("g", "b", "n", (F.col("total") / F.col("n")).alias("mean"))

