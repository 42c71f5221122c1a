"""Bootstrap confidence intervals: exact resampling of groups of any size, and Poisson weights in SQL.

Exact resampling draws a group of at most WHOLE rows in one task, with NumPy's stream for the same seed, draw for draw; larger groups
are drawn by many tasks (resample.py), which is the same estimator with another stream: bounds then agree within the error of the replicates.

The Poisson bootstrap is another estimator: each row gets an independent Poisson(1) weight in each replicate,
so replicates are plain weighted sums that meet in partial aggregates, for groups of any size. Its bounds agree with the exact ones
statistically, not digit by digit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.resample import BLOCK, replicate_means
from tidemark.sources.dims import small

RESAMPLES, ALPHA, SEED = 2000, 0.05, 0
#: Drawn indices that are held at once.
CELLS = 2_000_000
#: Most rows of a group that one task draws.
WHOLE = BLOCK
#: P(Poisson(1) <= k) for k = 0, 1, ... while above 16 bits' resolution.
CDF = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(7))
#: Replicates that one md5 gives, 16 bits each, and those of a Poisson bootstrap.
PER_HASH, REPLICATES = 8, 1000


def _clean(values) -> np.ndarray:
    v = np.asarray(values, dtype=float)
    return v[~np.isnan(v)]


def _means(v: np.ndarray, rng: np.random.Generator, n: int) -> np.ndarray:
    """Means of n resamples, drawn in chunks of rows: the same stream as one large draw."""
    out, step = np.empty(n), max(1, CELLS // len(v))
    for at in range(0, n, step):
        k = min(step, n - at)
        out[at : at + k] = v[rng.integers(0, len(v), size=(k, len(v)))].mean(axis=1)
    return out


def mean_ci(values, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> tuple[float, float, float]:
    """Mean and percentile interval; nan without values, the mean thrice for one."""
    v = _clean(values)
    if len(v) < 2:
        m = float(v.mean()) if len(v) else math.nan
        return m, m, m
    lo, hi = np.quantile(_means(v, np.random.default_rng(seed), resamples), [alpha / 2, 1 - alpha / 2])
    return float(v.mean()), float(lo), float(hi)


def diff_ci(a, b, resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> tuple[float, float, float]:
    """Difference of means (a - b) with its interval, the groups resampled independently; nan if one is empty."""
    a, b = _clean(a), _clean(b)
    if not len(a) or not len(b):
        return math.nan, math.nan, math.nan
    rng = np.random.default_rng(seed)
    lo, hi = np.quantile(_means(a, rng, resamples) - _means(b, rng, resamples), [alpha / 2, 1 - alpha / 2])
    return float(a.mean() - b.mean()), float(lo), float(hi)


def _named(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds _g, the group's key as a string that is never null, also where keys are."""
    return df.withColumn("_g", F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(by)))))


def _joined(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Left join on *by* in which null keys are equal."""
    return _named(left, by).join(_named(right, by).drop(*by), "_g", "left").drop("_g")


def _split(df: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the groups that one task draws, and of the larger ones (with _g), None if there are none."""
    rows = _named(df, by)
    large = rows.groupBy("_g").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("_g")
    if large.isEmpty():
        return df, None
    large = small(large)
    return rows.join(large, "_g", "left_anti").drop("_g"), rows.join(large, "_g", "left_semi")


def _bounds(means: DataFrame, value: str, names: tuple[str, str], alpha: float = ALPHA) -> DataFrame:
    return means.groupBy("_g").agg(*(F.percentile(value, F.lit(q)).alias(n) for n, q in zip(names, (alpha / 2, 1 - alpha / 2), strict=True)))


def _means_of(rows: DataFrame, on: Column, score: str, resamples: int, name: str, seed: int) -> DataFrame:
    """_g, b and the mean of each replicate of the rows *on*."""
    own = rows.where(on & F.col(score).isNotNull() & ~F.isnan(score)).select(F.col("_g").alias("g"), F.col(score).cast("double").alias("score"))
    return replicate_means(own, resamples, seed).select(F.col("g").alias("_g"), "b", F.col("mean").alias(name))


def _nulls(x: float) -> float | None:
    return None if math.isnan(x) else x


def exact_mean_ci(df: DataFrame, by: tuple[str, ...], score: str = "score", resamples: int = RESAMPLES) -> DataFrame:
    """by, n, mean, ci_low, ci_high. Values are taken in the order of (created_at, id), so results are repeatable."""
    keys = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by]
    own, large = _split(df.select(*by, "created_at", "id", score), by)

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["created_at", "id"], kind="stable")[score]
        m, lo, hi = map(_nulls, mean_ci(v, resamples))
        return pd.DataFrame([[*key, len(pdf), m, lo, hi]], columns=[*by, "n", "mean", "ci_low", "ci_high"])

    out = own.groupBy(*by).applyInPandas(group, ", ".join([*keys, "n long, mean double, ci_low double, ci_high double"]))
    if large is None:
        return out
    said = large.groupBy("_g", *by).agg(F.count("*").alias("n"), F.avg(F.nanvl(score, F.lit(None).cast("double"))).alias("mean"))
    bounds = _bounds(_means_of(large, F.lit(True), score, resamples, "m", SEED), "m", ("ci_low", "ci_high"))
    return out.unionByName(said.join(bounds, "_g", "left").drop("_g"))


def exact_diff_ci(df: DataFrame, by: tuple[str, ...], side: str, score: str = "score", resamples: int = RESAMPLES) -> DataFrame:
    """by, diff, diff_ci_low, diff_ci_high of the rows where *side* is true against those where it is false."""
    keys = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by]
    own, large = _split(df.select(*by, side, "created_at", "id", score), by)

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(["created_at", "id"], kind="stable")
        on = v[side].astype(bool)
        row = map(_nulls, diff_ci(v.loc[on, score], v.loc[~on, score], resamples))
        return pd.DataFrame([[*key, *row]], columns=[*by, "diff", "diff_ci_low", "diff_ci_high"])

    out = own.groupBy(*by).applyInPandas(group, ", ".join([*keys, "diff double, diff_ci_low double, diff_ci_high double"]))
    if large is None:
        return out
    on, value = F.coalesce(F.col(side), F.lit(False)), F.nanvl(score, F.lit(None).cast("double"))
    said = large.groupBy("_g", *by).agg((F.avg(F.when(on, value)) - F.avg(F.when(~on, value))).alias("diff"))
    # The sides are drawn apart, each with a seed of its own.
    both = _means_of(large, on, score, resamples, "x", SEED).join(_means_of(large, ~on, score, resamples, "y", SEED + 1), ["_g", "b"])
    bounds = _bounds(both.withColumn("m", F.col("x") - F.col("y")), "m", ("diff_ci_low", "diff_ci_high"))
    return out.unionByName(said.join(bounds, "_g", "left").drop("_g"))


def _weights(key: Column, block: Column) -> list[Column]:
    """Poisson(1) weights of a row in the PER_HASH replicates of a block, from 16 bits each of md5(key:block): the same in
    any engine. Three conversions give all eight slices."""
    digest = F.md5(F.concat_ws(":", key, block.cast("string")))
    words = [F.conv(F.substring(digest, at, n), 16, 10).cast("long") for at, n in ((1, 12), (13, 12), (25, 8))]
    slices = [F.shiftright(words[j // 3], (16 * (2 - j % 3)) if j < 6 else 16 * (7 - j)).bitwiseAND(F.lit(0xFFFF)) for j in range(PER_HASH)]
    # (v + 0.5) / 65536 > c, in whole numbers.
    return [sum((v > math.floor(c * 65536 - 0.5)).cast("int") for c in CDF) for v in slices]


def _own_keys(rows: DataFrame, by: tuple[str, ...], score: str, extra: tuple[str, ...]) -> DataFrame:
    """Adds _key, by which a row is drawn: its id, where no other row of its group has it.

    Rows that lack or share an id are told apart by their values, and equal ones by a number, so each is drawn on its own. Rows are
    counted before they are numbered: an id (or none) that a third of all rows share costs a task a row for each of its values.
    """
    named = _named(rows, by)
    each = named.groupBy("_g", *by, "id", score, *extra).agg(F.count("*").alias("_n"))
    # Rows without id are never looked up, and an id that many values share comes as one sum from each task.
    shared = each.where("id is not null").groupBy("_g", "id").agg(F.sum("_n").alias("_of")).where("_of > 1")
    told = each.join(shared, ["_g", "id"], "left")
    alone = told.where("id is not null and _of is null").withColumn("_key", F.col("id").cast("string"))
    again = told.where("id is null or _of is not null").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    made = F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("")), "_g", F.xxhash64(score, *extra).cast("string"), F.col("_i").cast("string"))
    return alone.unionByName(again.withColumn("_key", made).drop("_i")).drop("_g", "_n", "_of")


def _replicates(rows: DataFrame, by: tuple[str, ...], score: str, n: int, sides: dict[str, Column], extra: tuple[str, ...] = ()) -> DataFrame:
    """by and, for each side, its mean in every replicate: one row per key and replicate.

    A row is repeated for each block of PER_HASH replicates, not for each replicate, and its block's sums meet in partial
    aggregates, so a task shuffles one row for each key and block.
    """
    # Each row becomes many, so rows are dealt out first: a few files would keep all that work in a few tasks.
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keyed = _own_keys(rows, by, score, extra).repartition(parts, "_key")
    spread = keyed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-n // PER_HASH) - 1))))
    spread = spread.withColumns({f"_w{j}": w for j, w in enumerate(_weights(F.col("_key"), F.col("_block")))})
    part = lambda j, on: F.try_divide(F.sum(F.when(on, F.col(f"_w{j}") * F.col(score))), F.sum(F.when(on, F.col(f"_w{j}"))))
    sums = spread.groupBy(*by, "_block").agg(*(part(j, on).alias(f"_{s}{j}") for j in range(PER_HASH) for s, on in sides.items()))
    each = F.array(*(F.struct((F.col("_block") * PER_HASH + j).alias("b"), *(F.col(f"_{s}{j}").alias(s) for s in sides)) for j in range(PER_HASH)))
    return sums.select(*by, F.explode(each).alias("r")).select(*by, "r.*").where(F.col("b") < n)


def _interval(values: DataFrame, by: tuple[str, ...], column: str, names: tuple[str, str], alpha: float) -> DataFrame:
    return values.groupBy(*by).agg(*(F.percentile(column, F.lit(q)).alias(n) for n, q in zip(names, (alpha / 2, 1 - alpha / 2), strict=True)))


def poisson_mean_ci(df: DataFrame, by: tuple[str, ...], score: str = "score", replicates: int = REPLICATES, alpha: float = ALPHA) -> DataFrame:
    """by, mean, ci_low, ci_high."""
    rows = df.where(F.col(score).isNotNull()).select(*by, "id", score)
    ci = _interval(_replicates(rows, by, score, replicates, {"m": F.lit(True)}), by, "m", ("ci_low", "ci_high"), alpha)
    return _joined(rows.groupBy(*by).agg(F.avg(score).alias("mean")), ci, by)


def poisson_diff_ci(df: DataFrame, by: tuple[str, ...], side: str, score: str = "score", replicates: int = REPLICATES, alpha: float = ALPHA) -> DataFrame:
    """by, diff, diff_ci_low, diff_ci_high of *side* true against false; no interval where a side is empty."""
    rows = df.where(F.col(score).isNotNull()).select(*by, side, "id", score)
    reps = _replicates(rows, by, score, replicates, {"on": F.col(side), "off": ~F.col(side)}, (side,)).withColumn("m", F.col("on") - F.col("off"))
    diff = rows.groupBy(*by).agg((F.avg(F.when(F.col(side), F.col(score))) - F.avg(F.when(~F.col(side), F.col(score)))).alias("diff"))
    return _joined(diff, _interval(reps, by, "m", ("diff_ci_low", "diff_ci_high"), alpha), by)
