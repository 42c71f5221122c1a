"""Reply summaries, loyalty segments, cohorts and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.score import loyalty_score, loyalty_tier, tier_rank
from tidemark.operators.bootstrap import exact_mean_ci, poisson_mean_ci


def label_shares(label: str = "label") -> list[Column]:
    """Per cent of all rows by label, whatever its case; other labels and nulls count in the denominator alone."""
    low = F.lower(label)
    return [(100 * F.avg(F.when(low == v, 1.0).otherwise(0.0))).alias(n) for n, v in (("pct_critical", "negative"), ("pct_neutral", "neutral"), ("pct_supportive", "positive"))]


def post_summary(replies: DataFrame, score: str = "score", label: str = "label", slug: str | None = None) -> DataFrame:
    """One row per tracked post, without intervals; an asked-for slug without replies gives a row with n = 0."""
    rows = replies.where(F.col("tracked_slug").isNotNull())
    if slug is not None:
        rows = rows.where(F.col("tracked_slug") == slug)
        one = rows.agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), *label_shares(label))
        return one.select(F.lit(slug).alias("slug"), "*")
    return rows.groupBy(F.col("tracked_slug").alias("slug")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), *label_shares(label)).orderBy("slug")


def _mean_ci(rows: DataFrame, by: tuple[str, ...], score: str, exact: bool) -> DataFrame:
    ci = exact_mean_ci(rows, by, score) if exact else poisson_mean_ci(rows, by, score)
    return ci.select(*by, "ci_low", "ci_high")


def post_summary_ci(replies: DataFrame, score: str = "score", label: str = "label", exact: bool = True) -> DataFrame:
    """post_summary() with bootstrap intervals; without *exact* by the Poisson bootstrap, for posts of any size."""
    ci = _mean_ci(replies.where("tracked_slug is not null"), ("tracked_slug",), score, exact).withColumnRenamed("tracked_slug", "slug")
    return post_summary(replies, score, label).join(ci, "slug", "left").withColumns({"score_col": F.lit(score), "label_col": F.lit(label)}).orderBy("slug")


def with_loyalty(replies: DataFrame, keywords: list[str], as_of: Column | None = None, found: str | None = None) -> DataFrame:
    """Adds loyalty_score and loyalty_tier from the account's bio and age; without accounts they are 0 and unknown.
    *found* names a column with the keywords' number in the bio (keyword_hits), counted before a join, so that bios need not be shuffled."""
    if "account" not in replies.columns:
        return replies.withColumns({"loyalty_score": F.lit(0.0), "loyalty_tier": F.lit("unknown")})
    made = F.try_to_timestamp(F.col("account.created_at"))
    score = F.when(F.col("account").isNull(), 0.0).otherwise(loyalty_score(F.col("account.bio"), made, as_of if as_of is not None else F.current_timestamp(), keywords, F.col(found) if found else None))
    return replies.withColumn("loyalty_score", score).withColumn("loyalty_tier", loyalty_tier(F.col("loyalty_score")))


def loyalty_segments(replies: DataFrame, score: str = "score", by_slug: bool = True) -> DataFrame:
    """Rows and mean per (tracked post and) loyalty tier, tiers from low to unknown."""
    keys = [*(["tracked_slug"] if by_slug else []), "loyalty_tier"]
    rows = replies.where(" and ".join(f"{k} is not null" for k in keys))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(score).alias("mean")).orderBy(*keys[:-1], tier_rank(F.col("loyalty_tier")))


def loyalty_segments_ci(replies: DataFrame, score: str = "score", exact: bool = False) -> DataFrame:
    """loyalty_segments() by tracked post with bootstrap intervals of the mean."""
    keys = ("tracked_slug", "loyalty_tier")
    rows = replies.where(" and ".join(f"{k} is not null" for k in keys))
    ci = _mean_ci(rows, keys, score, exact)
    return loyalty_segments(replies, score).join(ci, list(keys), "left").withColumn("score_col", F.lit(score)).orderBy(keys[0], tier_rank(F.col("loyalty_tier")))


def flippers(replies: DataFrame, first: str, then: str, score: str = "score", edge: float = 0.1) -> DataFrame:
    """Users whose mean on one post is above the edge and on another below its negative."""
    mean = lambda slug: F.avg(F.when(F.col("tracked_slug") == slug, F.col(score)))
    means = replies.where(F.col("tracked_slug").isin(first, then) & F.col("user").isNotNull()).groupBy("user").agg(mean(first).alias("mean_first"), mean(then).alias("mean_then"))
    return means.where((F.col("mean_first") > edge) & (F.col("mean_then") < -edge))


def flipper_rows(replies: DataFrame, first: str, then: str, score: str = "score", edge: float = 0.1) -> DataFrame:
    """The flippers' replies to the second post."""
    return replies.where(F.col("tracked_slug") == then).join(flippers(replies, first, then, score, edge).select("user"), "user", "left_semi")


def stable_order(seed: int, key: str = "id") -> Column:
    """A repeatable random order that other engines can make too."""
    return F.md5(F.concat_ws(":", F.col(key), F.lit(seed)))


def bucket(score: Column, edge: float = 0.3) -> Column:
    return F.when(score < -edge, "critical").when(score < edge, "mid").when(score.isNotNull(), "supportive")


def stratified_sample(replies: DataFrame, n: int = 50, seed: int = 42, score: str = "score") -> DataFrame:
    """Up to n rows of each (post, score bucket), chosen by the stable order; null scores are in no bucket.

    The rank limit makes Spark keep n rows per bucket in each task before the shuffle.
    """
    rows = replies.where(F.col("tracked_slug").isNotNull() & F.col(score).isNotNull()).withColumn("bucket", bucket(F.col(score)))
    w = Window.partitionBy("tracked_slug", "bucket").orderBy(stable_order(seed), "id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def sample_with_flippers(replies: DataFrame, first: str, then: str, n: int = 50, seed: int = 42, score: str = "score") -> DataFrame:
    """The stratified sample and n flipper rows; an id that is in both is kept once, as part of the sample."""
    sample = stratified_sample(replies, n, seed, score)
    cohort = flipper_rows(replies, first, then, score).orderBy(stable_order(seed), "id").limit(n).withColumn("bucket", F.lit("flipper"))
    new = cohort.join(sample.select("id"), "id", "left_anti")
    both = sample.unionByName(new)
    return both.where("id is not null").dropDuplicates(["id"]).unionByName(both.where("id is null"))
