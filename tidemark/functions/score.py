"""Scores, labels and priors as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import keyword_hits
from tidemark.functions.time import account_years

EDGE = 0.05


def label(score: Column) -> Column:
    """Label with inclusive edges; null for null."""
    return F.when(score >= EDGE, "positive").when(score <= -EDGE, "negative").when(score.isNotNull(), "neutral")


def strict_label(score: Column) -> Column:
    """Label with strict edges, as model replies without one get."""
    return F.when(score > EDGE, "positive").when(score < -EDGE, "negative").when(score.isNotNull(), "neutral")


def expected_score(probabilities: Column) -> Column:
    """Sum of p times -1, 0, 1 over array<struct<label, score>>, to 4 places."""
    sign = lambda p: F.when(F.lower(p["label"]) == "positive", 1.0).when(F.lower(p["label"]) == "negative", -1.0).otherwise(0.0)
    return F.round(F.aggregate(probabilities, F.lit(0.0), lambda acc, p: acc + sign(p) * p["score"]), 4)


def likeliest_label(probabilities: Column) -> Column:
    """Label of the largest probability; the first of equals."""
    return F.aggregate(
        probabilities,
        F.struct(F.lit(None).cast("string").alias("label"), F.lit(-1.0).alias("score")),
        lambda best, p: F.when(p["score"] > best["score"], F.struct(F.lower(p["label"]).alias("label"), p["score"].alias("score"))).otherwise(best),
    )["label"]


def loyalty_score(bio: Column, created: Column, as_of: Column, keywords: list[str], found: Column | None = None) -> Column:
    """Prior in 0 to 1: 0.2 for each keyword in the bio up to 0.7, and a tenth for each year of age up to 0.3.
    *found* is the number of keywords in the bio where it was counted before."""
    found = keyword_hits(bio, keywords) if found is None else found
    hits = F.least(F.lit(0.7), found.cast("double") * F.lit(0.2))
    age = F.least(F.lit(0.3), F.greatest(F.lit(0.0), account_years(created, as_of) / F.lit(10.0)))
    return hits + F.coalesce(age, F.lit(0.0))


def loyalty_tier(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.3, "medium").otherwise("low")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "low", 0).when(tier == "medium", 1).when(tier == "high", 2).otherwise(3)
