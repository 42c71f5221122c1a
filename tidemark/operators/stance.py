"""Stance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.summary import crosstab_long, shares

#: The stance categories. Fixed values of the data model.
CATEGORIES = ("pro_war_supportive", "pro_trump_antiwar", "antiwar_betrayal", "antiwar_opposition", "pro_war_critical", "neutral_other")
ERROR = "error"


def valid(stances: DataFrame) -> DataFrame:
    return stances.where(F.col("stance") != ERROR)


def distribution(stances: DataFrame) -> DataFrame:
    return shares(valid(stances), "stance")


def by_post(stances: DataFrame) -> DataFrame:
    """Per cent of each stance within a tracked post."""
    return crosstab_long(valid(stances), "tracked_slug", "stance")


def against_score(stances: DataFrame, score: str = "score") -> DataFrame:
    """Mean score per stance, lowest first, flagged where the score's sign disagrees with the stance."""
    out = valid(stances).groupBy("stance").agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
    flag = F.when((F.col("stance") == "pro_war_critical") & (F.col("mean") < -0.1), "score negative, stance pro").when((F.col("stance") == "pro_trump_antiwar") & (F.col("mean") > 0), "score positive, stance anti").otherwise("")
    return out.withColumn("flag", flag).orderBy("mean", "stance")
