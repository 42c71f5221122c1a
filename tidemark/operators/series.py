"""Gap-preserving resampling, rolling means and matrices over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import week_start


def resample(df: DataFrame, every: str = "day", by: tuple[str, ...] = (), score: str = "score", dropna: bool = True) -> DataFrame:
    """by, period, mean, n: one row for each period from a key's first to its last, empty ones included.

    Posts meet in partial sums per (key, period); the calendar is made from these sums, so what is joined is as
    large as the output. With *dropna* rows without a score don't stretch the calendar.
    """
    rows = df.where(F.col("created_at").isNotNull())
    rows = rows.where(F.col(score).isNotNull()) if dropna else rows
    seen = rows.groupBy(*by, F.date_trunc(every, "created_at").alias("period")).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
    ends = seen.groupBy(*by).agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    spine = ends.where("lo is not null").select(*by, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {every}"))).alias("period"))
    on = ["period"]
    if by:  # a null key is a group of its own
        seen = seen.select(*(F.col(c).alias(f"_{c}") for c in by), *on, "mean", "n")
        match = (spine["period"] == seen["period"]) & _all(spine[c].eqNullSafe(seen[f"_{c}"]) for c in by)
        joined = spine.join(seen, match, "left").select(*(spine[c] for c in (*by, *on)), "mean", "n")
    else:
        joined = spine.join(seen, on, "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))


def _all(conditions):
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def rolling(series: DataFrame, width: int, by: tuple[str, ...] = (), value: str = "mean", name: str = "smoothed") -> DataFrame:
    """Centered rolling mean over *width* periods of a resampled series; one value is enough.

    Frames end (width - 1) // 2 periods after the row. Without keys the window is one partition of calendar
    periods, not of posts.
    """
    after = (width - 1) // 2
    w = Window.partitionBy(*by).orderBy("period").rowsBetween(after - width + 1, after)
    return series.withColumn(name, F.avg(value).over(w))


def timeline(df: DataFrame, score: str = "score", by_user: bool = False) -> DataFrame:
    """Daily mean with its 3-day mean and volume, or daily means per user."""
    return resample(df, "day", ("user",), score) if by_user else rolling(resample(df, "day", (), score), 3)


def tier_comparison(df: DataFrame, score: str = "score", days: int = 5) -> DataFrame:
    return rolling(resample(df, "day", ("tier",), score), days, ("tier",))


def public_search(df: DataFrame, score: str = "score") -> DataFrame:
    """Hourly means of search rows; rows without a score count for the span."""
    return resample(df.where(F.startswith("user", F.lit("search:"))), "hour", (), score, dropna=False)


def account_heatmap(df: DataFrame, score: str = "score") -> DataFrame:
    """user, week, mean in long form."""
    return df.where(F.col(score).isNotNull()).groupBy("user", week_start(F.col("created_at")).alias("week")).agg(F.avg(score).alias("mean"))


def account_week_pivot(df: DataFrame, score: str = "score", weeks: list[str] | None = None) -> DataFrame:
    """user by week matrix; columns are the weeks' Mondays. Given weeks save Spark a pass to find them."""
    rows = df.where(F.col(score).isNotNull()).withColumn("week", F.date_format(week_start(F.col("created_at")), "yyyy-MM-dd"))
    return rows.groupBy("user").pivot("week", weeks).agg(F.avg(score))


def charts(df: DataFrame, scores: tuple[str, ...]) -> dict[str, DataFrame]:
    """All plot-ready frames for each score column that exists; search rows appear only in their own chart."""
    out = {}
    own = df.where(~F.startswith("user", F.lit("search:")))
    for s in (c for c in scores if c in df.columns):
        out |= {f"timeline_{s}": timeline(own, s), f"timeline_by_user_{s}": timeline(own, s, True), f"tiers_{s}": tier_comparison(own, s), f"heatmap_{s}": account_heatmap(own, s), f"search_{s}": public_search(df, s)}
    return out
