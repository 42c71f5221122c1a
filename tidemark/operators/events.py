"""Event windows: posts before and after each event as an equi-join on days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bootstrap import REPLICATES, exact_diff_ci, poisson_diff_ci
from tidemark.sources.dims import small


def event_rows(posts: DataFrame, events: DataFrame, hours: int = 48) -> DataFrame:
    """Posts with every event whose window [c - h, c + h) they lie in, and whether they come after it.

    c is the event's midnight. Events are spread over the days that their windows touch and joined by day, so
    the join hashes on the day in place of comparing each post with each event; a residual condition settles
    the hours. The spread events are broadcast while they are few, else both sides are shuffled by day.
    """
    centre = F.col("date").cast("timestamp_ntz")
    dims = events.select(F.col("date").alias("event_date"), F.col("label").alias("event_label"), centre.alias("centre"))
    dims = dims.withColumns({"lo": F.col("centre") - F.expr(f"INTERVAL {hours} HOURS"), "hi": F.col("centre") + F.expr(f"INTERVAL {hours} HOURS")})
    days = F.sequence(F.to_date("lo"), F.to_date("hi"), F.expr("INTERVAL 1 DAY"))
    spread = small(dims.withColumn("day", F.explode(days)))
    at = F.col("created_at").cast("timestamp_ntz")
    rows = posts.withColumn("day", F.to_date("created_at")).join(spread, "day").where((at >= F.col("lo")) & (at < F.col("hi")))
    return rows.withColumn("is_post", at >= F.col("centre")).drop("day", "lo", "hi", "centre")


def compare_events(posts: DataFrame, events: DataFrame, hours: int = 48, score: str = "score", where: str | Column | None = None) -> DataFrame:
    """Rows and means before and after each event; events without rows are left out.

    n counts rows, means skip nulls. *where* is a Spark SQL predicate on posts.
    """
    rows = posts if where is None else posts.where(where)
    post = F.col("is_post")
    out = event_rows(rows.select("created_at", score), events, hours).groupBy("event_date", "event_label").agg(
        F.count_if(~post).alias("n_pre"),
        F.count_if(post).alias("n_post"),
        F.avg(F.when(~post, F.col(score))).alias("mean_pre"),
        F.avg(F.when(post, F.col(score))).alias("mean_post"),
    )
    return out.withColumns({"diff": F.col("mean_post") - F.col("mean_pre"), "window_hours": F.lit(hours), "event_date": F.date_format("event_date", "yyyy-MM-dd"), "score_col": F.lit(score)})


def compare_events_ci(posts: DataFrame, events: DataFrame, hours: int = 48, score: str = "score", where: str | Column | None = None, exact: bool = False, replicates: int = REPLICATES) -> DataFrame:
    """compare_events() with diff_ci_low and diff_ci_high, the bootstrap interval of the difference.

    The Poisson bootstrap takes windows of any size; *exact* resamples each event's rows in one task (posts need an id).
    """
    out = compare_events(posts, events, hours, score, where)
    rows = event_rows((posts if where is None else posts.where(where)).select("id", "created_at", score), events, hours)
    rows = rows.withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))
    by = ("event_date", "event_label")
    ci = exact_diff_ci(rows, by, "is_post", score) if exact else poisson_diff_ci(rows, by, "is_post", score, replicates)
    return out.join(ci.drop("diff"), list(by), "left")
