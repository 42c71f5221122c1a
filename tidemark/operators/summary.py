"""Group summaries, source reports and column choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import LABEL_COLUMNS, SCORE_COLUMNS


def mean_by(df: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """Mean and non-null count of the score per key, lowest mean first."""
    return df.groupBy(*keys).agg(F.avg(score).alias("mean"), F.count(score).alias("n")).orderBy("mean", *keys)


def weekly(df: DataFrame, score: str = "score", with_year: bool = False) -> DataFrame:
    """Mean by ISO week number; without the year, weeks of different years fall together."""
    keys = [F.weekofyear("created_at").cast("long").alias("week")]
    if with_year:
        keys.insert(0, F.expr("extract(YEAROFWEEK FROM created_at)").cast("long").alias("iso_year"))
    return df.groupBy(*keys).agg(F.avg(score).alias("mean"), F.count(score).alias("n"))


def picked(df: DataFrame, candidates: tuple[str, ...], preferred: str | None = None) -> str:
    """The preferred column if there is one, else the first candidate with any value; one aggregate over all."""
    if preferred and preferred in df.columns:
        return preferred
    there = [c for c in candidates if c in df.columns]
    row = df.agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in there)).first() if there else None
    for c in there:
        if row[c]:
            return c
    raise ValueError(f"no score or label column holds a value: {df.columns}")


def score_column(df: DataFrame, preferred: str | None = None) -> str:
    return picked(df, SCORE_COLUMNS, preferred)


def label_column(df: DataFrame, preferred: str | None = None) -> str:
    return picked(df, LABEL_COLUMNS, preferred)


def picked_per_group(df: DataFrame, key: str, candidates: tuple[str, ...]) -> DataFrame:
    """key, picked: the choice made within each group, null where no candidate has a value."""
    has = [(c, F.max(F.col(c).isNotNull())) for c in candidates]
    choice = F.coalesce(*(F.when(h, F.lit(c)) for c, h in has))
    return df.groupBy(key).agg(choice.alias("picked"))


def pending(df: DataFrame, score: str = "score") -> DataFrame:
    """Rows that a scorer still has to see: no score, and some text."""
    from tidemark.functions.text import empty_text

    return df.where(F.col(score).isNull() & ~empty_text(F.col("text")))


def source_counts(sources: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows per source of a dimension, 0 for sources without any."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return sources.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def missing_sources(sources: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Sources of the dimension that have no row; handles are compared without case."""
    have = rows.select(F.lower(key).alias("_k")).distinct()
    return sources.join(have, F.lower(sources[key]) == F.col("_k"), "left_anti")


def coverage(collected: Column, reported: Column) -> Column:
    """Per cent collected; null where nothing was reported."""
    return F.try_divide(F.lit(100.0) * collected, reported)


def budget(accounts: DataFrame, terms: DataFrame, account_cap: int, term_cap: int, price: float) -> DataFrame:
    """Posts and cost of a full collection at the caps."""
    a = accounts.agg((F.count("*") * account_cap).alias("account_posts"))
    t = terms.agg((F.count("*") * term_cap).alias("term_posts"))
    both = a.join(t, F.lit(True))  # one row each
    return both.select("account_posts", "term_posts", (F.col("account_posts") + F.col("term_posts")).alias("posts")).withColumn("cost", F.col("posts") * F.lit(price))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of the total per value, most frequent first. The total is a window over one row per value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy(F.col("n").desc(), column)


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str] | None = None) -> DataFrame:
    """Row-normalised shares in per cent, one column per value; missing cells are 0."""
    pivot = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1)))
    names = [c for c in pivot.columns if c != rows]
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in names), F.lit(0))
    return pivot.select(rows, *((100.0 * F.coalesce(F.col(f"`{c}`"), F.lit(0)) / total).alias(c) for c in names))


def crosstab_long(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """The same as rows (row, column, per cent) for any number of values; empty cells are left out."""
    cells = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).agg(F.count("*").alias("n"))
    return cells.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(rows)))


def totals(df: DataFrame) -> DataFrame:
    """posts, slugs (distinct tracked posts), url_only and errors over all rows."""
    from tidemark.functions.text import url_only

    errors = F.count_if(F.col("stance") == "error") if "stance" in df.columns else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("posts"), F.count_distinct("tracked_slug").alias("slugs"), F.count_if(url_only(F.col("text"))).alias("url_only"), errors.alias("errors"))
