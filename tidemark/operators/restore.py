"""Scores of earlier runs put back by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(prior: DataFrame, keys: tuple[str, ...], columns: list[str], order: str | tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the last in *order*, or without one the last in the order of the table's files and rows.

    A table has no order but its files'; a frame that is not read from files needs *order* where keys repeat.
    Partial aggregates, so copies cost little.
    """
    order = (order,) if isinstance(order, str) else order
    rank = F.struct(*order) if order else F.struct(F.input_file_name(), F.expr("input_file_block_start()"), F.monotonically_increasing_id())
    rows = prior.select(*keys, F.struct(*columns).alias("p"), rank.alias("_rank"))
    return rows.groupBy(*keys).agg(F.max_by("p", "_rank").alias("p")).select(*keys, *(F.col("p")[c].alias(f"_prior_{c}") for c in columns))


def restore(current: DataFrame, prior: DataFrame, scorers: tuple[str, ...], keys: tuple[str, ...] = ("id",), order: str | tuple[str, ...] = (), overwrite: bool = False) -> DataFrame:
    """Fill score_<s> and label_<s> from *prior* where the current score is null (or wherever prior has one).

    Score and label move together: a row that keeps its score keeps its label.
    """
    columns = [f"{p}_{s}" for s in scorers for p in ("score", "label")]
    both = current.join(last_wins(prior, keys, columns, order), list(keys), "left")
    new = {}
    for s in scorers:
        take = F.col(f"_prior_score_{s}").isNotNull() if overwrite else F.col(f"score_{s}").isNull()
        for p in ("score", "label"):
            new[f"{p}_{s}"] = F.when(take, F.col(f"_prior_{p}_{s}")).otherwise(F.col(f"{p}_{s}"))
    return both.withColumns(new).select(*current.columns)


def coverage_of(current: DataFrame, checkpoint: DataFrame, key: str = "id") -> DataFrame:
    """rows, hits, complete: does a checkpoint hold all current rows?"""
    both = current.select(key).join(checkpoint.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return both.agg(F.count("*").alias("rows"), F.count("_hit").alias("hits")).withColumn("complete", F.col("rows") == F.col("hits"))
