"""Ranked and ordered work per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return first_n(df, keys, order, 1)


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark drops the rest before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def bad_revisions(df: DataFrame, key: str, revision: str) -> DataFrame:
    """Rows whose revision isn't that of their predecessor plus one (the first: 1), in the order of revisions."""
    before = F.lag(revision, 1, 0).over(Window.partitionBy(key).orderBy(revision))
    return df.withColumn("__b", before).filter(F.col(revision) != F.col("__b") + 1).drop("__b")


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: Column, budget: int, n: int) -> DataFrame:
    """For each key the first rows whose running size stays in the budget, n at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__s", run).withColumn("__n", F.row_number().over(w)).filter((F.col("__s") <= budget) & (F.col("__n") <= n)).drop("__s", "__n")
