"""Set comparisons between result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.schema import BOX_COLUMNS


def _sides(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Each distinct row once, with flags for the sides that hold it; one shuffle."""
    yes, no = F.lit(True), F.lit(False)
    return (
        a.select(*columns, yes.alias("in_a"), no.alias("in_b"))
        .unionByName(b.select(*columns, no.alias("in_a"), yes.alias("in_b")))
        .groupBy(*columns)
        .agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
    )


def one_sided(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct rows found on one side only, with ``side`` a or b."""
    columns = columns or a.columns
    return (
        _sides(a, b, columns)
        .filter(F.col("in_a") != F.col("in_b"))
        .select(*columns, F.when(F.col("in_a"), "a").otherwise("b").alias("side"))
    )


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Observed boxes of one result table that the other lacks, by frame."""
    columns = ["video", "frame", *BOX_COLUMNS]
    return one_sided(a.filter("observed"), b.filter("observed"), columns).orderBy(
        "frame", "side", "video", *BOX_COLUMNS
    )


def pending(known: DataFrame, current: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Requested rows that are not done yet."""
    columns = columns or known.columns
    return known.select(*columns).subtract(current.select(*columns))


def common(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or a.columns
    return a.select(*columns).intersect(b.select(*columns))


def stack_samples(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def sets_equal(a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``equal`` is true when both sides hold the same distinct rows."""
    return one_sided(a, b, columns).agg((F.count("*") == 0).alias("equal"))


def first_seen_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Ordered de-duplication: one row per key with its first position."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))
