"""Where results live: folders by dataset, configuration, tracking, persist and design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE_KEYS = [
    "dataset", "config_hash", "tracking", "persist", "max_width", "max_height", "allow_overlap",
]


def result_rows(results: DataFrame, **key) -> DataFrame:
    """Rows of one address; keys are partition columns, so other folders are not read."""
    for name, value in key.items():
        results = results.filter(F.col(name) == F.lit(value))
    return results


def results_exist(results: DataFrame, **key) -> bool:
    """Whether any row is stored at an address; stops at the first."""
    return not result_rows(results, **key).limit(1).isEmpty()


def missing_results(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Addresses without any stored row."""
    return wanted.join(stored.select(*keys).distinct(), keys, "left_anti")


def score_lookup(scores: DataFrame, idx: int | None = None, **key) -> DataFrame:
    """Scores by their key parts; all but the design number are folders."""
    rows = result_rows(scores, **key)
    return rows if idx is None else rows.filter(F.col("idx") == idx)


def score_rows(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scores of many addresses at once."""
    return scores.join(wanted, [n for n in wanted.columns if n in scores.columns], "left_semi")


def dataset_of(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct datasets: the part of img paths between Datasets/ and /img/."""
    name = F.regexp_extract(F.col(column), r"Datasets/(.+)/img/[^/]*$", 1)
    return paths.select(name.alias("dataset")).filter("dataset <> ''").distinct()


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Datasets with an img folder below a root; reads names only."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path")
    )
    return dataset_of(listing)
