"""Run metadata: key/value rows and ordered stage lists per pipeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_COLUMNS = ["pipeline", "key", "value"]


def metadata_rows(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of a run table as (pipeline, key, value) text rows."""
    text = {k: F.col(k).cast("string") for k in keys}
    return runs.withColumns(text).unpivot("pipeline", keys, "key", "value")


def config_row(runs: DataFrame, columns: list[str]) -> DataFrame:
    """The configuration of each run as one JSON value under the key config."""
    return runs.select(
        "pipeline", F.lit("config").alias("key"), F.to_json(F.struct(*columns)).alias("value")
    )


def stage_rows(runs: DataFrame, stages: str = "stages") -> DataFrame:
    """Stage lists as (pipeline, name, sort_order) rows from 0."""
    return runs.select("pipeline", F.posexplode(stages).alias("sort_order", "name")).select(
        "pipeline", "name", "sort_order"
    )


def replace_pipelines(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with those of the pipelines in ``fresh`` replaced."""
    done = fresh.select("pipeline").distinct()
    return stored.join(done, "pipeline", "left_anti").unionByName(fresh)


def write_run_metadata(metadata: DataFrame, stages: DataFrame, path: str) -> None:
    """Store both tables; only the folders of the given pipelines are replaced."""
    for rows, name in ((metadata, "metadata"), (stages, "stages")):
        (
            rows.write.partitionBy("pipeline")
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(f"{path}/{name}")
        )


def read_run_metadata(spark: SparkSession, path: str, name: str = "metadata") -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def repair_metadata(
    metadata: DataFrame, updates: DataFrame, inserts: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Change values by (keys, key) where an update exists, and add the inserts.

    ``keys`` names the result set, by default video. All result sets are
    repaired in one join.
    """
    on = [*(keys or ["video"]), "key"]
    new = updates.select(*on, F.col("value").alias("new_value"))
    changed = metadata.join(new, on, "left").withColumn(
        "value", F.coalesce("new_value", "value")
    )
    return reduce(
        DataFrame.unionByName, [changed.select(*metadata.columns), inserts.select(*metadata.columns)]
    )
