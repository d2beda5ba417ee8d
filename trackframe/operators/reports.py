"""Comparison tables over videos and methods."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackframe.functions.scalars import pct, round2
from trackframe.operators import pareto as P

# Display names of the videos of each dataset.
VIDEO_NAMES = {
    "Video 1": "VISO/car/003",
    "Video 2": "VISO/car/004",
    "Video 3": "VISO/car/005",
    "Video 4": "VISO/car/006",
    "Video 5": "VISO/car/007",
    "Video 6": "VISO/car/008",
    "Video 7": "VISO/car/009",
}

# The three objective settings that are compared.
OBJECTIVE_SETTINGS = [
    ("Problem Objective function 1", 1024, 1024, True),
    ("Problem Objective function 2", 35, 35, True),
    ("Final Objective Function", 35, 35, False),
]
SETTING = ["max_width", "max_height", "allow_overlap"]

METRICS = ["recall", "prec", "f1"]


def names_table(spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """Dimension rows (name, video)."""
    return spark.createDataFrame(
        list((names or VIDEO_NAMES).items()), "name string, video string"
    )


def name_videos(df: DataFrame, names: DataFrame) -> DataFrame:
    """Add the display name; rows without one keep a null."""
    return df.join(names.select("video", "name"), "video", "left")


def videos_by_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Add the video of a display name."""
    return df.join(names.select("video", "name"), "name", "left")


def dataset_results(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per video recall, precision and F1 of the best F1 design, and the AP; two decimals."""
    keys = keys or ["video"]
    best = P.best_design(scores, "f1", keys).select(*keys, *METRICS)
    area = P.average_precision(P.pareto_front(scores, keys=keys), keys)
    return best.join(area, keys).select(
        *keys, *[round2(F.col(n)).alias(n) for n in METRICS], round2(F.col("ap")).alias("ap")
    )


def objective_table(scores: DataFrame) -> DataFrame:
    """Best F1 row and AP of each objective setting per video."""
    label = F.create_map(
        *chain.from_iterable(
            (F.lit(f"{w}|{h}|{str(o).lower()}"), F.lit(name))
            for name, w, h, o in OBJECTIVE_SETTINGS
        )
    )
    key = F.concat_ws("|", *[F.col(n).cast("string") for n in SETTING])
    named = dataset_results(scores, ["video", *SETTING]).withColumn(
        "objective_function", F.try_element_at(label, key)
    )
    return named.filter(F.col("objective_function").isNotNull()).withColumn(
        "allow_overlap", F.when(F.col("allow_overlap"), "yes").otherwise("no")
    )


def method_average(table: DataFrame) -> DataFrame:
    """Mean of each metric over videos as columns recall, precision, f1; two decimals."""
    wanted = ["recall", "precision", "f1"]
    return (
        table.groupBy("method")
        .agg(
            *[
                F.bround(F.avg(F.when(F.col("metric") == m, F.col("value"))), 2).alias(m)
                for m in wanted
            ]
        )
    )


def mean_ap(table: DataFrame) -> DataFrame:
    """Mean AP over videos per method; two decimals."""
    return (
        table.filter(F.col("metric") == "ap")
        .groupBy("method")
        .agg(F.bround(F.avg("value"), 2).alias("map"))
    )


def rank_methods(table: DataFrame, depth: int = 3) -> DataFrame:
    """Rows holding one of the ``depth`` highest distinct values of their column.

    Distinct values are taken first, so the ranking window sees each value once.
    """
    column = ["video", "metric"]
    order = Window.partitionBy(*column).orderBy(F.col("value").desc())
    ranked = (
        table.select(*column, "value")
        .distinct()
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= depth)
    )
    return table.join(ranked, [*column, "value"])


def add_method(table: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Append one method's (video, metric, value) rows, rounded to two decimals."""
    own = values.select(
        F.lit(name).alias("method"), "video", "metric", F.bround("value", 2).alias("value")
    )
    return table.select("method", "video", "metric", "value").unionByName(own)


def long_scores(results: DataFrame) -> DataFrame:
    """(video, recall, prec, f1) as (video, metric, value) rows."""
    renamed = results.withColumnRenamed("prec", "precision")
    return renamed.unpivot("video", ["recall", "precision", "f1"], "metric", "value")


def wide_table(table: DataFrame, videos: list[str], metrics: list[str]) -> DataFrame:
    """One row per method, one column per video and metric."""
    return table.groupBy("method").agg(
        *[
            F.max(
                F.when((F.col("video") == v) & (F.col("metric") == m), F.col("value"))
            ).alias(f"{v} {m}")
            for v in videos
            for m in metrics
        ]
    )


def side_by_side(table: DataFrame, summary: DataFrame) -> DataFrame:
    """Table rows with the summary columns of their method."""
    return table.join(summary, "method")


def sample_counts(scores: DataFrame, designs: int, keys: list[str] | None = None) -> DataFrame:
    """Per video sampled designs, their share of the space, and the front size."""
    keys = keys or ["video"]
    sampled = scores.groupBy(*keys).agg(F.count("*").alias("sampled_count"))
    front = P.pareto_front(scores, keys=keys).groupBy(*keys).agg(F.count("*").alias("front_count"))
    share = pct(F.col("sampled_count"), F.lit(float(designs)))
    return sampled.join(front, keys).select(
        *keys, "sampled_count", share.alias("sampled_percent"), "front_count"
    )


def average_samples(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    counts = scores.groupBy(*(keys or ["video"])).count()
    return counts.agg(F.avg("count").alias("avg_samples"))


def export_rows(scores: DataFrame, dataset: str, objective: str) -> DataFrame:
    """Sampled designs in the layout of the export file."""
    return scores.select(
        F.lit(dataset).alias("dataset"),
        F.col("video").cast("string").alias("video_name"),
        F.lit(objective).alias("objective_function"),
        "idx",
        "recall",
        F.col("prec").alias("precision"),
        "f1",
    )
