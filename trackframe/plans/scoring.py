"""Score detections against ground truth, from files to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackframe.operators import metrics as E
from trackframe.session import scratch_path
from trackframe.sources.files import read_regions
from trackframe.sources.sinks import write_metrics


def score_regions(calc: DataFrame, gt: DataFrame, **options) -> DataFrame:
    """Recall, precision and F1 per video."""
    return E.detection_scores(E.frame_counts(calc, gt, **options), ["video"])


def score_files(
    spark: SparkSession,
    calc_path: str,
    gt_path: str,
    metrics_path: str | None = None,
    video: str | None = None,
    **options,
) -> DataFrame:
    """Scores of two box files; per-frame counts are stored and scored from there."""
    calc = read_regions(spark, calc_path, video)
    gt = read_regions(spark, gt_path, video)
    counts = E.frame_counts(calc, gt, **options)
    stored = scratch_path(spark, "counts")
    counts.write.parquet(stored)
    counts = spark.read.parquet(stored)
    if metrics_path is not None:
        write_metrics(counts, metrics_path)
    return E.detection_scores(counts, ["video"])
