"""Track stored detections: boxes and matrices to tracks and confirmed regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators import particles as PA
from trackframe.operators.tracks import observation_hysteresis
from trackframe.session import cut
from trackframe.sources import sinks
from trackframe.sources.files import read_results


def track_results(
    spark: SparkSession,
    path: str,
    video: str | None = None,
    with_history: bool = False,
    **options,
) -> DataFrame:
    """Read motion results, write tracks, history and regions below ``path``.

    Gives the confirmed regions.
    """
    boxes = read_results(spark, path, "motion_regions", video)
    matrices = read_results(spark, path, "transformations", video)
    if with_history:
        tracks, history = PA.tracks_and_history(boxes, matrices, **options)
    else:
        tracks, history = cut(PA.particle_filter(boxes, matrices, **options)), None
    sinks.write_tracks(tracks, history, path)
    regions = observation_hysteresis(tracks).withColumn("ord", F.col("identity"))
    sinks.write_regions(regions, path)
    return read_results(spark, path, "regions", video)
