"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from trackframe import catalog
from trackframe.operators import tiles
from trackframe.plans import motion
from trackframe.session import drop_scratch, local_session
from trackframe.sources import fixtures

HEADLINE = [
    "iou_pairs",
    "greedy_match",
    "greedy_match_crowded",
    "detection_scores",
    "size_sweep",
    "greedy_assign",
    "suppress_duplicates",
    "velocity",
    "observation_hysteresis",
    "motion_only",
    "fingerprint",
    "compare_results",
    "pareto_front_3d",
    "front_history",
    "design_join",
    "dataset_results",
    "moving_foreground",
    "pixel_hysteresis",
    "box_blur",
    "density_filter",
    "connected_components",
    "anchored_history",
    "match_descriptors",
    "dead_reckoning",
    "particle_filter",
    "confirmed_tracks",
]


SIDE = 1024


def _enlarged(batches):
    """Images of 8 x 8 values as 1024 x 1024 bytes."""
    import numpy as np
    import pandas as pd

    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            small = np.clip((np.asarray(row.embedding, float) * 2 + 1) * 127.5, 0, 255)
            image = np.kron(small.reshape(8, 8), np.ones((SIDE // 8, SIDE // 8))).astype(np.uint8)
            rows.append((row.video, row.frame, SIDE, SIDE, image.tobytes()))
        yield pd.DataFrame(rows, columns=["video", "frame", "height", "width", "data"])


def large_detector(spark, sf_dir):
    """The detector on 12 frames of 1024 x 1024, made from the first video of the vectors."""
    rows = fixtures.vectors(spark, sf_dir).filter("video = 0 and frame <= 12")
    frames = rows.select("video", F.col("frame").cast("int").alias("frame"), "embedding").repartition(
        8
    ).mapInPandas(_enlarged, "video long, frame int, height int, width int, data binary")
    grid = tiles.Grid(SIDE, SIDE)
    return motion.motion_detect_tiles(tiles.frame_tiles(frames, grid), None, grid)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    queries, _ = catalog.load()
    queries = {**queries, "motion_detect_1024": large_detector}
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM paths and the Python workers before timing
    queries["at_frame"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries["pca_channels"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        drop_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
