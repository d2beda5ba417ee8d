"""Whole workflows, and the shape of their plans."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import pixel_table, rows_of
from trackframe import catalog
from trackframe.operators import registration as RG
from trackframe.plans import motion as MP
from trackframe.plans.stages import chain

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.load()

# Queries that run Python by design: arrays of pixels, linear algebra, keyed state.
PYTHON = {
    "explode_pixels", "pca_channels", "estimate_transform", "connected_components",
    "connected_components_rounds", "component_boxes", "component_centroids", "detect_blobs", "motion_detect",
    "motion_detect_still", "motion_detect_still_tiles", "motion_detect_tiles", "dead_reckoning", "particle_filter", "particle_filter_persist",
    "particle_history", "confirmed_tracks", "motion_only_in_order",
}
# Queries that write or stream before they give a frame; their plan is a scan.
EAGER = {n for n in QUERIES if n.startswith(("stream_", "write_", "read_"))}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_shape(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "InPandas" not in plan and "ArrowEvalPython" not in plan


def test_scan_reads_needed_columns_only(spark):
    plan = QUERIES["frame_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def moving_square(frames=14, size=40, shift=0):
    """A bright square that moves over a dark floor; the camera may drift."""
    rng = np.random.default_rng(1)
    floor = rng.integers(20, 30, (size, size + 40))
    images = {}
    for f in range(1, frames + 1):
        scene = floor.copy()
        x = 4 + 2 * f
        scene[15:21, x : x + 6] = 220
        left = shift * f
        images[f] = scene[:, left : left + size] if shift else scene[:, :size]
    return images


CONFIG = MP.MotionConfig(
    kernel_size=3, history_frames=5, scale_factor=20, dbscan_eps=2, dbscan_min_samples=5, dbscan_kernel=3
)


def square_box(f, shift=0):
    x = 4 + 2 * f - shift * f
    return x, 15, x + 6, 21


def check_found(found, frames, shift=0):
    assert {r["frame"] for r in found} == set(frames)
    for r in found:
        x1, y1, x2, y2 = square_box(r["frame"], shift)
        assert r["x1"] < x2 + 4 and r["x2"] > x1 - 12 and r["y1"] < y2 and r["y2"] > y1


def test_still_camera_finds_the_square(spark):
    pixels = pixel_table(spark, moving_square())
    still = MP.motion_detect(pixels, None, 40, 40, CONFIG).collect()
    check_found(still, range(6, 15))


def drift_matrices(spark, frames, history, shift):
    rows = [
        ("v", f, h, 1.0, 0.0, float(-shift * (f - h)), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
        for f in frames for h in range(f - history, f) if h >= 1 and f > history
    ]
    ddl = "video string, frame int, hist_frame int, " + ", ".join(f"{n} double" for n in RG.TRANSFORM_COLUMNS)
    return spark.createDataFrame(rows, ddl)


def test_identity_matrices_equal_a_still_camera(spark):
    pixels = pixel_table(spark, moving_square(9, 24))
    zero = drift_matrices(spark, range(1, 10), 5, 0)
    names = ["frame", "x1", "y1", "x2", "y2"]
    still = MP.motion_detect(pixels, None, 24, 24, CONFIG)
    warped = MP.motion_detect(pixels, zero, 24, 24, CONFIG)
    assert rows_of(warped, *names) == rows_of(still, *names) != []


def test_drifting_camera_finds_the_square(spark):
    pixels = pixel_table(spark, moving_square(10, 30, 1))
    matrices = drift_matrices(spark, range(1, 11), 5, 1)
    every_mask = replace(CONFIG, corrected=True)
    check_found(MP.motion_detect(pixels, matrices, 30, 30, every_mask).collect(), range(6, 11), 1)
    # the newest mask alone lets columns through that older frames do not cover
    published = MP.motion_detect(pixels, matrices, 30, 30, CONFIG)
    assert published.filter("x2 >= 29 and frame = 6").count() > 0


def test_registration_recovers_a_drift(spark):
    rng = np.random.default_rng(2)
    spots = rng.uniform(0, 100, (60, 2))
    words = rng.integers(0, 2**62, (60, 2))
    rows = [
        ("v", f, i, float(x - 1.5 * f), float(y + 0.5 * f), float(i), int(words[i][0]), int(words[i][1]))
        for f in range(1, 8) for i, (x, y) in enumerate(spots)
    ]
    ddl = "video string, frame int, kp int, x double, y double, response double, w0 bigint, w1 bigint"
    config = MP.MotionConfig(history_frames=3, good_match_percent=0.8, keypoints=50)
    found = MP.register_history(spark.createDataFrame(rows, ddl), ["w0", "w1"], config)
    table = {(r["frame"], r["hist_frame"]): r for r in found.collect()}
    assert set(table) == {(f, f - k) for f in range(4, 8) for k in (1, 2, 3)}
    for (f, h), r in table.items():
        assert abs(r["t13"] + 1.5 * (f - h)) < 1e-6 and abs(r["t23"] - 0.5 * (f - h)) < 1e-6
    back = MP.register_previous(spark.createDataFrame(rows, ddl), ["w0", "w1"], config)
    assert {(r["frame"], round(r["t13"], 6)) for r in back.collect()} == {(f, 1.5) for f in range(4, 8)}


def test_user_stages_chain(spark):
    df = spark.range(10)
    got = chain(df, lambda d: d.filter("id > 2"), (lambda d, by: d.select((F.col("id") * by).alias("id")), {"by": 3}))
    assert [i for (i,) in rows_of(got, "id")] == [9, 12, 15, 18, 21, 24, 27]


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(entry.oracle_sql()) <= set(entry.queries())
