"""Tiles give what pixel rows give, whatever the sizes of image and tile."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.helpers import pixel_table, rows_of
from trackframe.operators import morphology as MO
from trackframe.operators import pixels as PX
from trackframe.operators import registration as RG
from trackframe.operators import stacks as ST
from trackframe.operators import tiles as TI
from trackframe.operators.tracks import history_pairs
from trackframe.plans import motion as MP
from trackframe.schema import TRANSFORM_COLUMNS

WIDE, HIGH = 13, 9
PIXEL = ["frame", "y", "x"]


def images(frames, wide=WIDE, high=HIGH, seed=3):
    """Noise that stays the same for some frames at a time."""
    rng = np.random.default_rng(seed)
    still = rng.integers(0, 256, (high, wide))
    found = {}
    for f in range(1, frames + 1):
        changed = rng.random((high, wide)) < 0.4
        still = np.where(changed, rng.integers(0, 256, (high, wide)), still)
        found[f] = still.tolist()
    return found


def turns(spark, pairs, seed=1, strength=0.15):
    """A projective matrix for each pair, near the identity."""
    rng = np.random.default_rng(seed)
    rows = []
    for video, frame, hist in pairs:
        m = np.eye(3) + rng.normal(0, strength, (3, 3))
        m[:2, 2] = rng.normal(0, 2.0, 2)
        m[2] = [rng.normal(0, 0.004), rng.normal(0, 0.004), 1.0]
        rows.append((video, frame, hist, *map(float, m.reshape(-1))))
    ddl = "video string, frame int, hist_frame int, " + ", ".join(f"{n} double" for n in TRANSFORM_COLUMNS)
    return spark.createDataFrame(rows, ddl)


def pairs_of(spark, frames, history):
    table = spark.createDataFrame([("v", f) for f in range(1, frames + 1)], "video string, frame int")
    return sorted(tuple(r) for r in history_pairs(table, history).collect())


@pytest.mark.parametrize("tile", [1, 4, 5, 64])
def test_pixels_to_tiles_and_back(spark, tile):
    grid = TI.Grid(WIDE, HIGH, tile)
    pixels = pixel_table(spark, images(3))
    tiles = TI.to_tiles(pixels, grid)
    assert tiles.count() == 3 * math.ceil(WIDE / tile) * math.ceil(HIGH / tile)
    assert rows_of(TI.to_pixels(tiles, grid, {"data": "v"}), *PIXEL, "v") == rows_of(pixels, *PIXEL, "v")


@pytest.mark.parametrize("k,tile", [(1, 4), (2, 3), (3, 1), (3, 64), (4, 5), (5, 2), (7, 4)])
def test_blur(spark, k, tile):
    grid = TI.Grid(WIDE, HIGH, tile)
    pixels = pixel_table(spark, images(2))
    got = TI.to_pixels(TI.box_blur(TI.to_tiles(pixels, grid), k, grid), grid, {"data": "v"})
    assert rows_of(got, *PIXEL, "v") == rows_of(MO.box_blur(pixels, k, WIDE, HIGH), *PIXEL, "v")


def test_blur_refuses_a_kernel_larger_than_the_image(spark):
    grid = TI.Grid(3, 3)
    with pytest.raises(ValueError):
        TI.box_blur(TI.to_tiles(pixel_table(spark, {1: [[1] * 3] * 3}), grid), 7, grid)


def mask_of(spark, share, seed=2, frames=3):
    rng = np.random.default_rng(seed)
    rows = [("v", f, y, x) for f in range(1, frames + 1) for y in range(HIGH) for x in range(WIDE)
            if rng.random() < share]
    return spark.createDataFrame(rows, "video string, frame int, y int, x int")


def set_pixels(tiles, grid):
    return rows_of(TI.to_pixels(tiles, grid, {"data": "v"}, only_set=True), *PIXEL)


@pytest.mark.parametrize("eps,least,tile", [(1.0, 2, 3), (1.5, 4, 4), (2.5, 6, 2), (4.0, 20, 5), (3.0, 9, 64)])
def test_density(spark, eps, least, tile):
    grid, mask = TI.Grid(WIDE, HIGH, tile), mask_of(spark, 0.35)
    tiles = TI.to_tiles(mask.withColumn("v", F.lit(255)), grid)
    want = rows_of(MO.density_filter(mask, eps, least), *PIXEL)
    assert set_pixels(TI.density_filter(tiles, eps, least, grid), grid) == want


@pytest.mark.parametrize("k,tile", [(2, 3), (3, 4), (4, 2), (5, 5), (5, 64)])
def test_closing(spark, k, tile):
    grid, mask = TI.Grid(WIDE, HIGH, tile), mask_of(spark, 0.2)
    tiles = TI.to_tiles(mask.withColumn("v", F.lit(255)), grid)
    assert set_pixels(TI.close_mask(tiles, k, grid), grid) == rows_of(MO.close_mask(mask, k, WIDE, HIGH), *PIXEL)


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_projective_warp_and_coverage(spark, tile):
    grid, pixels = TI.Grid(WIDE, HIGH, tile), pixel_table(spark, images(5))
    matrices = turns(spark, pairs_of(spark, 5, 3))
    names = ["frame", "hist_frame", "y", "x"]
    got = TI.to_pixels(
        TI.warp_history(TI.to_tiles(pixels, grid), matrices, grid), grid, {"data": "v", "covered": "covered"}
    )
    want = RG.warp_history(pixels, matrices, WIDE, HIGH)
    assert rows_of(got, *names, "v", "covered") == rows_of(want, *names, "v", "covered")
    cover = TI.to_pixels(TI.coverage_masks(matrices, grid), grid, {"data": "v"})
    assert rows_of(cover, *names, "v") == rows_of(RG.coverage_masks(matrices, WIDE, HIGH), *names, "v")


def test_horizon_inside_the_image_and_matrices_that_leave_it(spark):
    grid, pixels = TI.Grid(WIDE, HIGH, 4), pixel_table(spark, images(2))
    rows = [
        ("v", 2, 1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, -0.15, 0.02, 1.0),  # w changes its sign
        ("v", 2, 2, 1.0, 0.0, 500.0, 0.0, 1.0, -900.0, 0.0, 0.0, 1.0),  # far outside
        ("v", 1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),  # no inverse
    ]
    ddl = "video string, frame int, hist_frame int, " + ", ".join(f"{n} double" for n in TRANSFORM_COLUMNS)
    matrices = spark.createDataFrame(rows, ddl)
    names = ["frame", "hist_frame", "y", "x"]
    got = TI.to_pixels(
        TI.warp_history(TI.to_tiles(pixels, grid), matrices, grid), grid, {"data": "v", "covered": "covered"}
    )
    want = RG.warp_history(pixels, matrices, WIDE, HIGH)
    assert rows_of(got, *names, "v", "covered") == rows_of(want, *names, "v", "covered")


@pytest.mark.parametrize("corrected", [False, True])
def test_history_of_a_still_camera(spark, corrected):
    grid, pixels = TI.Grid(WIDE, HIGH, 4), pixel_table(spark, images(9))
    found = TI.rolling_history(TI.to_tiles(pixels, grid), 4, 48, grid, corrected)
    features = PX.subtract_background(PX.rolling_history(pixels, 4, 48), 4)
    names = ["v", "weight", "dissimilarity", "background", "foreground"]
    got = TI.to_pixels(found, grid, {n: n for n in names})
    assert rows_of(got, *PIXEL, *names) == rows_of(features, *PIXEL, *names)
    moving = TI.to_pixels(found, grid, {"moving": "v"})
    assert rows_of(moving, *PIXEL, "v") == rows_of(PX.moving_foreground(features, 4, corrected), *PIXEL, "v")


def test_anchored_history_needs_all_matrices(spark):
    grid, pixels = TI.Grid(WIDE, HIGH, 5), pixel_table(spark, images(6))
    matrices = turns(spark, pairs_of(spark, 6, 4)).filter("not (frame = 6 and hist_frame = 3)")
    got = TI.anchored_history(TI.to_tiles(pixels, grid), matrices, 4, 48, grid)
    want = PX.anchored_history(RG.warp_history(pixels, matrices, WIDE, HIGH), 4, 48)
    names = ["weight", "dissimilarity", "background", "covered", "covered_all"]
    rows = rows_of(TI.to_pixels(got, grid, {n: n for n in names}), *PIXEL, *names)
    assert rows == rows_of(want, *PIXEL, *names) and {r[0] for r in rows} == {5}


@pytest.mark.parametrize("still,corrected", [(True, False), (False, False), (False, True)])
def test_whole_detector(spark, still, corrected):
    config = MP.MotionConfig(
        kernel_size=3, history_frames=4, dbscan_eps=1.5, dbscan_min_samples=3, dbscan_kernel=3,
        corrected=corrected,
    )
    grid, pixels = TI.Grid(WIDE, HIGH, 4), pixel_table(spark, images(8))
    matrices = None if still else turns(spark, pairs_of(spark, 8, 4), strength=0.01)
    got = MP.motion_detect_tiles(TI.to_tiles(pixels, grid), matrices, grid, config)
    want = MP.motion_detect(pixels, matrices, WIDE, HIGH, config)
    names = ["frame", "ord", "x1", "y1", "x2", "y2"]
    assert rows_of(got, *names) == rows_of(want, *names) and want.count() > 0


def test_a_large_frame_against_numpy(spark):
    """512 x 512 in tiles of 128: a shift by whole pixels, and no pixel row on the way."""
    size = 512
    rng = np.random.default_rng(8)
    data = {f: rng.integers(0, 256, (size, size), dtype=np.uint8) for f in (1, 2)}
    frames = spark.createDataFrame(
        [("v", f, size, size, bytearray(image.tobytes())) for f, image in data.items()],
        "video string, frame int, height int, width int, data binary",
    )
    grid = TI.Grid(size, size, 128)
    ddl = "video string, frame int, hist_frame int, " + ", ".join(f"{n} double" for n in TRANSFORM_COLUMNS)
    shift = spark.createDataFrame([("v", 2, 1, 1.0, 0.0, 37.0, 0.0, 1.0, -150.0, 0.0, 0.0, 1.0)], ddl)
    warped = TI.warp_history(TI.frame_tiles(frames, grid), shift, grid)
    want = np.zeros((size, size), np.uint8)
    want[: size - 150, 37:] = data[1][150:, : size - 37]
    got = np.zeros((size, size), np.uint8)
    rows = warped.collect()
    assert len(rows) == 16
    for r in rows:
        y0, y1, x0, x1 = grid.span(r["ty"], r["tx"])
        got[y0:y1, x0:x1] = grid.array(r["data"], r["ty"], r["tx"])
    assert (got == want).all()
    # each target tile reads the four source tiles that its corners reach, at most
    needed = TI._targets(shift, grid).groupBy("ty", "tx").count().agg(F.max("count")).first()[0]
    assert needed <= 6


def test_small_tiles_go_through_a_kernel_together(spark):
    grid = TI.Grid(WIDE, HIGH, 4)
    tiles = TI.to_tiles(pixel_table(spark, images(40)), grid)

    def count(canvases, borders):
        return np.full(canvases.shape, len(canvases))

    got = TI.to_pixels(TI.with_halo(tiles.coalesce(1), grid, 1, count), grid, {"data": "v"})
    # 40 frames in 8 partitions
    assert got.agg(F.max("v")).first()[0] > 1


def test_groups_go_together_and_are_never_cut(spark):
    rows = [("v", f, f % 2, 0, i) for f in range(50) for i in range(1 + 100 * (f == 7))]
    table = spark.createDataFrame(rows, "video string, frame int, ty int, tx int, i int").repartition(1)

    def count(part, starts):
        sizes = np.diff(np.r_[starts, len(part)]).astype(np.int32)
        columns = {"n": pa.array(sizes), "groups": pa.array(np.full(len(starts), len(starts), np.int32))}
        return ST.first_rows(part, starts, TI.KEY, columns)

    schema = "video string, frame int, ty int, tx int, n int, groups int"
    for batch in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = TI._grouped(table, TI.KEY, TI.Grid(8, 8, 4), count, schema).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r.frame, r.n) for r in got) == [(f, 101 if f == 7 else 1) for f in range(50)]
    assert max(r.groups for r in got) > 1
