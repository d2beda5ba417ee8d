"""Motion detection: preprocess, register, compare with history, find blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.operators import components as C
from trackframe.operators import morphology as MO
from trackframe.operators import pixels as PX
from trackframe.operators import registration as RG
from trackframe.operators import tiles as TI
from trackframe.operators.tracks import history_pairs
from trackframe.session import cut

PAIR = ["video", "frame", "hist_frame"]


@dataclass(frozen=True)
class MotionConfig:
    """Shipped parameters of the detector."""

    kernel_size: int = 3
    history_frames: int = 9
    good_match_percent: float = 0.3
    ransac_max_error: float = 5.0
    keypoints: int = 10_000
    keypoint_cell: int = 32
    scale_factor: int = 48
    dbscan_eps: float = 4.0
    dbscan_min_samples: int = 40
    dbscan_kernel: int = 5
    corrected: bool = False


def _pair_points(
    pairs: DataFrame, keypoints: DataFrame, words: list[str], frame_column: str, tag: str
) -> DataFrame:
    side = keypoints.select(
        "video", F.col("frame").alias(frame_column), "kp", "x", "y", *words
    )
    return pairs.join(side, ["video", frame_column]).select(
        *PAIR, "kp", F.col("x").alias(f"{tag}x"), F.col("y").alias(f"{tag}y"), *words
    )


def register_history(
    keypoints: DataFrame, words: list[str], config: MotionConfig, seed: int = 0
) -> DataFrame:
    """Matrices that take each history frame to its frame.

    ``keypoints(video, frame, kp, x, y, response, words...)``.
    """
    kept = RG.spatial_topk(keypoints, config.keypoints, config.keypoint_cell)
    pairs = history_pairs(kept.select("video", "frame"), config.history_frames)
    return _register(pairs, kept, words, config, seed, "hist_frame", "frame")


def register_previous(
    keypoints: DataFrame, words: list[str], config: MotionConfig, seed: int = 0
) -> DataFrame:
    """Matrix of each frame that takes it to the frame before it."""
    kept = RG.spatial_topk(keypoints, config.keypoints, config.keypoint_cell)
    pairs = history_pairs(kept.select("video", "frame"), config.history_frames)
    newest = pairs.filter(F.col("hist_frame") == F.col("frame") - 1)
    return _register(newest, kept, words, config, seed, "frame", "hist_frame").drop("hist_frame")


def _register(pairs, keypoints, words, config, seed, source, target) -> DataFrame:
    a = _pair_points(pairs, keypoints, words, source, "")
    b = _pair_points(pairs, keypoints, words, target, "m")
    matches = RG.match_descriptors(a, b, words, keys=PAIR)
    good = RG.top_fraction(matches, config.good_match_percent, PAIR)
    points = good.join(a.select(*PAIR, "kp", "x", "y"), [*PAIR, "kp"]).join(
        b.select(*PAIR, F.col("kp").alias("match"), "mx", "my"), [*PAIR, "match"]
    )
    return RG.estimate_transform(points, config.ransac_max_error, seed=seed, keys=PAIR)


def features(
    pixels: DataFrame,
    transforms: DataFrame | None,
    width: int,
    height: int,
    config: MotionConfig,
) -> DataFrame:
    """Blurred pixels with weight, dissimilarity and background of their history.

    Without transforms the camera is taken to be still, and no copies are made.
    """
    gray = MO.box_blur(pixels, config.kernel_size, width, height)
    h, scale = config.history_frames, config.scale_factor
    if transforms is None:
        return PX.rolling_history(gray, h, scale)
    warped = RG.warp_history(gray, transforms, width, height)
    return gray.join(PX.anchored_history(warped, h, scale), PX.PIXEL)


def motion_mask(
    pixels: DataFrame,
    transforms: DataFrame | None,
    width: int,
    height: int,
    config: MotionConfig = MotionConfig(),
) -> DataFrame:
    """Cleaned sparse mask of moving pixels.

    The raw mask is materialized: it is a small part of the pixels, and the
    density test reads it several times.
    """
    history = config.history_frames
    found = PX.subtract_background(
        features(pixels, transforms, width, height, config), history
    )
    if transforms is not None:
        seen = F.col("covered_all" if config.corrected else "covered")
        found = found.filter(seen == 1)
    moving = PX.moving_foreground(found, history, config.corrected)
    dense = MO.density_filter(
        cut(MO.set_pixels(moving)), config.dbscan_eps, config.dbscan_min_samples
    )
    return MO.close_mask(dense, config.dbscan_kernel, width, height)


def motion_detect(
    pixels: DataFrame,
    transforms: DataFrame | None,
    width: int,
    height: int,
    config: MotionConfig = MotionConfig(),
) -> DataFrame:
    """Boxes of moving blobs: video, frame, ord, x1, y1, x2, y2."""
    mask = motion_mask(pixels, transforms, width, height, config)
    return C.detect_blobs(mask, height).drop("hole")


def motion_mask_tiles(
    tiles: DataFrame,
    transforms: DataFrame | None,
    grid: TI.Grid,
    config: MotionConfig = MotionConfig(),
) -> DataFrame:
    """As :func:`motion_mask`, from tiles; pixels are rows only where the mask is set."""
    history, scale = config.history_frames, config.scale_factor
    gray = TI.box_blur(tiles, config.kernel_size, grid)
    if transforms is None:
        moving = TI.layer(TI.rolling_history(gray, history, scale, grid, config.corrected), "moving")
    else:
        # read as frames and as their history
        found = TI.anchored_history(cut(gray), transforms, history, scale, grid, config.corrected)
        moving = TI.seen_moving(found, config.corrected)
    cleaned = TI.clean_mask(
        moving, config.dbscan_eps, config.dbscan_min_samples, config.dbscan_kernel, grid
    )
    return TI.to_pixels(cleaned, grid, {"data": "v"}, only_set=True).drop("v")


def motion_detect_tiles(
    tiles: DataFrame,
    transforms: DataFrame | None,
    grid: TI.Grid,
    config: MotionConfig = MotionConfig(),
) -> DataFrame:
    """Boxes of moving blobs, from images of any size as tiles."""
    mask = motion_mask_tiles(tiles, transforms, grid, config)
    return C.detect_blobs(mask, grid.height).drop("hole")
