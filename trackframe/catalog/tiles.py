"""The pixel queries on tiles, against the same SQL as on pixel rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.catalog import ORACLES, query
from trackframe.catalog.pixels import SCALE, SIDE, SMALL, H, _shifts
from trackframe.operators import tiles as TI
from trackframe.plans import motion as MP
from trackframe.sources import fixtures as X
from trackframe.sources import frames as FR

#: Small tiles, so that frames have inner and outer borders.
GRID = TI.Grid(SIDE, SIDE, 3)


def same_as(name: str):
    """Register a query with the SQL of another one."""

    def register(build):
        registered = query(build.__name__)(build)
        ORACLES[build.__name__] = ORACLES[name]
        return registered

    return register


def _tiles(spark, sf):
    return TI.frame_tiles(FR.assemble_frames(X.pixels(spark, sf)), GRID)


def _mask(spark, sf):
    return TI.to_tiles(X.mask(spark, sf).withColumn("v", F.lit(255)), GRID)


def _set(tiles):
    return TI.to_pixels(tiles, GRID, {"data": "v"}, only_set=True).drop("v")


@same_as("explode_pixels")
def tile_pixels(spark, sf):
    """Pixels to tiles and back."""
    return TI.to_pixels(TI.to_tiles(X.pixels(spark, sf), GRID), GRID, {"data": "v"})


@same_as("box_blur")
def box_blur_tiles(spark, sf):
    return TI.to_pixels(TI.box_blur(_tiles(spark, sf), 3, GRID), GRID, {"data": "v"})


@same_as("box_blur_even")
def box_blur_even_tiles(spark, sf):
    return TI.to_pixels(TI.box_blur(_tiles(spark, sf), 4, GRID), GRID, {"data": "v"})


@same_as("warp_translate")
def warp_translate_tiles(spark, sf):
    return TI.to_pixels(TI.warp_history(_tiles(spark, sf), _shifts(spark, sf), GRID), GRID, {"data": "v"})


@same_as("coverage_masks")
def coverage_masks_tiles(spark, sf):
    return TI.to_pixels(TI.coverage_masks(_shifts(spark, sf), GRID), GRID, {"data": "v"})


@same_as("anchored_history")
def anchored_history_tiles(spark, sf):
    found = TI.anchored_history(_tiles(spark, sf), _shifts(spark, sf), H, SCALE, GRID)
    names = ("weight", "dissimilarity", "background", "covered", "covered_all")
    return TI.to_pixels(found, GRID, {n: n for n in names})


def _rolled(spark, sf, name, column, corrected=False):
    found = TI.rolling_history(_tiles(spark, sf), H, SCALE, GRID, corrected)
    return TI.to_pixels(found, GRID, {name: column})


@same_as("motion_weights")
def motion_weights_tiles(spark, sf):
    return _rolled(spark, sf, "weight", "weight")


@same_as("dissimilarity")
def dissimilarity_tiles(spark, sf):
    return _rolled(spark, sf, "dissimilarity", "dissimilarity")


@same_as("union_background")
def union_background_tiles(spark, sf):
    return _rolled(spark, sf, "background", "background")


@same_as("subtract_background")
def subtract_background_tiles(spark, sf):
    return _rolled(spark, sf, "foreground", "foreground")


@same_as("moving_foreground")
def moving_foreground_tiles(spark, sf):
    return _rolled(spark, sf, "moving", "v")


@same_as("moving_foreground_corrected")
def moving_foreground_corrected_tiles(spark, sf):
    return _rolled(spark, sf, "moving", "v", corrected=True)


@same_as("density_filter")
def density_filter_tiles(spark, sf):
    return _set(TI.density_filter(_mask(spark, sf), 1.5, 5, GRID))


@same_as("density_filter_wide")
def density_filter_wide_tiles(spark, sf):
    return _set(TI.density_filter(_mask(spark, sf), 2, 7, GRID))


@same_as("close_mask")
def close_mask_tiles(spark, sf):
    return _set(TI.close_mask(_mask(spark, sf), 3, GRID))


@same_as("motion_detect")
def motion_detect_tiles(spark, sf):
    return MP.motion_detect_tiles(_tiles(spark, sf), _shifts(spark, sf), GRID, SMALL)


@same_as("motion_detect_still")
def motion_detect_still_tiles(spark, sf):
    return MP.motion_detect_tiles(_tiles(spark, sf), None, GRID, SMALL)
