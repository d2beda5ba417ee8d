"""Neighbourhood operators on dense pixels and on sparse masks.

A sparse mask is ``mask(video, frame, y, x)``, one row per set pixel. Border
rule everywhere: pixels outside the image do not count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators.pixels import FRAME, ON, PIXEL


def _offsets(k: int) -> tuple[int, int]:
    """First and last offset of a k-wide kernel anchored at k // 2."""
    return -(k // 2), k - 1 - k // 2


# Dense pixels ---------------------------------------------------------------


def _mirrored(pixels: DataFrame, axis: str, size: int, low: int, high: int) -> DataFrame:
    """Add the mirror rows a window needs beyond both borders (edge not repeated)."""
    p = F.col(axis)
    spots = [p]
    # beyond the start, -p; beyond the end, 2 * (size - 1) - p
    if low < 0:
        spots.append(F.when((p >= 1) & (p <= -low), -p))
    if high > 0:
        back = 2 * (size - 1) - p
        spots.append(F.when((p <= size - 2) & (back <= size - 1 + high), back))
    return pixels.withColumn(axis, F.explode(F.array_compact(F.array(*spots))))


def box_blur(pixels: DataFrame, k: int, width: int, height: int) -> DataFrame:
    """k x k mean with mirrored border, rounded once, half to even.

    The kernel must not be larger than the image.
    """
    low, high = _offsets(k)
    if k // 2 >= min(width, height):
        raise ValueError("kernel larger than the image")
    across = (
        Window.partitionBy("video", "frame", "y").orderBy("x").rangeBetween(low, high)
    )
    down = Window.partitionBy("video", "frame", "x").orderBy("y").rangeBetween(low, high)
    wide = (
        _mirrored(pixels.select(*PIXEL, "v"), "x", width, low, high)
        .withColumn("s", F.sum("v").over(across))
        .filter((F.col("x") >= 0) & (F.col("x") < width))
    )
    both = (
        _mirrored(wide.select(*PIXEL, "s"), "y", height, low, high)
        .withColumn("s", F.sum("s").over(down))
        .filter((F.col("y") >= 0) & (F.col("y") < height))
    )
    return both.select(*PIXEL, F.bround(F.col("s") / float(k * k)).cast("int").alias("v"))


def _window_pass(pixels: DataFrame, k: int, agg) -> DataFrame:
    low, high = _offsets(k)
    across = (
        Window.partitionBy("video", "frame", "y").orderBy("x").rangeBetween(low, high)
    )
    down = Window.partitionBy("video", "frame", "x").orderBy("y").rangeBetween(low, high)
    return (
        pixels.select(*PIXEL, "v")
        .withColumn("v", agg("v").over(across))
        .withColumn("v", agg("v").over(down))
    )


def gray_erode(pixels: DataFrame, k: int) -> DataFrame:
    return _window_pass(pixels, k, F.min)


def gray_dilate(pixels: DataFrame, k: int) -> DataFrame:
    return _window_pass(pixels, k, F.max)


def threshold(pixels: DataFrame, limit: int) -> DataFrame:
    """255 above the limit, else 0."""
    return pixels.select(
        *PIXEL, F.when(F.col("v") > limit, F.lit(ON)).otherwise(F.lit(0)).alias("v")
    )


# Sparse masks ---------------------------------------------------------------


def set_pixels(values: DataFrame) -> DataFrame:
    """Pixels that are on, as a sparse mask."""
    return values.filter(F.col("v") == ON).select(*PIXEL)


def box_offsets(k: int) -> list[tuple[int, int]]:
    low, high = _offsets(k)
    return [(dy, dx) for dy in range(low, high + 1) for dx in range(low, high + 1)]


def ellipse_offsets(k: int) -> list[tuple[int, int]]:
    """Offsets of the filled ellipse inscribed in a k x k box."""
    c = k // 2
    cells = []
    for row in range(k):
        dy = row - c
        if c == 0:
            half = 0
        elif abs(dy) > c:
            continue
        else:
            half = round(c * math.sqrt((c * c - dy * dy) / (c * c)))
        first, last = max(c - half, 0), min(c + half, k - 1)
        cells += [(dy, col - c) for col in range(first, last + 1)]
    return cells


def _spread(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each set pixel offered to every pixel whose kernel covers it."""
    table = F.array(
        *[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx")) for dy, dx in offsets]
    )
    return mask.select(*FRAME, "y", "x", F.explode(table).alias("o")).select(
        *FRAME,
        (F.col("y") + F.col("o.dy")).alias("y"),
        (F.col("x") + F.col("o.dx")).alias("x"),
    )


def _in_image(width: int, height: int) -> Column:
    return F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)


def dilate(
    mask: DataFrame, offsets: list[tuple[int, int]], width: int, height: int
) -> DataFrame:
    """Pixels whose kernel covers a set pixel."""
    return _spread(mask, offsets).filter(_in_image(width, height)).distinct()


def erode(
    mask: DataFrame, offsets: list[tuple[int, int]], width: int, height: int
) -> DataFrame:
    """Pixels whose kernel covers only set pixels, inside the image."""
    needed = sum(
        (
            F.when(
                (F.col("x") + dx).between(0, width - 1) & (F.col("y") + dy).between(0, height - 1),
                1,
            ).otherwise(0)
            for dy, dx in offsets
        ),
        F.lit(0),
    )
    counts = _spread(mask, offsets).filter(_in_image(width, height)).groupBy(*PIXEL).count()
    return counts.filter(F.col("count") == needed).select(*PIXEL)


def close_mask(mask: DataFrame, k: int, width: int, height: int) -> DataFrame:
    """k x k dilate, then erode; the box splits into a row and a column pass."""
    low, high = _offsets(k)
    across = [(0, d) for d in range(low, high + 1)]
    down = [(d, 0) for d in range(low, high + 1)]
    grown = dilate(dilate(mask, across, width, height), down, width, height)
    return erode(erode(grown, across, width, height), down, width, height)


def open_close_mask(
    mask: DataFrame,
    erode_size: int,
    dilate_size: int,
    combine_size: int,
    width: int,
    height: int,
) -> DataFrame:
    """Elliptic erode and dilate, keep foreground that survived, then close."""
    eroded = erode(mask, ellipse_offsets(erode_size), width, height)
    opened = dilate(eroded, ellipse_offsets(dilate_size), width, height)
    kept = mask.select(*PIXEL).join(opened, PIXEL, "left_semi")
    shape = ellipse_offsets(combine_size)
    return erode(dilate(kept, shape, width, height), shape, width, height)


def group_filter(mask: DataFrame, size: int) -> DataFrame:
    """Set pixels with at least ``size`` set 8-neighbours."""
    around = [(dy, dx) for dy, dx in box_offsets(3) if (dy, dx) != (0, 0)]
    one, none = F.lit(1), F.lit(0)
    offered = _spread(mask, around).select(*PIXEL, one.alias("near"), none.alias("own"))
    own = mask.select(*PIXEL, none.alias("near"), one.alias("own"))
    return (
        offered.unionByName(own)
        .groupBy(*PIXEL)
        .agg(F.sum("near").alias("near"), F.max("own").alias("own"))
        .filter((F.col("own") == 1) & (F.col("near") >= size))
        .select(*PIXEL)
    )


def _near_counts(queries: DataFrame, sources: DataFrame, eps: float) -> DataFrame:
    """Query pixels with ``near``, the source pixels within ``eps`` of each.

    A source pixel is copied to the rows within reach only, with its row
    distance; how far it reaches along a row depends on that distance, so one
    window per row distance counts it. No pixel pairs are built.
    """
    reach = int(math.floor(eps))
    step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    copies = sources.select(*PIXEL, step.alias("d")).select(
        *FRAME,
        (F.col("y") + F.col("d")).alias("y"),
        "x",
        F.abs("d").alias("d"),
        F.lit(False).alias("asks"),
    )
    asks = queries.select(*PIXEL, F.lit(None).cast("int").alias("d"), F.lit(True).alias("asks"))
    row = Window.partitionBy("video", "frame", "y").orderBy("x")
    counts = []
    for d in range(reach + 1):
        half = int(math.floor(math.sqrt(eps * eps - d * d)))
        hit = F.when(F.col("d") == d, 1).otherwise(0)
        counts.append(F.sum(hit).over(row.rangeBetween(-half, half)))
    near = sum(counts[1:], counts[0])
    return (
        asks.unionByName(copies)
        .withColumn("near", near)
        .filter("asks")
        .select(*PIXEL, "near")
    )


def density_filter(mask: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Set pixels that density clustering would not call noise.

    A pixel is a core when at least ``min_samples`` set pixels lie within
    ``eps``, itself included. Cores and set pixels within ``eps`` of one stay.
    """
    cores = _near_counts(mask, mask, eps).filter(F.col("near") >= min_samples)
    return (
        _near_counts(mask, cores.select(*PIXEL), eps)
        .filter(F.col("near") >= 1)
        .select(*PIXEL)
    )
