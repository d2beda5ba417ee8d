"""Pixel algebra on ``pixels(video, frame, y, x, v)``.

History operators come in two forms with the same results. The rolling form
reads aligned frames (a still camera) with one window per pixel and no copies.
The anchored form reads ``history(video, frame, hist_frame, y, x, v)``, where
each frame carries its own warped copies of its predecessors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.functions.scalars import dim_outside, level3, quantize

FRAME = ["video", "frame"]
PIXEL = ["video", "frame", "y", "x"]
ON = 255
SAME_LEVELS = 1


def quantized(pixels: DataFrame, scale: int) -> DataFrame:
    return pixels.withColumn("q", quantize(F.col("v"), scale))


def pixel_align(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Same pixel of the same frame on both sides; values become va and vb."""
    left = a.select(*PIXEL, F.col("v").alias("va"))
    right = b.select(*PIXEL, F.col("v").alias("vb"))
    return left.join(right, PIXEL, how)


def scale_to_byte(pixels: DataFrame) -> DataFrame:
    """Multiply each frame by floor(255 / its maximum), by 1 for an all-zero frame."""
    peak = pixels.groupBy(*FRAME).agg(F.max("v").alias("peak"))
    factor = F.when(F.col("peak") > 0, F.floor(F.lit(255.0) / F.col("peak"))).otherwise(1)
    return pixels.join(peak, FRAME).select(
        *PIXEL, (F.col("v") * factor).cast("int").alias("v")
    )


def frame_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bits set on exactly one side."""
    return pixel_align(a, b).select(*PIXEL, F.col("va").bitwiseXOR(F.col("vb")).alias("v"))


def dim_overlay(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Halve the intensity outside a mask of set pixels."""
    on = mask.select(*PIXEL, F.lit(1).alias("m"))
    return pixels.join(on, PIXEL, "left").select(
        *PIXEL, dim_outside(F.col("v"), F.coalesce("m", F.lit(0))).alias("v")
    )


def frames_identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per video the first differing frame up to the shorter side, null for none."""
    zero = F.lit(0)
    none = F.lit(None).cast("int")
    rows = a.select(*PIXEL, F.col("v").alias("va"), none.alias("vb")).unionByName(
        b.select(*PIXEL, none.alias("va"), F.col("v").alias("vb"))
    )
    merged = rows.groupBy(*PIXEL).agg(F.max("va").alias("va"), F.max("vb").alias("vb"))
    ends = (
        a.select("video", F.col("frame").alias("fa"), zero.alias("fb"))
        .unionByName(b.select("video", zero.alias("fa"), F.col("frame").alias("fb")))
        .groupBy("video")
        .agg(F.least(F.max("fa"), F.max("fb")).alias("compared"))
    )
    first = (
        merged.filter(~F.col("va").eqNullSafe(F.col("vb")))
        .groupBy("video")
        .agg(F.min("frame").alias("first_diff"))
    )
    shown = F.when(F.col("first_diff") <= F.col("compared"), F.col("first_diff"))
    return ends.join(first, "video", "left").select(
        "video", "compared", shown.alias("first_diff"), shown.isNull().alias("identical")
    )


# History, rolling form ------------------------------------------------------


def _per_pixel() -> Window:
    return Window.partitionBy("video", "y", "x").orderBy("frame")


def intersect_pairs(pixels: DataFrame, scale: int) -> DataFrame:
    """Each pixel with its predecessor: change flag, difference, intersected value.

    ``inter`` is the older value, or 0 where the quantized change is at most one
    level. The first frame of a pixel has nulls.
    """
    w = _per_pixel()
    stepped = quantized(pixels, scale).withColumns(
        {"v0": F.lag("v").over(w), "q0": F.lag("q").over(w)}
    )
    same = F.abs(F.col("q") - F.col("q0")) <= SAME_LEVELS
    return stepped.withColumns(
        {
            "same": same,
            "diff": F.abs(F.col("v") - F.col("v0")),
            "inter": F.when(same, F.lit(0)).otherwise(F.col("v0")),
        }
    ).drop("v0", "q0")


def rolling_history(pixels: DataFrame, history: int, scale: int) -> DataFrame:
    """Weights, dissimilarity and background of each pixel's last ``history`` frames.

    The frame itself is left out; rows without a full history are dropped.
    """
    w = _per_pixel()
    # history frames f-H .. f-1 hold H-1 consecutive pairs, ending at f-H+1 .. f-1
    pairs = w.rowsBetween(-(history - 1), -1)
    same, diff, inter = F.col("same"), F.col("diff"), F.col("inter")
    rolled = intersect_pairs(pixels, scale).withColumns(
        {
            "held": F.row_number().over(w) - 1,
            "weight": F.sum(F.when(same, 1).otherwise(0)).over(pairs),
            "moved": F.sum(F.when(same, 0).otherwise(diff)).over(pairs),
            "union": F.last(F.when(inter != 0, inter), ignorenulls=True).over(pairs),
        }
    )
    return rolled.filter(F.col("held") >= history).select(
        *PIXEL,
        "v",
        F.col("weight").cast("int").alias("weight"),
        F.floor(F.col("moved") / history).cast("int").alias("dissimilarity"),
        F.coalesce("union", F.lit(0)).alias("background"),
    )


# History, anchored form -----------------------------------------------------


def anchored_history(history_pixels: DataFrame, history: int, scale: int) -> DataFrame:
    """The same features from per-frame warped histories; one grouping per pixel.

    A group holds the ``history`` values of one pixel of one frame. Where the
    warp came with ``covered``, that of the newest history frame and whether
    all are covered are passed on as ``covered`` and ``covered_all``.
    """
    q = quantize(F.col("v"), scale)
    extra = ["covered"] if "covered" in history_pixels.columns else []
    items = F.array_sort(F.collect_list(F.struct("hist_frame", "v", q.alias("q"), *extra)))
    grouped = history_pixels.groupBy(*PIXEL).agg(items.alias("h")).filter(
        F.size("h") == history
    )
    newer, older = F.slice("h", 2, history - 1), F.slice("h", 1, history - 1)
    pairs = F.zip_with(
        older,
        newer,
        lambda o, n: F.struct(
            (F.abs(n["q"] - o["q"]) <= SAME_LEVELS).alias("same"),
            F.abs(n["v"] - o["v"]).alias("diff"),
            o["v"].alias("old"),
        ),
    )
    zero = F.lit(0)
    return (
        grouped.withColumn("p", pairs)
        .select(
            *PIXEL,
            F.aggregate("p", zero, lambda s, e: s + F.when(e["same"], 1).otherwise(0)).alias(
                "weight"
            ),
            F.aggregate(
                "p", zero, lambda s, e: s + F.when(e["same"], 0).otherwise(e["diff"])
            ).alias("moved"),
            F.aggregate(
                "p",
                zero,
                lambda s, e: F.when(~e["same"] & (e["old"] != 0), e["old"]).otherwise(s),
            ).alias("background"),
            *(
                [
                    F.element_at("h", -1)["covered"].alias("covered"),
                    F.array_min(F.col("h.covered")).alias("covered_all"),
                ]
                if extra
                else []
            ),
        )
        .withColumn("dissimilarity", F.floor(F.col("moved") / history).cast("int"))
        .drop("moved")
    )


def motion_weights(pixels: DataFrame, history: int, scale: int) -> DataFrame:
    return rolling_history(pixels, history, scale).select(*PIXEL, "weight")


def history_of_dissimilarity(pixels: DataFrame, history: int, scale: int) -> DataFrame:
    return rolling_history(pixels, history, scale).select(*PIXEL, "dissimilarity")


def union_background(pixels: DataFrame, history: int, scale: int) -> DataFrame:
    return rolling_history(pixels, history, scale).select(*PIXEL, "background")


# Foreground -----------------------------------------------------------------


def foreground_value(v: Column, background: Column, weight: Column, history: int) -> Column:
    """Difference to the background, 0 where the pixel hardly ever changed."""
    return F.when(weight >= history - 1, F.lit(0)).otherwise(F.abs(v - background))


def subtract_background(features: DataFrame, history: int) -> DataFrame:
    """Add ``foreground`` to rows with v, background and weight."""
    value = foreground_value(F.col("v"), F.col("background"), F.col("weight"), history)
    return features.withColumn("foreground", value)


def moving_value(
    weight: Column,
    foreground: Column,
    dissimilarity: Column,
    history: int,
    corrected: bool = False,
) -> Column:
    """255 where a pixel moves, else 0."""
    third = (history - 1) // 3
    fg, dl = level3(foreground, corrected), level3(dissimilarity, corrected)
    medium = (weight > third) & (weight < history - 1) & (fg >= dl)
    low = (weight <= third) & (dl == 1) & (fg > dl)
    return F.when(medium | low, F.lit(ON)).otherwise(F.lit(0))


def moving_foreground(features: DataFrame, history: int, corrected: bool = False) -> DataFrame:
    """Rows with weight, foreground and dissimilarity to (pixel, v) with v 0 or 255."""
    value = moving_value(
        F.col("weight"), F.col("foreground"), F.col("dissimilarity"), history, corrected
    )
    return features.select(*PIXEL, value.alias("v"))


def apply_masks(moving: DataFrame, coverage: DataFrame, corrected: bool = False) -> DataFrame:
    """Multiply by the warped coverage of the history frames.

    ``coverage(video, frame, hist_frame, y, x, v)`` with v 0 or 1. Only the newest
    history frame counts, as published; ``corrected`` needs all of them.
    """
    newest = F.max_by("v", "hist_frame")
    every = F.min("v")
    kept = coverage.groupBy(*PIXEL).agg((every if corrected else newest).alias("c"))
    return moving.join(kept, PIXEL, "left").select(
        *PIXEL, (F.col("v") * F.coalesce("c", F.lit(0))).cast("int").alias("v")
    )


def pixel_hysteresis(
    mask: DataFrame,
    on_after: int,
    off_after: int | None = None,
    corrected: bool = False,
) -> DataFrame:
    """``mask(pixel, v)`` with v 0 or 255, smoothed over frames.

    A pixel switches on after ``on_after`` motion frames in a row and off after
    as many frames without, else it holds. ``corrected`` uses ``off_after`` to
    switch off.
    """
    off = off_after if corrected and off_after is not None else on_after
    w = _per_pixel()
    run = Window.partitionBy("video", "y", "x", "m", "island").orderBy("frame")
    value_rank = Window.partitionBy("video", "y", "x", "m").orderBy("frame")
    islands = mask.withColumn("m", F.col("v") == ON).withColumn(
        "island", F.row_number().over(w) - F.row_number().over(value_rank)
    )
    length = islands.withColumn("run", F.row_number().over(run))
    switch = F.when(F.col("m") & (F.col("run") == on_after), ON).when(
        ~F.col("m") & (F.col("run") == off), 0
    )
    held = F.last("switch", ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return length.withColumn("switch", switch).select(
        *PIXEL, F.coalesce(held, F.lit(0)).alias("v")
    )


# Regions over pixels --------------------------------------------------------


def region_pixels(regions: DataFrame, pixels: DataFrame, cell: int = 16) -> DataFrame:
    """Pixels inside each box; joined on grid cells of the frame."""
    from trackframe.operators.matching import to_cells

    boxes = to_cells(regions.select(*FRAME, "ord", *G.BOX_COLUMNS), cell)
    spread = pixels.withColumns(
        {"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)}
    )
    inside = (
        (F.col("x") >= F.col("x1"))
        & (F.col("x") < F.col("x2"))
        & (F.col("y") >= F.col("y1"))
        & (F.col("y") < F.col("y2"))
    )
    joined = boxes.join(spread, [*FRAME, "cx", "cy"]).filter(inside)
    return joined.select(*FRAME, "ord", "y", "x", "v")


def region_contrast(regions: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Population deviation of each padded box's gray levels over 255."""
    padded = regions.withColumns(
        dict(zip(G.BOX_COLUMNS, G.pad_box(G.corners(), width, height)))
    )
    scaled = F.stddev_pop(F.col("v") / 255.0)
    return region_pixels(padded, pixels).groupBy(*FRAME, "ord").agg(scaled.alias("contrast"))


def object_contrast(regions: DataFrame, pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Mean contrast of all boxes, per video."""
    return (
        region_contrast(regions, pixels, width, height)
        .groupBy("video")
        .agg(F.avg("contrast").alias("contrast"))
    )


# Colour ---------------------------------------------------------------------


def gray_pixels(colour: DataFrame) -> DataFrame:
    """(pixel, b, g, r) to (pixel, v)."""
    from trackframe.functions.scalars import to_gray

    return colour.select(*PIXEL, to_gray(F.col("b"), F.col("g"), F.col("r")).alias("v"))


def _principal_axes(rows):
    """Per video one covariance row to its three principal axes, strongest first."""
    import numpy as np
    import pandas as pd

    for batch in rows:
        out = []
        for row in batch.to_dict("records"):
            cov = np.array(
                [
                    [row["bb"], row["bg"], row["br"]],
                    [row["bg"], row["gg"], row["gr"]],
                    [row["br"], row["gr"], row["rr"]],
                ]
            )
            values, vectors = np.linalg.eigh(cov)
            axes = vectors[:, np.argsort(values)[::-1]].T
            lead = np.abs(axes).argmax(axis=1)
            axes = axes * np.sign(axes[range(3), lead])[:, None]
            out.append([row["video"], row["mb"], row["mg"], row["mr"], *axes.ravel()])
        yield pd.DataFrame(out, columns=["video", *PCA_COLUMNS])


PCA_COLUMNS = ["mb", "mg", "mr", *[f"a{i}{c}" for i in range(3) for c in "bgr"]]


def pca_channels(colour: DataFrame, corrected: bool = False) -> DataFrame:
    """Three principal components as bytes, fitted on each video's first frame.

    Components are scaled by their maximum in the frame to 255. Negative values
    wrap around, as published; ``corrected`` clamps them to 0.
    """
    pairs = [(a, b) for i, a in enumerate("bgr") for b in "bgr"[i:]]
    # The first frame is found by aggregation; only its pixels reach the fit.
    first = colour.groupBy("video").agg(F.min("frame").alias("frame"))
    moments = (
        colour.join(first, ["video", "frame"], "left_semi")
        .groupBy("video")
        .agg(
            *[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs],
            *[F.avg(c).alias(f"m{c}") for c in "bgr"],
        )
    )
    video_type = colour.schema["video"].dataType.simpleString()
    fields = ", ".join(f"{n} double" for n in PCA_COLUMNS)
    axes = moments.mapInPandas(_principal_axes, f"video {video_type}, {fields}")
    parts = {}
    for i in range(3):
        parts[f"c{i}"] = sum(
            (F.col(c) - F.col(f"m{c}")) * F.col(f"a{i}{c}") for c in "bgr"
        )
    projected = colour.join(axes, "video").select(*PIXEL, *[v.alias(n) for n, v in parts.items()])
    peaks = projected.groupBy(*FRAME).agg(*[F.max(n).alias(f"peak_{n}") for n in parts])

    def as_byte(name: str) -> Column:
        peak = F.col(f"peak_{name}")
        level = F.when(peak != 0, F.bround(F.col(name) / peak * 255)).otherwise(F.lit(0.0))
        whole = level.cast("int")
        return F.greatest(whole, F.lit(0)) if corrected else F.pmod(whole, F.lit(256))

    return projected.join(peaks, FRAME).select(*PIXEL, *[as_byte(n).alias(n) for n in parts])
