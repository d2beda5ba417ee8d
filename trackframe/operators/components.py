"""Connected components of masks, as boxes, centers and holes.

Pixels become horizontal runs first; runs of neighbouring rows that touch are
linked, and components are found on runs, which are far fewer than pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators.pixels import FRAME, PIXEL
from trackframe.session import cut, spread

ROW = ["video", "frame", "y"]

# Runs are labelled in blocks of this many frames and image rows; labels that meet
# at a border between two bands of rows are merged afterwards.
FRAME_BLOCK = 32
BAND_ROWS = 256


def mask_runs(mask: DataFrame) -> DataFrame:
    """Maximal horizontal runs (video, frame, y, xs, xe), xe exclusive."""
    row = Window.partitionBy(*ROW).orderBy("x")
    return (
        mask.select(*PIXEL)
        .withColumn("island", F.col("x") - F.row_number().over(row))
        .groupBy(*ROW, "island")
        .agg(F.min("x").alias("xs"), (F.max("x") + 1).alias("xe"))
        .drop("island")
    )


def gap_runs(runs: DataFrame, height: int) -> DataFrame:
    """Background runs between two runs of a row, flagged when they see the outside.

    A background pixel that reaches the image border is no part of a hole. A gap
    sees the outside on the first and last row, and where the row above or
    below has no set pixel on one of its sides.
    """
    row = Window.partitionBy(*ROW).orderBy("xs")
    gaps = (
        runs.withColumn("next", F.lead("xs").over(row))
        .filter(F.col("next").isNotNull())
        .select(*ROW, F.col("xe").alias("xs"), F.col("next").alias("xe"))
    )
    extent = runs.groupBy(*ROW).agg(F.min("xs").alias("lo"), F.max("xe").alias("hi"))
    for step, tag in ((-1, "up"), (1, "dn")):
        beside = extent.select(
            *FRAME,
            (F.col("y") - step).alias("y"),
            F.col("lo").alias(f"lo_{tag}"),
            F.col("hi").alias(f"hi_{tag}"),
        )
        gaps = gaps.join(beside, ROW, "left")

    def open_to(tag: str) -> Column:
        lo, hi = F.col(f"lo_{tag}"), F.col(f"hi_{tag}")
        return lo.isNull() | (F.col("xs") < lo) | (F.col("xe") > hi)

    border = (F.col("y") == 0) | (F.col("y") == height - 1)
    return gaps.select(
        *ROW, "xs", "xe", (border | open_to("up") | open_to("dn")).alias("outside")
    )


def _run_key() -> Column:
    return F.struct("y", "xs")


def run_links(runs: DataFrame, diagonal: bool) -> DataFrame:
    """Pairs (a, b) of run keys that touch, b in the row below a."""
    reach = 1 if diagonal else 0
    upper = runs.select(
        *FRAME, (F.col("y") + 1).alias("y"), F.struct("y", "xs").alias("a"), "xs", "xe"
    )
    lower = runs.select(
        *FRAME,
        "y",
        F.struct("y", "xs").alias("b"),
        F.col("xs").alias("ls"),
        F.col("xe").alias("le"),
    )
    touch = (F.col("ls") < F.col("xe") + reach) & (F.col("xs") < F.col("le") + reach)
    return upper.join(lower, ROW).filter(touch).select(*FRAME, "a", "b")


def _label_block(key, pdf):
    """Label the runs of a block of frames: linked runs share their first run.

    Positions become one number per run, in frame, row, column order; labels
    shrink along links and are followed to their end until nothing changes.
    """
    import numpy as np
    import pandas as pd

    first = pdf["frame"].min()
    wide = int(max(pdf["ax"].max(), pdf["bx"].max())) + 1
    high = int(max(pdf["ay"].max(), pdf["by"].max())) + 1

    def code(rows, y, x):
        frame = (rows["frame"] - first).to_numpy(dtype="int64")
        return (frame * high + rows[y].to_numpy()) * wide + rows[x].to_numpy()

    links = pdf[pdf["kind"] == 1]
    runs = pdf[pdf["kind"] == 0]
    codes = code(runs, "ay", "ax")
    order = np.argsort(codes)
    runs, codes = runs.iloc[order], codes[order]
    a = np.searchsorted(codes, code(links, "ay", "ax"))
    b = np.searchsorted(codes, code(links, "by", "bx"))
    label = np.arange(len(codes))
    while True:
        low = np.minimum(label[a], label[b])
        moved = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(moved, end, low)
        while True:
            further = moved[moved]
            if (further == moved).all():
                break
            moved = further
        if (moved == label).all():
            break
        label = moved
    root = runs.iloc[label]
    return pd.DataFrame(
        {
            "video": key[0],
            "frame": runs["frame"].to_numpy(),
            "y": runs["ay"].to_numpy(),
            "xs": runs["ax"].to_numpy(),
            "ly": root["ay"].to_numpy(),
            "lx": root["ax"].to_numpy(),
        }
    )


def _types(df: DataFrame) -> str:
    kind = {name: df.schema[name].dataType.simpleString() for name in ("video", "frame")}
    return f"video {kind['video']}, frame {kind['frame']}"


def _label_bands(runs: DataFrame, links: DataFrame, band_rows: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    y, x = F.col("y").cast("long"), F.col("xs").cast("long")
    nodes = runs.select(
        *FRAME, zero.alias("kind"), y.alias("ay"), x.alias("ax"), zero.alias("by"), zero.alias("bx")
    )
    edges = links.select(
        *FRAME,
        (zero + 1).alias("kind"),
        F.col("a.y").cast("long").alias("ay"),
        F.col("a.xs").cast("long").alias("ax"),
        F.col("b.y").cast("long").alias("by"),
        F.col("b.xs").cast("long").alias("bx"),
    )
    out = f"{_types(runs)}, y bigint, xs bigint, ly bigint, lx bigint"
    rows = nodes.unionByName(edges).withColumns(
        {"block": F.floor(F.col("frame") / FRAME_BLOCK), "band": F.floor(F.col("ay") / band_rows)}
    )
    keys = ["video", "block", "band"]
    return spread(rows, *keys).groupBy(*keys).applyInPandas(_label_block, out)


def _merge_labels(links: DataFrame) -> DataFrame:
    """(frame, a, root): the least label that a label is linked to, by star contraction.

    ``links`` are pairs (a, b) of labels that meet at a border between bands, which are
    few. Every node's neighbours are re-hung on its smallest neighbour, first for the
    larger ones, then for all, until nothing moves.
    """

    def both_ways(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(*FRAME, F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, larger: bool) -> DataFrame:
        """Hang the (larger or smaller) neighbours of each node on its minimum."""
        around = both_ways(e) if larger else e.select(
            *FRAME, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        low = around.groupBy(*FRAME, "a").agg(F.min("b").alias("m")).withColumn(
            "m", F.least("m", "a")
        )
        hung = around.join(low, [*FRAME, "a"])
        if larger:
            return hung.filter(F.col("b") > F.col("a")).select(
                *FRAME, F.col("b").alias("a"), F.col("m").alias("b")
            ).distinct()
        return (
            hung.select(*FRAME, "b", "m")
            .unionByName(low.select(*FRAME, F.col("a").alias("b"), "m"))
            .filter(F.col("b") != F.col("m"))
            .select(*FRAME, F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64(*FRAME, "a", "b"))).first())

    edges = cut(links)
    before, now = None, signature(edges)
    while now != before:
        edges = cut(star(star(edges, True), False))
        before, now = now, signature(edges)
    return edges.groupBy(*FRAME, "a").agg(F.min("b").alias("root"))


def label_runs(runs: DataFrame, diagonal: bool = True, band_rows: int = BAND_ROWS) -> DataFrame:
    """Add (ly, lx), the start of the first run of each run's component."""
    links = run_links(runs, diagonal)
    band = lambda y: F.floor(F.col(y) / band_rows)
    same = band("a.y") == band("b.y")
    labels = _label_bands(runs, links.filter(same), band_rows)
    if not runs.filter(F.col("y") >= band_rows).isEmpty():  # else there is no border
        labels = cut(labels)
        label = F.struct(F.col("ly").alias("y"), F.col("lx").alias("xs"))

        def end(name: str) -> DataFrame:
            return labels.select(
                *FRAME, F.col("y").alias(f"{name}_y"), F.col("xs").alias(f"{name}_x"),
                label.alias(f"{name}_label"),
            )

        crossing = links.filter(~same).select(
            *FRAME, *[F.col(f"{n}.{f}").cast("long").alias(f"{n}_{t}")
                      for n in ("a", "b") for f, t in (("y", "y"), ("xs", "x"))]
        )
        met = (
            crossing.join(end("a"), [*FRAME, "a_y", "a_x"]).join(end("b"), [*FRAME, "b_y", "b_x"])
            .select(*FRAME, F.col("a_label").alias("a"), F.col("b_label").alias("b"))
            .distinct()
        )
        roots = _merge_labels(met)
        labels = labels.withColumn("a", label).join(roots, [*FRAME, "a"], "left").select(
            *FRAME, "y", "xs",
            F.coalesce("root.y", "ly").alias("ly"), F.coalesce("root.xs", "lx").alias("lx"),
        )
    return runs.withColumns(
        {"y": F.col("y").cast("long"), "xs": F.col("xs").cast("long")}
    ).join(labels, [*FRAME, "y", "xs"])


LABEL = ["video", "frame", "ly", "lx"]


def component_runs(mask: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    return label_runs(cut(mask_runs(mask)), True, band_rows)


def connected_components(mask: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """Set pixels with the label (ly, lx) of their 8-connected component."""
    runs = component_runs(mask, band_rows)
    return runs.select(
        *LABEL, "y", F.explode(F.sequence(F.col("xs"), F.col("xe") - 1)).alias("x")
    )


def component_boxes(mask: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """Bounding box per component, x2 and y2 exclusive."""
    return _boxes(component_runs(mask, band_rows))


def _boxes(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*LABEL).agg(
        F.min("xs").alias("x1"),
        F.min("y").alias("y1"),
        F.max("xe").alias("x2"),
        (F.max("y") + 1).alias("y2"),
    )


def component_centroids(mask: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """Mean pixel position per component, cut to whole pixels."""
    runs = component_runs(mask, band_rows)
    size = F.col("xe") - F.col("xs")
    # sum of xs .. xe-1
    total_x = (F.col("xs") + F.col("xe") - 1) * size / 2
    return (
        runs.groupBy(*LABEL)
        .agg(
            F.sum(size).alias("pixels"),
            F.sum(total_x).alias("sx"),
            F.sum(F.col("y") * size).alias("sy"),
        )
        .select(
            *LABEL,
            "pixels",
            (F.col("sx") / F.col("pixels")).cast("int").alias("cx"),
            (F.col("sy") / F.col("pixels")).cast("int").alias("cy"),
        )
    )


def detect_blobs(mask: DataFrame, height: int, band_rows: int = BAND_ROWS) -> DataFrame:
    """Boxes of components and of holes; ``ord`` lists them top to bottom per frame.

    A hole is a 4-connected background part that does not reach the border; its
    box is that of the set pixels around it, one pixel larger on every side.
    """
    runs = cut(mask_runs(mask))
    outer = _boxes(label_runs(runs, True, band_rows)).withColumn("hole", F.lit(False))
    inner = (
        label_runs(cut(gap_runs(runs, height)), False, band_rows)
        .groupBy(*LABEL)
        .agg(
            (F.min("xs") - 1).alias("x1"),
            (F.min("y") - 1).alias("y1"),
            (F.max("xe") + 1).alias("x2"),
            (F.max("y") + 2).alias("y2"),
            F.bool_or("outside").alias("outside"),
        )
        .filter(~F.col("outside"))
        .drop("outside")
        .withColumn("hole", F.lit(True))
    )
    order = Window.partitionBy(*FRAME).orderBy("y1", "x1", "y2", "x2", "hole")
    return outer.unionByName(inner).select(
        *FRAME,
        (F.row_number().over(order) - 1).alias("ord"),
        *[F.col(n).cast("int").alias(n) for n in ("x1", "y1", "x2", "y2")],
        "hole",
    )
