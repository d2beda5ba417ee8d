"""Box geometry as Column expressions.

A box argument is a tuple of four Columns (x1, y1, x2, y2); :func:`corners`
makes one from column names. x2 and y2 are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.schema import BOX_COLUMNS

Box = tuple[Column, Column, Column, Column]

SAME_REGION_IOU = 0.3


def corners(alias: str | None = None) -> Box:
    dot = f"{alias}." if alias else ""
    return tuple(F.col(f"{dot}{name}") for name in BOX_COLUMNS)


def box_width(box: Box) -> Column:
    return box[2] - box[0]


def box_height(box: Box) -> Column:
    return box[3] - box[1]


def box_area(box: Box) -> Column:
    return F.abs(box_width(box).cast("long") * box_height(box).cast("long"))


def intersection_area(a: Box, b: Box) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    zero = F.lit(0)
    return F.greatest(wide, zero).cast("long") * F.greatest(high, zero).cast("long")


def iou(a: Box, b: Box) -> Column:
    """Intersection over union: 0 without overlap, exactly 1 for equal boxes."""
    inter = intersection_area(a, b)
    same = (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])
    union = box_area(a) + box_area(b) - inter
    return (
        F.when(inter == 0, F.lit(0.0))
        .when(same, F.lit(1.0))
        .otherwise(inter.cast("double") / union)
    )


def same_region(a: Box, b: Box, threshold: float = SAME_REGION_IOU) -> Column:
    return iou(a, b) > F.lit(threshold)


def touches(a: Box, b: Box) -> Column:
    """True when the interiors of two well-formed boxes share a pixel."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def centroid(box: Box) -> tuple[Column, Column]:
    return box_width(box) / 2 + box[0], box_height(box) / 2 + box[1]


def point_distance(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    dx, dy = p[0] - q[0], p[1] - q[1]
    return F.sqrt(dx * dx + dy * dy)


def centroid_distance(a: Box, b: Box) -> Column:
    return point_distance(centroid(a), centroid(b))


def xywh_to_xyxy(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    return df.withColumns(
        {"x2": F.col("x1") + F.col(width), "y2": F.col("y1") + F.col(height)}
    ).drop(width, height)


def xyxy_to_xywh(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    box = corners()
    return df.withColumns({width: box_width(box), height: box_height(box)}).drop("x2", "y2")


def snap_box(box: Box) -> Box:
    """Whole-pixel box that covers a fractional one."""
    return (
        F.floor(box[0]).cast("int"),
        F.floor(box[1]).cast("int"),
        F.ceil(box[2]).cast("int"),
        F.ceil(box[3]).cast("int"),
    )


def _matrix(alias: str | None) -> list[list[Column]]:
    dot = f"{alias}." if alias else ""
    return [[F.col(f"{dot}t{r}{c}") for c in (1, 2, 3)] for r in (1, 2, 3)]


def transform_box(box: Box, alias: str | None = None) -> Box:
    """Both corners through the frame matrix: half-even round, no perspective divide."""
    m = _matrix(alias)

    def along(row: int, x: Column, y: Column) -> Column:
        return F.bround(m[row][0] * x + m[row][1] * y + m[row][2]).cast("int")

    x1, y1, x2, y2 = box
    return along(0, x1, y1), along(1, x1, y1), along(0, x2, y2), along(1, x2, y2)


def project_point(x: Column, y: Column, alias: str | None = None) -> tuple[Column, Column]:
    """A point through the frame matrix with perspective divide; (0, 0) at infinity."""
    m = _matrix(alias)
    px, py, w = (m[r][0] * x + m[r][1] * y + m[r][2] for r in (0, 1, 2))
    return (
        F.when(w != 0, px / w).otherwise(F.lit(0.0)),
        F.when(w != 0, py / w).otherwise(F.lit(0.0)),
    )


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(value, high), low)


def pad_box(box: Box, image_width: int, image_height: int) -> Box:
    """Grow by half the size on every side, half-even round, stay in the image.

    The top edge moves by half of the width, as published.
    """
    x1, y1, x2, y2 = box
    half_w, half_h = box_width(box) / 2, box_height(box) / 2
    zero = F.lit(0.0)
    return (
        F.bround(F.greatest(x1 - half_w, zero)).cast("int"),
        F.bround(F.greatest(y1 - half_w, zero)).cast("int"),
        F.least(F.bround(x2 + half_w), F.lit(image_width - 1)).cast("int"),
        F.least(F.bround(y2 + half_h), F.lit(image_height - 1)).cast("int"),
    )


def min_size(df: DataFrame, pixels: int) -> DataFrame:
    return df.filter(box_area(corners()) >= pixels)


def max_size(df: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    box = corners()
    if width is not None:
        df = df.filter(box_width(box) <= width)
    if height is not None:
        df = df.filter(box_height(box) <= height)
    return df


def observed_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("observed"))


def frame_slice(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Frames start..end, renumbered so that ``start`` becomes 1."""
    if start is not None:
        df = df.filter(F.col("frame") >= start)
    if end is not None:
        df = df.filter(F.col("frame") <= end)
    shift = (start - 1) if start else 0
    return df.withColumn("frame", F.col("frame") - F.lit(shift)) if shift else df


def at_frame(df: DataFrame, frame: int) -> DataFrame:
    return df.filter(F.col("frame") == frame)


def jitter_box(box: Box, seed: int, *key: Column) -> Box:
    """Predicted box: a short random step plus up to one pixel of corner noise.

    All draws come from a hash of (seed, key), so a re-run gives the same box.
    """

    def uniform(tag: str) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in key]))
        # 52 bits into (0, 1)
        bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
        return (bits + 0.5) / F.lit(float(1 << 52))

    x1, y1, x2, y2 = box
    length = F.sqrt(F.pow(box_width(box), F.lit(2.0)) + F.pow(box_height(box), F.lit(2.0)))
    gauss = F.sqrt(-2 * F.log(uniform("radius"))) * F.cos(2 * F.pi() * uniform("phase"))
    step = F.abs(gauss) * 0.01 * length
    angle = uniform("angle") * 2 * F.pi()
    dx, dy = F.bround(step * F.sin(angle)), F.bround(step * F.cos(angle))
    dx1, dy1, dx2, dy2 = (F.bround(uniform(t) - 0.5) for t in ("x1", "y1", "x2", "y2"))
    dx2, dy2 = F.greatest(dx1, dx2), F.greatest(dy1, dy2)
    return tuple(
        (edge + move + noise).cast("int")
        for edge, move, noise in ((x1, dx, dx1), (y1, dy, dy1), (x2, dx, dx2), (y2, dy, dy2))
    )
