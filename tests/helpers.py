"""Plain-Python versions of operators, and table builders."""

from __future__ import annotations

BOXES = "video string, frame int, ord int, identity int, x1 int, y1 int, x2 int, y2 int"


def boxes(spark, rows):
    """rows of (frame, ord, identity, x1, y1, x2, y2)"""
    return spark.createDataFrame([("v", *r) for r in rows], BOXES)


def iou(a, b):
    wide = min(a[2], b[2]) - max(a[0], b[0])
    high = min(a[3], b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0
    if tuple(a) == tuple(b):
        return 1.0
    inter = wide * high
    area = lambda r: abs((r[2] - r[0]) * (r[3] - r[1]))
    return inter / (area(a) + area(b) - inter)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def mask_table(spark, lines, frame=1):
    """A picture in text, # for set pixels."""
    rows = [
        ("v", frame, y, x) for y, line in enumerate(lines) for x, c in enumerate(line) if c == "#"
    ]
    return spark.createDataFrame(rows, "video string, frame int, y int, x int")


def picture(df, width, height):
    on = {(r["y"], r["x"]) for r in df.collect()}
    return ["".join("#" if (y, x) in on else "." for x in range(width)) for y in range(height)]


def pixel_table(spark, frames, video="v"):
    """frames: {frame: 2-d list of values}"""
    rows = [
        (video, f, y, x, int(v))
        for f, image in frames.items()
        for y, line in enumerate(image)
        for x, v in enumerate(line)
    ]
    return spark.createDataFrame(rows, "video string, frame int, y int, x int, v int")
