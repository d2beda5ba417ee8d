"""Frames as binary rows and as pixel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pixel_rows(batches):
    import numpy as np
    import pandas as pd

    for batch in batches:
        for row in batch.itertuples(index=False):
            shape = (row.height, row.width, row.channels)
            image = np.frombuffer(row.data, dtype=np.uint8).reshape(shape)
            y, x = np.divmod(np.arange(row.height * row.width), row.width)
            flat = image.reshape(-1, row.channels).astype("int32")
            out = {"video": row.video, "frame": row.frame, "y": y, "x": x}
            names = ["v"] if row.channels == 1 else ["b", "g", "r"]
            out.update({n: flat[:, i] for i, n in enumerate(names)})
            yield pd.DataFrame(out)


def explode_pixels(frames: DataFrame, channels: int = 1) -> DataFrame:
    """Frames to one row per pixel: v, or b, g, r for three channels."""
    kind = {n: frames.schema[n].dataType.simpleString() for n in ("video", "frame")}
    values = "v int" if channels == 1 else "b int, g int, r int"
    schema = f"video {kind['video']}, frame {kind['frame']}, y int, x int, {values}"
    rows = frames.filter(F.col("channels") == channels).select(
        "video", "frame", "height", "width", "channels", "data"
    )
    return rows.mapInPandas(_pixel_rows, schema)


def assemble_frames(pixels: DataFrame) -> DataFrame:
    """Dense gray pixel rows to one binary row per frame.

    Image rows are put together first, then the frame from its rows.
    """
    byte = F.lpad(F.hex("v"), 2, "0")
    ordered = F.array_sort(F.collect_list(F.struct("x", byte.alias("t"))))
    rows = pixels.groupBy("video", "frame", "y").agg(
        F.array_join(F.transform(ordered, lambda e: e["t"]), "").alias("t"),
        F.count("*").cast("int").alias("width"),
    )
    stacked = F.array_sort(F.collect_list(F.struct("y", "t")))
    return rows.groupBy("video", "frame").agg(
        F.count("*").cast("int").alias("height"),
        F.max("width").alias("width"),
        F.lit(1).alias("channels"),
        F.unhex(F.array_join(F.transform(stacked, lambda e: e["t"]), "")).alias("data"),
    )


def explode_array_pixels(frames: DataFrame, values: str, width: int) -> DataFrame:
    """Frames held as an array column to pixel rows, without leaving the JVM."""
    position = F.posexplode(values).alias("pos", "v")
    return frames.select("video", "frame", position).select(
        "video",
        "frame",
        F.floor(F.col("pos") / width).cast("int").alias("y"),
        (F.col("pos") % width).alias("x"),
        "v",
    )
