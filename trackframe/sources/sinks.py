"""Writers of result tables and exchange files."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.schema import BOX_COLUMNS


def _overwrite_videos(df: DataFrame, path: str) -> None:
    """Replace only the partitions of the videos in ``df``."""
    (
        df.write.partitionBy("video")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def region_rows(regions: DataFrame) -> DataFrame:
    """Rows of the stored regions table; missing identities become nulls."""
    none = {"identity": F.lit(None).cast("long"), "id_str": F.lit(None).cast("string")}
    missing = {n: v for n, v in none.items() if n not in regions.columns}
    if "id_str" in missing and "identity" in regions.columns:
        missing["id_str"] = F.col("identity").cast("string")
    full = regions.withColumns(missing) if missing else regions
    return full.select("video", *BOX_COLUMNS, "identity", "id_str", "frame", "ord")


def write_regions(regions: DataFrame, path: str) -> None:
    """Boxes per video, sorted by frame and x1 inside each file."""
    placed = region_rows(regions).repartition("video", F.floor(F.col("frame") / 4096))
    _overwrite_videos(
        placed.sortWithinPartitions("video", "frame", "x1", "ord"), f"{path}/regions"
    )


def write_motion(regions: DataFrame, transforms: DataFrame, path: str) -> None:
    """Detected boxes and frame matrices of a run."""
    boxes = regions.select("video", *BOX_COLUMNS, "frame", "ord")
    placed = boxes.repartition("video", F.floor(F.col("frame") / 4096))
    _overwrite_videos(
        placed.sortWithinPartitions("video", "frame", "x1", "ord"), f"{path}/motion_regions"
    )
    _overwrite_videos(transforms, f"{path}/transformations")


def write_tracks(tracks: DataFrame, history: DataFrame | None, path: str) -> None:
    """Tracked boxes and, when given, particle history."""
    named = tracks.withColumn("id_str", F.col("identity").cast("string"))
    placed = named.repartition("video", F.floor(F.col("frame") / 4096))
    _overwrite_videos(
        placed.sortWithinPartitions("video", "frame", "x1"), f"{path}/bayesian_filter_regions"
    )
    if history is not None:
        _overwrite_videos(history, f"{path}/particle_filter_history")


# The four trailing columns of a ground truth file.
GT_CONSTANTS = {"c1": 1, "c2": -1, "c3": -1, "c4": -1}


def gt_rows(regions: DataFrame) -> DataFrame:
    """Columns of the 10-column ground truth file, below their video."""
    constants = [F.lit(value).alias(name) for name, value in GT_CONSTANTS.items()]
    return G.xyxy_to_xywh(regions).select(
        "video", "frame", "identity", "x1", "y1", "width", "height", *constants
    )


def write_gt(regions: DataFrame, path: str) -> None:
    """Ground truth files, one folder per video, in frame order inside each file."""
    placed = gt_rows(regions).repartition("video", F.floor(F.col("frame") / 4096))
    (
        placed.sortWithinPartitions("video", "frame", "identity")
        .write.partitionBy("video")
        .mode("overwrite")
        .csv(path, header=False)
    )


def write_metrics(counts: DataFrame, path: str) -> None:
    """Per-frame counts as CSV."""
    counts.sort("video", "frame").write.mode("overwrite").csv(path, header=True)


def write_baseline(regions: DataFrame, path: str) -> None:
    """Golden boxes x1, y1, x2, y2, frame; a folder of files per video."""
    rows = regions.select(*BOX_COLUMNS, "frame", "video")
    rows.sort("video", "frame", *BOX_COLUMNS).write.partitionBy("video").mode("overwrite").csv(
        path, header=False
    )


def write_velocities(table: DataFrame, path: str) -> None:
    table.sort("video", "identity", "frame").write.mode("overwrite").csv(path, header=True)


def write_samples(samples: DataFrame, path: str) -> None:
    """Sampled designs of all datasets as CSV."""
    samples.write.mode("overwrite").csv(path, header=True)


def append_scores(scores: DataFrame, path: str) -> None:
    """Add scored designs below their key folders."""
    from trackframe.sources.layout import SCORE_KEYS

    scores.write.partitionBy(*SCORE_KEYS).mode("append").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# Image files -----------------------------------------------------------------


def png_bytes(data: bytes, height: int, width: int, channels: int) -> bytes:
    """An 8-bit PNG of image rows in the order of frames: gray, or blue, green, red."""
    import numpy as np

    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, ::-1]
    # each line begins with the number of its filter
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 1:] = image.reshape(height, -1)

    def part(kind: bytes, body: bytes) -> bytes:
        check = struct.pack(">I", zlib.crc32(kind + body))
        return struct.pack(">I", len(body)) + kind + body + check

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    packed = zlib.compress(lines.tobytes())
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", packed) + part(b"IEND", b"")


def _write_images(batches, path: str):
    import pyarrow as pa
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    for batch in batches:
        names = []
        for row in batch.to_pylist():
            folder = f"{root}/Datasets/{row['video']}/img"
            store.create_dir(folder, recursive=True)
            name, part = f"{folder}/{row['frame']:09d}.png", f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(png_bytes(row["data"], row["height"], row["width"], row["channels"]))
            # a repeated task puts the same file in place again
            store.move(part, name)
            names.append(name)
        yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string())})


def write_frames(frames: DataFrame, path: str) -> None:
    """Frames as PNG files ``path/Datasets/<video>/img/<frame>.png``, for ``read_frames``.

    ``path`` is a folder or URI that all executors share. One and three channels.
    """
    rows = frames.filter(F.col("channels").isin(1, 3)).select(
        F.col("video").cast("string").alias("video"),
        F.col("frame").cast("long").alias("frame"),
        "height", "width", "channels", "data",
    )
    rows.mapInArrow(lambda batches: _write_images(batches, path), "path string").write.format(
        "noop"
    ).mode("overwrite").save()


def write_score_table(scores: DataFrame, path: str, videos: list, metrics: list[str]) -> None:
    """(method, video, metric, value) as a table with two header rows and a comment.

    One text file for the given columns; ``read_score_table`` reads it back.
    """
    columns = [(v, m) for v in videos for m in metrics]
    cells = [
        F.max(F.when((F.col("video") == v) & (F.col("metric") == m), F.col("value")))
        for v, m in columns
    ]
    text = [F.coalesce(cell.cast("string"), F.lit("")) for cell in cells]
    body = scores.groupBy("method").agg(F.concat_ws(",", *text).alias("cells")).select(
        F.lit(3).alias("place"), F.concat_ws(",", "method", "cells").alias("value")
    )
    heads = [
        (0, "# scores"),
        (1, ",".join(["", *[str(v) for v, _ in columns]])),
        (2, ",".join(["method", *[m for _, m in columns]])),
    ]
    head = scores.sparkSession.createDataFrame(heads, "place int, value string")
    lines = head.unionByName(body).coalesce(1).sortWithinPartitions("place", "value")
    lines.select("value").write.mode("overwrite").text(path)
