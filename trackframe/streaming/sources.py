"""Streams of frames and boxes.

Rows of a frame may come in several micro-batches and out of order, as far as the
watermark allows; the keyed operators wait for it and count what comes later still.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions.scalars import dataset_from_path, frame_from_name
from trackframe.sources.files import IMAGE_FPS

FILE_ROWS = "path string, modificationTime timestamp, length bigint, content binary"


def event_time(frame: Column, fps: float = IMAGE_FPS) -> Column:
    """Time of a frame since the start of its video."""
    return F.timestamp_micros((frame * F.lit(1_000_000.0 / fps)).cast("long"))


def with_event_time(rows: DataFrame, fps: float = IMAGE_FPS, late: str = "0 seconds") -> DataFrame:
    """Rows with ``event_time`` and a watermark that is ``late`` behind the latest frame.

    Rows that have an ``event_time`` are left as they are. Without lateness a frame is
    open for the micro-batch that follows its first rows.
    """
    if "event_time" in rows.columns:
        return rows
    timed = rows.withColumn("event_time", event_time(F.col("frame"), fps))
    return timed.withWatermark("event_time", late)


def stream_table(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as they land."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_frames(
    spark: SparkSession,
    path: str,
    schema,
    fps: float = IMAGE_FPS,
    late: str = "10 seconds",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Frame rows as they land, with event time frame / fps and a watermark."""
    rows = stream_table(spark, path, schema, files_per_batch)
    return with_event_time(rows, fps, late)


def stream_image_files(
    spark: SparkSession, path: str, fps: float = IMAGE_FPS, files_per_batch: int | None = None
) -> DataFrame:
    """Numbered image files as they land: video, frame, event_time, content."""
    reader = spark.readStream.format("binaryFile").schema(FILE_ROWS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = reader.load(path)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    frame = frame_from_name(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.select(
        dataset_from_path(folder).alias("video"),
        frame.alias("frame"),
        event_time(frame, fps).alias("event_time"),
        "content",
    )
