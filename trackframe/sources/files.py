"""Readers of annotation, frame, baseline and score-table files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe import schema
from trackframe.functions import geometry as G
from trackframe.functions.scalars import dataset_from_path
from trackframe.operators.running import row_numbers

# Fixed value: frame rate taken for image directories.
IMAGE_FPS = 30.0


def _video(video: str | None, path: Column) -> Column:
    if video is not None:
        return F.lit(video)
    # .../Datasets/<video>/gt/gt.txt and the like
    return F.regexp_extract(path, r"Datasets/(.+?)/(?:gt|img)/[^/]*$", 1)


def read_gt(
    spark: SparkSession, path: str, video: str | None = None, skip_first: bool = False
) -> DataFrame:
    """Ground truth file frame,id,x,y,w,h,... without header.

    ``skip_first`` leaves out the first line of each file, which a reader that
    expects a header would lose. ``ord`` is the identity.
    """
    reader = spark.read.schema(schema.GT_FILE).option("mode", "FAILFAST")
    rows = reader.option("header", skip_first).option("enforceSchema", True).csv(path)
    named = rows.withColumn("video", _video(video, F.input_file_name()))
    return G.xywh_to_xyxy(named).select(
        "video",
        "frame",
        F.col("identity").cast("int").alias("ord"),
        *G.BOX_COLUMNS,
        "identity",
        F.col("identity").cast("string").alias("id_str"),
    )


CVAT_TRACK = (
    "_id bigint, box array<struct<_frame: int, _xtl: double, _ytl: double, _xbr: double, _ybr: double>>"
)


def read_cvat(spark: SparkSession, path: str, video: str | None = None) -> DataFrame:
    """Annotation XML: each box of each track, on whole pixels, frames from 1."""
    tracks = (
        spark.read.format("xml")
        .option("rowTag", "track")
        .option("mode", "FAILFAST")
        .schema(CVAT_TRACK)
        .load(path)
        .withColumn("video", _video(video, F.input_file_name()))
    )
    boxes = tracks.select("video", F.col("_id").alias("identity"), F.explode("box").alias("b"))
    snapped = G.snap_box(tuple(F.col(f"b._{n}") for n in ("xtl", "ytl", "xbr", "ybr")))
    return boxes.select(
        "video",
        (F.col("b._frame") + 1).alias("frame"),
        F.col("identity").cast("int").alias("ord"),
        *[c.alias(n) for c, n in zip(snapped, G.BOX_COLUMNS)],
        "identity",
        F.col("identity").cast("string").alias("id_str"),
    )


def read_results(
    spark: SparkSession,
    path: str,
    table: str = "regions",
    video: str | None = None,
    frames: tuple[int, int] | None = None,
) -> DataFrame:
    """A stored table; the video prunes folders and the frame range is pushed down."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/{table}")
    if video is not None:
        rows = rows.filter(F.col("video") == video)
    if frames is not None:
        rows = rows.filter(F.col("frame").between(*frames))
    return rows


def read_regions(spark: SparkSession, path: str, video: str | None = None) -> DataFrame:
    """Boxes from gt.txt, annotation XML or stored results, told apart by name."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name == "gt.txt":
        return read_gt(spark, path, video)
    if name.endswith(".xml"):
        return read_cvat(spark, path, video)
    return read_results(spark, path, "regions", video)


def _numbered(listing: DataFrame) -> DataFrame:
    """Paths with video and frame = place of the file name within its folder.

    The order is cut by all but the last three characters of the name, so a
    folder of numbered images is many small windows.
    """
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    named = listing.withColumns(
        {
            "folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1),
            "name": F.regexp_extract("path", r"([^/]+)$", 1),
            "stem": name,
        }
    )
    cut = F.expr("substring(stem, 1, greatest(length(stem) - 3, 0))")
    return row_numbers(named, ["folder"], ["name"], cut, "frame").select(
        "path", "folder", F.col("frame").cast("int").alias("frame")
    )


def read_frames(spark: SparkSession, path: str, video: str | None = None) -> DataFrame:
    """Image folder to (video, frame, height, width, channels, data), frames by name.

    File names are numbered from a listing alone; pixels are joined to it once.
    """
    listing = spark.read.format("binaryFile").load(path).select("path")
    numbered = _numbered(listing)
    images = spark.read.format("image").load(path).select("image.*")
    name = F.lit(video) if video is not None else dataset_from_path(F.col("folder"))
    clean = F.regexp_replace("origin", "^file:/+", "/")
    return (
        images.withColumn("key", clean)
        .join(numbered.withColumn("key", F.regexp_replace("path", "^file:/+", "/")), "key")
        .select(
            name.alias("video"),
            "frame",
            "height",
            "width",
            F.col("nChannels").alias("channels"),
            "data",
        )
    )


def videos_of(frames: DataFrame, fps: float = IMAGE_FPS) -> DataFrame:
    """Size, rate and frame count per video."""
    return frames.groupBy("video").agg(
        F.max("width").alias("width"),
        F.max("height").alias("height"),
        F.lit(float(fps)).alias("fps"),
        F.count("*").alias("frame_count"),
    )


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Golden boxes x1, y1, x2, y2, frame, blanks after commas allowed.

    Folders ``video=...`` give the video; a single file has none.
    """
    return (
        spark.read.schema(f"{schema.BASELINE_FILE}, video string")
        .option("ignoreLeadingWhiteSpace", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_score_table(spark: SparkSession, path: str, header_rows: int = 1) -> DataFrame:
    """Published table to (method, video, metric, value).

    Lines from # on are comments. One header row names videos, and the metric is
    ap; two name video and metric.
    """
    lines = spark.read.text(path).filter(~F.ltrim("value").startswith("#"))
    heads = [row["value"] for row in lines.filter(F.trim("value") != "").head(header_rows)]
    titles = [[part.strip() for part in head.split(",")] for head in heads]
    width = len(titles[0])
    text = ", ".join(f"c{i} string" for i in range(width))
    rows = (
        spark.read.schema(text)
        .option("comment", "#")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    is_head = reduce(
        Column.__or__,
        [
            F.concat_ws(",", *[F.coalesce(f"c{i}", F.lit("")) for i in range(width)])
            == ",".join(title)
            for title in titles
        ],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(titles[0][i]).alias("video"),
                F.lit(titles[1][i].lower() if header_rows == 2 else "ap").alias("metric"),
                F.col(f"c{i}").cast("double").alias("value"),
            )
            for i in range(1, width)
        ]
    )
    body = rows.filter(~is_head)
    return body.select(F.col("c0").alias("method"), F.inline(cells))
