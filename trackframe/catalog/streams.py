"""Queries that run as streams and are read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.catalog import ORACLES, query
from trackframe.catalog.boxes import BOXES, counts_sql
from trackframe.catalog.scores import rounded, sweep_sql
from trackframe.operators import morphology as MO
from trackframe.operators import sweep as D
from trackframe.session import scratch_path
from trackframe.sources import fixtures as X
from trackframe.sources import frames as FR
from trackframe.streaming import sinks as SS
from trackframe.streaming import sources as SO
from trackframe.streaming import stateful as ST


def _stream(spark, sf, name):
    path = f"{sf}/{name}.parquet"
    # a glob, as the source takes folders or patterns but no single file
    return SO.stream_table(spark, f"{path}*", spark.read.parquet(path).schema)


def _drained(spark, stream, name):
    path = scratch_path(spark, name)
    SS.run_to_table(stream, path, scratch_path(spark, f"{name}-state"))
    found = spark.read.parquet(path)
    return ST.on_time(found) if ST.LATE in found.columns else found


def _landed(spark, rows, part, parts, name):
    """``rows`` in files of the numbers that ``part`` gives, one file a micro-batch.

    A last file has one row without a video, which moves the watermark past all frames.
    """
    path = scratch_path(spark, name)
    for number in range(parts):
        rows.filter(part == number).coalesce(1).write.mode("append").parquet(path)
    values = {"frame": 1_000_000, "video": None}
    closing = [F.lit(values.get(f.name, 1)).cast(f.dataType).alias(f.name) for f in rows.schema]
    spark.range(1).select(*closing).write.mode("append").parquet(path)
    return SO.stream_table(spark, path, rows.schema, files_per_batch=1)


def _split_boxes(spark, sf, name):
    """Boxes whose frames are split: odd identities come a quarter of the video later."""
    base = X.boxes_base(spark, sf)
    part = F.floor(F.col("frame") * 4 / 201) + F.col("identity") % 2
    return _landed(spark, base, part, 5, name)


def _boxes(spark, sf):
    return X.boxes_from_orders(_stream(spark, sf, "orders"))


@query(
    "stream_frames",
    "vectors",
    """select video, frame, 64 as bytes, cast(frame * 1000000 // 30 as bigint) as micros from vectors""",
)
def stream_frames(spark, sf):
    path = scratch_path(spark, "frames")
    FR.assemble_frames(X.pixels(spark, sf)).write.parquet(path)
    schema = spark.read.parquet(path).schema
    drained = _drained(spark, SO.stream_frames(spark, path, schema), "stream-frames")
    return drained.select(
        "video",
        "frame",
        F.length("data").alias("bytes"),
        F.unix_micros("event_time").alias("micros"),
    )


@query(
    "stream_history",
    "gt_regions",
    """with f as (select distinct video, frame from gt_regions),
    n as (select *, row_number() over (partition by video order by frame) as n from f)
    select a.video, a.frame, b.frame as hist_frame, case when b.n = a.n - 6 then 'evicted' else 'held' end as event
    from n a join n b on b.video = a.video and b.n between a.n - 6 and a.n - 1 where a.n > 5""",
)
def stream_history(spark, sf):
    stream = X.gt_from_base(_boxes(spark, sf))
    return _drained(spark, ST.stream_history(stream, 5), "stream-history")


def _boxes_in_batches(spark, sf, name, parts=4):
    """Boxes that land in several files, frames in order, one file a micro-batch."""
    path = scratch_path(spark, name)
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    frame = F.expr("(o_orderkey div 25) % 200")
    for part in range(parts):
        here = orders.filter(F.floor(frame * parts / 200) == part)
        here.coalesce(1).write.mode("append").parquet(path)
    stream = SO.stream_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    return X.boxes_from_orders(stream)


@query("stream_history_batches")
def stream_history_batches(spark, sf):
    """The same windows with state carried over micro-batches."""
    stream = X.gt_from_base(_boxes_in_batches(spark, sf, "history-files"))
    return _drained(spark, ST.stream_history(stream, 5), "stream-history-batches")


ORACLES["stream_history_batches"] = ORACLES["stream_history"]


@query("stream_history_split")
def stream_history_split(spark, sf):
    """The same windows from frames that come in pieces, over several micro-batches."""
    boxes = X.gt_from_base(_split_boxes(spark, sf, "split-history"))
    stream = SO.with_event_time(boxes, late="2 seconds")
    return _drained(spark, ST.stream_history(stream, 5), "stream-history-split")


ORACLES["stream_history_split"] = ORACLES["stream_history"]


@query(
    "stream_late_rows",
    "gt_regions",
    """with closed as (select max(frame) as last from gt_regions where frame * 4 < 603 and identity % 5 > 0)
    select video, frame,
      count(*) filter (where identity % 5 > 0 or frame > last) as in_time,
      count(*) filter (where identity % 5 = 0 and frame <= last) as too_late
    from gt_regions, closed group by video, frame""",
)
def stream_late_rows(spark, sf):
    """Every fifth box comes after all others: those of closed frames are told apart."""
    part = F.when(F.col("identity") % 5 == 0, 4).otherwise(F.floor(F.col("frame") * 4 / 201))
    rows = X.gt_from_base(X.boxes_base(spark, sf))
    stream = _landed(spark, rows, part, 5, "late-boxes")
    path = scratch_path(spark, "whole-frames")
    SS.run_to_table(ST.whole_frames(stream), path, scratch_path(spark, "whole-frames-state"))
    return (
        spark.read.parquet(path).groupBy("video", "frame")
        .agg(F.count_if(F.col("late") == 0).alias("in_time"), F.count_if(F.col("late") == 1).alias("too_late"))
    )


@query("stream_dead_reckoning")
def stream_dead_reckoning(spark, sf):
    stream = X.calc_from_base(_boxes(spark, sf))
    return _drained(spark, ST.stream_dead_reckoning(stream, 12, 0.3), "stream-reckoning")


@query("stream_particle_filter")
def stream_particle_filter(spark, sf):
    stream = X.calc_from_base(_boxes(spark, sf))
    filtered = ST.stream_particle_filter(stream, X.transformations(spark, sf))
    return _drained(spark, filtered, "stream-particles")


@query(
    "stream_observation_hysteresis",
    "observed_tracks",
    """select video, identity, frame, x1, y1, observed from (
      select *, count(*) over (partition by video, identity) as n from observed_tracks where observed) t
    where n >= 2""",
)
def stream_observation_hysteresis(spark, sf):
    stream = X.observed_from_events(_stream(spark, sf, "events"))
    return _drained(spark, ST.stream_observation_hysteresis(stream), "stream-observed")


@query("stream_pixel_hysteresis")
def stream_pixel_hysteresis(spark, sf):
    path = scratch_path(spark, "mask")
    MO.threshold(X.pixels(spark, sf), 139).write.parquet(path)
    stream = SO.stream_table(spark, path, spark.read.parquet(path).schema)
    return _drained(spark, ST.stream_pixel_hysteresis(stream, 2, 3), "stream-pixels")


ORACLES["stream_pixel_hysteresis"] = ORACLES["pixel_hysteresis"]


@query("stream_pixel_hysteresis_split")
def stream_pixel_hysteresis_split(spark, sf):
    """The same masks from frames whose halves come in different micro-batches."""
    mask = MO.threshold(X.pixels(spark, sf), 139)
    part = F.least(F.floor(F.col("frame") / 20), F.lit(3)) + F.col("x") % 2
    stream = SO.with_event_time(_landed(spark, mask, part, 5, "split-mask"), late="1 second")
    return _drained(spark, ST.stream_pixel_hysteresis(stream, 2, 3), "stream-pixels-split")


ORACLES["stream_pixel_hysteresis_split"] = ORACLES["pixel_hysteresis"]


def _sided(base):
    return (
        X.calc_from_base(base)
        .withColumn("side", F.lit("calc"))
        .unionByName(X.gt_from_base(base).withColumn("side", F.lit("gt")))
    )


COUNTED_SQL = counts_sql() + (
    " select * from counts where true_positive + false_negative + false_positive > 0"
)


@query("stream_counts_batches", BOXES, COUNTED_SQL)
def stream_counts_batches(spark, sf):
    """The same counts from several micro-batches."""
    path = scratch_path(spark, "counts-batches")
    sided = _sided(_boxes_in_batches(spark, sf, "counts-files"))
    SS.stream_counts(sided, path, scratch_path(spark, "counts-batches-state")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


@query("stream_counts_split", BOXES, COUNTED_SQL)
def stream_counts_split(spark, sf):
    """Each frame counted once, although its boxes come in several micro-batches."""
    path = scratch_path(spark, "counts-split")
    sided = _sided(_split_boxes(spark, sf, "split-counts"))
    sided = SO.with_event_time(sided, late="2 seconds")
    SS.stream_counts(sided, path, scratch_path(spark, "counts-split-state")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


@query("stream_counts", BOXES, COUNTED_SQL)
def stream_counts(spark, sf):
    path = scratch_path(spark, "counts")
    sided = _sided(_boxes(spark, sf))
    SS.stream_counts(sided, path, scratch_path(spark, "counts-state")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


@query(
    "stream_sink",
    "calc_regions",
    "select video, frame, identity, ord, x1, y1, x2, y2 from calc_regions",
)
def stream_sink(spark, sf):
    path = scratch_path(spark, "sink")
    stream = X.calc_from_base(_boxes(spark, sf))
    SS.stream_sink(stream, path, scratch_path(spark, "sink-state")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


def _request_design(idx: int) -> dict:
    return {"idx": idx, "threshold": idx / 10, "max_width": 16 + idx, "max_height": None}


@query("stream_sweep", BOXES, sweep_sql([_request_design(i) for i in range(5)]))
def stream_sweep(spark, sf):
    """Design requests arrive as region keys; each is scored once on all boxes."""
    path = scratch_path(spark, "sweep")
    requests = _stream(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("idx"))
    base = X.boxes_base(spark, sf)
    calc, gt = X.calc_from_base(base), X.gt_from_base(base)

    def score(wanted):
        designs = wanted.select(
            "idx", (F.col("idx") / 10).alias("threshold"), (F.col("idx") + 16).alias("max_width")
        )
        return D.threshold_sweep(calc, gt, designs)

    SS.stream_sweep(requests, path, scratch_path(spark, "sweep-state"), score).awaitTermination()
    scored = spark.read.parquet(path).drop("batch")
    return rounded(scored, "recall", "precision", "f1", digits=9)
