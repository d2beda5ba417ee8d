"""Sinks that a repeated micro-batch does not change twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trackframe.operators import metrics as E
from trackframe.operators import sweep as SW
from trackframe.session import cut
from trackframe.streaming.stateful import whole_frames


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Store a micro-batch in its own folder; a repeat replaces that folder.

    The first batch of a run replaces the whole table.
    """
    mode = "static" if batch_id == 0 else "dynamic"
    (
        rows.withColumn("batch", F.lit(batch_id))
        .write.partitionBy("batch")
        .mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .parquet(path)
    )


def stream_sink(
    stream: DataFrame, path: str, checkpoint: str, transform: Callable | None = None
) -> StreamingQuery:
    """Append the rows of each micro-batch, after an optional batch transform."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(transform(batch) if transform else batch, batch_id, path)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_counts(
    boxes: DataFrame, path: str, checkpoint: str, late_path: str | None = None, **options
) -> StreamingQuery:
    """Per-frame counts, each frame once, when the watermark has closed it.

    ``boxes`` holds detections and truth with ``side`` calc or gt. A frame may come in
    pieces; its boxes are counted together. Boxes that come after that are in no count:
    their numbers go to ``late_path`` as (video, frame, side, late). Other options are
    those of ``frame_counts``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        whole = batch.filter("late = 0")
        calc = whole.filter("side = 'calc'").drop("side", "late")
        gt = whole.filter("side = 'gt'").drop("side", "late")
        write_batch(E.present_frame_counts(calc, gt, **options), batch_id, path)
        if late_path is not None:
            late = batch.filter("late > 0").groupBy("video", "frame", "side")
            write_batch(late.agg(F.sum("late").alias("late")), batch_id, late_path)
        batch.unpersist()

    return (
        whole_frames(boxes).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_totals(counts: DataFrame) -> DataFrame:
    """Scores of everything counted so far, per video."""
    return E.detection_scores(counts, ["video"])


def stream_sweep(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Score requested design numbers once each.

    ``requests`` has idx; ``score`` takes a table (idx) of the numbers without a
    stored score and gives rows with idx. A request that repeats, in this batch or
    from an earlier one, is skipped. The first batch replaces the whole table, even
    if nothing was requested in it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        wanted = batch.select("idx").filter("idx is not null").distinct()
        if batch_id > 0:
            try:
                stored = batch.sparkSession.read.parquet(path)
            except AnalysisException:  # no batch had a request so far
                stored = None
            if stored is not None:
                wanted = SW.pending_designs(stored.filter(F.col("batch") < batch_id), wanted)
        write_batch(score(cut(wanted)), batch_id, path)

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available into a parquet table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
