"""Detection counts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.operators import matching as M
from trackframe.session import cut

SPINE_STEP = 4096
COUNTS = ["true_positive", "false_negative", "false_positive"]

# Used in place of a missing identity, so that all such boxes share one mark.
NO_IDENTITY = -(2**62)


def frame_spine(last: DataFrame, column: str = "last_frame") -> DataFrame:
    """Every frame 1..last of each video, generated in blocks that can spread."""
    blocks = last.filter(F.col(column) >= 1).withColumn(
        "block", F.explode(F.sequence(F.lit(1), F.col(column), F.lit(SPINE_STEP)))
    )
    inside = F.sequence(
        F.col("block"), F.least(F.col("block") + (SPINE_STEP - 1), F.col(column))
    )
    return blocks.select("video", F.explode(inside).alias("frame"))


def frame_count(df: DataFrame) -> DataFrame:
    """Last frame number of each video; use :func:`frame_count_value` for one number."""
    return df.groupBy("video").agg(F.coalesce(F.max("frame"), F.lit(0)).alias("frame_count"))


def frame_count_value(df: DataFrame) -> DataFrame:
    """One row with the last frame number, 0 for no boxes at all."""
    return df.agg(F.coalesce(F.max("frame"), F.lit(0)).alias("frame_count"))


def box_counts(calc: DataFrame, gt: DataFrame) -> DataFrame:
    """Boxes of both sides per (video, frame), as nc and ng; reads key columns only."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return (
        calc.select(*M.FRAME_KEYS, one.alias("nc"), none.alias("ng"))
        .unionByName(gt.select(*M.FRAME_KEYS, none.alias("nc"), one.alias("ng")))
        .groupBy(*M.FRAME_KEYS)
        .agg(F.sum("nc").alias("nc"), F.sum("ng").alias("ng"))
    )


def common_frames(counts: DataFrame) -> DataFrame:
    """Per video the smaller of both last frames; only videos with both sides."""
    last = [F.max(F.when(F.col(n) > 0, F.col("frame"))) for n in ("nc", "ng")]
    return (
        counts.groupBy("video")
        .agg(last[0].alias("fa"), last[1].alias("fb"))
        .filter(F.col("fa").isNotNull() & F.col("fb").isNotNull())
        .select("video", F.least("fa", "fb").alias("last_frame"))
        .filter(F.col("last_frame") >= 1)
    )


def up_to_last(df: DataFrame, last: DataFrame) -> DataFrame:
    """Rows of frames 1..last_frame of their video."""
    inside = (F.col("frame") >= 1) & (F.col("frame") <= F.col("last_frame"))
    return df.join(last, "video").filter(inside).drop("last_frame")


def _pairs(calc: DataFrame, gt: DataFrame, threshold: float, legacy: bool) -> DataFrame:
    def side(df: DataFrame) -> DataFrame:
        names = [*M.FRAME_KEYS, "ord", *G.BOX_COLUMNS]
        slim = df.select(*names, *(["identity"] if legacy else []))
        mark = F.coalesce(F.col("identity"), F.lit(NO_IDENTITY)) if legacy else F.col("ord")
        return slim.withColumn("mark", mark.cast("long")).drop("identity")

    return M.overlap_join(side(calc), side(gt), threshold)


def _fits(side: str, width: int | None, height: int | None) -> Column:
    ok = F.lit(True)
    if width is not None:
        ok = ok & (F.col(f"{side}_x2") - F.col(f"{side}_x1") <= width)
    if height is not None:
        ok = ok & (F.col(f"{side}_y2") - F.col(f"{side}_y1") <= height)
    return ok


def matched_counts(
    calc: DataFrame,
    gt: DataFrame,
    max_width: int | None = None,
    max_height: int | None = None,
    allow_overlap: bool = False,
    threshold: float = 0.0,
    legacy_null_ids: bool = False,
) -> DataFrame:
    """Per frame with any pair: boxes matched in the detection and in the truth pass.

    The two passes are independent. The first walks detections and tests the
    size of the truth box, the second walks truth and tests the detection.
    """
    pairs = _pairs(calc, gt, threshold, legacy_null_ids).withColumns(
        {
            "first": _fits("b", max_width, max_height),
            "second": _fits("a", max_width, max_height),
        }
    )
    if allow_overlap:
        marked = both_ends(pairs).groupBy(*M.FRAME_KEYS, "side", "walker").agg(F.lit(1))
    else:
        marked = walk_both(both_ends(pairs))
    return marked.groupBy(*M.FRAME_KEYS).agg(
        F.count(F.when(F.col("side") == 1, 1)).alias("calc_matched"),
        F.count(F.when(F.col("side") == 2, 1)).alias("gt_matched"),
    )


def both_ends(pairs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Each pair once per pass: side, walker, mark of the other end, its order, lose.

    ``pairs`` has a_ord, b_ord, a_mark, b_mark, iou, and first and second, whether
    the pair counts in the pass over a and in that over b.
    """

    def end(side: int, walker: str, other: str, ok: str) -> Column:
        return F.struct(
            F.lit(side).alias("side"),
            F.col(f"{walker}_ord").cast("long").alias("walker"),
            F.col(f"{other}_mark").alias("mark"),
            F.col(f"{other}_ord").cast("long").alias("other"),
            F.col(ok).alias("ok"),
        )

    ends = F.explode(F.array(end(1, "a", "b", "first"), end(2, "b", "a", "second")))
    kept = [*M.FRAME_KEYS, *(carry or [])]
    return (
        pairs.select(*kept, (-F.col("iou")).alias("lose"), ends.alias("end"))
        .filter("end.ok")
        .select(*kept, "lose", "end.*")
    )


def walk_both(ends: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Both passes of every frame: each walker in order takes its best free end."""
    order = [F.col("walker"), F.col("lose"), F.col("other")]
    return M.greedy_edges(
        ends, "walker", "mark", order, keys=[*M.FRAME_KEYS, *(carry or []), "side"]
    )


def _summed(counts: DataFrame, matched: DataFrame, spine: DataFrame | None) -> DataFrame:
    """Box counts, matches and the frame spine in one grouping on (video, frame)."""
    zero = F.lit(0)

    def rows(df: DataFrame, tp: Column, fn: Column, fp: Column) -> DataFrame:
        return df.select(
            *M.FRAME_KEYS, *[c.cast("long").alias(n) for c, n in zip((tp, fn, fp), COUNTS)]
        )

    found, missed = F.col("calc_matched"), F.col("gt_matched")
    total = rows(counts, zero, F.col("ng"), F.col("nc")).unionByName(
        rows(matched, found, -missed, -found)
    )
    if spine is not None:
        total = total.unionByName(rows(spine, zero, zero, zero))
    return total.groupBy(*M.FRAME_KEYS).agg(*[F.sum(name).alias(name) for name in COUNTS])


def frame_counts(calc: DataFrame, gt: DataFrame, **options) -> DataFrame:
    """video, frame, true_positive, false_negative, false_positive for 1..last common frame.

    Options are those of :func:`matched_counts`. Frames without boxes show as
    zeros. Box counts are materialized: one row per frame answers where videos end
    and what was not matched.
    """
    counts = cut(box_counts(calc, gt))
    last = common_frames(counts)
    matched = matched_counts(calc, gt, **options)
    return up_to_last(_summed(counts, matched, frame_spine(last)), last)


def present_frame_counts(calc: DataFrame, gt: DataFrame, **options) -> DataFrame:
    """The same counts for frames that hold a box of either side."""
    counts = cut(box_counts(calc, gt))
    return _summed(counts, matched_counts(calc, gt, **options), None)


def detection_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall, precision and F1 of summed counts; 0 where a denominator is 0."""
    tp, fn, fp = (F.col(name) for name in COUNTS)

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))

    recall, precision = F.col("recall"), F.col("precision")
    sums = [F.sum(name).alias(name) for name in COUNTS]
    return (
        counts.groupBy(*(by or []))
        .agg(*sums)
        .withColumns({"recall": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp)})
        .withColumn("f1", ratio(2 * precision * recall, precision + recall))
    )
