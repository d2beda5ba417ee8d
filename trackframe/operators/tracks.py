"""Operators on tracks that need no carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.operators.running import FRAME_CHUNK, by_frames, previous_row, running
from trackframe.schema import BOX_COLUMNS, TRANSFORM_COLUMNS

TRACK_KEYS = ["video", "identity"]

# Motion test of the dataset builder.
MOTION_BACK = 20
MOTION_AHEAD = 30
MOTION_IOU = 0.425


def with_previous(tracks: DataFrame) -> DataFrame:
    """Each box with struct ``prev`` of the last box of its track."""
    return previous_row(tracks, TRACK_KEYS, ["frame"], ["frame", *BOX_COLUMNS], by_frames())


def _step(tracks: DataFrame) -> tuple[DataFrame, Column, Column, Column, Column]:
    pairs = with_previous(tracks).filter(F.col("prev").isNotNull())
    cx, cy = G.centroid(G.corners())
    px, py = G.centroid(G.corners("prev"))
    return pairs, cx, cy, cx - px, cy - py


def velocity(tracks: DataFrame, fps: float) -> DataFrame:
    """Distance to the previous center of the track times fps; gaps are not scaled."""
    pairs, cx, cy, dx, dy = _step(tracks)
    return pairs.select(
        *TRACK_KEYS,
        "frame",
        cx.alias("centroid_x"),
        cy.alias("centroid_y"),
        (F.sqrt(dx * dx + dy * dy) * F.lit(float(fps))).alias("velocity"),
    )


def direction(tracks: DataFrame) -> DataFrame:
    """Heading in radians from the previous center of the track."""
    pairs, cx, cy, dx, dy = _step(tracks)
    return pairs.select(
        *TRACK_KEYS,
        "frame",
        cx.alias("centroid_x"),
        cy.alias("centroid_y"),
        F.atan2(dy, dx).alias("direction"),
    )


def velocity_table(tracks: DataFrame, fps: float) -> DataFrame:
    """Velocity and direction in the layout of the velocity file."""
    pairs, cx, cy, dx, dy = _step(tracks)
    return pairs.select(
        *TRACK_KEYS,
        "frame",
        cx.alias("centroid_x"),
        cy.alias("centroid_y"),
        (F.sqrt(dx * dx + dy * dy) * F.lit(float(fps))).alias("velocity"),
        F.atan2(dy, dx).alias("direction"),
    )


def observation_hysteresis(tracks: DataFrame) -> DataFrame:
    """Observed boxes of tracks observed at least twice, the first one included."""
    track = Window.partitionBy(*TRACK_KEYS)
    return (
        tracks.filter("observed")
        .withColumn("__n", F.count("*").over(track))
        .filter("__n >= 2")
        .drop("__n")
    )


def motion_only(
    gt: DataFrame,
    back: int = MOTION_BACK,
    ahead: int = MOTION_AHEAD,
    iou: float = MOTION_IOU,
) -> DataFrame:
    """Boxes whose identity has moved (IoU <= limit) within the frames around.

    Tracks are cut in blocks of ``back + ahead`` frames. A box is offered to its
    own block and to the neighbours it can serve, so a key is a bounded block of
    one track. The semi join stops at the first proof of motion.
    """
    size = max(back + ahead, 1)
    now = gt.withColumn("block", by_frames(size=size))
    # A box at frame g proves motion for frames g - ahead .. g + back.
    other = gt.select(
        F.col("video").alias("o_video"),
        F.col("identity").alias("o_identity"),
        F.col("frame").alias("o_frame"),
        *[F.col(n).alias(f"o_{n}") for n in BOX_COLUMNS],
        F.explode(
            F.sequence(
                F.floor((F.col("frame") - ahead) / F.lit(size)),
                F.floor((F.col("frame") + back) / F.lit(size)),
            )
        ).alias("o_block"),
    )
    box = G.corners()
    moved = G.iou(box, tuple(F.col(f"o_{n}") for n in BOX_COLUMNS)) <= iou
    gap = F.col("o_frame") - F.col("frame")
    return now.join(
        other,
        (F.col("video") == F.col("o_video"))
        & (F.col("identity") == F.col("o_identity"))
        & (F.col("block") == F.col("o_block"))
        & gap.between(-back, ahead)
        & (gap != 0)
        & moved,
        "left_semi",
    ).drop("block")


def motion_only_in_order(
    gt: DataFrame,
    back: int = MOTION_BACK,
    ahead: int = MOTION_AHEAD,
    iou: float = MOTION_IOU,
) -> DataFrame:
    """The published pruning: frames in order, dropped boxes no longer count.

    A box is compared with the earlier boxes of its track that were kept and
    with all later ones. A track is read in frame order and holds the frames
    within reach only.
    """
    import numpy as np

    from trackframe.operators.fold import fold_frames
    from trackframe.operators.reckoning import corners_of, pairwise_iou

    names = ["video", "identity", "frame", "ord", *BOX_COLUMNS]

    def decide(state, until):
        """Settle waiting boxes whose later neighbours are all known."""
        kept, waiting = state["kept"], state["waiting"]
        rows = []
        while waiting and waiting[0][0] < until:
            frame, order, box = waiting.pop(0)
            kept[:] = [k for k in kept if k[0] >= frame - back]
            later = [w for w in waiting if w[0] <= frame + ahead]
            others = [k[-1] for k in kept] + [w[-1] for w in later]
            if others and (pairwise_iou(box[None, :], np.array(others)) <= iou).any():
                kept.append((frame, box))
                rows.append((frame, order, *box.tolist()))
        return rows

    def step(state, key, frame, columns):
        for order, box in zip(columns["ord"].tolist(), corners_of(columns)):
            state["waiting"].append((frame, order, box))
        return [(*key, *r) for r in decide(state, frame - ahead)]

    def finish(state, key):
        return [(*key, *r) for r in decide(state, float("inf"))]

    fields = ", ".join(f"{n} {gt.schema[n].dataType.simpleString()}" for n in names)
    return fold_frames(
        gt.select(*names),
        TRACK_KEYS,
        lambda key: {"kept": [], "waiting": []},
        step,
        fields,
        finish=finish,
    )


def assign_ids(df: DataFrame) -> DataFrame:
    """Number boxes without identity from 0 per video, in frame then list order."""
    fresh = F.col("identity").isNull()
    counted = running(
        df,
        ["video"],
        ["frame", "ord"],
        by_frames(),
        {"n_fresh": ("sum", F.when(fresh, 1).otherwise(0).cast("long"))},
    )
    identity = F.when(fresh, F.col("n_fresh") - 1).otherwise(F.col("identity"))
    return counted.withColumn("identity", identity.cast("long")).drop("n_fresh").withColumn(
        "id_str", F.col("identity").cast("string")
    )


def with_transform(regions: DataFrame, transforms: DataFrame) -> DataFrame:
    """Boxes with the matrix of their frame; frames that lack either are left out."""
    return regions.join(
        transforms.select("video", "frame", *TRANSFORM_COLUMNS), ["video", "frame"]
    )


def transformed(regions: DataFrame, transforms: DataFrame) -> DataFrame:
    """Boxes moved by the matrix of their frame."""
    moved = G.transform_box(G.corners())
    return (
        with_transform(regions, transforms)
        .withColumns(dict(zip(BOX_COLUMNS, moved)))
        .drop(*TRANSFORM_COLUMNS)
    )


def history_pairs(frames: DataFrame, history: int) -> DataFrame:
    """(video, frame, hist_frame) for frames whose ``history`` predecessors all exist.

    Each frame offers itself to the next frames and announces itself as an
    anchor; one grouping on (video, frame) holds at most ``history`` + 1 rows.
    """
    rows = frames.select("video", "frame").distinct()
    none = F.lit(None).cast(frames.schema["frame"].dataType)
    offered = rows.select(
        "video",
        F.explode(F.sequence(F.col("frame") + 1, F.col("frame") + history)).alias("anchor"),
        F.col("frame").alias("hist_frame"),
    )
    anchors = rows.select("video", F.col("frame").alias("anchor"), none.alias("hist_frame"))
    grouped = (
        offered.unionByName(anchors)
        .groupBy("video", "anchor")
        .agg(
            F.collect_list("hist_frame").alias("h"),
            F.bool_or(F.col("hist_frame").isNull()).alias("exists"),
        )
        .filter(F.col("exists") & (F.size("h") == history))
    )
    return grouped.select(
        "video", F.col("anchor").alias("frame"), F.explode("h").alias("hist_frame")
    )


def sort_regions(df: DataFrame) -> DataFrame:
    """Total order by video, frame and x1, spread by range."""
    return df.orderBy("video", "frame", "x1", "ord")


def regions_fingerprint(df: DataFrame, chunk: int = FRAME_CHUNK, strip: int = 256) -> DataFrame:
    """MD5 per video over its boxes in frame, x1 order.

    Equal boxes of a frame are counted first. Boxes of an upright strip give one
    digest, strips of a frame one, frames of a block one, and blocks in order
    give the video's, so no task sees a whole video or a whole crowded frame.
    """
    counted = df.groupBy("video", "frame", *BOX_COLUMNS).agg(F.count("*").alias("n"))

    def joined(*order: str) -> Column:
        """Digest of the last column's texts in the order of the columns."""
        items = F.sort_array(F.collect_list(F.struct(*order)))
        texts = F.transform(items, lambda e: e[order[-1]].cast("string"))
        return F.md5(F.array_join(texts, ";")).alias("d")

    text = F.concat_ws(",", *[F.col(n).cast("string") for n in [*BOX_COLUMNS, "n"]])
    strips = (
        counted.withColumn("t", text)
        .groupBy("video", "frame", F.floor(F.col("x1") / strip).alias("strip"))
        .agg(joined(*BOX_COLUMNS, "t"))
    )
    frames = strips.groupBy("video", "frame").agg(joined("strip", "d"))
    blocks = frames.groupBy("video", by_frames(size=chunk).alias("block")).agg(
        joined("frame", "d")
    )
    return blocks.groupBy("video").agg(joined("block", "d")).withColumnRenamed(
        "d", "fingerprint"
    )


def distinct_frames(df: DataFrame) -> DataFrame:
    return df.select("video", "frame").distinct()


def distinct_identities(df: DataFrame) -> DataFrame:
    return df.select("video", "identity").distinct()


def object_size(gt: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean width and height, and mean shorter and longer side."""
    box = G.corners()
    width, height = G.box_width(box), G.box_height(box)
    return gt.groupBy(*(by or [])).agg(
        F.avg(width).alias("avg_width"),
        F.avg(height).alias("avg_height"),
        F.avg(F.least(width, height)).alias("avg_min_side"),
        F.avg(F.greatest(width, height)).alias("avg_max_side"),
    )
