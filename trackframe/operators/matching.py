"""Box joins and one-to-one matching per frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.session import spread

FRAME_KEYS = ["video", "frame"]
CELL = 64


def _cells(low: Column, high: Column, cell: int) -> Column:
    """Grid positions covered by the half-open pixel range low..high."""
    return F.sequence(F.floor(low / cell), F.floor((high - 1) / cell))


def to_cells(df: DataFrame, cell: int = CELL) -> DataFrame:
    """One row per grid cell a box covers; empty and inverted boxes cover none."""
    box = G.corners()
    return (
        df.filter((box[2] > box[0]) & (box[3] > box[1]))
        .withColumn("cx", F.explode(_cells(box[0], box[2], cell)))
        .withColumn("cy", F.explode(_cells(box[1], box[3], cell)))
    )


def overlap_join(
    a: DataFrame,
    b: DataFrame,
    min_iou: float = 0.0,
    cell: int = CELL,
    keys: list[str] | None = None,
) -> DataFrame:
    """Pairs of boxes of one frame with IoU > 0 and at least ``min_iou``.

    Both sides are spread over grid cells and joined on (frame, cell), so a
    crowded frame is many join keys. A pair that shares several cells is kept
    only in the cell of its intersection's top-left corner.

    Output: keys, iou, and every other column of a side with prefix a_ or b_.
    """
    keys = keys or FRAME_KEYS
    on = [*keys, "cx", "cy"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        renamed = [
            F.col(name) if name in on else F.col(name).alias(f"{tag}_{name}")
            for name in [*df.columns, "cx", "cy"]
        ]
        return to_cells(df, cell).select(*renamed)

    joined = side(a, "a").join(side(b, "b"), on)
    box_a = tuple(F.col(f"a_{name}") for name in G.BOX_COLUMNS)
    box_b = tuple(F.col(f"b_{name}") for name in G.BOX_COLUMNS)
    home = (F.floor(F.greatest(box_a[0], box_b[0]) / cell) == F.col("cx")) & (
        F.floor(F.greatest(box_a[1], box_b[1]) / cell) == F.col("cy")
    )
    pairs = (
        joined.filter(G.touches(box_a, box_b) & home)
        .withColumn("iou", G.iou(box_a, box_b))
        .drop("cx", "cy")
    )
    return pairs.filter(F.col("iou") >= min_iou) if min_iou > 0 else pairs


def take_free(batches: Iterator, keys: list[str]) -> Iterator:
    """Keep each edge of sorted Arrow batches whose two ends l and r are both free.

    All that is held are the used ends of the current key.
    """
    import pyarrow as pa

    current, left, right = None, set(), set()
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in (*keys, "l", "r")]
        kept = []
        for *key, a, b in zip(*columns, strict=True):
            if key != current:
                current, left, right = key, set(), set()
            free = a not in left and b not in right
            if free:
                left.add(a)
                right.add(b)
            kept.append(free)
        yield batch.filter(pa.array(kept, pa.bool_()))


def greedy_edges(
    edges: DataFrame,
    left: str,
    right: str,
    order: list[Column],
    keys: list[str] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Greedy one-to-one matching: take edges in ``order`` while both ends are free.

    Edges are dealt by key, sorted inside their partition and streamed through one
    walk, whatever the size of a frame. Output: keys, left, right, carry columns.
    """
    keys = keys or FRAME_KEYS
    carry = carry or []
    names = [f"o{i}" for i in range(len(order))]
    ranked = edges.select(
        *keys,
        *[value.alias(name) for name, value in zip(names, order)],
        F.col(left).alias("l"),
        F.col(right).alias("r"),
        *[F.col(name).alias(f"c_{name}") for name in carry],
    )
    placed = spread(ranked, *keys).sortWithinPartitions(*keys, *names, "l", "r")
    kept = placed.drop(*names).mapInArrow(
        lambda batches: take_free(batches, keys), placed.drop(*names).schema
    )
    return kept.select(
        *keys,
        F.col("l").alias(left),
        F.col("r").alias(right),
        *[F.col(f"c_{name}").alias(name) for name in carry],
    )


def greedy_match(
    a: DataFrame,
    b: DataFrame,
    min_iou: float = 0.0,
    max_width: int | None = None,
    max_height: int | None = None,
    cell: int = CELL,
) -> DataFrame:
    """Per frame, in order of ``ord``, each a takes its best free b.

    Best is the highest IoU, then the lowest ``ord`` of b. Size limits apply to
    the b box. Output: video, frame, a_ord, b_ord, iou.
    """
    pairs = overlap_join(_slim(a), _slim(b), min_iou, cell)
    pairs = within_size(pairs, "b", max_width, max_height)
    return greedy_edges(
        pairs,
        "a_ord",
        "b_ord",
        [F.col("a_ord"), -F.col("iou"), F.col("b_ord")],
        carry=["iou"],
    )


def _slim(df: DataFrame) -> DataFrame:
    return df.select(*FRAME_KEYS, "ord", *G.BOX_COLUMNS)


def within_size(
    pairs: DataFrame, side: str, width: int | None, height: int | None
) -> DataFrame:
    if width is not None:
        pairs = pairs.filter(F.col(f"{side}_x2") - F.col(f"{side}_x1") <= width)
    if height is not None:
        pairs = pairs.filter(F.col(f"{side}_y2") - F.col(f"{side}_y1") <= height)
    return pairs


def best_match(a: DataFrame, b: DataFrame, min_iou: float = 0.0) -> DataFrame:
    """Overlap allowed: each a with its best b, or null. One row per a box."""
    pairs = overlap_join(_slim(a), _slim(b), min_iou)
    best = (
        pairs.groupBy(*FRAME_KEYS, F.col("a_ord").alias("ord"))
        .agg(F.min(F.struct((-F.col("iou")).alias("n"), F.col("b_ord"))).alias("best"))
        .select(*FRAME_KEYS, "ord", F.col("best.b_ord"), (-F.col("best.n")).alias("iou"))
    )
    return a.join(best, [*FRAME_KEYS, "ord"], "left")


def top1_by_iou(pairs: DataFrame) -> DataFrame:
    """The best b of each a among given pairs, ties by the order of b."""
    best = F.min(F.struct((-F.col("iou")).alias("n"), F.col("b_ord")))
    return (
        pairs.groupBy(*FRAME_KEYS, "a_ord")
        .agg(best.alias("best"))
        .select(*FRAME_KEYS, "a_ord", F.col("best.b_ord"), (-F.col("best.n")).alias("iou"))
    )


def hit_boxes(
    a: DataFrame,
    b: DataFrame,
    test: Callable[[G.Box, G.Box], Column],
    key: list[str],
    cell: int = CELL,
) -> DataFrame:
    """Distinct ``key`` columns of the a boxes for which some b box passes ``test``.

    Both are spread over grid cells; the semi join stops at the first proof, so
    no pairs are built however crowded a cell is. ``test`` gets both boxes and
    sees the columns of b with prefix b_.
    """
    right = to_cells(b, cell).select(
        *[F.col(n).alias(f"b_{n}") for n in [*b.columns, "cx", "cy"]]
    )
    box_a, box_b = G.corners(), tuple(F.col(f"b_{n}") for n in G.BOX_COLUMNS)
    same = [F.col(n) == F.col(f"b_{n}") for n in (*FRAME_KEYS, "cx", "cy")]
    on = reduce(Column.__and__, same) & G.touches(box_a, box_b) & test(box_a, box_b)
    return to_cells(a, cell).join(right, on, "left_semi").select(*key).distinct()


def _touching(a: DataFrame, b: DataFrame, min_iou: float) -> DataFrame:
    def test(box_a: G.Box, box_b: G.Box) -> Column:
        return G.iou(box_a, box_b) >= min_iou if min_iou > 0 else F.lit(True)

    boxes = b.select(*FRAME_KEYS, *G.BOX_COLUMNS)
    return hit_boxes(_slim(a), boxes, test, [*FRAME_KEYS, "ord"])


def region_semi(a: DataFrame, b: DataFrame, min_iou: float = 0.0) -> DataFrame:
    """Boxes of a that touch some box of b."""
    return a.join(_touching(a, b, min_iou), [*FRAME_KEYS, "ord"], "left_semi")


def region_anti(a: DataFrame, b: DataFrame, min_iou: float = 0.0) -> DataFrame:
    """Boxes of a that touch no box of b."""
    return a.join(_touching(a, b, min_iou), [*FRAME_KEYS, "ord"], "left_anti")


def nearest_previous(curr: DataFrame, prev: DataFrame, max_dist: float) -> DataFrame:
    """Pairs of a box and a box of the frame before, centers at most ``max_dist`` apart.

    Centers fall into square cells four distances wide. A previous center is
    offered to every cell its reach touches, mostly one or two per direction, so
    each pair meets once, in the cell of the current center. ``ord`` names the
    box on both sides. Output: video, frame, curr, prev, dist.
    """
    size = F.lit(float(max(max_dist, 1.0)) * 4)

    def centered(df: DataFrame, name: str, tag: str) -> DataFrame:
        x, y = G.centroid(G.corners())
        return df.select(
            "video",
            "frame",
            F.col("ord").alias(name),
            x.alias(f"{tag}x"),
            y.alias(f"{tag}y"),
        )

    def reached(center: Column) -> Column:
        return F.explode(
            F.sequence(F.floor((center - max_dist) / size), F.floor((center + max_dist) / size))
        )

    now = centered(curr, "curr", "c").withColumns(
        {"gx": F.floor(F.col("cx") / size), "gy": F.floor(F.col("cy") / size)}
    )
    before = (
        centered(prev, "prev", "p")
        .withColumn("frame", F.col("frame") + 1)
        .withColumn("gx", reached(F.col("px")))
        .withColumn("gy", reached(F.col("py")))
    )
    dist = G.point_distance((F.col("cx"), F.col("cy")), (F.col("px"), F.col("py")))
    return (
        now.join(before, ["video", "frame", "gx", "gy"])
        .withColumn("dist", dist)
        .filter(F.col("dist") <= max_dist)
        .select("video", "frame", "curr", "prev", "dist")
    )


def greedy_assign(pairs: DataFrame) -> DataFrame:
    """Smallest distances first, each previous and each current box used once."""
    order = [F.col("dist"), F.col("prev"), F.col("curr")]
    return greedy_edges(pairs, "curr", "prev", order, carry=["dist"])


def assign_previous(curr: DataFrame, prev: DataFrame, max_dist: float) -> DataFrame:
    """Nearest boxes of the frame before, one to one."""
    return greedy_assign(nearest_previous(curr, prev, max_dist))


def carry_forward(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """Boxes of ``curr`` plus each track of the frame before that has no box now.

    Frames without any current box get nothing. Both sides need identity.
    """
    frames = curr.select(*FRAME_KEYS).distinct()
    names = [name for name in curr.columns if name in prev.columns]
    moved = prev.select(*names).withColumn("frame", F.col("frame") + 1)
    missing = moved.join(
        curr.filter(F.col("identity").isNotNull()).select(*FRAME_KEYS, "identity"),
        [*FRAME_KEYS, "identity"],
        "left_anti",
    ).join(frames, FRAME_KEYS, "left_semi")
    return (
        curr.select(*names)
        .withColumn("carried", F.lit(False))
        .unionByName(missing.withColumn("carried", F.lit(True)))
    )


def suppress_duplicates(df: DataFrame, threshold: float, corrected: bool = False) -> DataFrame:
    """Drop the loser of every pair of boxes of a frame with IoU >= threshold.

    An identified box beats an unidentified one and the lower identity wins.
    Two unidentified boxes remove each other, as published; ``corrected`` keeps
    the one listed first.
    """
    slim = df.select(*FRAME_KEYS, "ord", "identity", *G.BOX_COLUMNS)
    mine, theirs = F.col("identity"), F.col("b_identity")
    neither = F.lit(True) if not corrected else F.col("b_ord") < F.col("ord")
    loses = (
        F.when(mine.isNull() & theirs.isNull(), neither)
        .when(mine.isNull(), F.lit(True))
        .when(theirs.isNull(), F.lit(False))
        .when(mine == theirs, neither)
        .otherwise(theirs < mine)
    )

    def test(box_a: G.Box, box_b: G.Box) -> Column:
        return (F.col("ord") != F.col("b_ord")) & loses & (G.iou(box_a, box_b) >= threshold)

    losers = hit_boxes(slim, slim, test, [*FRAME_KEYS, "ord"])
    return df.join(losers, [*FRAME_KEYS, "ord"], "left_anti")
