"""Queries on boxes: geometry, matching, counts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.catalog import query
from trackframe.functions import geometry as G
from trackframe.functions import sql_functions
from trackframe.operators import matching as M
from trackframe.operators import metrics as E
from trackframe.sources import fixtures as X

BOXES = "gt_regions calc_regions"

IOU_SQL = """
pairs as (
  select a.video, a.frame, a.ord as a_ord, b.ord as b_ord,
    a.x2 - a.x1 as aw, a.y2 - a.y1 as ah, b.x2 - b.x1 as bw, b.y2 - b.y1 as bh,
    case when a.x1 = b.x1 and a.y1 = b.y1 and a.x2 = b.x2 and a.y2 = b.y2 then 1.0e0
    else cast((least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) as double)
      / ((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1)
        - (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1))) end as iou
  from calc_regions a join gt_regions b on a.video = b.video and a.frame = b.frame
    and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2
)"""


def greedy_sql(tag: str, walker: str, other: str, where: str = "true") -> str:
    """Two CTEs: the greedy walk over one side of ``pairs``, and its last step per frame."""
    return f"""
{tag}_c as (
  select video, frame, {walker} as w, list({other} order by iou desc, {other}) as cands,
    row_number() over (partition by video, frame order by {walker}) as rn,
    count(*) over (partition by video, frame) as n
  from pairs where {where} group by video, frame, {walker}
),
{tag}_walk as (
  select video, frame, rn, n, w, cands[1] as pick, [cands[1]] as used from {tag}_c where rn = 1
  union all
  select c.video, c.frame, c.rn, c.n, c.w,
    list_filter(c.cands, lambda k: not list_contains(r.used, k))[1] as pick,
    case when len(list_filter(c.cands, lambda k: not list_contains(r.used, k))) > 0
      then list_append(r.used, list_filter(c.cands, lambda k: not list_contains(r.used, k))[1])
      else r.used end as used
  from {tag}_walk r join {tag}_c c on c.video = r.video and c.frame = r.frame and c.rn = r.rn + 1
)"""


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    base = X.boxes_base(spark, sf)
    return X.calc_from_base(base), X.gt_from_base(base)


@query(
    "iou_pairs",
    BOXES,
    f"with {IOU_SQL} select video, frame, a_ord, b_ord, round(iou, 9) as iou from pairs",
)
def iou_pairs(spark, sf):
    calc, gt = _both(spark, sf)
    return M.overlap_join(calc, gt).select(
        "video", "frame", "a_ord", "b_ord", F.round("iou", 9).alias("iou")
    )


@query(
    "iou_pairs_threshold",
    BOXES,
    f"with {IOU_SQL} select video, frame, a_ord, b_ord from pairs where iou >= 0.5e0",
)
def iou_pairs_threshold(spark, sf):
    calc, gt = _both(spark, sf)
    return M.overlap_join(calc, gt, 0.5).select("video", "frame", "a_ord", "b_ord")


@query(
    "same_region",
    BOXES,
    f"with {IOU_SQL} select video, frame, a_ord, b_ord, iou > 0.3e0 as same from pairs",
)
def same_region(spark, sf):
    calc, gt = _both(spark, sf)
    a = tuple(F.col(f"a_{n}") for n in G.BOX_COLUMNS)
    b = tuple(F.col(f"b_{n}") for n in G.BOX_COLUMNS)
    return M.overlap_join(calc, gt).select(
        "video", "frame", "a_ord", "b_ord", G.same_region(a, b).alias("same")
    )


@query(
    "sql_functions",
    BOXES,
    f"""with {IOU_SQL} select p.video, p.frame, p.a_ord, p.b_ord, round(p.iou, 9) as iou,
      cast(p.aw*p.ah as bigint) as area, a.x1 + (a.x2-a.x1)/2.0e0 as cx, a.y1 + (a.y2-a.y1)/2.0e0 as cy
    from pairs p join calc_regions a on a.video=p.video and a.frame=p.frame and a.ord=p.a_ord""",
)
def sql_functions_query(spark, sf):
    sql_functions.register(spark)
    calc, gt = _both(spark, sf)
    return M.overlap_join(calc, gt).selectExpr(
        "video",
        "frame",
        "a_ord",
        "b_ord",
        "round(iou(a_x1, a_y1, a_x2, a_y2, b_x1, b_y1, b_x2, b_y2), 9) as iou",
        "box_area(a_x1, a_y1, a_x2, a_y2) as area",
        "centroid_x(a_x1, a_y1, a_x2, a_y2) as cx",
        "centroid_y(a_x1, a_y1, a_x2, a_y2) as cy",
    )


@query(
    "box_geometry",
    "gt_regions",
    """select video, frame, ord, x2-x1 as width, y2-y1 as height, (x2-x1)*(y2-y1) as area,
      x1 + (x2-x1)/2.0e0 as cx, y1 + (y2-y1)/2.0e0 as cy from gt_regions""",
)
def box_geometry(spark, sf):
    box = G.corners()
    cx, cy = G.centroid(box)
    return X.gt_regions(spark, sf).select(
        "video",
        "frame",
        "ord",
        G.box_width(box).alias("width"),
        G.box_height(box).alias("height"),
        G.box_area(box).alias("area"),
        cx.alias("cx"),
        cy.alias("cy"),
    )


@query(
    "centroid_distance",
    BOXES,
    f"""with {IOU_SQL} select p.video, p.frame, p.a_ord, p.b_ord,
      round(sqrt(pow((a.x1+a.x2)/2.0e0-(b.x1+b.x2)/2.0e0, 2) + pow((a.y1+a.y2)/2.0e0-(b.y1+b.y2)/2.0e0, 2)), 6) as dist
    from pairs p join calc_regions a on a.video=p.video and a.frame=p.frame and a.ord=p.a_ord
      join gt_regions b on b.video=p.video and b.frame=p.frame and b.ord=p.b_ord""",
)
def centroid_distance(spark, sf):
    calc, gt = _both(spark, sf)
    a = tuple(F.col(f"a_{n}") for n in G.BOX_COLUMNS)
    b = tuple(F.col(f"b_{n}") for n in G.BOX_COLUMNS)
    return M.overlap_join(calc, gt).select(
        "video", "frame", "a_ord", "b_ord", F.round(G.centroid_distance(a, b), 6).alias("dist")
    )


@query(
    "box_conversions",
    "gt_regions",
    """select video, frame, ord, x1, y1, x2 - x1 as width, y2 - y1 as height,
      x1 + (x2 - x1) as back_x2, y1 + (y2 - y1) as back_y2 from gt_regions""",
)
def box_conversions(spark, sf):
    wide = G.xyxy_to_xywh(X.gt_regions(spark, sf)).drop("identity")
    back = G.xywh_to_xyxy(wide.withColumns({"w": F.col("width"), "h": F.col("height")}), "w", "h")
    return back.withColumnsRenamed({"x2": "back_x2", "y2": "back_y2"})


@query(
    "snap_box",
    "gt_regions",
    """select video, frame, ord, cast(floor(x1*0.37e0) as int) as x1, cast(floor(y1*0.37e0) as int) as y1,
      cast(ceil(x2*0.37e0) as int) as x2, cast(ceil(y2*0.37e0) as int) as y2 from gt_regions""",
)
def snap_box(spark, sf):
    snapped = G.snap_box(tuple(c * F.lit(0.37) for c in G.corners()))
    return X.gt_regions(spark, sf).select(
        "video", "frame", "ord", *[c.alias(n) for c, n in zip(snapped, G.BOX_COLUMNS)]
    )


@query(
    "pad_clamp_box",
    "gt_regions",
    """select video, frame, ord,
      cast(round_even(greatest(x1 - (x2-x1)/2.0e0, 0), 0) as int) as x1,
      cast(round_even(greatest(y1 - (x2-x1)/2.0e0, 0), 0) as int) as y1,
      cast(least(round_even(x2 + (x2-x1)/2.0e0, 0), 255) as int) as x2,
      cast(least(round_even(y2 + (y2-y1)/2.0e0, 0), 191) as int) as y2 from gt_regions""",
)
def pad_clamp_box(spark, sf):
    padded = G.pad_box(G.corners(), 256, 192)
    return X.gt_regions(spark, sf).select(
        "video", "frame", "ord", *[c.alias(n) for c, n in zip(padded, G.BOX_COLUMNS)]
    )


@query(
    "clamp",
    "gt_regions",
    "select video, frame, ord, greatest(least(x1, 200), 50) as x1 from gt_regions",
)
def clamp(spark, sf):
    return X.gt_regions(spark, sf).select(
        "video", "frame", "ord", G.clamp(F.col("x1"), F.lit(50), F.lit(200)).alias("x1")
    )


@query("min_size", "gt_regions", "select * from gt_regions where (x2-x1)*(y2-y1) >= 200")
def min_size(spark, sf):
    return G.min_size(X.gt_regions(spark, sf), 200)


@query("max_size", "gt_regions", "select * from gt_regions where x2-x1 <= 16 and y2-y1 <= 14")
def max_size(spark, sf):
    return G.max_size(X.gt_regions(spark, sf), 16, 14)


@query("observed_only", "observed_tracks", "select * from observed_tracks where observed")
def observed_only(spark, sf):
    return G.observed_only(X.observed_tracks(spark, sf))


@query(
    "frame_slice",
    "gt_regions",
    """select video, frame - 89 as frame, identity, ord, x1, y1, x2, y2 from gt_regions
    where frame between 90 and 180""",
)
def frame_slice(spark, sf):
    return G.frame_slice(X.gt_regions(spark, sf), 90, 180)


@query("at_frame", "gt_regions", "select * from gt_regions where frame = 42")
def at_frame(spark, sf):
    return G.at_frame(X.gt_regions(spark, sf), 42)


@query(
    "best_match",
    BOXES,
    f"""with {IOU_SQL}, best as (
      select *, row_number() over (partition by video, frame, a_ord order by iou desc, b_ord) as rn from pairs)
    select a.video, a.frame, a.ord, coalesce(b.b_ord, -1) as b_ord, round(coalesce(b.iou, 0), 9) as iou
    from calc_regions a left join best b on b.video=a.video and b.frame=a.frame and b.a_ord=a.ord and b.rn=1""",
)
def best_match(spark, sf):
    calc, gt = _both(spark, sf)
    return M.best_match(calc, gt).select(
        "video",
        "frame",
        "ord",
        F.coalesce("b_ord", F.lit(-1).cast("long")).alias("b_ord"),
        F.round(F.coalesce("iou", F.lit(0.0)), 9).alias("iou"),
    )


@query(
    "top1_by_iou",
    BOXES,
    f"""with {IOU_SQL} select video, frame, a_ord, b_ord from (
      select *, row_number() over (partition by video, frame, a_ord order by iou desc, b_ord) as rn from pairs) t
    where rn = 1""",
)
def top1_by_iou(spark, sf):
    calc, gt = _both(spark, sf)
    return M.top1_by_iou(M.overlap_join(calc, gt)).drop("iou")


@query(
    "greedy_match",
    BOXES,
    f"""with recursive {IOU_SQL}, {greedy_sql('g', 'a_ord', 'b_ord')}
    select video, frame, w as a_ord, pick as b_ord from g_walk where pick is not null""",
)
def greedy_match(spark, sf):
    calc, gt = _both(spark, sf)
    return M.greedy_match(calc, gt).drop("iou")


@query(
    "greedy_match_rounds",
    BOXES,
    f"""with recursive {IOU_SQL}, {greedy_sql('g', 'a_ord', 'b_ord')}
    select video, frame, w as a_ord, pick as b_ord from g_walk where pick is not null""",
)
def greedy_match_rounds(spark, sf):
    """The same matching with small grid cells."""
    calc, gt = _both(spark, sf)
    return M.greedy_match(calc, gt, cell=16).drop("iou")


CROWD = 20


def crowded(df: DataFrame) -> DataFrame:
    """CROWD frames as one: hundreds of boxes in a frame, with long chains of overlaps."""
    return df.withColumn("ord", F.col("frame") * 1000 + F.col("ord")).withColumn(
        "frame", F.floor((F.col("frame") - 1) / CROWD) + 1
    )


def _crowd_sql(name: str) -> str:
    return f"""{name}_crowd as (select video, (frame - 1) // {CROWD} + 1 as frame,
      frame * 1000 + ord as ord, identity, x1, y1, x2, y2 from {name})"""


CROWD_SQL = f"""{_crowd_sql('calc_regions')}, {_crowd_sql('gt_regions')}, """ + IOU_SQL.replace(
    "from calc_regions a join gt_regions b", "from calc_regions_crowd a join gt_regions_crowd b"
)


@query(
    "greedy_match_crowded",
    BOXES,
    f"""with recursive {CROWD_SQL}, {greedy_sql('g', 'a_ord', 'b_ord', 'iou >= 0.3e0')}
    select video, frame, w as a_ord, pick as b_ord from g_walk where pick is not null""",
)
def greedy_match_crowded(spark, sf):
    """Frames of several hundred boxes on either side."""
    calc, gt = (crowded(df) for df in _both(spark, sf))
    return M.greedy_match(calc, gt, 0.3).drop("iou")


@query(
    "region_semi",
    BOXES,
    f"""with {IOU_SQL} select video, frame, ord, x1, y1, x2, y2 from calc_regions a
    where exists (select 1 from pairs p where p.video=a.video and p.frame=a.frame and p.a_ord=a.ord)""",
)
def region_semi(spark, sf):
    calc, gt = _both(spark, sf)
    return M.region_semi(calc, gt).drop("identity")


@query(
    "region_anti",
    BOXES,
    f"""with {IOU_SQL} select video, frame, ord, x1, y1, x2, y2 from calc_regions a
    where not exists (select 1 from pairs p where p.video=a.video and p.frame=a.frame and p.a_ord=a.ord)""",
)
def region_anti(spark, sf):
    calc, gt = _both(spark, sf)
    return M.region_anti(calc, gt).drop("identity")


LAST_SQL = """lastf as (
  select a.video, least(a.m, b.m) as m from (select video, max(frame) as m from calc_regions group by 1) a
  join (select video, max(frame) as m from gt_regions group by 1) b on a.video = b.video),
spine as (select video, unnest(range(1, m + 1)) as frame from lastf),
nc as (select video, frame, count(*) as n from calc_regions group by 1, 2),
ng as (select video, frame, count(*) as n from gt_regions group by 1, 2)"""

COUNTS_SQL = """counts as (
  select s.video, s.frame, cast(coalesce(f.n, 0) as bigint) as true_positive,
    cast(coalesce(ng.n, 0) - coalesce(b.n, 0) as bigint) as false_negative,
    cast(coalesce(nc.n, 0) - coalesce(f.n, 0) as bigint) as false_positive
  from spine s left join nc on nc.video=s.video and nc.frame=s.frame
  left join ng on ng.video=s.video and ng.frame=s.frame
  left join fwd f on f.video=s.video and f.frame=s.frame
  left join bwd b on b.video=s.video and b.frame=s.frame)"""


def counts_sql(where_first: str = "true", where_second: str = "true") -> str:
    return f"""with recursive {IOU_SQL}, {LAST_SQL},
{greedy_sql('g', 'a_ord', 'b_ord', where_first)}, {greedy_sql('h', 'b_ord', 'a_ord', where_second)},
fwd as (select video, frame, count(pick) as n from g_walk group by 1, 2),
bwd as (select video, frame, count(pick) as n from h_walk group by 1, 2),
{COUNTS_SQL}"""


OVERLAP_COUNTS = f"""with {IOU_SQL}, {LAST_SQL},
fwd as (select video, frame, count(distinct a_ord) as n from pairs group by 1, 2),
bwd as (select video, frame, count(distinct b_ord) as n from pairs group by 1, 2),
{COUNTS_SQL}"""

SCORES_SQL = """select video, tp as true_positive, fn as false_negative, fp as false_positive,
  round(r, 9) as recall, round(p, 9) as precision,
  round(case when p + r = 0 then 0 else 2*p*r/(p+r) end, 9) as f1
from (select *, case when tp+fn=0 then 0 else cast(tp as double)/(tp+fn) end as r,
    case when tp+fp=0 then 0 else cast(tp as double)/(tp+fp) end as p
  from (select video, cast(sum(true_positive) as bigint) as tp, cast(sum(false_negative) as bigint) as fn,
    cast(sum(false_positive) as bigint) as fp from counts group by video) c) d"""


def rounded_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in ("recall", "precision", "f1")})


@query("frame_counts_deny", BOXES, counts_sql() + " select * from counts")
def frame_counts_deny(spark, sf):
    return E.frame_counts(*_both(spark, sf))


@query("frame_counts_overlap", BOXES, OVERLAP_COUNTS + " select * from counts")
def frame_counts_overlap(spark, sf):
    return E.frame_counts(*_both(spark, sf), allow_overlap=True)


@query("detection_scores", BOXES, counts_sql() + SCORES_SQL)
def detection_scores(spark, sf):
    return rounded_scores(E.detection_scores(E.frame_counts(*_both(spark, sf)), ["video"]))


@query(
    "max_size_scores",
    BOXES,
    counts_sql("bw <= 16 and bh <= 14", "aw <= 16 and ah <= 14") + SCORES_SQL,
)
def max_size_scores(spark, sf):
    counts = E.frame_counts(*_both(spark, sf), max_width=16, max_height=14)
    return rounded_scores(E.detection_scores(counts, ["video"]))


@query("threshold_scores", BOXES, counts_sql("iou >= 0.5e0", "iou >= 0.5e0") + SCORES_SQL)
def threshold_scores(spark, sf):
    counts = E.frame_counts(*_both(spark, sf), threshold=0.5)
    return rounded_scores(E.detection_scores(counts, ["video"]))


@query(
    "frame_count",
    "gt_regions",
    "select video, coalesce(max(frame), 0) as frame_count from gt_regions group by video",
)
def frame_count(spark, sf):
    return E.frame_count(X.gt_regions(spark, sf))
