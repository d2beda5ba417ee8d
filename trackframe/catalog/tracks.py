"""Queries on tracks, frames and result sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.catalog import ORACLES, query
from trackframe.functions import geometry as G
from trackframe.operators import matching as M
from trackframe.operators import sets as S
from trackframe.operators import tracks as T
from trackframe.plans.stages import chain
from trackframe.sources import fixtures as X

STEP_SQL = """with s as (
  select video, identity, frame, x1 + (x2-x1)/2.0e0 as cx, y1 + (y2-y1)/2.0e0 as cy,
    lag(x1 + (x2-x1)/2.0e0) over w as px, lag(y1 + (y2-y1)/2.0e0) over w as py
  from tracks window w as (partition by video, identity order by frame))"""


@query(
    "velocity",
    "tracks",
    STEP_SQL + """ select video, identity, frame, cx as centroid_x, cy as centroid_y,
      round(sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py)) * 30, 6) as velocity from s where px is not null""",
)
def velocity(spark, sf):
    return T.velocity(X.tracks(spark, sf), 30).withColumn("velocity", F.round("velocity", 6))


@query(
    "direction",
    "tracks",
    STEP_SQL + """ select video, identity, frame, cx as centroid_x, cy as centroid_y,
      round(atan2(cy-py, cx-px), 6) as direction from s where px is not null""",
)
def direction(spark, sf):
    return T.direction(X.tracks(spark, sf)).withColumn("direction", F.round("direction", 6))


@query(
    "velocity_table",
    "tracks",
    STEP_SQL + """ select video, identity, frame, cx as centroid_x, cy as centroid_y,
      round(sqrt((cx-px)*(cx-px) + (cy-py)*(cy-py)) * 30, 6) as velocity,
      round(atan2(cy-py, cx-px), 6) as direction from s where px is not null""",
)
def velocity_table(spark, sf):
    return T.velocity_table(X.tracks(spark, sf), 30).withColumns(
        {n: F.round(n, 6) for n in ("velocity", "direction")}
    )


@query(
    "observation_hysteresis",
    "observed_tracks",
    """select video, identity, frame, x1, y1, observed from (
      select *, count(*) over (partition by video, identity) as n from observed_tracks where observed) t
    where n >= 2""",
)
def observation_hysteresis(spark, sf):
    return T.observation_hysteresis(X.observed_tracks(spark, sf))


MOVED_SQL = """case when a.x1<b.x2 and b.x1<a.x2 and a.y1<b.y2 and b.y1<a.y2 then
  case when a.x1=b.x1 and a.y1=b.y1 and a.x2=b.x2 and a.y2=b.y2 then 1.0e0 else
    cast((least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) as double)
    / ((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1)
      - (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1))) end
  else 0 end <= {limit}"""


@query(
    "motion_only",
    "gt_regions",
    f"""select a.* from gt_regions a where exists (select 1 from gt_regions b
      where b.video=a.video and b.identity=a.identity and b.frame<>a.frame
      and b.frame between a.frame-20 and a.frame+30 and {MOVED_SQL.format(limit="0.425e0")})""",
)
def motion_only(spark, sf):
    return T.motion_only(X.gt_regions(spark, sf))


@query(
    "motion_only_short",
    "gt_regions",
    f"""select a.* from gt_regions a where exists (select 1 from gt_regions b
      where b.video=a.video and b.identity=a.identity and b.frame<>a.frame
      and b.frame between a.frame-3 and a.frame+2 and {MOVED_SQL.format(limit="0.425e0")})""",
)
def motion_only_short(spark, sf):
    return T.motion_only(X.gt_regions(spark, sf), 3, 2)


NEAR_SQL = """near as (
  select c.video, c.frame, c.ord as curr, p.ord as prev, sqrt(
    ((c.x1+(c.x2-c.x1)/2.0e0)-(p.x1+(p.x2-p.x1)/2.0e0))*((c.x1+(c.x2-c.x1)/2.0e0)-(p.x1+(p.x2-p.x1)/2.0e0))
    + ((c.y1+(c.y2-c.y1)/2.0e0)-(p.y1+(p.y2-p.y1)/2.0e0))*((c.y1+(c.y2-c.y1)/2.0e0)-(p.y1+(p.y2-p.y1)/2.0e0))) as dist
  from calc_regions c join calc_regions p on p.video=c.video and p.frame=c.frame-1
),
pairs as (select * from near where dist <= 20)"""


@query(
    "nearest_previous",
    "calc_regions",
    f"""with {NEAR_SQL} select video, frame, curr, prev, round(dist, 6) as dist from pairs""",
)
def nearest_previous(spark, sf):
    calc = X.calc_regions(spark, sf)
    return M.nearest_previous(calc, calc, 20).withColumn("dist", F.round("dist", 6))


ASSIGN_SQL = """with recursive {near},
e as (select video, frame, curr, prev,
  row_number() over (partition by video, frame order by dist, prev, curr) as rn from pairs),
walk as (
  select video, frame, rn, [curr] as uc, [prev] as up, curr, prev, true as taken from e where rn = 1
  union all
  select e.video, e.frame, e.rn,
    case when list_contains(w.uc, e.curr) or list_contains(w.up, e.prev) then w.uc else list_append(w.uc, e.curr) end,
    case when list_contains(w.uc, e.curr) or list_contains(w.up, e.prev) then w.up else list_append(w.up, e.prev) end,
    e.curr, e.prev, not (list_contains(w.uc, e.curr) or list_contains(w.up, e.prev))
  from walk w join e on e.video=w.video and e.frame=w.frame and e.rn=w.rn+1)
select video, frame, curr, prev from walk where taken""".format(near=NEAR_SQL)


@query("greedy_assign", "calc_regions", ASSIGN_SQL)
def greedy_assign(spark, sf):
    calc = X.calc_regions(spark, sf)
    return M.assign_previous(calc, calc, 20).drop("dist")


@query("greedy_assign_rounds", "calc_regions", ASSIGN_SQL)
def greedy_assign_rounds(spark, sf):
    """The same assignment from pairs that are there already."""
    calc = X.calc_regions(spark, sf)
    return M.greedy_assign(M.nearest_previous(calc, calc, 20)).drop("dist")


@query(
    "carry_forward",
    "gt_regions calc_regions",
    """select video, frame, identity, ord, x1, y1, x2, y2, false as carried from gt_regions
    union all
    select p.video, p.frame + 1, p.identity, p.ord, p.x1, p.y1, p.x2, p.y2, true from calc_regions p
    where exists (select 1 from gt_regions c where c.video=p.video and c.frame=p.frame+1)
      and not exists (select 1 from gt_regions c
        where c.video=p.video and c.frame=p.frame+1 and c.identity=p.identity)""",
)
def carry_forward(spark, sf):
    return M.carry_forward(X.calc_regions(spark, sf), X.gt_regions(spark, sf))


DUP_SQL = """select video, frame, ord, ident, x1, y1, x2, y2 from d a where not exists (
  select 1 from d b where b.video=a.video and b.frame=a.frame and b.ord<>a.ord
    and a.x1<b.x2 and b.x1<a.x2 and a.y1<b.y2 and b.y1<a.y2
    and not ({moved})
    and case when a.ident is null and b.ident is null then {neither}
      when a.ident is null then true when b.ident is null then false
      when a.ident = b.ident then {neither} else b.ident < a.ident end)"""
DUP_WITH = """with d as (select video, frame, ord,
  case when ord % 3 = 0 then null else identity end as ident, x1, y1, x2, y2 from calc_regions) """
# IoU >= 0.15 is the complement of IoU < 0.15
BELOW = MOVED_SQL.replace("<= {limit}", "< 0.15e0")
FILLED = "select video, frame, ord, coalesce(ident, -1) as identity, x1, y1, x2, y2 from ({}) q"


def _with_gaps(spark, sf):
    return X.calc_regions(spark, sf).withColumn(
        "identity", F.when(F.col("ord") % 3 != 0, F.col("identity"))
    )


def _filled(df):
    return df.withColumn("identity", F.coalesce("identity", F.lit(-1).cast("long")))


@query(
    "suppress_duplicates",
    "calc_regions",
    DUP_WITH + FILLED.format(DUP_SQL.format(moved=BELOW, neither="true")),
)
def suppress_duplicates(spark, sf):
    return _filled(M.suppress_duplicates(_with_gaps(spark, sf), 0.15))


@query(
    "suppress_duplicates_corrected",
    "calc_regions",
    DUP_WITH + FILLED.format(DUP_SQL.format(moved=BELOW, neither="b.ord < a.ord")),
)
def suppress_duplicates_corrected(spark, sf):
    return _filled(M.suppress_duplicates(_with_gaps(spark, sf), 0.15, corrected=True))


@query(
    "assign_ids",
    "calc_regions",
    DUP_WITH + """select video, frame, ord, x1, y1, x2, y2, case when ident is not null then ident else
      row_number() over (partition by video, ident is null order by frame, ord) - 1 end as identity
    from d""",
)
def assign_ids(spark, sf):
    return T.assign_ids(_with_gaps(spark, sf)).drop("id_str")


@query(
    "with_transform",
    "gt_regions transformations",
    "select r.*, t.t13, t.t23 from gt_regions r join transformations t on r.video=t.video and r.frame=t.frame",
)
def with_transform(spark, sf):
    joined = T.with_transform(X.gt_regions(spark, sf), X.transformations(spark, sf))
    return joined.select("video", "frame", "identity", "ord", *G.BOX_COLUMNS, "t13", "t23")


@query(
    "transform_box",
    "gt_regions transformations",
    """select r.video, r.frame, r.identity, r.ord,
      cast(round_even(t11*x1+t12*y1+t13, 0) as int) as x1, cast(round_even(t21*x1+t22*y1+t23, 0) as int) as y1,
      cast(round_even(t11*x2+t12*y2+t13, 0) as int) as x2, cast(round_even(t21*x2+t22*y2+t23, 0) as int) as y2
    from gt_regions r join transformations t on r.video=t.video and r.frame=t.frame""",
)
def transform_box(spark, sf):
    return T.transformed(X.gt_regions(spark, sf), X.transformations(spark, sf))


@query(
    "project_point",
    "gt_regions transformations",
    """select r.video, r.frame, r.ord,
      round((t11*x1+t12*y1+t13)/(t31*x1+t32*y1+t33*1.25e0), 6) as px,
      round((t21*x1+t22*y1+t23)/(t31*x1+t32*y1+t33*1.25e0), 6) as py
    from gt_regions r join transformations t on r.video=t.video and r.frame=t.frame""",
)
def project_point(spark, sf):
    matrices = X.transformations(spark, sf).withColumn("t33", F.col("t33") * 1.25)
    px, py = G.project_point(F.col("x1"), F.col("y1"))
    return T.with_transform(X.gt_regions(spark, sf), matrices).select(
        "video", "frame", "ord", F.round(px, 6).alias("px"), F.round(py, 6).alias("py")
    )


@query(
    "history_pairs",
    "gt_regions",
    """with f as (select distinct video, frame from gt_regions),
    h as (select a.video, a.frame, b.frame as hist_frame, count(*) over (partition by a.video, a.frame) as n
      from f a join f b on b.video=a.video and b.frame between a.frame-5 and a.frame-1)
    select video, frame, hist_frame from h where n = 5""",
)
def history_pairs(spark, sf):
    return T.history_pairs(X.gt_regions(spark, sf), 5)


@query(
    "history_window",
    "gt_regions",
    """with f as (select distinct video, frame from gt_regions),
    h as (select a.video, a.frame, b.frame as hist_frame, count(*) over (partition by a.video, a.frame) as n
      from f a join f b on b.video=a.video and b.frame between a.frame-9 and a.frame-1)
    select video, frame, min(hist_frame) as oldest, max(hist_frame) as newest from h where n = 9 group by 1, 2""",
)
def history_window(spark, sf):
    return (
        T.history_pairs(X.gt_regions(spark, sf), 9)
        .groupBy("video", "frame")
        .agg(F.min("hist_frame").alias("oldest"), F.max("hist_frame").alias("newest"))
    )


@query(
    "sort_regions",
    "calc_regions",
    "select * from calc_regions order by video, frame, x1, ord",
)
def sort_regions(spark, sf):
    return T.sort_regions(X.calc_regions(spark, sf))


@query(
    "fingerprint",
    "gt_regions",
    """with c as (select video, frame, x1, y1, x2, y2, count(*) as n from gt_regions group by 1, 2, 3, 4, 5, 6),
    s as (select video, frame, cast(floor(x1 / 256.0e0) as bigint) as strip,
      md5(string_agg(concat_ws(',', x1, y1, x2, y2, n), ';' order by x1, y1, x2, y2)) as d from c group by 1, 2, 3),
    f as (select video, frame, md5(string_agg(d, ';' order by strip)) as d from s group by 1, 2),
    b as (select video, frame // 1024 as block, md5(string_agg(d, ';' order by frame)) as d from f group by 1, 2)
    select video, md5(string_agg(d, ';' order by block)) as fingerprint from b group by 1""",
)
def fingerprint(spark, sf):
    return T.regions_fingerprint(X.gt_regions(spark, sf))


@query("distinct_frames", "gt_regions", "select distinct video, frame from gt_regions")
def distinct_frames(spark, sf):
    return T.distinct_frames(X.gt_regions(spark, sf))


@query("distinct_identities", "gt_regions", "select distinct video, identity from gt_regions")
def distinct_identities(spark, sf):
    return T.distinct_identities(X.gt_regions(spark, sf))


@query(
    "object_size",
    "gt_regions",
    """select video, round(avg(x2-x1), 6) as avg_width, round(avg(y2-y1), 6) as avg_height,
      round(avg(least(x2-x1, y2-y1)), 6) as avg_min_side, round(avg(greatest(x2-x1, y2-y1)), 6) as avg_max_side
    from gt_regions group by video""",
)
def object_size(spark, sf):
    sizes = T.object_size(X.gt_regions(spark, sf), ["video"])
    return sizes.withColumns({n: F.round(n, 6) for n in sizes.columns if n != "video"})


OBSERVED = "observed_boxes"
OBSERVED_SQL = """with a as (select video, frame, x1, y1, x2, y2 from calc_regions where ord % 7 <> 3),
b as (select video, frame, x1, y1, x2, y2 from gt_regions where ord % 5 <> 1)"""


@query(
    "compare_results",
    "gt_regions calc_regions",
    OBSERVED_SQL + """ select *, 'a' as side from (select * from a except select * from b) p
    union all select *, 'b' as side from (select * from b except select * from a) q""",
)
def compare_results(spark, sf):
    a = X.calc_regions(spark, sf).withColumn("observed", F.expr("ord % 7 <> 3"))
    b = X.gt_regions(spark, sf).withColumn("observed", F.expr("ord % 5 <> 1"))
    return S.compare_results(a, b)


@query(
    "pending",
    "gt_regions calc_regions",
    """select video, frame, identity from gt_regions except select video, frame, identity from calc_regions""",
)
def pending(spark, sf):
    return S.pending(
        X.gt_regions(spark, sf), X.calc_regions(spark, sf), ["video", "frame", "identity"]
    )


@query(
    "common",
    "gt_regions calc_regions",
    """select video, frame, identity from gt_regions intersect select video, frame, identity from calc_regions""",
)
def common(spark, sf):
    return S.common(
        X.gt_regions(spark, sf), X.calc_regions(spark, sf), ["video", "frame", "identity"]
    )


@query(
    "sets_equal",
    "gt_regions calc_regions",
    """select count(*) = 0 as equal from (
      (select video, frame, identity from gt_regions except select video, frame, identity from calc_regions)
      union all
      (select video, frame, identity from calc_regions except select video, frame, identity from gt_regions)) t""",
)
def sets_equal(spark, sf):
    return S.sets_equal(
        X.gt_regions(spark, sf), X.calc_regions(spark, sf), ["video", "frame", "identity"]
    )


@query(
    "first_seen_order",
    "gt_regions",
    "select video, identity, min(frame) as frame from gt_regions group by 1, 2",
)
def first_seen_order(spark, sf):
    return S.first_seen_order(X.gt_regions(spark, sf), ["video", "identity"], "frame")


# Looking ahead at least as far as back, no box that was dropped could have proved a later one.
@query("motion_only_in_order")
def motion_only_in_order(spark, sf):
    return T.motion_only_in_order(X.gt_regions(spark, sf)).select(
        "video", "frame", "identity", "ord", *G.BOX_COLUMNS
    )


ORACLES["motion_only_in_order"] = ORACLES["motion_only"]


def _user_grow(df, pixels):
    """A stage a user might write: grow boxes on every side."""
    grown = {n: F.col(n) - pixels for n in ("x1", "y1")}
    return df.withColumns({**grown, **{n: F.col(n) + pixels for n in ("x2", "y2")}})


@query(
    "user_stage",
    "gt_regions",
    """select video, frame - 9 as frame, identity, ord, x1-2 as x1, y1-2 as y1, x2+2 as x2, y2+2 as y2
    from gt_regions where frame between 10 and 150 and (x2-x1)*(y2-y1) >= 150""",
)
def user_stage(spark, sf):
    return chain(
        X.gt_regions(spark, sf),
        (G.min_size, {"pixels": 150}),
        (_user_grow, {"pixels": 2}),
        (G.frame_slice, {"start": 10, "end": 150}),
    )
