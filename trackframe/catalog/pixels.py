"""Queries on pixels, masks, components and registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.catalog import ORACLES, query
from trackframe.functions import geometry as G
from trackframe.functions import scalars as SC
from trackframe.operators import components as C
from trackframe.operators import morphology as MO
from trackframe.operators import pixels as PX
from trackframe.operators import registration as RG
from trackframe.plans import motion as MP
from trackframe.sources import fixtures as X
from trackframe.sources import frames as FR

SIDE = 8
H, SCALE = 4, 48

ROLL = f"""q as (select *, cast(floor(v*{SCALE}/255.0e0) as int) as q from pixels),
st as (select *, lag(v) over w as v0, lag(q) over w as q0, row_number() over w - 1 as held
  from q window w as (partition by video, y, x order by frame)),
pr as (select *, abs(q-q0) <= 1 as same, abs(v-v0) as diff,
  case when abs(q-q0) <= 1 then 0 else v0 end as inter from st),
feat as (select video, frame, y, x, v, cast(weight as int) as weight,
    cast(floor(moved / {H}.0e0) as int) as dissimilarity, coalesce(bg, 0) as background
  from (select *, sum(case when same then 1 else 0 end) over p as weight,
      sum(case when same then 0 else diff end) over p as moved,
      last_value(nullif(inter, 0) ignore nulls) over p as bg
    from pr window p as (partition by video, y, x order by frame rows between {H - 1} preceding and 1 preceding)) t
  where held >= {H}),
fg as (select *, case when weight >= {H - 1} then 0 else abs(v - background) end as foreground from feat)"""


def _level(name: str, low: int, medium: int, high: int) -> str:
    return f"case when {name} <= 85 then {low} when {name} < 170 then {medium} else {high} end"


def _moving(codes: tuple[int, int, int]) -> str:
    fgl, dl = _level("foreground", *codes), _level("dissimilarity", *codes)
    return f"""case when (weight > {(H - 1) // 3} and weight < {H - 1} and {fgl} >= {dl})
      or (weight <= {(H - 1) // 3} and {dl} = 1 and {fgl} > {dl}) then 255 else 0 end"""


@query(
    "quantize",
    "pixels",
    f"select video, frame, y, x, cast(floor(v*{SCALE}/255.0e0) as int) as q from pixels",
)
def quantize(spark, sf):
    return PX.quantized(X.pixels(spark, sf), SCALE).drop("v")


@query(
    "level3",
    "pixels",
    f"select video, frame, y, x, {_level('v', 3, 2, 5)} as code, {_level('v', 1, 2, 3)} as corrected from pixels",
)
def level3(spark, sf):
    return X.pixels(spark, sf).select(
        *PX.PIXEL,
        SC.level3(F.col("v")).alias("code"),
        SC.level3(F.col("v"), corrected=True).alias("corrected"),
    )


COLOUR_SQL = "(select *, v as b, (v*3 + x*7) % 256 as g, (v*5 + y*11) % 256 as r from pixels) c"


def _colour(spark, sf):
    return X.pixels(spark, sf).selectExpr(
        "video", "frame", "y", "x", "v as b", "(v*3 + x*7) % 256 as g", "(v*5 + y*11) % 256 as r"
    )


@query(
    "to_gray",
    "pixels",
    f"""select video, frame, y, x, cast(round_even(b*0.114e0 + g*0.587e0 + r*0.299e0, 0) as int) as v
    from {COLOUR_SQL}""",
)
def to_gray(spark, sf):
    return PX.gray_pixels(_colour(spark, sf))


@query("pca_channels")
def pca_channels(spark, sf):
    return PX.pca_channels(_colour(spark, sf))


@query(
    "scale_to_byte",
    "pixels",
    """select video, frame, y, x, cast(v * case when m > 0 then floor(255.0e0/m) else 1 end as int) as v
    from (select *, max(v) over (partition by video, frame) as m from pixels) t""",
)
def scale_to_byte(spark, sf):
    return PX.scale_to_byte(X.pixels(spark, sf))


@query(
    "pixel_align",
    "pixels",
    """select a.video, a.frame, a.y, a.x, a.v as va, b.v as vb from pixels a join pixels b
    on b.video=a.video and b.frame=a.frame-1 and b.y=a.y and b.x=a.x""",
)
def pixel_align(spark, sf):
    pixels = X.pixels(spark, sf)
    return PX.pixel_align(pixels, pixels.withColumn("frame", F.col("frame") + 1))


@query(
    "frame_xor",
    "pixels",
    """select a.video, a.frame, a.y, a.x, xor(a.v, b.v) as v from pixels a join pixels b
    on b.video=a.video and b.frame=a.frame-1 and b.y=a.y and b.x=a.x""",
)
def frame_xor(spark, sf):
    pixels = X.pixels(spark, sf)
    return PX.frame_xor(pixels, pixels.withColumn("frame", F.col("frame") + 1))


@query(
    "dim_overlay",
    "pixels",
    """select video, frame, y, x, case when v >= 140 then v else cast(floor(v*0.5e0) as int) end as v
    from pixels""",
)
def dim_overlay(spark, sf):
    pixels = X.pixels(spark, sf)
    return PX.dim_overlay(pixels, pixels.filter("v >= 140"))


@query(
    "frames_identical",
    "pixels",
    """with b as (select video, frame, y, x, case when video % 2 = 0 and frame >= 7 and y = x then xor(v, 1) else v end as v
      from pixels where video <> 4 or frame < 6),
    d as (select a.video, min(a.frame) as f from pixels a join b using (video, frame, y, x) where a.v <> b.v group by 1),
    e as (select a.video, least(a.m, b.m) as compared from (select video, max(frame) as m from pixels group by 1) a
      join (select video, max(frame) as m from b group by 1) b using (video))
    select e.video, e.compared, coalesce(d.f, 0) as first_diff, d.f is null as identical from e left join d using (video)""",
)
def frames_identical(spark, sf):
    pixels = X.pixels(spark, sf)
    changed = F.expr("case when video % 2 = 0 and frame >= 7 and y = x then v ^ 1 else v end")
    other = pixels.filter("video <> 4 or frame < 6").withColumn("v", changed)
    return PX.frames_identical(pixels, other).withColumn(
        "first_diff", F.coalesce("first_diff", F.lit(0).cast("long"))
    )


@query("motion_weights", "pixels", f"with {ROLL} select video, frame, y, x, weight from feat")
def motion_weights(spark, sf):
    return PX.motion_weights(X.pixels(spark, sf), H, SCALE)


@query(
    "dissimilarity", "pixels", f"with {ROLL} select video, frame, y, x, dissimilarity from feat"
)
def dissimilarity(spark, sf):
    return PX.history_of_dissimilarity(X.pixels(spark, sf), H, SCALE)


@query(
    "pair_frames",
    "pixels",
    f"with {ROLL} select video, frame, y, x, v, q, same, diff from pr where v0 is not null",
)
def pair_frames(spark, sf):
    pairs = PX.intersect_pairs(X.pixels(spark, sf), SCALE)
    return pairs.filter(F.col("diff").isNotNull()).drop("inter")


@query(
    "intersect_pair",
    "pixels",
    f"with {ROLL} select video, frame, y, x, inter from pr where v0 is not null",
)
def intersect_pair(spark, sf):
    pairs = PX.intersect_pairs(X.pixels(spark, sf), SCALE)
    return pairs.filter(F.col("inter").isNotNull()).select(*PX.PIXEL, "inter")


@query("union_background", "pixels", f"with {ROLL} select video, frame, y, x, background from feat")
def union_background(spark, sf):
    return PX.union_background(X.pixels(spark, sf), H, SCALE)


def _foreground(spark, sf):
    return PX.subtract_background(PX.rolling_history(X.pixels(spark, sf), H, SCALE), H)


@query("subtract_background", "pixels", f"with {ROLL} select video, frame, y, x, foreground from fg")
def subtract_background(spark, sf):
    return _foreground(spark, sf).select(*PX.PIXEL, "foreground")


@query(
    "moving_foreground",
    "pixels",
    f"with {ROLL} select video, frame, y, x, {_moving((3, 2, 5))} as v from fg",
)
def moving_foreground(spark, sf):
    return PX.moving_foreground(_foreground(spark, sf), H)


@query(
    "moving_foreground_corrected",
    "pixels",
    f"with {ROLL} select video, frame, y, x, {_moving((1, 2, 3))} as v from fg",
)
def moving_foreground_corrected(spark, sf):
    return PX.moving_foreground(_foreground(spark, sf), H, corrected=True)


# Translations of history frames: hist -> frame coordinates.
SHIFT = """shift as (select a.video, a.frame, b.frame as hist_frame, (a.frame - b.frame) % 3 - 1 as dx, b.frame % 2 as dy
  from (select distinct video, frame from pixels) a join (select distinct video, frame from pixels) b
    on b.video = a.video and b.frame between a.frame - 4 and a.frame - 1 where a.frame > 4),
grid as (select s.*, gy.y, gx.x from shift s, (select unnest(range(0, 8)) as y) gy, (select unnest(range(0, 8)) as x) gx),
hist as (select g.video, g.frame, g.hist_frame, cast(g.y as int) as y, cast(g.x as int) as x, coalesce(p.v, 0) as v,
    case when p.v is null then 0 else 1 end as c
  from grid g left join pixels p on p.video = g.video and p.frame = g.hist_frame
    and p.y = g.y - g.dy and p.x = g.x - g.dx)"""


def _shifts(spark, sf):
    from trackframe.operators.tracks import history_pairs

    pairs = history_pairs(X.vectors(spark, sf).select("video", "frame"), H)
    return pairs.selectExpr(
        "video",
        "frame",
        "hist_frame",
        "1D as t11",
        "0D as t12",
        "cast((frame - hist_frame) % 3 - 1 as double) as t13",
        "0D as t21",
        "1D as t22",
        "cast(hist_frame % 2 as double) as t23",
        "0D as t31",
        "0D as t32",
        "1D as t33",
    )


@query(
    "warp_translate",
    "pixels",
    f"with {SHIFT} select video, frame, hist_frame, y, x, v from hist",
)
def warp_translate(spark, sf):
    return RG.warp_history(X.pixels(spark, sf), _shifts(spark, sf), SIDE, SIDE).drop("covered")


@query(
    "coverage_masks",
    "pixels",
    f"with {SHIFT} select video, frame, hist_frame, y, x, c as v from hist",
)
def coverage_masks(spark, sf):
    return RG.coverage_masks(_shifts(spark, sf), SIDE, SIDE)


ANCHORED = f"""{SHIFT},
q as (select *, cast(floor(v*{SCALE}/255.0e0) as int) as q from hist),
st as (select *, lag(v) over w as v0, lag(q) over w as q0
  from q window w as (partition by video, frame, y, x order by hist_frame)),
pr as (select * from st where v0 is not null),
feat as (select video, frame, y, x, cast(sum(case when abs(q-q0) <= 1 then 1 else 0 end) as int) as weight,
    cast(floor(sum(case when abs(q-q0) <= 1 then 0 else abs(v-v0) end) / {H}.0e0) as int) as dissimilarity,
    coalesce(max_by(v0, hist_frame) filter (abs(q-q0) > 1 and v0 <> 0), 0) as background
  from pr group by 1, 2, 3, 4),
cov as (select video, frame, y, x, max_by(c, hist_frame) as covered, min(c) as covered_all from hist group by 1, 2, 3, 4)"""


@query("anchored_history", "pixels", f"with {ANCHORED} select * from feat join cov using (video, frame, y, x)")
def anchored_history(spark, sf):
    warped = RG.warp_history(X.pixels(spark, sf), _shifts(spark, sf), SIDE, SIDE)
    return PX.anchored_history(warped, H, SCALE)


MASKED = """with {shift}, cov as (select video, frame, y, x, {pick} as c from hist group by 1, 2, 3, 4)
select p.video, p.frame, p.y, p.x, case when p.v >= 140 then 255 else 0 end * coalesce(c, 0) as v
from pixels p left join cov using (video, frame, y, x)"""


@query("apply_masks", "pixels", MASKED.format(shift=SHIFT, pick="max_by(c, hist_frame)"))
def apply_masks(spark, sf):
    moving = MO.threshold(X.pixels(spark, sf), 139)
    return PX.apply_masks(moving, RG.coverage_masks(_shifts(spark, sf), SIDE, SIDE))


@query("apply_masks_corrected", "pixels", MASKED.format(shift=SHIFT, pick="min(c)"))
def apply_masks_corrected(spark, sf):
    moving = MO.threshold(X.pixels(spark, sf), 139)
    coverage = RG.coverage_masks(_shifts(spark, sf), SIDE, SIDE)
    return PX.apply_masks(moving, coverage, corrected=True)


HYST = """with recursive m as (select video, frame, y, x, v >= 140 as m from pixels),
walk as (
  select video, frame, y, x, case when m then 1 else 0 end as on_run, case when m then 0 else 1 end as off_run,
    case when m and {on} = 1 then 255 else 0 end as v from m where frame = 1
  union all
  select m.video, m.frame, m.y, m.x, case when m.m then w.on_run + 1 else 0 end,
    case when m.m then 0 else w.off_run + 1 end,
    case when m.m and w.on_run + 1 = {on} then 255 when not m.m and w.off_run + 1 = {off} then 0 else w.v end
  from walk w join m on m.video = w.video and m.frame = w.frame + 1 and m.y = w.y and m.x = w.x)
select video, frame, y, x, v from walk"""


@query("pixel_hysteresis", "pixels", HYST.format(on=2, off=2))
def pixel_hysteresis(spark, sf):
    return PX.pixel_hysteresis(MO.threshold(X.pixels(spark, sf), 139), 2, 3)


@query("pixel_hysteresis_corrected", "pixels", HYST.format(on=2, off=3))
def pixel_hysteresis_corrected(spark, sf):
    return PX.pixel_hysteresis(MO.threshold(X.pixels(spark, sf), 139), 2, 3, corrected=True)


def _blur_sql(k: int) -> str:
    low, high = -(k // 2), k - 1 - k // 2
    return f"""with o as (select dy, dx from (select unnest(range({low}, {high + 1})) as dy) a,
      (select unnest(range({low}, {high + 1})) as dx) b),
    n as (select p.video, p.frame, p.y, p.x, abs(p.y + dy) as ny, abs(p.x + dx) as nx from pixels p, o),
    r as (select video, frame, y, x, case when ny > 7 then 14 - ny else ny end as ny,
      case when nx > 7 then 14 - nx else nx end as nx from n)
    select r.video, r.frame, r.y, r.x, cast(round_even(sum(p.v) / {k * k}.0e0, 0) as int) as v
    from r join pixels p on p.video = r.video and p.frame = r.frame and p.y = r.ny and p.x = r.nx
    group by 1, 2, 3, 4"""


@query("box_blur", "pixels", _blur_sql(3))
def box_blur(spark, sf):
    return MO.box_blur(X.pixels(spark, sf), 3, SIDE, SIDE)


@query("box_blur_even", "pixels", _blur_sql(4))
def box_blur_even(spark, sf):
    return MO.box_blur(X.pixels(spark, sf), 4, SIDE, SIDE)


OFFSETS_3 = "o as (select dy, dx from (values (-1), (0), (1)) a(dy), (values (-1), (0), (1)) b(dx))"


@query(
    "threshold",
    "pixels",
    f"""with {OFFSETS_3},
    e as (select p.video, p.frame, p.y, p.x, min(n.v) as v from pixels p, o
      join pixels n on n.video=p.video and n.frame=p.frame and n.y=p.y+o.dy and n.x=p.x+o.dx group by 1, 2, 3, 4),
    d as (select p.video, p.frame, p.y, p.x, max(n.v) as v from e p, o
      join e n on n.video=p.video and n.frame=p.frame and n.y=p.y+o.dy and n.x=p.x+o.dx group by 1, 2, 3, 4)
    select video, frame, y, x, case when v > 90 then 255 else 0 end as v from d""",
)
def threshold(spark, sf):
    return MO.threshold(MO.gray_dilate(MO.gray_erode(X.pixels(spark, sf), 3), 3), 90)


GRID_SQL = """full_grid as (select distinct video, frame, gy.y, gx.x from mask,
  (select unnest(range(0, 8)) as y) gy, (select unnest(range(0, 8)) as x) gx)"""


def _morph(source: str, name: str, offsets, kind: str) -> str:
    """CTE: pixels of the grid whose kernel covers any (dilate) or only (erode) set pixels."""
    values = ", ".join(f"({dy}, {dx})" for dy, dx in offsets)
    test = "count(s.video) > 0" if kind == "dilate" else "count(s.video) = count(*)"
    return f"""{name} as (select g.video, g.frame, g.y, g.x from full_grid g
  join (values {values}) o(dy, dx) on g.y + o.dy between 0 and 7 and g.x + o.dx between 0 and 7
  left join {source} s on s.video = g.video and s.frame = g.frame and s.y = g.y + o.dy and s.x = g.x + o.dx
  group by 1, 2, 3, 4 having {test})"""


@query(
    "close_mask",
    "mask",
    f"""with {GRID_SQL}, {_morph('mask', 'd', MO.box_offsets(3), 'dilate')},
    {_morph('d', 'e', MO.box_offsets(3), 'erode')} select * from e""",
)
def close_mask(spark, sf):
    return MO.close_mask(X.mask(spark, sf), 3, SIDE, SIDE)


CROSS = [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
DISC_5 = [(-2, 0), (2, 0)] + [(dy, dx) for dy in (-1, 0, 1) for dx in range(-2, 3)]


@query(
    "open_close_mask",
    "mask",
    f"""with {GRID_SQL}, {_morph('mask', 'e1', CROSS, 'erode')}, {_morph('e1', 'd1', CROSS, 'dilate')},
    kept as (select m.video, m.frame, m.y, m.x from mask m join d1 using (video, frame, y, x)),
    {_morph('kept', 'd2', DISC_5, 'dilate')}, {_morph('d2', 'e2', DISC_5, 'erode')} select * from e2""",
)
def open_close_mask(spark, sf):
    return MO.open_close_mask(X.mask(spark, sf), 3, 3, 5, SIDE, SIDE)


@query(
    "group_filter",
    "mask",
    """select a.video, a.frame, a.y, a.x from mask a join mask b on b.video=a.video and b.frame=a.frame
      and b.y between a.y-1 and a.y+1 and b.x between a.x-1 and a.x+1 and not (a.y=b.y and a.x=b.x)
    group by 1, 2, 3, 4 having count(*) >= 4""",
)
def group_filter(spark, sf):
    return MO.group_filter(X.mask(spark, sf), 4)


DENSITY = """with n as (select a.video, a.frame, a.y, a.x, count(*) as c from mask a join mask b
  on b.video=a.video and b.frame=a.frame and (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) <= {r2}
  group by 1, 2, 3, 4)
select distinct a.video, a.frame, a.y, a.x from mask a join n b on b.c >= {m} and b.video=a.video and b.frame=a.frame
  and (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x) <= {r2}"""


@query("density_filter", "mask", DENSITY.format(r2="2.25", m=5))
def density_filter(spark, sf):
    return MO.density_filter(X.mask(spark, sf), 1.5, 5)


@query("density_filter_wide", "mask", DENSITY.format(r2="4", m=7))
def density_filter_wide(spark, sf):
    return MO.density_filter(X.mask(spark, sf), 2, 7)


REACH = """reach as (
  select video, frame, y*8+x as p, y as qy, x as qx from mask
  union
  select r.video, r.frame, r.p, n.y, n.x from reach r join mask n on n.video=r.video and n.frame=r.frame
    and n.y between r.qy-1 and r.qy+1 and n.x between r.qx-1 and r.qx+1),
lab as (select video, frame, p // 8 as y, p % 8 as x, min(qy*8+qx) // 8 as ly, min(qy*8+qx) % 8 as lx
  from reach group by video, frame, p)"""


@query("connected_components", "mask", f"with recursive {REACH} select * from lab")
def connected_components(spark, sf):
    return C.connected_components(X.mask(spark, sf))


@query("connected_components_rounds", "mask", f"with recursive {REACH} select * from lab")
def connected_components_rounds(spark, sf):
    """The same labels from bands of two rows, merged at their borders."""
    return C.connected_components(X.mask(spark, sf), band_rows=2)


BOXES_SQL = """select video, frame, ly, lx, min(x) as x1, min(y) as y1, max(x)+1 as x2, max(y)+1 as y2
from lab group by 1, 2, 3, 4"""


@query("component_boxes", "mask", f"with recursive {REACH} {BOXES_SQL}")
def component_boxes(spark, sf):
    return C.component_boxes(X.mask(spark, sf))


@query(
    "component_centroids",
    "mask",
    f"""with recursive {REACH} select video, frame, ly, lx, count(*) as pixels,
      cast(floor(avg(x)) as int) as cx, cast(floor(avg(y)) as int) as cy from lab group by 1, 2, 3, 4""",
)
def component_centroids(spark, sf):
    return C.component_centroids(X.mask(spark, sf))


@query(
    "detect_blobs",
    "mask",
    f"""with recursive {REACH}, {GRID_SQL},
    bg as (select g.* from full_grid g where not exists (select 1 from mask m
      where m.video=g.video and m.frame=g.frame and m.y=g.y and m.x=g.x)),
    out as (select video, frame, y*8+x as p, y as qy, x as qx from bg
      union
      select r.video, r.frame, r.p, n.y, n.x from out r join bg n on n.video=r.video and n.frame=r.frame
        and abs(n.y-r.qy) + abs(n.x-r.qx) = 1),
    inner_bg as (select video, frame, p, min(qy*8+qx) as lab from out group by 1, 2, 3
      having min(least(qy, qx)) > 0 and max(greatest(qy, qx)) < 7),
    boxes as (select video, frame, x1, y1, x2, y2, false as hole from ({BOXES_SQL}) a union all
      select video, frame, min(p % 8) - 1, min(p // 8) - 1, max(p % 8) + 2, max(p // 8) + 2, true
      from inner_bg group by video, frame, lab)
    select *, row_number() over (partition by video, frame order by y1, x1, y2, x2, hole) - 1 as ord from boxes""",
)
def detect_blobs(spark, sf):
    return C.detect_blobs(X.mask(spark, sf), SIDE)


# One box per frame of the 8 x 8 images.
PATCH_SQL = """patches as (select distinct video, frame, 0 as ord, frame % 4 as x1, video % 3 as y1,
  frame % 4 + 2 + frame % 2 as x2, video % 3 + 3 as y2 from pixels)"""


def _patches(spark, sf):
    return X.vectors(spark, sf).selectExpr(
        "video",
        "frame",
        "0 as ord",
        "frame % 4 as x1",
        "video % 3 as y1",
        "frame % 4 + 2 + frame % 2 as x2",
        "video % 3 + 3 as y2",
    )


@query(
    "region_pixels",
    "pixels",
    f"""with {PATCH_SQL} select r.video, r.frame, r.ord, p.y, p.x, p.v from patches r join pixels p
    on p.video=r.video and p.frame=r.frame and p.x >= r.x1 and p.x < r.x2 and p.y >= r.y1 and p.y < r.y2""",
)
def region_pixels(spark, sf):
    return PX.region_pixels(_patches(spark, sf), X.pixels(spark, sf), 4)


@query(
    "object_contrast",
    "pixels",
    f"""with {PATCH_SQL}, w as (select video, frame, ord,
      cast(round_even(greatest(x1 - (x2-x1)/2.0e0, 0), 0) as int) as x1,
      cast(round_even(greatest(y1 - (x2-x1)/2.0e0, 0), 0) as int) as y1,
      cast(least(round_even(x2 + (x2-x1)/2.0e0, 0), 7) as int) as x2,
      cast(least(round_even(y2 + (y2-y1)/2.0e0, 0), 7) as int) as y2 from patches),
    s as (select r.video, r.frame, r.ord, stddev_pop(p.v/255.0e0) as c from w r join pixels p
      on p.video=r.video and p.frame=r.frame and p.x >= r.x1 and p.x < r.x2 and p.y >= r.y1 and p.y < r.y2
      group by 1, 2, 3)
    select video, round(avg(c), 6) as contrast from s group by 1""",
)
def object_contrast(spark, sf):
    found = PX.object_contrast(_patches(spark, sf), X.pixels(spark, sf), SIDE, SIDE)
    return found.withColumn("contrast", F.round("contrast", 6))


@query("explode_pixels", "pixels", "select * from pixels")
def explode_pixels(spark, sf):
    """Pixels put together to binary frames and taken apart again."""
    return FR.explode_pixels(FR.assemble_frames(X.pixels(spark, sf)))


@query(
    "explode_array_pixels",
    "vectors",
    """select video, frame, pos // 8 as y, pos % 8 as x, round(cast(e as double), 6) as v from (
      select video, frame, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as pos from vectors) t""",
)
def explode_array_pixels(spark, sf):
    rows = FR.explode_array_pixels(X.vectors(spark, sf), "embedding", SIDE)
    return rows.withColumn("v", F.round(F.col("v").cast("double"), 6))


# Keypoints: twenty vectors make one frame; sign bits in two words of 32 bits.
POINTS_SQL = """kps as (select video, (frame-1) // 20 as frame, (frame-1) % 20 as kp,
  list_sum(list_transform(range(0, 32), lambda i: case when embedding[i+1] > 0 then 1::bigint << i else 0 end))::bigint as w0,
  list_sum(list_transform(range(0, 32), lambda i: case when embedding[i+33] > 0 then 1::bigint << i else 0 end))::bigint as w1
  from vectors),
dists as (select a.video, a.frame, a.kp, b.kp as match,
    cast(bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)) as int) as dist
  from kps a join kps b on b.video = a.video and b.frame = a.frame + 1),
matches as (select video, frame, kp, match, dist from (
  select *, row_number() over (partition by video, frame, kp order by dist, match) as rn from dists) t where rn = 1)"""


def _keypoints(spark, sf):
    def word(first: int):
        bits = F.sequence(F.lit(0), F.lit(31))
        bit = lambda i: F.when(
            F.get("embedding", i + first) > 0, F.expr("1L").cast("long") * F.pow(F.lit(2.0), i).cast("long")
        ).otherwise(F.lit(0).cast("long"))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, i: s + bit(i))

    return X.vectors(spark, sf).select(
        "video",
        F.expr("(frame-1) div 20").alias("frame"),
        F.expr("(frame-1) % 20").alias("kp"),
        word(0).alias("w0"),
        word(32).alias("w1"),
    )


def _matches(spark, sf):
    points = _keypoints(spark, sf)
    following = points.withColumn("frame", F.col("frame") - 1)
    return RG.match_descriptors(points, following, ["w0", "w1"])


@query("match_descriptors", "vectors", f"with {POINTS_SQL} select * from matches")
def match_descriptors(spark, sf):
    return _matches(spark, sf)


@query(
    "top_fraction",
    "vectors",
    f"""with {POINTS_SQL} select video, frame, kp, match, dist from (
      select *, row_number() over (partition by video, frame order by dist, kp) as rn,
        count(*) over (partition by video, frame) as n from matches) t where rn <= floor(n * 0.3e0)""",
)
def top_fraction(spark, sf):
    return RG.top_fraction(_matches(spark, sf), 0.3)


@query(
    "spatial_topk",
    "pixels",
    """select video, frame, y, x, v, place from (
      select *, row_number() over (partition by video, frame order by rn, v desc, y*8+x) as place from (
        select *, row_number() over (partition by video, frame, y // 3, x // 3 order by v desc, y*8+x) as rn
        from pixels) a) b where place <= 12""",
)
def spatial_topk(spark, sf):
    points = X.pixels(spark, sf).withColumns(
        {"kp": F.col("y") * SIDE + F.col("x"), "response": F.col("v")}
    )
    return RG.spatial_topk(points, 12, 3).drop("kp", "response")


@query(
    "estimate_transform",
    "gt_regions transformations",
    """select t.video, t.frame, t.t11, t.t22, t.t13, t.t23, t.t33 from transformations t
    where exists (select 1 from gt_regions g where g.video = t.video and g.frame = t.frame)""",
)
def estimate_transform(spark, sf):
    """Corner points of each frame, one in five moved away, give back the frame's matrix."""
    from trackframe.operators.tracks import with_transform

    joined = with_transform(X.gt_regions(spark, sf), X.transformations(spark, sf))
    px, py = G.project_point(F.col("x1"), F.col("y1"))
    wrong = F.when(F.col("ord") % 5 == 0, 23 + 3 * F.col("ord")).otherwise(0)
    matches = joined.select(
        "video",
        "frame",
        F.col("ord").alias("kp"),
        F.col("x1").alias("x"),
        F.col("y1").alias("y"),
        (px + wrong).alias("mx"),
        (py - wrong).alias("my"),
    )
    found = RG.estimate_transform(matches, 2.0)
    return found.select(
        "video", "frame", *[(F.round(n, 4) + 0.0).alias(n) for n in ("t11", "t22", "t13", "t23", "t33")]
    )


SMALL = MP.MotionConfig(
    kernel_size=3, history_frames=H, dbscan_eps=1.5, dbscan_min_samples=3, dbscan_kernel=3
)


def _chain_sql(features: str, seen: str = "") -> str:
    """The whole detector: blur, features ``feat``, foreground, density, closing, boxes."""
    blobs = ORACLES["detect_blobs"]
    tail = blobs[blobs.index("reach as ("):].replace(" mask", " closed")
    grid = GRID_SQL.replace("full_grid", "frames_grid").replace(" mask", " dense")
    morph = [
        _morph("dense", "grown", MO.box_offsets(3), "dilate"),
        _morph("grown", "closed", MO.box_offsets(3), "erode"),
    ]
    morph = [m.replace("full_grid", "frames_grid") for m in morph]
    return f"""with recursive blurred as ({_blur_sql(3)}), {features},
    moved as (select video, frame, y, x from fg where {_moving((3, 2, 5))} = 255 {seen}),
    dense as ({DENSITY.format(r2="2.25", m=3).replace("mask", "moved")}),
    {grid}, {', '.join(morph)}, {tail}"""


STILL = ROLL.replace("from pixels", "from blurred")
WARPED = (
    ANCHORED.replace("left join pixels", "left join blurred").replace("feat as", "feats as")
    + f""", feat as (select f.*, b.v, c.covered from feats f join cov c using (video, frame, y, x)
      join blurred b using (video, frame, y, x)),
    fg as (select *, case when weight >= {H - 1} then 0 else abs(v - background) end as foreground from feat)"""
)


def _only_boxes(sql: str) -> str:
    return f"select video, frame, ord, x1, y1, x2, y2 from ({sql}) boxes_found"


@query("motion_detect", "pixels", _only_boxes(_chain_sql(WARPED, "and covered = 1")))
def motion_detect(spark, sf):
    return MP.motion_detect(X.pixels(spark, sf), _shifts(spark, sf), SIDE, SIDE, SMALL)


@query("motion_detect_still", "pixels", _only_boxes(_chain_sql(STILL)))
def motion_detect_still(spark, sf):
    return MP.motion_detect(X.pixels(spark, sf), None, SIDE, SIDE, SMALL)
