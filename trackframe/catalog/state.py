"""Queries on particles and keyed track state."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.catalog import query
from trackframe.functions import geometry as G
from trackframe.operators import particles as PA
from trackframe.operators import reckoning as K
from trackframe.sources import fixtures as X

# Five particles per truth box, spread around it.
PART_SQL = """particles as materialized (select video, frame, ord as filter, p as particle,
  x1 + (p*3 + ord) % 7 - 3 as x1, y1 + (p*5 + ord) % 5 - 2 as y1,
  x2 + (p*3 + ord) % 7 - 3 as x2, y2 + (p*5 + ord) % 5 - 2 as y2, 0.2e0 as weight
  from gt_regions, (select unnest(range(0, 5)) as p) n)"""
HIT_SQL = """hits as materialized (select a.video, a.frame, a.filter, a.particle, b.ord, b.x1, b.y1, b.x2, b.y2,
  case when a.x1=b.x1 and a.y1=b.y1 and a.x2=b.x2 and a.y2=b.y2 then 1.0e0 else
    cast((least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) as double)
    / ((a.x2-a.x1)*(a.y2-a.y1) + (b.x2-b.x1)*(b.y2-b.y1)
      - (least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1))) end as iou
  from particles a join calc_regions b on a.video=b.video and a.frame=b.frame
    and a.x1 < b.x2 and b.x1 < a.x2 and a.y1 < b.y2 and b.y1 < a.y2)"""
UPDATED_SQL = """best as materialized (select video, frame, filter, particle, arg_min(
    {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'iou': iou, 'ord': ord}, {'a': -iou, 'b': ord}) as top
  from hits group by video, frame, filter, particle),
updated as materialized (select p.video, p.frame, p.filter, p.particle, coalesce(b.top.x1, p.x1) as x1, coalesce(b.top.y1, p.y1) as y1,
  coalesce(b.top.x2, p.x2) as x2, coalesce(b.top.y2, p.y2) as y2,
  p.weight * coalesce(b.top.iou, 1) as weight, b.top.ord is not null as observed
  from particles p left join best b on b.video=p.video and b.frame=p.frame and b.filter=p.filter
    and b.particle=p.particle)"""
RESAMPLED_SQL = """asked as (select *, cast(round_even((weight / sum(weight) over (partition by video, frame, filter)) / 0.2e0, 0) as int) as asked,
    row_number() over (partition by video, frame, filter order by weight desc, particle) as rn from updated),
ahead as (select *, coalesce(sum(asked) over (partition by video, frame, filter order by rn
    rows between unbounded preceding and 1 preceding), 0) as ahead from asked),
copies as (select *, greatest(least(asked, 5 - ahead), 0) as copies from ahead),
stops as (select *, coalesce(max(case when copies = 0 then 1 else 0 end) over (partition by video, frame, filter order by rn
    rows between unbounded preceding and 1 preceding), 0) as stopped from copies),
placed as (select *, coalesce(sum(copies) over (partition by video, frame, filter order by rn
    rows between unbounded preceding and 1 preceding), 0) as spot from stops where copies > 0 and stopped = 0),
resampled as (select video, frame, filter, cast(spot + c as bigint) as particle, particle as parent, x1, y1, x2, y2, 0.2e0 as weight
  from placed, (select unnest(range(0, 5)) as c) n where c < copies)"""


def _particles(spark, sf):
    p = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("particle")
    spread = X.gt_regions(spark, sf).select("*", p)
    sx, sy = "(particle*3 + ord) % 7 - 3", "(particle*5 + ord) % 5 - 2"
    return spread.selectExpr(
        "video",
        "frame",
        "ord as filter",
        "particle",
        f"x1 + {sx} as x1",
        f"y1 + {sy} as y1",
        f"x2 + {sx} as x2",
        f"y2 + {sy} as y2",
        "0.2D as weight",
    )


def jitter_sql(seed: int, key: str, rest: str, source: str) -> str:
    """Boxes of ``source`` moved by the draws that md5 makes of seed, tag and key."""

    def uniform(tag: str) -> str:
        digest = f"md5(concat_ws(':', '{seed}', '{tag}', {key}))"
        return f"((cast('0x' || substr({digest}, 1, 13) as bigint) + 0.5e0) / 4503599627370496e0)"

    draws = ", ".join(f"{uniform(t)} as u_{t}" for t in ("radius", "phase", "angle", "x1", "y1", "x2", "y2"))
    length = "sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1))"
    step = f"abs(sqrt(-2*ln(u_radius)) * cos(2*pi()*u_phase)) * 0.01e0 * {length}"
    noise = {n: f"round_even(u_{n} - 0.5e0, 0)" for n in ("x1", "y1", "x2", "y2")}
    noise["x2"] = f"greatest({noise['x1']}, {noise['x2']})"
    noise["y2"] = f"greatest({noise['y1']}, {noise['y2']})"
    moved = ", ".join(
        f"cast({n} + round_even({step} * {turn}(u_angle*2*pi()), 0) + {noise[n]} as int) as {n}"
        for n, turn in (("x1", "sin"), ("y1", "cos"), ("x2", "sin"), ("y2", "cos"))
    )
    return f"select {rest}, {moved} from (select *, {draws} from {source}) d"


@query(
    "jitter_box",
    "gt_regions",
    jitter_sql(7, "video, frame, ord", "video, frame, ord, identity", "gt_regions"),
)
def jitter_box(spark, sf):
    moved = G.jitter_box(G.corners(), 7, F.col("video"), F.col("frame"), F.col("ord"))
    return X.gt_regions(spark, sf).withColumns(dict(zip(G.BOX_COLUMNS, moved)))


@query(
    "particle_predict",
    "gt_regions",
    f"""with {PART_SQL} """ + jitter_sql(
        3, "video, frame, filter, particle",
        "video, frame, filter, particle, weight, false as observed", "particles",
    ),
)
def particle_predict(spark, sf):
    return PA.particle_predict(_particles(spark, sf), 3)


@query(
    "particle_transform",
    "gt_regions transformations",
    f"""with {PART_SQL} select p.video, p.frame, filter, particle,
      cast(round_even(t11*x1+t12*y1+t13, 0) as int) as x1, cast(round_even(t21*x1+t22*y1+t23, 0) as int) as y1,
      cast(round_even(t11*x2+t12*y2+t13, 0) as int) as x2, cast(round_even(t21*x2+t22*y2+t23, 0) as int) as y2, weight
    from particles p join transformations t on p.video=t.video and p.frame=t.frame""",
)
def particle_transform(spark, sf):
    return PA.particle_transform(_particles(spark, sf), X.transformations(spark, sf))


@query(
    "particle_update",
    "gt_regions calc_regions",
    f"""with {PART_SQL}, {HIT_SQL}, {UPDATED_SQL} select video, frame, filter, particle, x1, y1, x2, y2,
      round(weight, 9) as weight, observed from updated""",
)
def particle_update(spark, sf):
    updated = PA.particle_update(_particles(spark, sf), X.calc_regions(spark, sf))
    return updated.withColumn("weight", F.round("weight", 9))


@query(
    "particle_resample",
    "gt_regions calc_regions",
    f"with {PART_SQL}, {HIT_SQL}, {UPDATED_SQL}, {RESAMPLED_SQL} select * from resampled",
)
def particle_resample(spark, sf):
    updated = PA.particle_update(_particles(spark, sf), X.calc_regions(spark, sf))
    return PA.particle_resample(updated)


@query(
    "particle_weights",
    "gt_regions calc_regions",
    f"""with {PART_SQL}, {HIT_SQL}, {UPDATED_SQL}, {RESAMPLED_SQL},
    g as (select video, frame, filter, parent, x1, y1, x2, y2, sum(weight) as weight, min(particle) as first
      from resampled group by 1, 2, 3, 4, 5, 6, 7, 8)
    select video, frame, filter, parent, x1, y1, x2, y2, round(weight, 9) as weight, first,
      row_number() over (partition by video, frame, filter order by weight desc, first) = 1 as is_best from g""",
)
def particle_weights(spark, sf):
    updated = PA.particle_update(_particles(spark, sf), X.calc_regions(spark, sf))
    found = PA.particle_weights(PA.particle_resample(updated))
    return found.withColumn("weight", F.round("weight", 9))


@query(
    "filter_probability",
    "gt_regions calc_regions",
    f"""with {PART_SQL}, {HIT_SQL} select video, frame, filter, ord, round(sum(iou*0.2e0), 9) as probability
    from hits group by 1, 2, 3, 4""",
)
def filter_probability(spark, sf):
    found = PA.filter_probability(_particles(spark, sf), X.calc_regions(spark, sf))
    return found.withColumn("probability", F.round("probability", 9))


CLAIM = """with {p}, {h} select c.video, c.frame, c.ord, c.x1, c.y1, c.x2, c.y2 from calc_regions c where {n} exists (
  select 1 from hits h where h.video=c.video and h.frame=c.frame and h.ord=c.ord)"""


@query(
    "claimed", "gt_regions calc_regions", CLAIM.format(p=PART_SQL, h=HIT_SQL, n="")
)
def claimed(spark, sf):
    return PA.claimed(_particles(spark, sf), X.calc_regions(spark, sf)).drop("identity")


@query(
    "unclaimed", "gt_regions calc_regions", CLAIM.format(p=PART_SQL, h=HIT_SQL, n="not")
)
def unclaimed(spark, sf):
    return PA.unclaimed(_particles(spark, sf), X.calc_regions(spark, sf)).drop("identity")


@query("dead_reckoning")
def dead_reckoning(spark, sf):
    return K.dead_reckoning(X.calc_regions(spark, sf), 12, 0.3)


@query("particle_filter")
def particle_filter(spark, sf):
    return PA.particle_filter(X.calc_regions(spark, sf), X.transformations(spark, sf))


@query("particle_filter_persist")
def particle_filter_persist(spark, sf):
    return PA.particle_filter(
        X.calc_regions(spark, sf), X.transformations(spark, sf), persist=True
    )


@query("particle_history")
def particle_history(spark, sf):
    return PA.particle_history(X.calc_regions(spark, sf), X.transformations(spark, sf))


@query("confirmed_tracks")
def confirmed_tracks(spark, sf):
    return PA.confirmed_tracks(X.calc_regions(spark, sf), X.transformations(spark, sf))
