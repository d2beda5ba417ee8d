"""Queries on design scores, Pareto fronts and comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.catalog import query
from trackframe.catalog.boxes import BOXES, COUNTS_SQL, IOU_SQL, LAST_SQL, greedy_sql
from trackframe.operators import pareto as P
from trackframe.operators import reports as R
from trackframe.operators import sets as S
from trackframe.operators import sweep as D
from trackframe.sources import fixtures as X

FRONT3 = """dist as (select video, recall, prec, f1, min(idx) as idx from scores group by 1, 2, 3, 4),
front as (select * from dist p where not exists (select 1 from dist r where r.video = p.video
  and r.recall >= p.recall and r.prec >= p.prec and r.f1 >= p.f1
  and (r.recall > p.recall or r.prec > p.prec or r.f1 > p.f1)))"""

LIVES = """lives as (
  select p.video, p.idx, p.sample_ord, p.recall, p.prec, min(r.sample_ord) as killer
  from scores p left join scores r on r.video = p.video and r.sample_ord <> p.sample_ord
    and r.recall >= p.recall and r.prec >= p.prec
    and (r.sample_ord < p.sample_ord or r.recall > p.recall or r.prec > p.prec)
  group by 1, 2, 3, 4, 5),
ever as (select * from lives where killer is null or killer > sample_ord)"""

SLAB = "(recall - lag(recall) over w) * (prec + lag(prec) over w) / 2"


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("pareto_front_3d", "scores", f"with {FRONT3} select * from front")
def pareto_front_3d(spark, sf):
    return P.pareto_front(X.scores(spark, sf))


@query(
    "pareto_front_2d",
    "scores",
    """with dist as (select video, recall, prec, min(idx) as idx from scores group by 1, 2, 3)
    select * from dist p where not exists (select 1 from dist r where r.video = p.video
      and r.recall >= p.recall and r.prec >= p.prec and (r.recall > p.recall or r.prec > p.prec))""",
)
def pareto_front_2d(spark, sf):
    return P.pareto_front(X.scores(spark, sf), ["recall", "prec"])


FRONT4 = """early as (select *, -cast(sample_ord as double) as early from scores),
front as (select video, idx, recall, prec, f1, early from early p where not exists (
  select 1 from early r where r.video = p.video
  and r.recall >= p.recall and r.prec >= p.prec and r.f1 >= p.f1 and r.early >= p.early
  and (r.recall > p.recall or r.prec > p.prec or r.f1 > p.f1 or r.early > p.early)))"""

OBJECTIVES4 = [*P.OBJECTIVES, "early"]


def _early_scores(spark, sf):
    """Scores with a fourth objective: to be sampled early."""
    return X.scores(spark, sf).withColumn("early", -F.col("sample_ord").cast("double"))


@query("pareto_front_4d", "scores", f"with {FRONT4} select * from front")
def pareto_front_4d(spark, sf):
    return P.pareto_front(_early_scores(spark, sf), OBJECTIVES4)


@query(
    "margin_front_4d",
    "scores",
    f"""with {FRONT4}, low as (select video, min(recall) as lr, min(prec) as lp, min(f1) as lf,
      min(early) as le from early group by 1),
    s as (select f.video, recall - (recall-lr)*0.05e0 as recall, prec - (prec-lp)*0.05e0 as prec,
      f1 - (f1-lf)*0.05e0 as f1, early - (early-le)*0.05e0 as early from front f join low using (video))
    select video, idx, recall, prec, f1, early from early y where not exists (select 1 from s
      where s.video=y.video and s.recall > y.recall and s.prec > y.prec and s.f1 > y.f1
      and s.early > y.early)""",
)
def margin_front_4d(spark, sf):
    return P.margin_front(_early_scores(spark, sf), 0.05, OBJECTIVES4)


@query(
    "margin_front",
    "scores",
    f"""with {FRONT3}, low as (select video, min(recall) as lr, min(prec) as lp, min(f1) as lf from scores group by 1),
    s as (select f.video, recall - (recall-lr)*0.05e0 as recall, prec - (prec-lp)*0.05e0 as prec,
      f1 - (f1-lf)*0.05e0 as f1 from front f join low using (video))
    select video, idx, recall, prec, f1 from scores y where not exists (select 1 from s
      where s.video=y.video and s.recall > y.recall and s.prec > y.prec and s.f1 > y.f1)""",
)
def margin_front(spark, sf):
    return P.margin_front(X.scores(spark, sf), 0.05)


@query(
    "design_scores",
    "scores",
    f"""with {FRONT3}, t as (select video, count(*) as n, sum(recall) as sr, sum(prec) as sp, sum(f1) as sf,
      max(recall)-min(recall) as rr, max(prec)-min(prec) as rp, max(f1)-min(f1) as rf from scores group by 1)
    select video, idx, round((recall*n - sr + rr*0.1e0*(n-1)) + (prec*n - sp + rp*0.1e0*(n-1))
      + (f1*n - sf + rf*0.1e0*(n-1)), 6) as score from front join t using (video)""",
)
def design_scores(spark, sf):
    scores = X.scores(spark, sf)
    scored = P.design_scores(P.pareto_front(scores), scores, 0.1)
    return rounded(scored, "score").select("video", "idx", "score")


@query(
    "order_by_recall",
    "scores",
    f"with {FRONT3} select video, idx, recall, prec, f1 from front order by video, recall, idx",
)
def order_by_recall(spark, sf):
    return P.order_by_recall(P.pareto_front(X.scores(spark, sf)))


AP_SQL = f"""ap as (select video, sum(coalesce(slab, recall*prec)) as ap from (
  select video, recall, prec, {SLAB} as slab from front
  window w as (partition by video order by recall, idx)) t group by 1)"""


@query(
    "average_precision",
    "scores",
    f"with {FRONT3}, {AP_SQL} select video, round(ap, 6) as ap from ap",
)
def average_precision(spark, sf):
    return rounded(P.average_precision(P.pareto_front(X.scores(spark, sf))), "ap")


@query(
    "pr_curve",
    "scores",
    f"""with {FRONT3}, o as (select video, row_number() over (partition by video order by recall, idx) as point,
      recall, prec from front)
    select * from o union all select video, 0, 0, prec from o where point = 1""",
)
def pr_curve(spark, sf):
    return P.pr_curve(P.pareto_front(X.scores(spark, sf)))


@query(
    "best_design",
    "scores",
    """select video, idx, sample_ord, recall, prec, f1 from (
      select *, row_number() over (partition by video order by f1 desc, idx) as rn from scores) t where rn = 1""",
)
def best_design(spark, sf):
    return P.best_design(X.scores(spark, sf), "f1")


MAXIMA_SQL = (
    f"with {FRONT3}, "
    + ", ".join(
        f"""m_{n} as (select * from (select *, row_number() over (partition by video order by {n} desc, idx) as rn
  from front) t where rn = 1)"""
        for n in P.OBJECTIVES
    )
    + ", maxima as (select m_recall.video, "
    + ", ".join(
        f"m_{n}.{f} as max_{n}_{f}" for n in P.OBJECTIVES for f in ("idx", *P.OBJECTIVES)
    )
    + " from m_recall join m_prec using (video) join m_f1 using (video))"
)


@query("front_maxima", "scores", MAXIMA_SQL + " select * from maxima")
def front_maxima(spark, sf):
    return P.front_maxima(P.pareto_front(X.scores(spark, sf)))


TARGETS_SQL = "targets(video, tr, tp, tf) as (values " + ", ".join(
    f"({i}, {r}e0, {p}e0, {f}e0)" for i, (r, p, f) in enumerate(D.VIDEO_TARGETS.values())
) + ")"


def _targets(spark):
    return spark.createDataFrame(
        [(i, *t) for i, t in enumerate(D.VIDEO_TARGETS.values())],
        "video bigint, target_recall double, target_prec double, target_f1 double",
    )


@query(
    "meets_targets",
    "scores",
    MAXIMA_SQL + f""", {TARGETS_SQL} select m.video, max_recall_recall as max_recall, max_prec_prec as max_prec,
      max_f1_f1 as max_f1, coalesce(max_recall_recall >= tr, false) as recall_ok,
      coalesce(max_prec_prec >= tp, false) as prec_ok, coalesce(max_f1_f1 >= tf, false) as f1_ok
    from maxima m left join targets t on m.video = t.video""",
)
def meets_targets(spark, sf):
    maxima = P.front_maxima(P.pareto_front(X.scores(spark, sf)))
    return P.meets_targets(maxima, _targets(spark))


@query(
    "meets_average_targets",
    "scores",
    MAXIMA_SQL + """, a as (select avg(max_recall_recall) as ar, avg(max_prec_prec) as ap, avg(max_f1_f1) as af from maxima)
    select round(ar, 6) as avg_recall, round(ap, 6) as avg_prec, round(af, 6) as avg_f1,
      ar >= 0.84e0 as recall_ok, ap >= 0.85e0 as prec_ok, af >= 0.84e0 as f1_ok from a""",
)
def meets_average_targets(spark, sf):
    maxima = P.front_maxima(P.pareto_front(X.scores(spark, sf)))
    return rounded(
        P.meets_average_targets(maxima, D.AVERAGE_TARGETS), "avg_recall", "avg_prec", "avg_f1"
    )


@query(
    "running_best",
    "scores",
    "with b as (select *, "
    + ", ".join(f"coalesce(max({n}) over w, 0) as best_{n}" for n in P.OBJECTIVES)
    + " from scores window w as (partition by video order by sample_ord rows between unbounded preceding and 1 preceding))"
    + " select *, "
    + ", ".join(f"{n} > best_{n} as new_{n}" for n in P.OBJECTIVES)
    + " from b",
)
def running_best(spark, sf):
    return P.running_best(X.scores(spark, sf))


@query(
    "front_history",
    "scores",
    f"""with {LIVES}, n as (select video, sample_ord, row_number() over (partition by video order by sample_ord) as n from scores),
    live as (select n.video, n.n, e.recall, e.prec, e.idx from n join ever e on e.video = n.video
      and e.sample_ord <= n.sample_ord and (e.killer is null or e.killer > n.sample_ord)),
    s as (select video, n, {SLAB} as slab from live window w as (partition by video, n order by recall, idx))
    select video, n, round(sum(coalesce(slab, 0)), 6) as area from s group by 1, 2""",
)
def front_history(spark, sf):
    return rounded(P.front_history(X.scores(spark, sf)), "area")


SINCE_SQL = f"""{LIVES}, n as (select video, sample_ord, row_number() over (partition by video order by sample_ord) as n from scores),
since as (select n.video, n.n, n.n - max(m.n) as samples_since from n
  join ever e on e.video = n.video and e.sample_ord <= n.sample_ord
    and (e.killer is null or e.killer > n.sample_ord)
  join n m on m.video = e.video and m.sample_ord = e.sample_ord group by 1, 2)"""


@query(
    "samples_since_front",
    "scores",
    f"with {SINCE_SQL} select video, n, samples_since, round(samples_since / cast(n as double), 6) as share from since",
)
def samples_since_front(spark, sf):
    return rounded(P.samples_since_front(X.scores(spark, sf)), "share")


@query(
    "samples_until_stop",
    "scores",
    f"""with {SINCE_SQL} select video, n, samples_since, round((0.5e0*n - samples_since)/0.5e0, 6) as remaining
    from (select *, max(n) over (partition by video) as m from since) t where n = m""",
)
def samples_until_stop(spark, sf):
    return rounded(P.samples_until_stop(X.scores(spark, sf)), "remaining")


@query(
    "new_front_points",
    "scores",
    f"""with {LIVES} select s.video, s.idx, s.sample_ord, e.idx is not null as is_new_front
    from scores s left join ever e on e.video = s.video and e.idx = s.idx""",
)
def new_front_points(spark, sf):
    return P.new_front_points(X.scores(spark, sf))


@query(
    "zero_floor",
    "scores",
    "select video, idx, sample_ord, "
    + ", ".join(
        f"case when recall + prec + f1 = 0 then 1e-5 else {n} end as {n}" for n in P.OBJECTIVES
    )
    + " from scores",
)
def zero_floor(spark, sf):
    return P.zero_floor(X.scores(spark, sf))


@query(
    "transfer_front",
    "scores",
    f"""with {FRONT3}, known as (select distinct video, idx // 7 as idx from scores)
    select (f.video + 1) % 7 as video, f.idx // 7 as idx, f.recall, f.prec, f.f1, k.idx is not null as sampled
    from front f left join known k on k.video = (f.video + 1) % 7 and k.idx = f.idx // 7""",
)
def transfer_front(spark, sf):
    """Each video's front as candidates for the next video."""
    scores = X.scores(spark, sf)
    front = P.pareto_front(scores).withColumns(
        {"video": (F.col("video") + 1) % 7, "idx": F.expr("idx div 7")}
    )
    known = scores.select("video", F.expr("idx div 7").alias("idx"))
    return P.transfer_front(front, known)


def _pick(digit: str, values: list) -> str:
    return "[" + ", ".join(str(v) for v in values) + f"][{digit} + 1]"


SPACE_VALUES = list(D.learned_parameters().values())
SPACE_NAMES = [D.short_name(k) for k in D.learned_parameters()]
# Digit expressions of a design number for sizes 4, 5, 8, 5, 8, 3.
SPACE_DIGITS = ["(idx // 5) % 4", "idx % 5", "(idx // 20) % 8", "(idx // 160) % 5",
                "(idx // 800) % 8", "(idx // 6400) % 3"]
SPACE_SQL = ", ".join(
    f"{_pick(d, v)} as {n}" for d, v, n in zip(SPACE_DIGITS, SPACE_VALUES, SPACE_NAMES)
)


@query(
    "design_space",
    "scores",
    f"""select idx, {SPACE_SQL}, coalesce(n, 0) as samples
    from (select unnest(range(0, 19200)) as idx) every
    left join (select idx, count(*) as n from scores group by idx) s using (idx)""",
)
def design_space(spark, sf):
    """The whole space, with how often each design was sampled."""
    samples = X.scores(spark, sf).groupBy("idx").agg(F.count("*").alias("n"))
    return (
        D.design_space(spark).join(samples, "idx", "left")
        .withColumn("samples", F.coalesce("n", F.lit(0).cast("long"))).drop("n")
    )


@query(
    "with_parameters",
    "scores",
    "select video, idx, " + ", ".join(
        f"case when idx between 0 and 19199 then {_pick(d, v)} end as {n}"
        for d, v, n in zip(SPACE_DIGITS, SPACE_VALUES, SPACE_NAMES)
    ) + " from scores",
)
def with_parameters(spark, sf):
    return D.with_parameters(X.scores(spark, sf).select("video", "idx"))


@query(
    "design_join",
    "scores",
    """with every as (select video, unnest(range(0, 19200)) as idx from (select distinct video from scores) v)
    select e.video, e.idx, coalesce(recall, 0) as recall, coalesce(prec, 0) as prec, coalesce(f1, 0) as f1,
      s.idx is not null as sampled, true as known
    from every e left join scores s on s.video = e.video and s.idx = e.idx
    union all select video, idx, recall, prec, f1, true, false from scores where idx >= 19200 or idx < 0""",
)
def design_join(spark, sf):
    return D.design_join(X.scores(spark, sf))


@query(
    "sampling_budget",
    "scores",
    """select video, idx from (select video, idx, row_number() over (partition by video
        order by md5(concat('7:', cast(idx as varchar))), idx) as rn, count(*) over (partition by video) as n
      from scores) t where rn <= floor(n * 0.3e0)""",
)
def sampling_budget(spark, sf):
    return D.sampling_budget(X.scores(spark, sf).select("video", "idx"), 0.3, 7, ["video"])


SWEEP = [
    {"idx": 0},
    {"idx": 1, "threshold": 0.3},
    {"idx": 2, "threshold": 0.5, "max_width": 16},
    {"idx": 3, "max_width": 18, "max_height": 13},
    {"idx": 4, "max_width": 0},
    {"idx": 5, "threshold": 0.3},
]


def sweep_sql(designs: list[dict]) -> str:
    parts, names = [], []
    for d in designs:
        i, t = d["idx"], d.get("threshold") or 0
        w, h = (10**6 if d.get(n) is None else d[n] for n in ("max_width", "max_height"))
        parts += [
            greedy_sql(f"g{i}", "a_ord", "b_ord", f"iou >= {t}e0 and bw <= {w} and bh <= {h}"),
            greedy_sql(f"h{i}", "b_ord", "a_ord", f"iou >= {t}e0 and aw <= {w} and ah <= {h}"),
        ]
        names += [
            f"select {i} as idx, video, frame, count(pick) as tp, 0 as found from g{i}_walk group by 2, 3",
            f"select {i}, video, frame, 0, count(pick) from h{i}_walk group by 2, 3",
        ]
    return f"""with recursive {IOU_SQL}, {LAST_SQL}, {', '.join(parts)},
hits as (select idx, video, sum(tp) as tp, sum(found) as found from ({' union all '.join(names)}) u
  join lastf using (video) where frame <= m group by 1, 2),
c as (select video, sum(n) as n from nc join lastf using (video) where frame <= m group by 1),
g as (select video, sum(n) as n from ng join lastf using (video) where frame <= m group by 1),
i as (select unnest([{', '.join(str(d['idx']) for d in designs)}]) as idx),
d as (select i.idx, c.video, coalesce(tp, 0) as tp, g.n - coalesce(found, 0) as fn, c.n - coalesce(tp, 0) as fp
  from c join g on c.video = g.video cross join i
  left join hits h on h.video = c.video and h.idx = i.idx)
select video, idx, cast(tp as bigint) as true_positive, cast(fn as bigint) as false_negative,
  cast(fp as bigint) as false_positive, round(r, 9) as recall, round(p, 9) as precision,
  round(case when p + r = 0 then 0 else 2*p*r/(p+r) end, 9) as f1
from (select *, case when tp+fn=0 then 0 else cast(tp as double)/cast(tp+fn as double) end as r,
  case when tp+fp=0 then 0 else cast(tp as double)/cast(tp+fp as double) end as p from d) q"""


@query("size_sweep", BOXES, sweep_sql(SWEEP))
def size_sweep(spark, sf):
    base = X.boxes_base(spark, sf)
    swept = D.threshold_sweep(X.calc_from_base(base), X.gt_from_base(base), SWEEP)
    return rounded(swept, "recall", "precision", "f1", digits=9)


CALLBACK_SQL = f"""with {IOU_SQL.replace('calc_regions', 'moved')}, {LAST_SQL.replace('calc_regions', 'moved')},
fwd as (select video, frame, count(distinct a_ord) as n from pairs group by 1, 2),
bwd as (select video, frame, count(distinct b_ord) as n from pairs group by 1, 2),
{COUNTS_SQL}
select {{idx}} as idx, video, cast(sum(true_positive) as bigint) as true_positive,
  cast(sum(false_negative) as bigint) as false_negative, cast(sum(false_positive) as bigint) as false_positive
from counts group by 2"""


def _callback_sql(idx: int) -> str:
    moved = f"""moved as (select video, frame, identity, ord, x1+{idx} as x1, y1, x2+{idx} as x2, y2 from calc_regions)"""
    return "(with " + moved + ", " + CALLBACK_SQL.format(idx=idx)[len("with "):].lstrip() + ")"


@query(
    "user_callback",
    BOXES,
    "select * from (" + " union all ".join(f"select * from {_callback_sql(i)}" for i in (0, 2, 5)) + ") u",
)
def user_callback(spark, sf):
    """A user's detector, called once per design: boxes moved sideways by idx."""
    base = X.boxes_base(spark, sf)
    calc, gt = X.calc_from_base(base), X.gt_from_base(base)

    def detect(design):
        step = design["idx"]
        return calc.withColumns({"x1": F.col("x1") + step, "x2": F.col("x2") + step})

    scored = D.sweep([{"idx": i} for i in (0, 2, 5)], detect, gt, allow_overlap=True)
    return scored.select("idx", "video", "true_positive", "false_negative", "false_positive")


R2 = "round_even({0} * 100, 0) / 100"


@query(
    "dataset_results",
    "scores",
    f"""with {FRONT3}, {AP_SQL}, best as (select * from (
      select *, row_number() over (partition by video order by f1 desc, idx) as rn from scores) t where rn = 1)
    select b.video, {R2.format('recall')} as recall, {R2.format('prec')} as prec, {R2.format('f1')} as f1,
      {R2.format('ap')} as ap from best b join ap using (video)""",
)
def dataset_results(spark, sf):
    return R.dataset_results(X.scores(spark, sf))


# Setting of a score row: idx % 3 picks one of the three compared objectives.
OBJECTIVE_VIEW = """o as (select *, idx % 3 as setting from scores),
dist as (select video, setting, recall, prec, f1, min(idx) as idx from o group by 1, 2, 3, 4, 5),
front as (select * from dist p where not exists (select 1 from dist r where r.video = p.video and r.setting = p.setting
  and r.recall >= p.recall and r.prec >= p.prec and r.f1 >= p.f1
  and (r.recall > p.recall or r.prec > p.prec or r.f1 > p.f1))),
ap as (select video, setting, sum(coalesce(slab, recall*prec)) as ap from (
  select video, setting, recall, prec, {slab} as slab from front
  window w as (partition by video, setting order by recall, idx)) t group by 1, 2),
best as (select * from (
  select *, row_number() over (partition by video, setting order by f1 desc, idx) as rn from o) t where rn = 1)"""


def _with_settings(df):
    setting = F.col("idx") % 3
    return df.withColumns(
        {
            "max_width": F.when(setting == 0, 1024).otherwise(35),
            "max_height": F.when(setting == 0, 1024).otherwise(35),
            "allow_overlap": setting < 2,
        }
    )


@query(
    "objective_table",
    "scores",
    f"""with {OBJECTIVE_VIEW.format(slab=SLAB)}
    select b.video, case b.setting when 0 then 'Problem Objective function 1'
        when 1 then 'Problem Objective function 2' else 'Final Objective Function' end as objective_function,
      case when b.setting = 0 then 1024 else 35 end as max_width,
      case when b.setting = 0 then 1024 else 35 end as max_height,
      case when b.setting < 2 then 'yes' else 'no' end as allow_overlap,
      {R2.format('recall')} as recall, {R2.format('prec')} as prec, {R2.format('f1')} as f1,
      {R2.format('ap')} as ap from best b join ap on ap.video = b.video and ap.setting = b.setting""",
)
def objective_table(spark, sf):
    return R.objective_table(_with_settings(X.scores(spark, sf)))


@query(
    "sample_counts",
    "scores",
    f"""with {FRONT3}, c as (select video, count(*) as n from scores group by 1),
    f as (select video, count(*) as n from front group by 1)
    select c.video, c.n as sampled_count,
      concat(cast(round_even(c.n / 19200.0e0 * 10000, 0) / 100 as varchar), '%') as sampled_percent,
      f.n as front_count from c join f using (video)""",
)
def sample_counts(spark, sf):
    return R.sample_counts(X.scores(spark, sf), D.space_size())


@query(
    "average_samples",
    "scores",
    "select avg(n) as avg_samples from (select count(*) as n from scores group by video) t",
)
def average_samples(spark, sf):
    return R.average_samples(X.scores(spark, sf))


# A method table: method = idx % 14, best values of each method and video.
TABLE_SQL = """wide as (select concat('M', cast(idx % 14 as varchar)) as method, video % 7 as video, max(recall) as recall,
  max(prec) as precision, max(f1) as f1, max(recall * prec) as ap from scores group by 1, 2),
tab as (select method, video, metric, value from (unpivot wide on recall, precision, f1, ap into name metric value value) u)"""
BEST_SQL = """bests as (
  select video, recall, prec as precision, f1 from (
    select *, row_number() over (partition by video order by f1 desc, idx) as rn from scores) t where rn = 1)"""


def _method_table(spark, sf):
    wide = (
        X.scores(spark, sf)
        .groupBy(
            F.concat(F.lit("M"), (F.col("idx") % 14).cast("string")).alias("method"), "video"
        )
        .agg(
            F.max("recall").alias("recall"),
            F.max("prec").alias("precision"),
            F.max("f1").alias("f1"),
            F.max(F.col("recall") * F.col("prec")).alias("ap"),
        )
    )
    return wide.unpivot(["method", "video"], ["recall", "precision", "f1", "ap"], "metric", "value")


@query(
    "method_average",
    "scores",
    f"""with {TABLE_SQL} select method, round_even(avg(case when metric = 'recall' then value end), 2) as recall,
      round_even(avg(case when metric = 'precision' then value end), 2) as precision,
      round_even(avg(case when metric = 'f1' then value end), 2) as f1 from tab group by 1""",
)
def method_average(spark, sf):
    return R.method_average(_method_table(spark, sf))


@query(
    "mean_ap",
    "scores",
    f"with {TABLE_SQL} select method, round_even(avg(value), 2) as map from tab where metric = 'ap' group by 1",
)
def mean_ap(spark, sf):
    return R.mean_ap(_method_table(spark, sf))


@query(
    "side_by_side",
    "scores",
    f"""with {TABLE_SQL}, m as (select method, round_even(avg(value), 2) as map from tab where metric = 'ap' group by 1)
    select t.*, m.map from tab t join m using (method)""",
)
def side_by_side(spark, sf):
    table = _method_table(spark, sf)
    return R.side_by_side(table, R.mean_ap(table))


@query(
    "rank_methods",
    "scores",
    f"""with {TABLE_SQL} select method, video, metric, value, place from (
      select *, dense_rank() over (partition by video, metric order by value desc) as place from tab) t where place <= 3""",
)
def rank_methods(spark, sf):
    return R.rank_methods(_method_table(spark, sf))


@query(
    "add_method",
    "scores",
    f"""with {TABLE_SQL}, {BEST_SQL} select method, video, metric, value from tab union all
    select 'ours', video, metric, round_even(value, 2) from (
      unpivot bests on recall, precision, f1 into name metric value value) u""",
)
def add_method(spark, sf):
    best = P.best_design(X.scores(spark, sf), "f1").select("video", "recall", "prec", "f1")
    return R.add_method(_method_table(spark, sf), "ours", R.long_scores(best))


@query(
    "name_videos",
    "scores",
    """select video, idx, case when video < 5 then concat('Video ', cast(video + 1 as varchar)) else '-' end as name
    from scores""",
)
def name_videos(spark, sf):
    names = spark.createDataFrame(
        [(f"Video {i + 1}", i) for i in range(5)], "name string, video bigint"
    )
    named = R.name_videos(X.scores(spark, sf).select("video", "idx"), names)
    return named.withColumn("name", F.coalesce("name", F.lit("-")))


def _exports(spark, sf):
    scores = X.scores(spark, sf)
    return S.stack_samples(
        [
            R.export_rows(scores.filter(F.col("idx") % 3 == setting), "VISO", name)
            for setting, (name, *_rest) in enumerate(R.OBJECTIVE_SETTINGS)
        ]
    )


@query(
    "stack_samples",
    "scores",
    """select 'VISO' as dataset, cast(video as varchar) as video_name, case idx % 3
        when 0 then 'Problem Objective function 1' when 1 then 'Problem Objective function 2'
        else 'Final Objective Function' end as objective_function,
      idx, recall, prec as precision, f1 from scores""",
)
def stack_samples(spark, sf):
    return _exports(spark, sf)
