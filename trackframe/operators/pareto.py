"""Pareto fronts, their areas and how they grow.

All objectives are maximized. Dominance never compares all pairs of a dataset. Two
objectives need an order by the first and a running maximum of the second. With three,
points fall into a coarse grid of the first two objectives. A cell that is greater in
both grid directions settles most points with one small summary per dataset; what is
left is compared only inside its own row and column band. More objectives go through
fronts of blocks, merged in a tree (:mod:`trackframe.operators.skyline`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators import skyline
from trackframe.operators.running import running
from trackframe.session import cut

GRID = 16
# Chunks of the running maximum over a first objective.
STEPS = 64
AREA_BLOCK = 1024
KEYS = ["video"]
OBJECTIVES = ["recall", "prec", "f1"]


def _borders(df: DataFrame, keys: list[str], objectives: list[str]) -> DataFrame:
    """Per key the quantiles of the first two objectives, as borders of grid cells.

    Whatever the scale of the objectives, cells hold about as many points each.
    """
    shares = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
    return cut(
        df.groupBy(*keys).agg(
            *[
                F.percentile_approx(objectives[i], shares, F.lit(1000)).alias(f"b{i}")
                for i in (0, 1)
            ]
        )
    )


def _bucket(value: Column, borders: Column) -> Column:
    """Grid position: the borders that the value has reached. It never decreases with it."""
    return F.size(F.filter(borders, lambda b: b <= value)).cast("long")


def _gridded(
    df: DataFrame, borders: DataFrame, keys: list[str], objectives: list[str]
) -> DataFrame:
    """Points with their cell; those of a key without rivals have cell 0."""
    cell = {
        f"g{i}": F.coalesce(_bucket(F.col(objectives[i]), F.col(f"b{i}")), F.lit(0).cast("long"))
        for i in (0, 1)
    }
    return df.join(borders, keys, "left").withColumns(cell).drop("b0", "b1")


def _shadow(gridded: DataFrame, keys: list[str], value: Column, agg) -> DataFrame:
    """Per cell the aggregate of ``value`` over all cells greater in both directions.

    At most GRID * GRID rows per key; the spreading is combined before each shuffle.
    """
    cells = gridded.groupBy(*keys, "g0", "g1").agg(agg(value).alias("s"))
    for axis, other in (("g0", "g1"), ("g1", "g0")):
        cells = (
            cells.filter(F.col(axis) > 0)
            .withColumn(axis, F.explode(F.sequence(F.lit(0), F.col(axis) - 1)))
            .groupBy(*keys, axis, other)
            .agg(agg("s").alias("s"))
        )
    return cells


def _at_least(a: str, b: str, objectives: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{o}") >= F.col(f"{b}.{o}") for o in objectives])


def _above(a: str, b: str, objectives: list[str], every: bool) -> Column:
    tests = [F.col(f"{a}.{o}") > F.col(f"{b}.{o}") for o in objectives]
    return reduce(Column.__and__ if every else Column.__or__, tests)


def _not_dominated_by_order(
    points: DataFrame,
    dominators: DataFrame,
    keys: list[str],
    objectives: list[str],
    strict: bool,
) -> DataFrame:
    """Two objectives: the best second value among all greater first values settles a point.

    One row per value of the first objective carries the best second value; the running
    maximum over them is cut at quantiles, so that no key is one window.
    """
    one, two = objectives
    whole = F.col(one).isNotNull() & F.col(two).isNotNull()
    rivals = dominators.filter(whole).groupBy(*keys, one).agg(F.max(two).alias("equal"))
    steps = rivals
    if points is not dominators:
        nothing = F.lit(None).cast(rivals.schema["equal"].dataType)
        asked = points.select(*keys, one, nothing.alias("equal")).filter(F.col(one).isNotNull())
        steps = rivals.unionByName(asked).groupBy(*keys, one).agg(F.max("equal").alias("equal"))
    shares = F.array(*[F.lit(i / STEPS) for i in range(1, STEPS)])
    borders = steps.groupBy(*keys).agg(
        F.percentile_approx(one, shares, F.lit(20 * STEPS)).alias("borders")
    )
    placed = steps.join(borders, keys).select(
        *keys,
        F.col(one).alias("value"),
        "equal",
        # falling values, NaN before all, and chunks that rise along them
        (~F.isnan(one)).alias("number"),
        (-F.col(one)).alias("falling"),
        F.size(F.filter("borders", lambda b: b > F.col(one))).alias("chunk"),
    )
    best = running(
        placed, keys, ["number", "falling"], F.col("chunk"), {"above": ("max", F.col("equal"))},
        inclusive=False,
    ).select(*keys, F.col("value").alias(one), "equal", "above")
    beaten = F.col("above") > F.col(two)
    if not strict:
        beaten = (F.col("above") >= F.col(two)) | (F.col("equal") > F.col(two))
    return (
        points.join(best, [*keys, one], "left")
        .filter(~F.coalesce(beaten, F.lit(False)))
        .select(*points.columns)
    )


def not_dominated(
    points: DataFrame,
    dominators: DataFrame,
    keys: list[str],
    objectives: list[str],
    strict: bool = False,
) -> DataFrame:
    """Points that no dominator beats.

    Beating is at least as good everywhere and better somewhere, or with
    ``strict`` better everywhere. Two or more objectives.
    """
    if len(objectives) < 2:
        raise ValueError("dominance needs two objectives")
    if len(objectives) == 2:
        return _not_dominated_by_order(points, dominators, keys, objectives, strict)
    if len(objectives) > 3:
        return skyline.not_dominated(points, dominators, keys, objectives, strict)
    third = F.col(objectives[2])
    alike = points is dominators
    source = points if alike else dominators.select(*keys, *objectives)
    borders = _borders(source, keys, objectives)
    rivals = _gridded(source, borders, keys, objectives)
    shadow = _shadow(rivals, keys, third, F.max)

    def grid_survivors(df: DataFrame) -> DataFrame:
        beaten = F.col("s") > third if strict else F.col("s") >= third
        return (
            df.join(shadow, [*keys, "g0", "g1"], "left")
            .filter(~F.coalesce(beaten, F.lit(False)))
            .drop("s")
        )

    # A rival beaten from a greater cell cannot be the only one to beat a point.
    # What the grid leaves is little and read several times.
    band = cut(grid_survivors(rivals))
    left = band if alike else grid_survivors(
        _gridded(points, borders, keys, objectives)
    )
    beats = _above("r", "p", objectives, every=strict)
    if not strict:
        beats = _at_least("r", "p", objectives) & beats
    for axis in ("g0", "g1"):
        same = reduce(
            Column.__and__, [F.col(f"p.{k}") == F.col(f"r.{k}") for k in [*keys, axis]]
        )
        left = left.alias("p").join(band.alias("r"), same & beats, "left_anti")
    return left.drop("g0", "g1")


def pareto_front(
    scores: DataFrame,
    objectives: list[str] | None = None,
    keys: list[str] | None = None,
    idx: str = "idx",
) -> DataFrame:
    """Non-dominated rows per key; equal rows are one, with the lowest index."""
    keys, objectives = keys or KEYS, objectives or OBJECTIVES
    distinct = scores.groupBy(*keys, *objectives).agg(F.min(idx).alias(idx))
    return not_dominated(distinct, distinct, keys, objectives)


def margin_front(
    scores: DataFrame,
    margin: float,
    objectives: list[str] | None = None,
    keys: list[str] | None = None,
    idx: str = "idx",
) -> DataFrame:
    """Rows that come within the margin of every front point on some objective.

    The margin of a front point is its distance to the column minimum times
    ``margin``. A row fails when a front point moved down by its margin is still
    better everywhere.
    """
    keys, objectives = keys or KEYS, objectives or OBJECTIVES
    lows = scores.groupBy(*keys).agg(*[F.min(o).alias(f"low_{o}") for o in objectives])
    moved = {
        o: F.col(o) - (F.col(o) - F.col(f"low_{o}")) * F.lit(float(margin)) for o in objectives
    }
    lowered = pareto_front(scores, objectives, keys, idx).join(lows, keys).withColumns(moved)
    return not_dominated(
        scores.select(*keys, idx, *objectives),
        lowered.select(*keys, *objectives),
        keys,
        objectives,
        strict=True,
    )


def design_scores(
    rows: DataFrame,
    scores: DataFrame,
    margin: float = 0.0,
    objectives: list[str] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Sum over objectives of r*n - total + range*margin*(n-1)."""
    keys, objectives = keys or KEYS, objectives or OBJECTIVES
    n = F.col("n")
    totals = scores.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.sum(o).alias(f"sum_{o}") for o in objectives],
        *[(F.max(o) - F.min(o)).alias(f"range_{o}") for o in objectives],
    )
    parts = [
        F.col(o) * n - F.col(f"sum_{o}") + F.col(f"range_{o}") * F.lit(float(margin)) * (n - 1)
        for o in objectives
    ]
    return (
        rows.join(totals, keys)
        .withColumn("score", reduce(Column.__add__, parts))
        .select(*rows.columns, "score")
    )


def order_by_recall(front: DataFrame) -> DataFrame:
    return front.orderBy(*KEYS, "recall", "idx")


def _trapezoids(df: DataFrame, keys: list[str], rectangle: bool, name: str) -> DataFrame:
    """Area of precision over recall per key; groups are single fronts."""
    order = Window.partitionBy(*keys).orderBy("recall", "idx")
    step = df.withColumns(
        {"r0": F.lag("recall").over(order), "p0": F.lag("prec").over(order)}
    )
    slab = (F.col("recall") - F.col("r0")) * (F.col("prec") + F.col("p0")) / 2
    first = F.col("recall") * F.col("prec") if rectangle else F.lit(0.0)
    return step.groupBy(*keys).agg(
        F.sum(F.when(F.col("r0").isNull(), first).otherwise(slab)).alias(name)
    )


def average_precision(front: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Trapezoids over recall plus the rectangle left of the first point."""
    return _trapezoids(front, keys or KEYS, True, "ap")


def pr_curve(front: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Front by recall as points 1.., after point 0 at recall 0 and the first precision."""
    keys = keys or KEYS
    order = Window.partitionBy(*keys).orderBy("recall", "idx")
    points = front.select(
        *keys, F.row_number().over(order).alias("point"), "recall", "prec", "idx"
    )
    start = front.groupBy(*keys).agg(
        F.min_by("prec", F.struct("recall", "idx")).alias("prec")
    ).select(*keys, F.lit(0).alias("point"), F.lit(0.0).alias("recall"), "prec")
    return points.select(*keys, "point", "recall", "prec").unionByName(start)


def best_design(scores: DataFrame, metric: str, keys: list[str] | None = None) -> DataFrame:
    """The row with the highest metric, lowest index among equals."""
    keys = keys or KEYS
    others = [name for name in scores.columns if name not in keys]
    best = F.max_by(F.struct(*others), F.struct(F.col(metric), -F.col("idx")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def front_maxima(front: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per key with the front rows of best recall, precision and F1."""
    keys = keys or KEYS
    row = F.struct("idx", *OBJECTIVES)
    picks = {
        name: F.max_by(row, F.struct(F.col(name), -F.col("idx"))) for name in OBJECTIVES
    }
    return (
        front.groupBy(*keys)
        .agg(*[pick.alias(name) for name, pick in picks.items()])
        .select(
            *keys,
            *[
                F.col(f"{name}.{field}").alias(f"max_{name}_{field}")
                for name in OBJECTIVES
                for field in ("idx", *OBJECTIVES)
            ],
        )
    )


def meets_targets(maxima: DataFrame, targets: DataFrame) -> DataFrame:
    """Per video, whether the best recall, precision and F1 reach their targets.

    A video without targets reaches none.
    """
    checks = {
        f"{name}_ok": F.coalesce(
            F.col(f"max_{name}_{name}") >= F.col(f"target_{name}"), F.lit(False)
        )
        for name in OBJECTIVES
    }
    return maxima.join(targets, "video", "left").select(
        "video",
        *[F.col(f"max_{n}_{n}").alias(f"max_{n}") for n in OBJECTIVES],
        *[check.alias(name) for name, check in checks.items()],
    )


def meets_average_targets(maxima: DataFrame, targets: dict[str, float]) -> DataFrame:
    """One row: average best recall, precision and F1 against required averages."""
    averages = maxima.agg(*[F.avg(f"max_{n}_{n}").alias(f"avg_{n}") for n in OBJECTIVES])
    return averages.withColumns(
        {f"{n}_ok": F.col(f"avg_{n}") >= F.lit(targets[n]) for n in OBJECTIVES}
    )


def sample_order(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``n``, the 1-based count of samples up to each row of a key."""
    keys = keys or KEYS
    block = F.floor(F.col("sample_ord") / AREA_BLOCK)
    one = F.lit(1).cast("long")
    return running(scores, keys, ["sample_ord"], block, {"n": ("sum", one)})


def front_lifetimes(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Samples that were ever on the front, with ``death``, the order that ended it.

    Only recall and precision matter: F1 never falls when both rise. A sample is
    never on the front when an earlier one is at least as good, and leaves it
    when a later one beats it. The first sample to do either is on the front
    itself, so only samples that pass the grid test need comparing.
    """
    keys = keys or KEYS
    objectives = ["recall", "prec"]
    samples = scores.select(*keys, "idx", "sample_ord", *objectives)
    rows = _gridded(samples, _borders(samples, keys, objectives), keys, objectives)
    shadow = _shadow(rows, keys, F.col("sample_ord"), F.min)
    # few samples pass the grid, and they are compared with each other below
    alive = cut(
        rows.join(shadow, [*keys, "g0", "g1"], "left")
        .filter(F.col("s").isNull() | (F.col("s") > F.col("sample_ord")))
        .withColumnRenamed("s", "death")
    )
    small = alive.drop("death")
    later = F.col("r.sample_ord") > F.col("p.sample_ord")
    beats = _at_least("r", "p", objectives) & (
        ~later | _above("r", "p", objectives, every=False)
    )
    kills = []
    for axis in ("g0", "g1"):
        same = reduce(
            Column.__and__, [F.col(f"p.{k}") == F.col(f"r.{k}") for k in [*keys, axis]]
        )
        other = F.col("r.sample_ord") != F.col("p.sample_ord")
        kills.append(
            small.alias("p")
            .join(small.alias("r"), same & other & beats)
            .groupBy(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.sample_ord").alias("sample_ord"))
            .agg(F.min("r.sample_ord").alias("killer"))
        )
    killers = (
        kills[0].unionByName(kills[1]).groupBy(*keys, "sample_ord").agg(F.min("killer").alias("killer"))
    )
    return (
        alive.join(killers, [*keys, "sample_ord"], "left")
        .filter(F.col("killer").isNull() | (F.col("killer") > F.col("sample_ord")))
        .select(
            *keys, "idx", "sample_ord", *objectives, F.least("death", "killer").alias("death")
        )
    )


def front_history(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the front after every sample, without the first rectangle.

    The area changes only when a sample joins the front. Those events are few;
    they meet the front rows alive at that time in blocks of the sample order,
    and the last known area is carried to the samples between.
    """
    keys = keys or KEYS
    lives = cut(front_lifetimes(scores, keys))
    events = lives.select(
        *keys,
        F.col("sample_ord").alias("event"),
        F.floor(F.col("sample_ord") / AREA_BLOCK).alias("block"),
    )
    last = events.groupBy(*keys).agg(F.max("event").alias("last_event"))
    spans = (
        lives.join(last, keys)
        .withColumn("until", F.least(F.col("death") - 1, F.col("last_event")))
        .withColumn(
            "block",
            F.explode(
                F.sequence(
                    F.floor(F.col("sample_ord") / AREA_BLOCK), F.floor(F.col("until") / AREA_BLOCK)
                )
            ),
        )
    )
    on_front = spans.join(events, [*keys, "block"]).filter(
        F.col("event").between(F.col("sample_ord"), F.col("until"))
    )
    areas = _trapezoids(on_front, [*keys, "event"], False, "event_area").withColumnRenamed(
        "event", "sample_ord"
    )
    rows = scores.select(*keys, "sample_ord").join(areas, [*keys, "sample_ord"], "left")
    block = F.floor(F.col("sample_ord") / AREA_BLOCK)
    return running(
        rows,
        keys,
        ["sample_ord"],
        block,
        {"n": ("sum", F.lit(1).cast("long")), "area": ("last", F.col("event_area"))},
    ).select(*keys, "n", "area")


def samples_since_front(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per prefix, the samples since the newest front point: count and share.

    The newest sample that ever joined cannot have left yet, as only a newer
    one could end it.
    """
    keys = keys or KEYS
    joined = front_lifetimes(scores, keys).select(*keys, "sample_ord", F.lit(True).alias("joined"))
    counted = sample_order(scores.select(*keys, "sample_ord"), keys)
    rows = counted.join(joined, [*keys, "sample_ord"], "left")
    block = F.floor(F.col("sample_ord") / AREA_BLOCK)
    newest = running(
        rows, keys, ["sample_ord"], block, {"at": ("max", F.when(F.col("joined"), F.col("n")))}
    )
    since = F.col("n") - F.col("at")
    return newest.select(
        *keys, "n", since.alias("samples_since"), (since / F.col("n")).alias("share")
    )


def samples_until_stop(
    scores: DataFrame, fraction: float = 0.5, keys: list[str] | None = None
) -> DataFrame:
    """(f*n - j) / (1 - f) for the last prefix of each key."""
    keys = keys or KEYS
    last = (
        samples_since_front(scores, keys)
        .groupBy(*keys)
        .agg(F.max("n").alias("n"), F.max_by("samples_since", "n").alias("samples_since"))
    )
    f = F.lit(float(fraction))
    return last.withColumn("remaining", (f * F.col("n") - F.col("samples_since")) / (1 - f))


def new_front_points(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every sample, flagged when it was on the front as it arrived."""
    keys = keys or KEYS
    joined = front_lifetimes(scores, keys).select(
        *keys, "sample_ord", F.lit(True).alias("is_new_front")
    )
    return (
        scores.select(*keys, "idx", "sample_ord")
        .join(joined, [*keys, "sample_ord"], "left")
        .withColumn("is_new_front", F.coalesce("is_new_front", F.lit(False)))
    )


def is_new_front_point(scores: DataFrame, idx: int, keys: list[str] | None = None) -> DataFrame:
    return new_front_points(scores, keys).filter(F.col("idx") == idx)


def running_best(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best recall, precision and F1 before each sample, and flags for new bests."""
    keys = keys or KEYS
    block = F.floor(F.col("sample_ord") / AREA_BLOCK)
    specs = {f"best_{n}": ("max", F.col(n)) for n in OBJECTIVES}
    best = running(scores, keys, ["sample_ord"], block, specs, inclusive=False)
    filled = {f"best_{n}": F.coalesce(f"best_{n}", F.lit(0.0)) for n in OBJECTIVES}
    flags = {f"new_{n}": F.col(n) > F.col(f"best_{n}") for n in OBJECTIVES}
    return best.withColumns(filled).withColumns(flags)


def zero_floor(scores: DataFrame, floor: float = 1e-5) -> DataFrame:
    """Rows whose objectives sum to zero get a small positive score instead."""
    total = reduce(Column.__add__, [F.col(n) for n in OBJECTIVES])
    return scores.withColumns(
        {n: F.when(total == 0, F.lit(floor)).otherwise(F.col(n)) for n in OBJECTIVES}
    )


def transfer_front(
    ref_front: DataFrame, known: DataFrame, keys: list[str] | None = None, idx: str = "idx"
) -> DataFrame:
    """Front designs of a reference, flagged when the target video has sampled them.

    ``keys`` name the target in both tables.
    """
    on = [*(keys or KEYS), idx]
    seen = known.select(*on).distinct().withColumn("sampled", F.lit(True))
    return ref_front.join(seen, on, "left").withColumn(
        "sampled", F.coalesce("sampled", F.lit(False))
    )
