"""Design spaces, sampling budgets and sweeps over designs."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.operators import matching as M
from trackframe.operators import metrics as E
from trackframe.operators.running import row_numbers
from trackframe.session import cut

# The shipped parameter declaration, in its own order.
DECLARATION = {
    "preprocess/kernel_size": {"type": "int32", "min": 3, "max": 7, "step": 1},
    "motion_detector/history_frames": {"type": "int32", "min": 3, "max": 8, "step": 1},
    "motion_detector/registration/good_match_percent": {
        "type": "float", "min": 0, "max": 1, "step": 0.1, "skip_learn": True,
    },
    "motion_detector/registration/ransac_max_error": {
        "type": "float", "min": 0, "max": 20, "step": 2, "skip_learn": True,
    },
    "motion_detector/registration/ssc_num_ret_points": {
        "type": "int32", "min": 0, "max": 100000, "step": 100, "skip_learn": True,
    },
    "motion_detector/registration/ssc_tolerence": {
        "type": "float", "min": 0, "max": 2, "step": 0.1, "skip_learn": True,
    },
    "motion_detector/quantize_frames/scale_factor": {
        "type": "int32", "min": 5, "max": 20, "step": 2,
    },
    "motion_detector/dbscan/eps": {"type": "float", "min": 0.5, "max": 5, "step": 1},
    "motion_detector/dbscan/min_samples": {"type": "int32", "min": 5, "max": 20, "step": 2},
    "motion_detector/dbscan/kernel": {"type": "int32", "min": 3, "max": 10, "odd": True},
}

# Fixed values: (recall, precision, F1) each video must reach, and the averages.
VIDEO_TARGETS = {
    "VISO/car/003": (0.92, 0.92, 0.84),
    "VISO/car/004": (0.83, 0.89, 0.85),
    "VISO/car/005": (0.94, 0.88, 0.91),
    "VISO/car/006": (0.88, 0.93, 0.86),
    "VISO/car/007": (0.80, 0.84, 0.80),
    "VISO/car/008": (0.83, 0.85, 0.81),
    "VISO/car/009": (0.93, 0.73, 0.78),
}
AVERAGE_TARGETS = {"recall": 0.84, "prec": 0.85, "f1": 0.84}

# Settings tried together on a pair of boxes, and copies of the settings table.
SETTINGS_BLOCK, SETTINGS_SALT = 64, 32


def parameter_values(spec: dict) -> list[float]:
    """Values of one parameter; the upper bound is left out.

    An odd parameter counts 2*(min-1)+1, 2*min+1, ... below its bound, so its own
    minimum is not reached, as published.
    """
    low, high = spec.get("min", 0), spec.get("max", 100)
    step = spec.get("step", 1)
    if spec.get("odd"):
        low, high = low - 1, high / 2
    count = max(math.ceil((high - low) / step), 0)
    values = [low + i * step for i in range(count)]
    values = [2 * v + 1 for v in values] if spec.get("odd") else values
    return [int(v) for v in values] if spec.get("type") == "int32" else values


def learned_parameters(declaration: dict | None = None) -> dict[str, list[float]]:
    declaration = declaration or DECLARATION
    return {
        key: parameter_values(spec)
        for key, spec in declaration.items()
        if not spec.get("skip_learn")
    }


def space_size(declaration: dict | None = None) -> int:
    return math.prod(len(v) for v in learned_parameters(declaration).values())


def short_name(key: str) -> str:
    return key.split("/", 1)[1].replace("/", "_") if "/" in key else key


def decode_design(
    idx: Column, declaration: dict | None = None, spark: SparkSession | None = None
) -> dict[str, Column]:
    """Parameter columns of a design number, by arithmetic instead of a product join.

    The second parameter runs fastest, then the first, then the third and on. A number
    outside the space has no parameters.
    """
    inside = (idx >= 0) & (idx < space_size(declaration))
    parameters = list(learned_parameters(declaration).items())
    fastest_first = [1, 0, *range(2, len(parameters))] if len(parameters) > 1 else [0]
    columns: dict[str, Column] = {}
    rest = idx
    for position in fastest_first:
        key, values = parameters[position]
        table = F.array(*[F.lit(v) for v in values])
        value = F.element_at(table, (rest % len(values)).cast("int") + 1)
        columns[key] = F.when(inside, value)
        rest = F.floor(rest / len(values))
    return {short_name(key): columns[key] for key, _ in parameters}


def design_space(spark: SparkSession, declaration: dict | None = None) -> DataFrame:
    """Every design with its number and parameters."""
    base = spark.range(space_size(declaration)).withColumnRenamed("id", "idx")
    return base.withColumns(decode_design(F.col("idx"), declaration))


def with_parameters(scores: DataFrame, declaration: dict | None = None) -> DataFrame:
    """Scored designs with the parameters their numbers stand for."""
    return scores.withColumns(decode_design(F.col("idx"), declaration))


def design_join(
    scores: DataFrame, declaration: dict | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Every design of every dataset with its score, 0 where it was not sampled.

    Scores of numbers outside the space are kept, with ``known`` false.
    """
    keys = keys or ["video"]
    size = space_size(declaration)
    every = (
        scores.select(*keys)
        .distinct()
        .withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    )
    values = ["recall", "prec", "f1"]
    filled = {n: F.coalesce(n, F.lit(0.0)) for n in values}
    joined = every.join(scores.select(*keys, "idx", *values), [*keys, "idx"], "full")
    known = (F.col("idx") >= 0) & (F.col("idx") < size)
    sampled = F.col("f1").isNotNull()
    return joined.withColumns({"sampled": sampled, "known": known}).withColumns(filled)


def sampling_budget(
    space: DataFrame, share: float = 0.3, seed: int = 0, keys: list[str] | None = None
) -> DataFrame:
    """floor(n * share) designs per key, in the order of a seeded hash."""
    keys = keys or []
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string")))
    hashed = space.withColumn("h", digest)
    numbered = row_numbers(hashed, keys, ["h", "idx"], F.substring("h", 1, 3))
    if keys:
        counted = numbered.join(space.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    else:
        counted = numbered.withColumn("n", F.lit(space.count()))
    return counted.filter(F.col("rn") <= F.floor(F.col("n") * share)).drop("rn", "n", "h")


def pending_designs(scores: DataFrame, requested: list[int] | DataFrame) -> list[int] | DataFrame:
    """Requested design numbers without a stored score.

    A table of numbers (idx) gives such a table, a list gives a list in request order.
    """
    if isinstance(requested, DataFrame):
        return requested.select("idx").distinct().join(scores.select("idx"), "idx", "left_anti")
    wanted = list(dict.fromkeys(int(i) for i in requested))
    if not wanted:
        return []
    table = scores.sparkSession.createDataFrame([(i,) for i in wanted], "idx long")
    open_ = {row["idx"] for row in pending_designs(scores, table).collect()}
    return [i for i in wanted if i in open_]


def design_table(spark: SparkSession, designs: list[dict] | DataFrame) -> DataFrame:
    """idx, threshold, max_width, max_height; a null size is no limit, 0 is one."""
    types = {"idx": "long", "threshold": "double", "max_width": "long", "max_height": "long"}
    if not isinstance(designs, DataFrame):
        rows = [
            (int(d["idx"]), float(d.get("threshold") or 0.0), d.get("max_width"), d.get("max_height"))
            for d in designs
        ]
        designs = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in types.items()))
    columns = [
        (F.col(n) if n in designs.columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()
    ]
    return designs.select(*columns).fillna({"threshold": 0.0})


def _with_each(rows: DataFrame, table: DataFrame, salt: list[str]) -> DataFrame:
    """Every row with every row of a small table, joined on blocks of that table.

    Both the blocks and a salt of ``rows`` are join keys, so that few blocks do not
    mean few tasks.
    """
    names = table.columns
    blocks = -(-table.count() // SETTINGS_BLOCK) or 1
    block = F.pmod(F.xxhash64(*names), F.lit(blocks)).cast("int")
    packed = (
        table.groupBy(block.alias("__block"))
        .agg(F.collect_list(F.struct(*names)).alias("__each"))
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SETTINGS_SALT - 1))))
    )
    dealt = rows.withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ).withColumn("__salt", F.pmod(F.xxhash64(*salt), F.lit(SETTINGS_SALT)).cast("int"))
    return (
        dealt.join(packed, ["__block", "__salt"])
        .withColumn("__one", F.explode("__each"))
        .select(*rows.columns, "__one.*")
    )


def threshold_sweep(
    calc: DataFrame, gt: DataFrame, designs: list[dict] | DataFrame
) -> DataFrame:
    """Scores per (video, idx) for designs with threshold, max_width, max_height.

    ``designs`` may be a table of any length. The overlap join happens once for all;
    designs of the same setting are matched once, and all settings go through one
    walk keyed by (video, frame, setting).
    """
    table = cut(design_table(calc.sparkSession, designs))
    limits = ["threshold", "max_width", "max_height"]
    settings = cut(
        table.select(*limits).distinct().withColumn("setting", F.monotonically_increasing_id())
    )
    counts = cut(E.box_counts(calc, gt))
    slim = [*M.FRAME_KEYS, "ord", *G.BOX_COLUMNS]
    size = lambda side, a, b: F.col(f"{side}_{b}") - F.col(f"{side}_{a}")
    pairs = M.overlap_join(calc.select(*slim), gt.select(*slim)).select(
        *M.FRAME_KEYS, "iou", "a_ord", "b_ord",
        F.col("a_ord").cast("long").alias("a_mark"), F.col("b_ord").cast("long").alias("b_mark"),
        *[
            value.alias(f"{side}_{name}")
            for side in ("a", "b")
            for name, value in (("w", size(side, "x1", "x2")), ("h", size(side, "y1", "y2")))
        ],
    )
    tried = _with_each(pairs, settings, [*M.FRAME_KEYS, "a_ord"]).filter(
        F.col("iou") >= F.col("threshold")
    )

    def fits(side: str) -> Column:
        free = lambda limit, value: F.col(limit).isNull() | (F.col(value) <= F.col(limit))
        return free("max_width", f"{side}_w") & free("max_height", f"{side}_h")

    ends = E.both_ends(tried.withColumns({"first": fits("b"), "second": fits("a")}), ["setting"])
    last = E.common_frames(counts)
    hits = (
        E.up_to_last(E.walk_both(ends, ["setting"]), last)
        .groupBy("video", "setting")
        .agg(
            F.count(F.when(F.col("side") == 1, 1)).alias("tp"),
            F.count(F.when(F.col("side") == 2, 1)).alias("found"),
        )
    )
    same = [table[n].eqNullSafe(settings[n]) for n in limits]
    numbered = table.join(settings, same).select("idx", "setting")
    boxes = _with_each(
        E.up_to_last(counts, last)
        .groupBy("video")
        .agg(F.sum("nc").alias("nc"), F.sum("ng").alias("ng")),
        numbered,
        ["video"],
    )
    tp = F.coalesce("tp", F.lit(0))
    sums = boxes.join(hits, ["video", "setting"], "left").select(
        "video",
        "idx",
        tp.alias("true_positive"),
        (F.col("ng") - F.coalesce("found", F.lit(0))).alias("false_negative"),
        (F.col("nc") - tp).alias("false_positive"),
    )
    return E.detection_scores(sums, ["video", "idx"])


def sweep(
    designs: list[dict],
    detect: Callable[[dict], DataFrame],
    gt: DataFrame,
    stored: DataFrame | None = None,
    **score_options,
) -> DataFrame | None:
    """Score a user's detector under each design that has no stored score yet.

    ``detect`` takes a design (with idx) and gives boxes. Gives the new rows, or
    None when nothing is pending; the caller appends them to the score table.
    """
    todo = designs
    if stored is not None:
        wanted = set(pending_designs(stored, [d["idx"] for d in designs]))
        todo = [d for d in designs if d["idx"] in wanted]
    if not todo:
        return None
    results = [
        E.detection_scores(E.frame_counts(detect(d), gt, **score_options), ["video"]).withColumn(
            "idx", F.lit(int(d["idx"])).cast("long")
        )
        for d in todo
    ]
    return reduce(DataFrame.unionByName, results)
