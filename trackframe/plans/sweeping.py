"""Sweep designs against stored scores, then report the front and its growth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.operators import pareto as P
from trackframe.operators import sweep as SW
from trackframe.sources import layout, sinks


def sweep_and_store(
    spark: SparkSession,
    path: str,
    designs: list[dict],
    detect: Callable[[dict], DataFrame],
    gt: DataFrame,
    key: dict,
    stored: bool = True,
    **score_options,
) -> int:
    """Score the designs that have no stored score under ``key``; gives their number.

    ``key`` holds the seven address parts of a score table. ``stored=False``
    starts a new table.
    """
    known = layout.score_lookup(sinks.read_scores(spark, path), **key) if stored else None
    todo = designs
    if known is not None:
        pending = set(SW.pending_designs(known, [d["idx"] for d in designs]))
        todo = [d for d in designs if d["idx"] in pending]
    rows = SW.sweep(todo, detect, gt, **score_options)
    if rows is None:
        return 0
    last = None if known is None else known.agg(F.max("sample_ord")).first()[0]
    first = 0 if last is None else last + 1
    position = {d["idx"]: first + i for i, d in enumerate(todo)}
    order = F.create_map(*[F.lit(v).cast("long") for pair in position.items() for v in pair])
    keyed = rows.withColumns({name: F.lit(value) for name, value in key.items()})
    sinks.append_scores(
        keyed.withColumn("sample_ord", order[F.col("idx")]).select(
            *layout.SCORE_KEYS, "video", "idx", "recall", "precision", "f1", "sample_ord"
        ),
        path,
    )
    return len(todo)


def report(scores: DataFrame) -> dict[str, DataFrame]:
    """Front, area and progress tables of a score table with video and prec."""
    floored = P.zero_floor(scores)
    front = P.pareto_front(floored)
    return {
        "front": front,
        "area": P.average_precision(front),
        "history": P.front_history(floored),
        "progress": P.samples_since_front(floored),
        "running_best": P.running_best(floored),
    }
