"""Dominance in any number of objectives: fronts of blocks, merged in a tree.

Rows are dealt at random into blocks of bounded size, and each block keeps its own
front. What is left is dealt anew until blocks hardly shrink; the rest, which is a front
or near it, meets block by block. No task holds more than two blocks of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.session import cut

# Rows of a block, rows compared at a time, and the share that a round must remove.
BLOCK, STEP, SHRINK = 8192, 256, 0.25
ID = "__row"


def beaten_by(points, rivals, strict: bool):
    """Which rows of ``points`` a row of ``rivals`` beats; numpy arrays (rows, objectives)."""
    import numpy as np

    out = np.zeros(len(points), bool)
    for at in range(0, len(points), STEP):
        some = points[at : at + STEP]
        shape = (len(some), len(rivals))
        every, any_ = np.ones(shape, bool), np.zeros(shape, bool)
        for mine, theirs in zip(some.T, rivals.T, strict=True):
            if strict:
                every &= theirs > mine[:, None]
            else:
                every &= theirs >= mine[:, None]
                any_ |= theirs > mine[:, None]
        out[at : at + STEP] = (every if strict else every & any_).any(axis=1)
    return out


def front_of(points):
    """Which rows no other row beats.

    By falling sum, ties by falling values, a row comes after all that beat it; so each
    step of rows meets the front found so far and itself only. Without finite sums the
    falling values alone do.
    """
    import numpy as np

    total = points.sum(axis=1) if np.isfinite(points).all() else np.zeros(len(points))
    order = np.lexsort([*points.T[::-1], total])[::-1]
    front, kept = points[:0], []
    for at in range(0, len(order), STEP):
        step = order[at : at + STEP]
        step = step[~beaten_by(points[step], front, False)]
        step = step[~beaten_by(points[step], points[step], False)]
        front = np.vstack([front, points[step]])
        kept.append(step)
    mask = np.zeros(len(points), bool)
    mask[np.concatenate(kept) if kept else []] = True
    return mask


def _values(table, objectives: list[str]):
    import numpy as np

    return np.stack([table.column(o).to_numpy().astype(float) for o in objectives], axis=1)


def _dealt(df: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """Add ``blocks`` of the key and ``block`` of the row."""
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return df.join(sizes, keys).withColumn("block", F.pmod(by, F.col("blocks")).cast("int"))


def local_fronts(
    df: DataFrame, keys: list[str], objectives: list[str]
) -> tuple[DataFrame, bool]:
    """Rows that no row of their own blocks beats, after rounds of random blocks.

    Every row that is dropped is beaten by one that stays. The second value tells
    whether each key was one block in the end, which makes its rows the front itself.
    """
    import pyarrow as pa

    left, before, number = cut(df), None, 0
    while True:
        dealt = _dealt(left, keys, F.xxhash64(*objectives, F.lit(number)))
        left = cut(
            dealt.groupBy(*keys, "block").applyInArrow(
                lambda t: t.filter(pa.array(front_of(_values(t, objectives)))), dealt.schema
            )
        )
        rows, most = left.agg(F.count("*"), F.max("blocks")).first()
        left, number = left.drop("block", "blocks"), number + 1
        if (most or 0) <= 1:
            return left, True
        if before is not None and rows > before * (1 - SHRINK):
            return left, False
        before = rows


def _beaten(
    points: DataFrame, rivals: DataFrame, keys: list[str], objectives: list[str], strict: bool
) -> DataFrame:
    """Ids of points that a rival of any block beats."""
    asked = _dealt(points.select(*keys, ID, *objectives), keys, F.xxhash64(ID))
    held = _dealt(rivals.select(*keys, *objectives), keys, F.xxhash64(*objectives))
    many = lambda df, name: df.select(*keys, F.col("blocks").alias(name)).distinct()
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        asked.join(many(held, "n"), keys).withColumn("other", upto("n")).drop("n", "blocks")
    )
    renamed = {c: f"r_{c}" for c in [*keys, *objectives]}
    right = (
        held.join(many(asked, "n"), keys).withColumn("other", upto("n")).drop("n", "blocks")
        .withColumnsRenamed(renamed | {"block": "r_block", "other": "r_other"})
    )

    def worse(mine, theirs):
        import pyarrow as pa

        rivals = _values(theirs, [f"r_{o}" for o in objectives])
        mask = beaten_by(_values(mine, objectives), rivals, strict)
        return mine.select([ID]).filter(pa.array(mask))

    return (
        left.groupBy(*keys, "block", "other")
        .cogroup(right.groupBy(*[f"r_{k}" for k in keys], "r_other", "r_block"))
        .applyInArrow(worse, left.select(ID).schema)
        .distinct()
    )


def not_dominated(
    points: DataFrame, dominators: DataFrame, keys: list[str], objectives: list[str], strict: bool
) -> DataFrame:
    """Points that no dominator beats, for any number of objectives.

    A row with a null objective or key neither beats nor is beaten; NaN counts as
    infinity. Only the front of the dominators matters, as beating carries over.
    """
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*keys, *objectives]])
    sky = [f"__o{i}" for i in range(len(objectives))]
    values = {}
    for name, o in zip(sky, objectives):
        value = F.col(o).cast("double")
        values[name] = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(value)
    rivals, exact = local_fronts(
        dominators.filter(whole).withColumns(values).select(*keys, *sky).distinct(), keys, sky
    )
    # ids are read twice, so they are written once
    named = cut(points.withColumns(values).withColumn(ID, F.monotonically_increasing_id()))
    left = named.filter(whole)
    inside = points is dominators and not strict
    if inside:
        # what a round of blocks has dropped is beaten already
        left = left.join(rivals, [*keys, *sky], "left_semi")
    if not (inside and exact):
        left = left.join(_beaten(left, rivals, keys, sky, strict), ID, "left_anti")
    return left.select(*points.columns).unionByName(named.filter(~whole).select(*points.columns))
