"""Ordered running values over keys of any size.

A plain ``Window.partitionBy(video)`` puts a whole video into one task. Here the
order is cut into chunks: the window runs inside (key, chunk), one summary row
per chunk carries the value on, and both are combined. Only the summaries of a
key meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
FRAME_CHUNK = 1024


def by_frames(column: str = "frame", size: int = FRAME_CHUNK) -> Column:
    return F.floor(F.col(column) / F.lit(size))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    specs: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add one running column per spec, from the start of the key to each row.

    ``specs`` maps a new name to (kind, value) with kind one of max, min, sum,
    last. ``last`` skips nulls. ``inclusive=False`` leaves the row itself out.
    ``chunk`` must never decrease along ``order``; ``order`` must be unique
    within a key.
    """
    tagged = df.withColumn(CHUNK, chunk)
    for name, (_, value) in specs.items():
        tagged = tagged.withColumn(f"__v_{name}", value)

    order_columns = [F.col(name) for name in order]
    position = F.struct(*order_columns)
    partial, carried, local, final = [], {}, {}, {}
    inside = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order_columns)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    before = (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    for name, (kind, _) in specs.items():
        value, part = F.col(f"__v_{name}"), f"__p_{name}"
        carry = F.col(f"__c_{name}")
        if kind == "last":
            partial.append(
                F.max_by(value, F.when(value.isNotNull(), position)).alias(part)
            )
            carried[f"__c_{name}"] = F.last(F.col(part), ignorenulls=True).over(before)
            local[f"__l_{name}"] = F.last(value, ignorenulls=True).over(inside)
            final[name] = F.coalesce(F.col(f"__l_{name}"), carry)
            continue
        agg = {"max": F.max, "min": F.min, "sum": F.sum}[kind]
        partial.append(agg(value).alias(part))
        carried[f"__c_{name}"] = agg(F.col(part)).over(before)
        local[f"__l_{name}"] = agg(value).over(inside)
        here = F.col(f"__l_{name}")
        if kind == "max":
            final[name] = F.greatest(here, carry)
        elif kind == "min":
            final[name] = F.least(here, carry)
        else:
            zero = F.lit(0)
            final[name] = F.coalesce(here, zero) + F.coalesce(carry, zero)

    summaries = (
        tagged.groupBy(*keys, CHUNK)
        .agg(*partial)
        .withColumns(carried)
        .select(*keys, CHUNK, *carried)
    )
    kept = df.columns
    joined = tagged.withColumns(local).join(summaries, [*keys, CHUNK])
    return joined.select(
        *[F.col(name) for name in kept if name not in final],
        *[value.alias(name) for name, value in final.items()],
    )


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "rn"
) -> DataFrame:
    """1-based position along ``order`` within ``keys``."""
    return running(df, keys, order, chunk, {name: ("sum", F.lit(1).cast("long"))})


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fields: list[str],
    chunk: Column,
    name: str = "prev",
) -> DataFrame:
    """Struct ``name`` with the fields of the preceding row; null on the first."""
    return running(
        df, keys, order, chunk, {name: ("last", F.struct(*fields))}, inclusive=False
    )
