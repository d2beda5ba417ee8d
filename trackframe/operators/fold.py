"""Ordered state over the frames of a key, one frame in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from trackframe.session import spread

FLUSH_ROWS = 10_000


def frames_of(batches: Iterator, keys: list[str]) -> Iterator:
    """Cut sorted batches into (key, frame, columns) pieces, across batch borders.

    The columns of a piece are arrays by name.
    """
    import numpy as np
    import pandas as pd

    def piece(columns, begin, end):
        part = {name: values[begin:end] for name, values in columns.items()}
        return tuple(part[k][0] for k in keys), int(part["frame"][0]), part

    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if batch.empty:
            held = None
            continue
        columns = {name: batch[name].to_numpy() for name in batch.columns}
        change = np.zeros(len(batch) - 1, dtype=bool)
        for name in [*keys, "frame"]:
            change |= columns[name][1:] != columns[name][:-1]
        starts = np.r_[0, np.flatnonzero(change) + 1]
        for begin, end in zip(starts[:-1], starts[1:]):
            yield piece(columns, begin, end)
        held = batch.iloc[starts[-1] :].reset_index(drop=True)
    if held is not None:
        columns = {name: held[name].to_numpy() for name in held.columns}
        yield piece(columns, 0, len(held))


def fold_frames(
    df: DataFrame,
    keys: list[str],
    start: Callable,
    step: Callable,
    schema: str,
    order: str = "ord",
    finish: Callable | None = None,
) -> DataFrame:
    """Run ``step(state, key, frame, columns) -> list of tuples`` over frames in order.

    ``start(key)`` makes the state of a key and ``finish(state, key)`` may add
    rows after its last frame. Keys are spread by hash and sorted inside their
    partition, so a task streams through its keys and holds one frame and one
    state.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        import pandas as pd

        current, state, out = None, None, []
        for key, frame, columns in frames_of(batches, keys):
            if key != current:
                if finish is not None and current is not None:
                    out.extend(finish(state, current))
                current, state = key, start(key)
            out.extend(step(state, key, frame, columns))
            if len(out) >= FLUSH_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        if finish is not None and current is not None:
            out.extend(finish(state, current))
        if out:
            yield pd.DataFrame(out, columns=names)

    placed = spread(df, *keys).sortWithinPartitions(*keys, "frame", order)
    return placed.mapInPandas(run, schema)
