"""User stages: any function from DataFrame to DataFrame, chained by transform."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

Stage = Callable[..., DataFrame]


def chain(df: DataFrame, *stages: Stage | tuple[Stage, dict]) -> DataFrame:
    """Apply stages in order; a stage with options is a (function, options) pair."""

    def apply(rows: DataFrame, stage) -> DataFrame:
        function, options = stage if isinstance(stage, tuple) else (stage, {})
        return rows.transform(function, **options)

    return reduce(apply, stages, df)
