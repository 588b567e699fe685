"""Stateful folds over a stream: one state a key, rows of a batch in their order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def smooth(stream: DataFrame, key: str, order: list[str], value: str, weight: float) -> DataFrame:
    """Exponential smoothing of each key's values; a missing value holds the level.

    Emits one row a key and batch: key, level, n (rows so far). The state is the level, the count and
    the order of the last row; a row that comes after later ones were folded is applied last, as
    nothing can be unfolded. Null keys form a key of their own.
    """
    kind = stream.schema[key].dataType.simpleString()

    def fold(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(chunks)).sort_values(order, kind="stable")
        for v in rows[value].tolist():
            n += 1
            if v is not None and v == v:
                level = v if level is None else level + (v - level) * weight
        state.update((level, n))
        yield pd.DataFrame({key: [k[0]], "level": pd.array([level], dtype="Float64"), "n": [n]})

    grouped = stream.select(key, *order, F.col(value).cast("double").alias(value)).groupBy(key)
    return grouped.applyInPandasWithState(fold, f"{key} {kind}, level double, n bigint", "level double, n bigint", "append", GroupStateTimeout.NoTimeout)
