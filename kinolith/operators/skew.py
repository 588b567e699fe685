"""Joins that stay balanced when single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: At most so many keys are treated as hot; every key above 1/HOT_KEYS of the rows is among them.
HOT_KEYS = 200
#: Keys below this many rows are left to the ordinary shuffle.
HOT_ROWS = 20_000


def hot_keys(df: DataFrame, key: str, limit: int = HOT_KEYS, least: int = HOT_ROWS) -> list:
    """The keys with ``least`` rows or more, ``limit`` of them at most (a bounded driver-side list)."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    top = counts.where(F.col("count") >= least).orderBy(F.desc("count"), key).limit(limit)
    return [r[0] for r in top.collect()]


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per ``key``).

    Hot keys of ``rows`` meet their ``HOT_KEYS`` lookup rows at most by a broadcast of that many
    rows, so no task receives a hot group; all other rows take the shuffled join.
    """
    hot = hot_keys(rows, key, least=least)
    if not hot:
        return rows.join(lookup, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(lookup.where(F.col(key).isin(hot)))
    return rows.where(is_hot).join(few, key, "left").unionByName(rows.where(~is_hot).join(lookup, key, "left"))
