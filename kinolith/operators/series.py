"""Operators on ordered rows: differences, sessions, replay, holds, windows, interval lookups.

Windows are partitioned by the series' key; the engine sorts and spills, it doesn't collect. Folds
that feed back into themselves work on the ordered array of one series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def so_far(keys: list[str], order: list[str]):
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def lag_change(value: str, keys: list[str], order: list[str]) -> Column:
    """Absolute difference to the previous row of the series; null on its first."""
    return F.abs(F.col(value) - F.lag(value).over(ordered(keys, order)))


def sessions(df: DataFrame, value: str, keys: list[str], order: list[str], threshold: float, least: int) -> DataFrame:
    """Half-open runs of rows without a change above the threshold, of ``least`` rows or more.

    Columns: the keys, segment, first_pos, end_pos (positions from 0, end exclusive), n.
    """
    w = ordered(keys, order)
    cut = F.coalesce((lag_change(value, keys, order) > threshold).cast("int"), F.lit(0))
    marked = df.withColumn("_cut", cut).withColumn("_pos", F.row_number().over(w) - 1)
    marked = marked.withColumn("segment", F.sum("_cut").over(so_far(keys, order)))
    found = marked.groupBy(*keys, "segment").agg(F.min("_pos").alias("first_pos"), (F.max("_pos") + 1).alias("end_pos"), F.count("*").alias("n"))
    return found.where(F.col("n") >= least)


def hold_and_backfill(value: Column, keys: list[str], order: list[str]) -> Column:
    """The last known value; before the first known one, that one."""
    later = ordered(keys, order).rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(F.last(value, True).over(so_far(keys, order)), F.first(value, True).over(later))


def fold(df: DataFrame, keys: list[str], order: list[str], value: str, step, start: Column) -> DataFrame:
    """Keys and the final state of a fold ``step(state, value)`` over each series in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(
        *keys, F.aggregate("_rows", start, lambda s, r: step(s, r["_v"])).alias("state"), F.size("_rows").alias("n")
    )


def latest_start(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, name: str, bucket: int) -> DataFrame:
    """For each point the interval of its key with start <= at < end that starts last; ties to the larger name.

    Intervals are listed in the buckets of ``bucket`` units that they touch, so the join is on equal
    keys and buckets; points without an interval keep a null name.
    """
    places = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor((F.col(end) - 1) / bucket))))
    dealt = points.withColumn("_b", F.floor(F.col(at) / bucket))
    hit = (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    joined = dealt.join(places, [key, "_b"], "left").withColumn("_hit", F.when(hit, F.struct(F.col(start).alias("s"), F.col(name).alias("n"))))
    return joined.groupBy(*points.columns).agg(F.max("_hit").alias("_best")).select(*points.columns, F.col("_best.n").alias(name))


def first_then_fill(df: DataFrame, keys: list[str], each: str, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of each group: the first of every ``each``, then the earliest others, in order."""
    first = F.row_number().over(ordered([*keys, each], order))
    ranked = df.withColumn("_again", (first > 1).cast("int"))
    kept = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_again", *order))).where(F.col("_rank") <= cap)
    return kept.drop("_again", "_rank")


def windows_of(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Complete windows of ``width`` values with the change to the value that follows."""
    w = ordered(keys, order)
    held = F.collect_list(value).over(w.rowsBetween(Window.currentRow, width - 1))
    target = F.lead(value, width).over(w) - F.lead(value, width - 1).over(w)
    return df.withColumn("window", held).withColumn("target", target).where(F.col("target").isNotNull() & (F.size("window") == width))
