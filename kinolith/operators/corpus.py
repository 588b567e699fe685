"""Building a corpus: reject reasons, two-key dedup, budgets, order statistics, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinolith.functions.text import body_key, clean


def reject_cascade(df: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """Add ``reason``: the name of the first rule that holds; null where none does.

    A rule that is null counts as not holding. Empty tables stay empty.
    """
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        reason = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def reason_histogram(df: DataFrame, column: str = "reason", k: int = 15) -> DataFrame:
    """The k most common values with their counts; ties go by the value, null last."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k)


def dedup_two_keys(df: DataFrame, order: str, name: str, caption: str, body: str, least: int = 15) -> DataFrame:
    """First of each name in scan order; then captions under ``least`` go; then the first of each body.

    A record with a short caption still uses up its name, but not its body. Null names are equal to
    each other, as are null bodies. Each first is found by a min-by aggregate, which combines before
    the shuffle, so a name or body that a third of the rows share is no hot group.
    """
    record = F.struct(*df.columns)
    named = df.groupBy(F.col(name).alias("_k")).agg(F.min_by(record, F.struct(order)).alias("_r")).select("_r.*")
    long = named.where(F.length(clean(F.col(caption))) >= least)
    record = F.struct(*long.columns)
    return long.groupBy(body_key(F.col(body)).alias("_k")).agg(F.min_by(record, F.struct(order)).alias("_r")).select("_r.*")


def order_statistics(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group: count, sum, max and for each share q the element at floor(q n) of the sorted values.

    Null values don't count. The values of a group are counted before they are ranked, so a group
    with many rows ranks its distinct values only, and never meets in one list.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumn("_hi", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(whole))
    at = lambda q: F.min(F.when(F.col("_hi") > F.floor(F.col("_all") * q), F.col(value)))
    return ranked.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.sum(F.col(value) * F.col("_n")).alias("total"),
        F.max(value).alias("largest"),
        *[at(q).alias(name) for name, q in shares.items()],
    )


def budget_prefix(df: DataFrame, key: list[str], order: list[str], cost: Column, budget: float) -> DataFrame:
    """Rows of each group, in order, whose running cost stays within the budget."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running_cost", F.sum(cost).over(w)).where(F.col("running_cost") <= budget)


def largest_or_smallest(df: DataFrame, key: str, size: str, order: str, low: float, high: float) -> DataFrame:
    """Per group the largest item with low < size <= high, or else the smallest item; ties by ``order``."""
    fits = (F.col(size) > low) & (F.col(size) <= high)
    best = F.max(F.when(fits, F.struct(F.col(size).alias("s"), (-F.col(order)).alias("o"))))
    least = F.min(F.struct(F.col(size).alias("s"), F.col(order).alias("o")))
    found = df.where(F.col(size).isNotNull()).groupBy(key).agg(best.alias("b"), least.alias("l"))
    return found.select(key, F.coalesce(-F.col("b.o"), F.col("l.o")).alias("picked"), F.coalesce(F.col("b.s"), F.col("l.s")).alias("picked_size"))


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered; the engine keeps k rows a group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def even_subsample(df: DataFrame, order: str, k: int) -> DataFrame:
    """At most k rows at the truncated positions of an even grid over the order; all rows if k suffice.

    Positions come from the ranges of a distributed sort, not from one task's window.
    """
    placed = with_position(df, order)
    n = df.agg(F.count("*").alias("_n"))
    step = F.floor(F.col("_i") * (F.col("_n") - 1) / (k - 1))
    grid = df.sparkSession.range(k).select(F.col("id").alias("_i")).join(F.broadcast(n)).select(
        F.when(F.col("_n") <= k, F.when(F.col("_i") < F.col("_n"), F.col("_i"))).otherwise(step).alias("position")
    ).where("position IS NOT NULL").distinct()
    return placed.join(F.broadcast(grid), "position")


def with_position(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """Add ``position`` (from 0) in the order of a unique column, without one task for all rows.

    Rows are counted in ranges of the column; a row's position is its rank in its range plus the
    rows of the ranges before (a table of ``parts`` rows).
    """
    low, high = F.min(order).alias("_lo"), F.max(order).alias("_hi")
    ends = df.agg(low, high)
    width = F.greatest((F.col("_hi") - F.col("_lo") + 1) / parts, F.lit(1e-9))
    dealt = df.join(F.broadcast(ends)).withColumn("_part", F.least(F.floor((F.col(order) - F.col("_lo")) / width), F.lit(parts - 1)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over ``parts`` rows
    offsets = sizes.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    placed = dealt.withColumn("_r", inside).join(F.broadcast(offsets), "_part")
    return placed.withColumn("position", F.col("_r") + F.col("_offset")).drop("_part", "_r", "_offset", "_lo", "_hi")


def conditional_rates(df: DataFrame, over_all: list[str], over_known: list[str]) -> DataFrame:
    """Rates of flags: over all rows, or over the rows that carry the flag (null: not stated)."""
    n = F.count("*")
    share = lambda hits, base: F.round(F.try_divide(hits, base), 6)
    cells = [n.alias("n")]
    cells += [share(F.count_if(F.col(c)), n).alias(f"{c}_rate") for c in over_all]
    for c in over_known:
        cells += [share(F.count_if(F.col(c)), F.count(c)).alias(f"{c}_rate"), F.count(c).alias(f"{c}_known")]
    return df.agg(*cells)


def pearson(x: str, y: str) -> Column:
    """Pearson's r of two columns as an aggregate; null where one of them doesn't vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.round(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), 6)
