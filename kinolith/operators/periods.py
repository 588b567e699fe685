"""Continuous periods of overlapping integer intervals and the gaps between them.

Intervals are decomposed into canonical dyadic blocks. Blocks are grouped by entity and by their
ancestor at the top level of their tier (levels 0..K, K+1..2K, ...), so that a group holds at
most 2^(K+1) distinct blocks however many rows an entity has. Within a group, blocks covered by
an ancestor go, sibling pairs merge upward and adjacent blocks coalesce into runs. Only the first
and last run of a group meet other groups of the entity: two windows over one summary row a group
join them, the runs between are final.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from kinolith.functions.clean import strip_invisible
from kinolith.sources.tables import table

#: Levels of a tier: groups span 2^TIER_LEVELS units (about 410 s in tenths).
TIER_LEVELS = 12
#: Interval ends beyond this leave the range in which levels are told apart by doubles.
LIMIT = 1 << 50
#: Ends from here on don't fit 32 bits in tenths of a second.
MOST_SECONDS = 214_748_364.0


def dyadic_blocks(start: Column, end: Column) -> Column:
    """Canonical blocks of [start, end): an array of (level, index), 2 log2(length) at most.

    Shifts round down, so the left bound is shifted as its negative.

    At level l the interval has shrunk to [ceil(start/2^l), floor(end/2^l)); an odd left bound
    and an odd right bound each emit a block there.
    """

    def at(level: Column) -> Column:
        left, right = -F.call_function("shiftright", -start, level), F.call_function("shiftright", end, level)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        block = lambda index: F.struct(level.alias("level"), index.cast("bigint").alias("idx"))
        empty = F.array().cast("array<struct<level:int,idx:bigint>>")
        return F.when(
            left < right,
            F.concat(
                F.when(odd(left), F.array(block(left))).otherwise(empty),
                F.when(odd(right), F.array(block(right - 1))).otherwise(empty),
            ),
        ).otherwise(empty)

    top = F.floor(F.log2((end - start).cast("double"))).cast("int") + 1
    return F.flatten(F.transform(F.sequence(F.lit(0), top), at))


def _levels_to_runs(owner: np.ndarray, level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (owner, start, end) of the blocks of many groups at once.

    ``level`` counts from the tier's base, ``index`` from the group's start, so a block is below
    2^(TIER_LEVELS + 1) and (owner, index) fits one 64-bit code.
    """
    width = 1 << (TIER_LEVELS + 1)
    held = [np.unique(owner[level == k] * width + index[level == k]) for k in range(TIER_LEVELS + 1)]
    # top down: drop blocks that an ancestor covers
    cover = held[TIER_LEVELS]
    for k in range(TIER_LEVELS - 1, -1, -1):
        parent = held[k] // width * width + (held[k] % width >> 1)
        held[k] = held[k][~np.isin(parent, cover)]
        halves = cover // width * width + (cover % width << 1)
        cover = np.unique(np.concatenate([halves, halves + 1, held[k]]))
    # bottom up: a pair of siblings becomes its parent
    for k in range(TIER_LEVELS):
        codes = held[k]
        even = codes[(codes & 1) == 0]
        pairs = even[np.isin(even + 1, codes)]
        if pairs.size:
            held[k] = codes[~np.isin(codes & ~np.int64(1), pairs)]
            held[k + 1] = np.unique(np.concatenate([held[k + 1], pairs // width * width + (pairs % width >> 1)]))
    # disjoint maximal blocks in order; adjacent ones coalesce
    who = np.concatenate([c // width for c in held])
    start = np.concatenate([(c % width) << k for k, c in enumerate(held)])
    end = np.concatenate([((c % width) + 1) << k for k, c in enumerate(held)])
    order = np.lexsort((start, who))
    who, start, end = who[order], start[order], end[order]
    first = np.ones(len(who), bool)
    first[1:] = (who[1:] != who[:-1]) | (start[1:] > end[:-1])
    last = np.append(first[1:], True)
    return who[first], start[first], end[last]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("blocks")
        sizes = np.diff(blocks.offsets.to_numpy())
        code = blocks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), sizes)
        group = batch.column("grp").to_numpy(zero_copy_only=False).astype(np.int64)
        who, start, end = _levels_to_runs(owner, code >> (TIER_LEVELS + 1), code & ((1 << (TIER_LEVELS + 1)) - 1))
        base = batch.column("tier").to_numpy(zero_copy_only=False).astype(np.int64)[who] * TIER_LEVELS
        origin = group[who] << TIER_LEVELS
        offsets = np.searchsorted(who, np.arange(batch.num_rows + 1)).astype(np.int32)
        runs = pa.StructArray.from_arrays(
            [pa.array((origin + start) << base), pa.array((origin + end) << base)], names=["f", "t"]
        )
        keep = [i for i, name in enumerate(batch.schema.names) if name != "blocks"]
        columns = [batch.column(i) for i in keep] + [pa.ListArray.from_arrays(pa.array(offsets), runs)]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in keep] + ["runs"])


def periods_and_gaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Periods and gaps of the integer intervals [start, end) per entity.

    Result: kind (period or gap), the keys, from_at, to_at. Intervals that touch form one period.
    Null bounds, bounds beyond 2^50 and empty or reversed intervals do not count; repeated rows
    count once. Null keys form an entity of their own. Other columns are ignored.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = intervals.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        F.col(start).cast("bigint").alias("_s"),
        F.col(end).cast("bigint").alias("_e"),
    )
    rows = rows.where(f"_s < _e and _s > {-LIMIT} and _e < {LIMIT}").distinct()
    blocks = rows.select(*names, F.explode(dyadic_blocks(F.col("_s"), F.col("_e"))).alias("b"))
    tier = F.when(F.col("b.level") == 0, 0).otherwise(F.floor((F.col("b.level") - 1) / TIER_LEVELS)).cast("int")
    blocks = blocks.withColumn("tier", tier)
    above = (F.col("tier") + 1) * TIER_LEVELS - F.col("b.level")
    blocks = blocks.withColumn("grp", F.call_function("shiftright", F.col("b.idx"), above))
    # one int a block: its level in the tier and its index in the group, which is below 2^(TIER_LEVELS + 1)
    inside = F.col("b.idx") - F.call_function("shiftleft", F.col("grp"), above)
    code = (F.col("b.level") - F.col("tier") * TIER_LEVELS) * (1 << (TIER_LEVELS + 1)) + inside
    grouped = blocks.groupBy(*names, "tier", "grp").agg(F.collect_set(code.cast("int")).alias("blocks"))

    kinds = {f.name: f.dataType.simpleString() for f in grouped.schema.fields}
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*names, "tier", "grp"]) + ", runs array<struct<f:bigint,t:bigint>>"
    runs = grouped.mapInArrow(_runs, schema)

    # one summary row a group of tier 0; of higher tiers, whose runs span whole groups, one a run
    low = runs.where("tier = 0").select(*names, "runs")
    high = runs.where("tier > 0").select(*names, F.explode("runs").alias("r")).select(*names, F.array("r").alias("runs"))
    parts = low.unionByName(high)
    parts = parts.withColumn("lo", F.col("runs")[0]["f"]).withColumn("hi", F.element_at("runs", -1)["t"])
    entity = Window.partitionBy(*names).orderBy("lo", F.desc("hi"))
    before = F.max("hi").over(entity.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("prev", before).where("prev is null or prev < hi")

    out = lambda kind, f, t: F.struct(F.lit(kind).alias("kind"), f.alias("f"), t.alias("t"))
    n = F.size("runs")
    inner = F.when(n > 2, F.transform(F.slice("runs", 2, F.greatest(n - 2, F.lit(1))), lambda r: out("period", r["f"], r["t"])))
    inner_gaps = F.when(
        n > 1,
        F.transform(
            F.sequence(F.lit(0), n - 2), lambda i: out("gap", F.get("runs", i)["t"], F.get("runs", i + 1)["f"])
        ),
    )
    outer_gap = F.when(F.col("prev") < F.col("lo"), F.array(out("gap", F.col("prev"), F.col("lo"))))
    done = parts.select(*names, F.explode(F.flatten(F.array_compact(F.array(inner, inner_gaps, outer_gap)))).alias("o"))
    done = done.select("o.kind", *names, "o.f", "o.t")

    edge = F.when(n == 1, F.col("runs")).otherwise(F.array(F.col("runs")[0], F.element_at("runs", -1)))
    edges = parts.select(*names, F.explode(edge).alias("r")).select(*names, "r.f", "r.t")
    by_start = Window.partitionBy(*names).orderBy("f", "t")
    so_far = F.max("t").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("new", F.coalesce(F.col("f") > so_far, F.lit(True)).cast("int"))
    edges = edges.withColumn("island", F.sum("new").over(by_start))
    merged = edges.groupBy(*names, "island").agg(F.min("f").alias("f"), F.max("t").alias("t"))
    merged = merged.select(F.lit("period").alias("kind"), *names, "f", "t")
    result = merged.unionByName(done)
    return result.select(
        "kind", *[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("f").alias("from_at"), F.col("t").alias("to_at")
    )


def timeline_events(events: DataFrame) -> DataFrame:
    """Events that count, in tenths of a second, with ``fits``: whether both ends are within 32 bits.

    An event counts if it has a scene, an actor with a visible character and two real numbers with e
    after s. Those that don't fit can't be given in the columns of the periods; they are listed by
    ``rejected_events`` instead of being lost.
    """
    actor = F.lower(strip_invisible(F.col("who")))
    real = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5)
    fits = (F.abs(F.col("s")) < MOST_SECONDS) & (F.abs(F.col("e")) < MOST_SECONDS)
    kept = events.where(F.col("scene_id").isNotNull() & (actor != "") & real(F.col("s")) & real(F.col("e")) & (F.col("e") > F.col("s")))
    return kept.select(
        "scene_id", actor.alias("who"), "s", "e", fits.alias("fits"),
        F.when(fits, tenth("s").cast("bigint")).alias("a"), F.when(fits, tenth("e").cast("bigint")).alias("b"),
    )


def scene_periods(events: DataFrame) -> DataFrame:
    """Periods and gaps of the actors of scenes in tenths of a second.

    An event shorter than the rounding (both ends on one tenth) leaves nothing. See
    ``timeline_events`` for what counts.
    """
    found = periods_and_gaps(timeline_events(events).where("fits"), ["scene_id", "who"], "a", "b")
    return found.select(
        "kind", "scene_id", "who",
        F.col("from_at").cast("int").alias("from_tenth"), F.col("to_at").cast("int").alias("to_tenth"),
    )


def rejected_events(events: DataFrame) -> DataFrame:
    """Events that count but whose ends don't fit the columns of the periods, per scene and actor."""
    return timeline_events(events).where(~F.col("fits")).groupBy("scene_id", "who").agg(F.count("*").alias("n_events"))


def scene_table(spark: SparkSession, folder: str) -> DataFrame:
    return scene_periods(table(spark, folder, "scene_grammar", "scene_id", "who", "s", "e"))
