"""Filling containers of fixed capacity: bulk-synchronous best fit.

Documents and gaps are range-sorted by size, and all of one size are one class with a count, so a
capacity has no more classes of either kind than tokens. In a round, a sweep from the largest size
down gives every item class its successors, the smallest gaps that hold it and that no larger item
has taken; conflicts go by rank, larger sizes first, then by rank in the class. Then the gaps are
updated, and the next round sweeps again. Each capacity has its own task, which sweeps until nothing
fits; then as many containers open as the rest needs at least, in another job.

Members of a class are told apart by their rank alone. What a round decides are ranges of ranks: so
many containers of a gap class take so many items each of a size class and become the members of
another gap class. The containers follow these moves by themselves, in parallel, and say which rank
of which size they took; an equal join on size and rank brings documents and containers together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinolith.llm.bpe import TOKENIZERS, VOCABULARY, encoder_of, load_vocabulary
from kinolith.session import through_table

#: A size class is ranked in so many parts, as one size may hold a third of all rows.
RANK_PARTS = 64
#: Containers of one row of the table that they are spread from.
SPREAD = 10_000

_CLASSES = "capacity int, is_gap boolean, value int, n bigint, first_rank bigint"
_MOVES = "capacity int, round int, gap int, gap_rank bigint, n bigint, size int, each int, size_rank bigint, new_gap int, new_rank bigint"


def sweep(items: list[tuple[int, int, int]], gaps: list[tuple[int, int]]) -> list[tuple]:
    """One round of one capacity: moves (gap, gap_rank, n, size, each, size_rank, new_gap, new_rank).

    ``items``: (size, count, first rank not placed yet); ``gaps``: (gap, count). From the largest value
    down, gaps are stacked and every size takes from the top of the stack, the smallest gaps that hold
    it. Each container takes one item, or several of one size where that size has more items than
    there are containers left. Containers that take none move to the same gap, with size 0.
    """
    order = sorted([(g, 0, n, 0) for g, n in gaps if n] + [(s, 1, n, r) for s, n, r in items if n], key=lambda x: (-x[0], x[1]))
    stack: list[list[int]] = []  # gap, first rank, count
    held, taken = 0, []
    for value, is_item, n, rank in order:
        if not is_item:
            stack.append([value, 0, n])
            held += n
            continue
        each = max(1, -(-n // held)) if held else 1
        while n and stack:
            gap, first, k = stack[-1]
            m = min(each, gap // value)
            full = min(k, n // m)
            if not full:
                m, full = n, 1
            taken.append((gap, first, full, value, m, rank))
            rank, n, held = rank + full * m, n - full * m, held - full
            if full == k:
                stack.pop()
            else:
                stack[-1][1], stack[-1][2] = first + full, k - full
    taken += [(gap, first, k, 0, 0, 0) for gap, first, k in stack]
    following: dict[int, int] = {}
    moves = []
    for gap, first, k, size, m, rank in taken:
        new = gap - size * m
        at = following.get(new, 0)
        following[new] = at + k
        moves.append((gap, first, k, size, m, rank, new, at))
    return moves


def _apply(items: dict[int, tuple[int, int]], moves: list[tuple]) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """Items (size: count, next rank) and gaps (gap: count) after the moves of a round."""
    left, gaps = dict(items), {}
    for _, _, n, size, each, _, new, _ in moves:
        gaps[new] = gaps.get(new, 0) + n
        if size:
            many, rank = left[size]
            left[size] = (many - n * each, rank + n * each)
    return {s: x for s, x in left.items() if x[0]}, gaps


def _sweep_group(key: tuple, table: pa.Table) -> pa.Table:
    """Rounds of one capacity until a sweep places nothing."""
    rows = table.to_pydict()
    items = {v: (n, r) for v, n, r, g in zip(rows["value"], rows["n"], rows["first_rank"], rows["is_gap"]) if not g}
    gaps = {v: n for v, n, g in zip(rows["value"], rows["n"], rows["is_gap"]) if g}
    found, number = [], 0
    while items:
        moves = sweep([(s, n, r) for s, (n, r) in items.items()], list(gaps.items()))
        if not any(m[3] for m in moves):
            break
        found += [(key[0].as_py(), number, *m) for m in moves]
        items, gaps = _apply(items, moves)
        number += 1
    names = [x.split()[0] for x in _MOVES.split(", ")]
    kinds = [pa.int32() if x.split()[1] == "int" else pa.int64() for x in _MOVES.split(", ")]
    return pa.Table.from_arrays([pa.array([m[i] for m in found], k) for i, k in enumerate(kinds)], names=names)


def plan_rounds(spark: SparkSession, counts: dict[int, dict[int, int]]) -> tuple[dict[int, list[list[tuple]]], dict[int, list[tuple]]]:
    """Per capacity the moves of every round, and the openings (round, gap, first container, count).

    ``counts``: items of each size, for each capacity. The driver opens containers and passes the
    classes on: at most a count for every size and gap up to the capacity (and a few sizes above it).
    """
    items = {c: {s: (n, 0) for s, n in sizes.items() if s > 0 and n > 0} for c, sizes in counts.items()}
    gaps: dict[int, dict[int, int]] = {c: {} for c in counts}
    opened = {c: 0 for c in counts}
    openings: dict[int, list[tuple]] = {c: [] for c in counts}
    rounds: dict[int, list[list[tuple]]] = {c: [] for c in counts}
    while any(items.values()):
        rows = []
        for c, left in items.items():
            # sizes above the capacity are single characters; each gets a container of its own size
            need = [(s, n) for s, (n, _) in sorted(left.items()) if s > c]
            total = sum(s * n for s, (n, _) in left.items() if s <= c)
            for value, n in need + [(c, -(-total // c))] * (total > 0):
                openings[c].append((len(rounds[c]), value, opened[c], n))
                gaps[c][value] = gaps[c].get(value, 0) + n
                opened[c] += n
            rows += [(c, False, s, n, r) for s, (n, r) in left.items()]
            rows += [(c, True, g, n, 0) for g, n in gaps[c].items()] if left else []
        classes = spark.createDataFrame(rows, _CLASSES).repartition(len(counts), "capacity").sortWithinPartitions("capacity", F.desc("value"))
        made: dict[tuple[int, int], list[tuple]] = {}
        for c, number, *move in classes.groupBy("capacity").applyInArrow(_sweep_group, _MOVES).collect():
            made.setdefault((c, number), []).append(tuple(move))
        for c, number in sorted(made):
            rounds[c].append(made[c, number])
            items[c], gaps[c] = _apply(items[c], made[c, number])
    return rounds, openings


def follow(rounds: list[list[tuple]], born: np.ndarray, gap: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(container index, size, size rank) of every item that the given containers take.

    ``born``: the round before which a container opens; ``gap`` and ``rank``: its class at that time.
    """
    gap, rank = gap.copy(), rank.copy()
    for number, moves in enumerate(rounds):
        table = np.array(sorted(moves), np.int64)
        alive = np.flatnonzero(born <= number)
        wide = 1 << 40
        at = np.searchsorted(table[:, 0] * wide + table[:, 1], gap[alive] * wide + rank[alive], "right") - 1
        m = table[at]
        inside = rank[alive] - m[:, 1]
        start = m[:, 5] + inside * m[:, 4]
        for k in range(int(m[:, 4].max(initial=0))):
            some = np.flatnonzero(m[:, 4] > k)
            yield alive[some], m[some, 3], start[some] + k
        gap[alive], rank[alive] = m[:, 6], m[:, 7] + inside


def containers(spark: SparkSession, rounds: dict[int, list[list[tuple]]], openings: dict[int, list[tuple]]) -> DataFrame:
    """capacity, n_tokens, rank, container_id of every placed item, made by the containers in parallel."""
    # ranks of an opening stand behind the members that its class has at that time
    starts = []
    for c, opens in openings.items():
        for number, value, first, n in opens:
            before = sum(m[2] for m in rounds[c][number - 1] if m[6] == value) if number else 0
            before += sum(k for r, v, f, k in opens if (r, v) == (number, value) and f < first)
            starts += [(c, number, value, before + i, first + i, min(SPREAD, n - i)) for i in range(0, n, SPREAD)]
    shared = spark.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = shared.value
        for batch in batches:
            for c, born, gap, rank, first, n in zip(*(batch.column(i).to_pylist() for i in range(6))):
                full = lambda x: np.full(n, x, np.int64)  # noqa: B023, E731
                for who, size, at in follow(moves[c], full(born), full(gap), rank + np.arange(n)):
                    kinds = (np.full(len(who), c, np.int32), size.astype(np.int32), at, first + who)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kinds], names=["capacity", "n_tokens", "rank", "container_id"])

    rows = spark.createDataFrame(starts, "capacity int, born int, gap int, rank bigint, first bigint, n int")
    spread = rows.repartition(max(1, min(200, len(starts))))
    return spread.mapInArrow(run, "capacity int, n_tokens int, rank bigint, container_id bigint")


def document_parts(documents: DataFrame, capacities: list[int], folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """row and parts (capacity, part_no, n_parts, n_tokens, from_char, to_char) of every row, without its text."""
    shared = documents.sparkSession.sparkContext.broadcast(load_vocabulary(folder, name))
    fields = ["capacity", "part_no", "n_parts", "n_tokens", "from_char", "to_char"]
    kind = pa.list_(pa.struct([(f, pa.int32()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                some = batch.slice(begin, 1000)
                rows = []
                for text in some.column(1).to_pylist():
                    text = text or ""
                    ids = encoder.encode(text)
                    row = []
                    for capacity in capacities:
                        parts = encoder.parts(text, ids, capacity)
                        row += [(capacity, i, len(parts), *p) for i, p in enumerate(parts)]
                    rows.append([dict(zip(fields, r)) for r in row])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, kind)], names=["row", "parts"])

    key = documents.schema["row"].dataType.simpleString()
    part = "struct<capacity:int,part_no:int,n_parts:int,n_tokens:int,from_char:int,to_char:int>"
    return documents.select("row", "text").mapInArrow(run, f"row {key}, parts array<{part}>")


def ranked_parts(items: DataFrame) -> DataFrame:
    """Add to every part its rank among those of its capacity and size, counted in parts of a class."""
    klass = ["capacity", "n_tokens", "part"]
    items = items.withColumn("part", F.pmod(F.xxhash64("row", "part_no"), F.lit(RANK_PARTS)).cast("int"))
    sizes = items.groupBy(*klass).count()
    before = Window.partitionBy("capacity", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*klass, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy(*klass).orderBy("row", "part_no")) - 1
    # a merge join: the offsets have up to RANK_PARTS rows a size, too many to broadcast to every task
    ranked = items.withColumn("local", local).join(offsets.hint("merge"), klass)
    return ranked.withColumn("rank", F.col("offset") + F.col("local")).drop("part", "local", "offset")


def pack(documents: DataFrame, packs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Every text of ``documents`` in containers of every capacity of ``packs``.

    Columns: pack_name, capacity, container_id, doc_id, part_no, n_parts, n_tokens, text. A document is cut
    only where it is larger than the capacity, at token borders; its parts joined by part_no are
    the text. Null and empty texts have no tokens and lie in container 0. Repeated rows and equal
    sizes are placed row by row. Packs with a null or non-positive capacity are left out; packs of
    one name with several capacities stay apart by their capacity. An empty table gives no rows.

    A column ``row`` that names each row, such as its file and place, spares a copy of the texts: sizes
    are planned without them, and they are joined once, at the end. Without it rows are numbered in a
    table of their own. The same rows give the same containers at every run.
    """
    spark = documents.sparkSession
    wanted = packs.where("capacity > 0").select("pack_name", F.col("capacity").cast("int").alias("capacity")).distinct()
    # a pack is a setting, not data: the list is as long as the table of packs
    capacities = sorted(r.capacity for r in wanted.select("capacity").distinct().collect())
    if "row" not in documents.columns:
        documents = through_table(documents.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    documents = documents.select("row", "doc_id", "text")
    parts = through_table(document_parts(documents, capacities, folder, name), "parts")

    items = parts.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    counts: dict[int, dict[int, int]] = {c: {} for c in capacities}
    # bounded by the capacities: one row a size (single characters above a capacity add a few)
    for r in items.groupBy("capacity", "n_tokens").count().collect():
        counts[r.capacity][r.n_tokens] = r["count"]
    rounds, openings = plan_rounds(spark, counts)
    # a merge join: what the containers take looks small to the planner, yet has a row for every part
    taken = containers(spark, rounds, openings).hint("merge")
    placed = ranked_parts(items.where("n_tokens > 0")).join(taken, ["capacity", "n_tokens", "rank"])
    nothing = items.where("n_tokens = 0").withColumn("container_id", F.lit(0).cast("bigint"))
    shape = ["row", "capacity", "part_no", "n_parts", "n_tokens", "from_char", "to_char", "container_id"]
    all_parts = placed.select(*shape).unionByName(nothing.select(*shape))
    full = all_parts.join(documents, "row").join(F.broadcast(wanted), "capacity")
    text = F.substring(F.col("text"), F.col("from_char") + 1, F.col("to_char") - F.col("from_char"))
    return full.select("pack_name", "capacity", "container_id", "doc_id", "part_no", "n_parts", "n_tokens", text.alias("text"))


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, parts, tokens and the share of room used per pack and capacity."""
    found = packed.groupBy("pack_name", "capacity").agg(
        (F.max("container_id") + 1).alias("n_containers"),
        F.count("*").alias("n_parts_placed"),
        F.count_if(F.col("n_parts") > 1).alias("n_split_parts"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    share = F.try_divide(F.col("n_tokens").cast("double"), F.col("n_containers") * F.col("capacity"))
    return found.withColumn("fill", F.round(share, 6))
