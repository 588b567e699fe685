"""Containers: sweeps against sequential best fit, whole texts, hostile rows."""

import bisect
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinolith.llm import packing

DOCUMENTS = [(i, "the actor walks to the park " * (i % 4 + 1)) for i in range(24)] + [(24, None), (25, ""), (3, "the actor walks to the park "), (3, "the actor walks to the park ")]
SCHEMA, PACKS = "doc_id bigint, text string", "pack_name string, capacity int"


def best_fit(sizes, capacity):
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        if i == len(gaps):
            n += 1
            bisect.insort(gaps, max(0, capacity - s))
        else:
            bisect.insort(gaps, gaps.pop(i) - s)
    return n


def test_a_sweep_gives_each_item_its_smallest_free_gap():
    moves = packing.sweep([(5, 2, 0), (3, 1, 7)], [(9, 1), (5, 1), (4, 2)])
    taken = {(m[0], m[3]): m for m in moves if m[3]}
    assert set(taken) == {(5, 5), (9, 5), (4, 3)}
    assert taken[4, 3][5] == 7 and sum(m[2] for m in moves) == 4


@pytest.mark.parametrize(("capacity", "loss"), [(16, 0.03), (100, 0.01)])
def test_rounds_place_everything_about_as_well_as_sequential_best_fit(spark, capacity, loss):
    rng = random.Random(capacity)
    # one size holds a third of all items
    sizes = [rng.randint(1, capacity) for _ in range(800)] + [3] * 400
    counts = Counter(sizes)
    rounds, openings = packing.plan_rounds(spark, {capacity: dict(counts)})
    seen, room = set(), Counter()
    for number, value, first, n in openings[capacity]:
        before = sum(m[2] for m in rounds[capacity][number - 1] if m[6] == value) if number else 0
        for who, size, rank in packing.follow(rounds[capacity], np.full(n, number), np.full(n, value), before + np.arange(n)):
            for w, s, r in zip(who.tolist(), size.tolist(), rank.tolist()):
                assert (s, r) not in seen
                seen.add((s, r))
                room[first + w] += s
    assert seen == {(s, r) for s, n in counts.items() for r in range(n)}
    assert max(room.values()) <= capacity
    assert len(room) <= (1 + loss) * best_fit(sizes, capacity) + 1


def test_packs_of_one_name_stay_apart_and_repeated_rows_are_placed_each(spark):
    documents = spark.createDataFrame(DOCUMENTS, SCHEMA)
    packs = spark.createDataFrame([("ctx", 32), ("ctx", 64), ("none", None), ("bad", 0)], PACKS)
    packed = packing.pack(documents, packs)
    rows = packed.collect()
    assert {r.capacity for r in rows} == {32, 64}
    held, tokens, texts = Counter(), Counter(), defaultdict(list)
    for r in rows:
        held[r.capacity, r.container_id] += r.n_tokens
        tokens[r.capacity] += r.n_tokens
        texts[r.capacity, r.doc_id].append(r.text)
    assert all(n <= capacity for (capacity, _), n in held.items())
    assert all(len(texts[c, 3]) == 3 for c in (32, 64))
    report = {r.capacity: r for r in packing.fill_report(packed).collect()}
    for capacity in (32, 64):
        n = max(c for k, c in held if k == capacity) + 1
        assert report[capacity].n_containers == n and report[capacity].n_tokens == tokens[capacity]
        assert abs(report[capacity].fill - tokens[capacity] / (n * capacity)) < 1e-6


def test_a_document_larger_than_the_capacity_and_a_character_larger_than_it(spark):
    documents = spark.createDataFrame([(1, "walks to the park and waves " * 9), (2, "棒人間")], SCHEMA)
    rows = packing.pack(documents, spark.createDataFrame([("tiny", 2)], PACKS)).collect()
    for i, text in ((1, "walks to the park and waves " * 9), (2, "棒人間")):
        parts = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.part_no)
        assert "".join(r.text for r in parts) == text and len(parts) == parts[0].n_parts


def test_empty_table(spark):
    packs = spark.createDataFrame([("ctx", 32)], PACKS)
    assert packing.pack(spark.createDataFrame([], SCHEMA), packs).collect() == []
