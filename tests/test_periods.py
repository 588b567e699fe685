"""Continuous periods on hostile intervals."""

import random

from kinolith.operators import periods

SCHEMA = "scene_id bigint, who string, s double, e double, act string"


def brute(rows):
    found = []
    for key in sorted({r[0] for r in rows}):
        cells = sorted({x for k, a, b in rows if k == key for x in range(a, b)})
        runs, start = [], None
        for i, x in enumerate(cells):
            if start is None:
                start = x
            if i + 1 == len(cells) or cells[i + 1] != x + 1:
                runs.append((start, x + 1))
                start = None
        found += [("period", key, *r) for r in runs]
        found += [("gap", key, a[1], b[0]) for a, b in zip(runs, runs[1:])]
    return sorted(found)


def test_random_intervals_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a = rng.choice([rng.randint(-9000, 9000), rng.randint(0, 60)])
        rows.append((rng.randint(1, 4), a, a + rng.choice([1, 2, 7, 64, 1000])))
    df = spark.createDataFrame(rows + rows[:50], "k int, a bigint, b bigint")
    assert sorted(map(tuple, periods.periods_and_gaps(df, ["k"], "a", "b").collect())) == brute(rows)


def test_ends_past_32_bits_are_rejected_not_dropped(spark):
    rows = [(1, " Mab ", 0.0, 1.0, "x"), (1, "mab", 1.0, 2.0, "x"), (1, "mab", 3.0, 1e12, "x"), (1, "mab", 3.0, 1e14, "x"), (1, "ivo", 5.0, 4.0, "x"), (None, "ivo", 1.0, 2.0, "x"), (1, None, 1.0, 2.0, "x"), (1, "ivo", float("nan"), 2.0, "x"), (1, "ivo", 1.0, float("inf"), "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in periods.scene_periods(df).collect()] == [("period", 1, "mab", 0, 20)]
    assert [tuple(r) for r in periods.rejected_events(df).collect()] == [(1, "mab", 2)]


def test_one_entity_with_a_third_of_all_rows_and_an_empty_table(spark):
    df = spark.range(30000).selectExpr("IF(id % 3 = 0, 0, id) AS k", "id * 2 AS a", "id * 2 + 1 AS b")
    found = periods.periods_and_gaps(df, ["k"], "a", "b")
    assert found.where("k = 0 AND kind = 'period'").count() == 10000
    assert found.where("k = 0 AND kind = 'gap'").count() == 9999
    assert periods.periods_and_gaps(df.where("k < 0"), ["k"], "a", "b").collect() == []
