"""Operators on nulls, ties, repeated rows, empty tables and clashing names."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kinolith.functions import text as T
from kinolith.functions.expressions import translate
from kinolith.operators import corpus, scenes, scripts, series, vectors
from kinolith.session import scratch_path
from kinolith.sources import files
from kinolith.streaming.folds import smooth
from kinolith.streaming.ingest import ingest, stream_of


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    return [r[0] for r in df.select(column).collect()]


def test_cleaning_and_tokens(spark):
    assert one(spark, T.clean(F.col("c")), " a　\n\tb ", None, "") == ["a b", "", ""]
    assert one(spark, T.tokens(F.col("c")), "  a b c", None, " ") == [["a", "b", "c"], [], []]
    assert one(spark, T.rgb_of(F.col("c")), "#0f8", "#010203", "x", None) == [[0, 255, 136], [1, 2, 3], None, None]
    assert one(spark, T.take_while(F.col("c"), "@s", "@ "), "x\n@ 1\n\ns 2\nq\ns 3", " none ") == ["@ 1\ns 2", "none"]
    assert one(spark, T.atoms_text(T.number_atoms(F.col("c"))), "a 12 -7 #0f8", None) == ["a 12 -7 #0f8", ""]
    assert one(spark, T.key_values(F.col("c"), ("a", "b")), "a=1 c=2,a=3", "", None) == [{"a": "3"}, {}, {}]


def test_reject_cascade_gives_the_first_reason_and_keeps_its_name_free(spark):
    df = spark.createDataFrame([("x", None), (None, 1)], "a string, reason int")
    out = corpus.reject_cascade(df, ("no a", F.col("a").isNull()), ("null rule", F.lit(None).cast("boolean")), ("any", F.lit(True)))
    assert [r.reason for r in out.collect()] == ["any", "no a"]


def test_dedup_uses_up_the_name_but_not_the_body_of_a_short_caption(spark):
    rows = [(1, "n", "short", "body"), (2, "n", "a caption that is long", "body"), (3, "m", "a caption that is long", "body"), (4, "k", "a caption that is long", "H head\nbody"), (5, None, "a caption that is long", "z"), (6, None, "a caption that is long", "y")]
    df = spark.createDataFrame(rows, "i int, name string, caption string, body string")
    out = corpus.dedup_two_keys(df, "i", "name", "caption", "body")
    assert sorted(r.i for r in out.collect()) == [3, 5]
    assert corpus.dedup_two_keys(df.where("i < 0"), "i", "name", "caption", "body").collect() == []


def test_order_statistics_take_elements_not_interpolations(spark):
    df = spark.createDataFrame([("a", v) for v in (4, 1, 3, 2)] + [("b", 7), ("b", None)] + [("c", 5)] * 300, "g string, v int")
    out = {r.g: r for r in corpus.order_statistics(df, ["g"], "v", {"med": 0.5}).collect()}
    assert out["a"].med == 3 and out["a"].n == 4 and out["b"].med == 7 and out["b"].n == 1 and out["c"].total == 1500


def test_positions_without_one_window(spark):
    df = spark.createDataFrame([(i * i,) for i in range(500)], "i bigint").orderBy(F.rand(1))
    assert [tuple(r) for r in corpus.with_position(df, "i").orderBy("i").select("position", "i").collect()] == [(i, i * i) for i in range(500)]
    assert corpus.even_subsample(df, "i", 5).count() == 5 and corpus.even_subsample(df.limit(3), "i", 5).count() == 3
    assert corpus.with_position(df.where("i < 0"), "i").collect() == []


def test_equations_are_translated_or_refused(spark):
    df = spark.createDataFrame([(3.0,), (0.0,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(translate("where(x > 0, log(x) + 2 ** 3, x % 2) + a", {"x": F.col("x")}, {"a": 1.0})).collect()]
    assert got == pytest.approx([math.log(3) + 9, 1.0, 2.0])
    assert [r[0] for r in df.select(translate("1 / x", {"x": F.col("x")})).collect()][1] is None
    for bad in ("__import__('os')", "x.real", "y + 1", "[x]", "lambda: 1", "x if x else 1", "open(x)", "'a'", "sin(x=1)", "True"):
        with pytest.raises(ValueError):
            translate(bad, {"x": F.col("x")})


def test_hold_sessions_windows(spark):
    rows = [("a", i, v) for i, v in enumerate([None, 5.0, None, 50.0, 51.0, 52.0, None])] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    held = df.select("k", "i", series.hold_and_backfill(F.col("v"), ["k"], ["i"]).alias("h")).orderBy("k", "i")
    assert [r.h for r in held.collect()] == [5.0, 5.0, 5.0, 50.0, 51.0, 52.0, 52.0, None]
    runs = series.sessions(df.where("v IS NOT NULL"), "v", ["k"], ["i"], 10.0, 2)
    assert [(r.first_pos, r.end_pos, r.n) for r in runs.collect()] == [(1, 4, 3)]
    assert series.windows_of(df, ["k"], ["i"], "v", 2).where("size(window) <> 2").count() == 0


def test_latest_start_against_brute_force(spark):
    rng = random.Random(4)
    spans = [(rng.randint(0, 3), a := rng.randint(0, 300), a + rng.randint(1, 120), i) for i in range(80)]
    points = sorted({(rng.randint(0, 4), rng.randint(0, 350)) for _ in range(120)})
    got = series.latest_start(spark.createDataFrame(points, "k int, at int"), spark.createDataFrame(spans, "k int, a int, b int, n int"), "k", "at", "a", "b", "n", 40)
    want = {p: max(((a, n) for k, a, b, n in spans if k == p[0] and a <= p[1] < b), default=(None, None))[1] for p in points}
    assert {(r.k, r.at): r.n for r in got.collect()} == want


SCENE = "bg park dur 115 | cast mab lime 43 100 ; ivo white 17 100 | prop ball 25 60 | tl 7 35 ivo kick ball mab ; 9 34 mab walk 20"


def test_scene_faults_and_problems(spark):
    texts = [SCENE, None, " ", "bg park", "bg park len 9 | cast mab lime 4 5", SCENE.replace("43", "4x"), SCENE.replace("mab lime 43 100", "mab lime"), SCENE.replace("| prop", "| what"), SCENE.replace("9 34 mab walk 20", "9 34"), "bg park dur 9 | prop ball 1 2"]
    df = scenes.parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string"), "raw")
    errors = [r.parse_error for r in df.orderBy("i").collect()]
    assert errors == [None, "empty output", "empty output", "fewer than 2 sections", "bad header 'bg park len 9'", "not a number: '4x'", "bad cast entry ['mab', 'lime']", "unknown section 'what'", "bad event ['9', '34']", "empty cast"]
    assert df.where("i = 0").select(scenes.text_of()).first()[0] == SCENE
    broken = SCENE.replace("park", "moon").replace("white", "lime").replace("ball 25 60", "rock 25 60").replace("mab walk", "zed fly").replace("7 35", "35 7")
    found = scenes.parse(spark.createDataFrame([(broken,)], "raw string"), "raw")
    assert found.select(scenes.problems()).first()[0] == ["background", "two characters share a colour", "unknown actor", "unknown action", "bad window", "kick without ball", "mannequin"]


def test_repaired_scenes_have_only_what_repair_leaves(spark):
    df = scenes.parse(spark.read.parquet("/root/testdata/sf0.01/out_of_distribution.parquet").select("row_id", "raw"), "raw").where("parse_error IS NULL")
    left = scenes.repair(df).select("dur", F.explode(F.array_distinct(scenes.problems())).alias("p"))
    # kicks that overlap are left, and so are ends past the longest duration
    assert {r.p for r in left.where("p <> 'window past duration' OR dur < 400").collect()} <= {"overlapping kicks"}


def test_most_similar_and_nearest(spark):
    rows = [(i, [float(i % 7), float(i % 3), 1.0]) for i in range(300)] + [(300, [0.0, 0.0, 0.0]), (301, None), (None, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "i bigint, v array<double>")
    found = {r.query_id: r for r in vectors.most_similar(df, "i", "v", block=2).collect()}
    assert set(found) == {0, 100, 200, 300} and found[100].best_id == 100 % 21 and found[100].cosine == 1.0
    assert vectors.farthest_points([[0, 0], [1, 0], [5, 0], [0, 4]], 3) == [0, 2, 3] and vectors.farthest_points([], 2) == []


def test_places_points_lists_and_numbers():
    out = scripts.spaced([5.0, 5.0, 5.2], 1.0, 0.4, 9.6)
    assert sorted(out) == sorted(out, key=float) and min(b - a for a, b in zip(sorted(out), sorted(out)[1:])) >= 0.9
    assert scripts.spaced([], 1, 0, 1) == [] and max(scripts.spaced([9.6, 9.6, 9.6], 1.0, 0.4, 9.6)) <= 9.6
    square = scripts.resampled([[0, 0], [1, 0], [1, 1], [0, 1]], 8)
    assert square[1] == pytest.approx([0.5, 0]) and square[3] == pytest.approx([1, 0.5])
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert scripts.list_patch(a, scripts.list_diff(a, b)) == b
    assert scripts.rounded_numbers("M 1.25 -0.04 2.675 x7", 1) == "M 1.2 0 2.7 x7"


def test_dropped_connections_are_replayed_without_loss_or_repeat(spark):
    waits, opened = [], []

    def flaky():
        opened.append(1)
        for i in range(10):
            if i == 3 * len(opened) and len(opened) < 4:
                raise ConnectionError
            yield f"line {i}"

    assert list(files.replayed(flaky, sleep=waits.append)) == [f"line {i}" for i in range(10)]
    assert len(opened) == 4 and waits == [3.0, 3.0, 3.0]

    def dead():
        raise ConnectionError
        yield

    with pytest.raises(ConnectionError):
        list(files.replayed(dead, retries=3, sleep=waits.append))
    assert waits[3:] == [3.0, 6.0, 12.0]
    shards = spark.createDataFrame([("a",), ("b",)], "name string")
    got = files.remote_lines(shards, "name", lambda shard: (f"{shard}{i}" for i in range(2500)), batch=1000)
    assert got.count() == 5000 and got.where("line = 'b2499'").first().line_no == 2500


def test_schedule_keeps_clear_of_busy_windows():
    rng = random.Random(2)
    for _ in range(200):
        busy = [(a := rng.randint(0, 150), a + rng.randint(1, 40)) for _ in range(rng.randint(0, 4))]
        out = scripts.scheduled(busy, [rng.random() for _ in range(7)], 200)
        assert all(14 <= e - s <= 28 and e <= 200 for s, e in out)
        assert all(e <= s2 or e2 <= s for s, e in out for s2, e2 in busy)
        assert all(a[1] < b[0] for a, b in zip(out, out[1:]))


def test_ingestion_resumes_and_adds_only_what_is_new(spark):
    path, folder = scratch_path(spark, "in"), scratch_path(spark, "out")
    step = lambda df: df.withColumn("y", F.col("x") * 2)
    spark.createDataFrame([(1,), (2,)], "x int").write.parquet(path)
    assert ingest(stream_of(spark, path, "x"), step, folder).count() == 2
    assert ingest(stream_of(spark, path, "x"), step, folder).count() == 2
    spark.createDataFrame([(3,)], "x int").write.mode("append").parquet(path)
    assert sorted(r.y for r in ingest(stream_of(spark, path, "x"), step, folder).collect()) == [2, 4, 6]


def test_smoothing_goes_on_over_batches(spark):
    path, folder = scratch_path(spark, "in"), scratch_path(spark, "out")
    for rows in ([("a", 1, 8.0), ("a", 2, None)], [("a", 3, 0.0), (None, 1, 1.0)]):
        spark.createDataFrame(rows, "k string, i int, v double").write.mode("append").parquet(path)
        found = ingest(stream_of(spark, path), lambda df: smooth(df, "k", ["i"], "v", 0.5), folder)
    assert sorted((r.k or "", r.level, r.n) for r in found.collect()) == [("", 1.0, 1), ("a", 4.0, 3), ("a", 8.0, 2)]


def test_files(spark):
    path = scratch_path(spark, "json")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    files.write_shards(df, path, "s")
    files.write_shards(df.unionByName(spark.createDataFrame([(3, "c")], "i int, s string")), path, "s")
    assert sorted(r.i for r in files.json_lines(spark, path, "i int, s string").collect()) == [1, 2, 3]
    files.write_report(df, f"{path}-report", seed=7)
    assert {r.seed for r in spark.read.json(f"{path}-report").collect()} == {7}
    files.write_frames(spark.range(20).selectExpr("id AS frame", "id * 2 AS x"), f"{path}-frames", "frame", 4)
    assert spark.read.json(f"{path}-frames/frames").count() == 20
    assert sum(r.value.startswith("--- frame") for r in spark.read.text(f"{path}-frames/text").collect()) == 4
    assert files.text_table(df) == "i  s\n1  a\n2  b"
    probe = files.schema_probe(spark.createDataFrame([('{"a": 1}',), ('{"b": "x"}',)], "j string"), "j")
    assert "a" in probe and "b" in probe
