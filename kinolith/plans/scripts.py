"""Queries of scripts, frames, generated scenes and curves."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from kinolith.functions.text import hash_bucket, tokens
from kinolith.operators import scenes, scripts as S
from kinolith.operators import series, vectors
from kinolith.plans.scenes import _TRAIN
from kinolith.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text")


def parse_kv_lines(spark, sf):
    """Lines of scripts in the documents: how many words each has, by what it is."""
    return S.script_lines(_docs(spark, sf), "doc_id", "text").where("head <> 'text'").select("doc_id", "line_no", "head", F.size("words").alias("n_words"))


def parse_lines_dispatch(spark, sf):
    """Operations of the frame lines in the documents."""
    return S.frame_ops(_docs(spark, sf), "doc_id", "text").select("doc_id", "line_no", "frame", "seq", "kind", "shape", F.array_join(F.transform("args", lambda x: x.cast("string")), " ").alias("args"))


def structural_score(spark, sf):
    """Whether the frame lines of a document move anything, and how much."""
    ops = S.frame_ops(_docs(spark, sf), "doc_id", "text")
    by = ops.groupBy("doc_id").agg(F.count_distinct("line_no").alias("n_frames"), F.count_distinct("shape").alias("n_shapes"), F.count("*").alias("n_ops"), F.count_if(F.col("kind") == "t").alias("n_moves"))
    why = F.when(F.col("n_moves") == 0, "static").when(F.col("n_shapes") < 2, "one shape")
    return by.select("doc_id", why.isNull().alias("ok"), why.alias("why"), "n_frames", "n_shapes", "n_ops")


def frame_replay(spark, sf):
    """Place of each shape after each of its moves, in line order."""
    ops = S.frame_ops(_docs(spark, sf), "doc_id", "text").where("kind = 't'")
    w = Window.partitionBy("doc_id", "shape").orderBy("line_no", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return ops.select("doc_id", "shape", "line_no", "seq", F.sum(F.col("args")[0]).over(w).alias("x"), F.sum(F.col("args")[1]).over(w).alias("y"))


def delta_encode(spark, sf):
    """Whole-number deltas against what a decoder would hold, sent where it is off by two or more."""
    start = F.struct(F.lit(0.0).alias("held"), F.lit(0).alias("sent"))
    step = lambda s, v: F.when(F.abs(v - s["held"]) >= 2, F.struct((s["held"] + F.rint(v - s["held"])).alias("held"), (s["sent"] + 1).alias("sent"))).otherwise(s)
    out = series.fold(table(spark, sf, "events", "user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value", step, start)
    return out.select("user_id", F.col("state.held").alias("held"), F.col("state.sent").alias("sent"))


def budget_trim_rounds(spark, sf):
    """Lines kept of every document by the iterative trim to 120 tokens."""
    costs = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.size(tokens(x)))
    return _docs(spark, sf).select("doc_id", S.trim_rounds(costs, 120, 2).alias("kept"))


def measurable_gate(spark, sf):
    """Mean separation of the outputs of a source, null where fewer than half of them could be measured."""
    df = table(spark, sf, "out_of_distribution", "label", "staging").select("label", F.when(~F.isnan("staging.min_sep"), F.col("staging.min_sep")).alias("sep"))
    by = df.groupBy("label").agg(F.round(F.count("sep") / F.count("*"), 6).alias("rate"), F.avg("sep").alias("m"))
    ok = F.col("rate") >= 0.5
    return by.select("label", "rate", ok.alias("measurable"), F.when(ok, F.round("m", 6)).alias("mean_sep"))


def grouped_error(spark, sf):
    """Mean absolute difference of two staging measures per group of prompts."""
    s = table(spark, sf, "out_of_distribution", "grp", "staging").where("staging IS NOT NULL AND NOT isnan(staging.staging) AND NOT isnan(staging.span_frac)")
    return s.groupBy("grp").agg(F.round(F.avg(F.abs(F.col("staging.staging") - F.col("staging.span_frac"))), 6).alias("mae"), F.count("*").alias("n"))


def gen_specs(spark, sf):
    """A generated scene for every held-out item."""
    made = S.generated(table(spark, sf, "ood_prompts", "item_id"), "item_id", 7)
    who = F.array_join(F.transform("cast", lambda c: F.concat_ws(" ", c["id"], c["color"], c["x"].cast("string"))), ";")
    what = F.array_join(F.transform("timeline", lambda e: F.concat_ws(" ", e["s"].cast("string"), e["e"].cast("string"), e["who"], e["act"])), ";")
    return made.select("item_id", "bg", "dur", who.alias("who"), what.alias("what"))


def compile_timeline(spark, sf):
    """Place of the actor at each event of the training scenes: the last walk's target, at first the cast's place."""
    df = scenes.parse(table(spark, sf, "scene_train", "pair_id", "dsl"), "dsl").where("parse_error IS NULL")
    events = df.select("pair_id", "cast", F.posexplode("timeline").alias("i", "e"))
    start = F.get(F.filter("cast", lambda c: c["id"] == F.col("e.who")), 0)["x"]
    w = Window.partitionBy("pair_id", "e.who").orderBy("e.s", "i").rowsBetween(Window.unboundedPreceding, -1)
    return events.select("pair_id", F.col("i").alias("event"), F.coalesce(F.last("e.to", True).over(w), start).alias("x"))


def grid_cross(spark, sf):
    """Pixels of a 40 by 30 grid over a 4 by 3 world, y upwards."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    grid = spark.range(1).select(axis(40).alias("i")).select("i", axis(30).alias("j"))
    x, y = F.col("i") * 4 / 40 - 2, F.col("j") * 3 / 30 - 1.5
    return grid.select("i", "j", F.rint((x + 2) * 160).cast("int").alias("px"), F.rint((F.lit(1.5) - y) * 160).cast("int").alias("py"))


def curve_points(spark, sf):
    """Points of y = 1 / (x - 0.5) over a line of 201, in runs without a break."""
    points = spark.range(201).select(F.col("id").alias("i"), (F.col("id") / 200).alias("x"))
    points = points.withColumn("y", F.try_divide(F.lit(1.0), F.col("x") - 0.5)).withColumn("gap", F.col("y").isNull().cast("int"))
    run = F.sum("gap").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))  # 201 rows
    return points.withColumn("run", run).where("y IS NOT NULL").select("i", "run", F.round("y", 6).alias("y"))


def round_rewrite(spark, sf):
    return S.map_texts(_docs(spark, sf), "doc_id", "text", lambda t: S.rounded_numbers(t, 1), "text")


def space_out(spark, sf):
    """Places of the cast of the training scenes, at least 12 tenths apart."""
    df = scenes.parse(table(spark, sf, "scene_train", "pair_id", "dsl"), "dsl").where("parse_error IS NULL").select("pair_id", F.col("cast.x").alias("xs"))
    return S.map_arrays(df, "pair_id", "xs", lambda xs: S.spaced(xs, 12.0, 4.0, 96.0), "xs")


def arc_resample(spark, sf):
    """The 32 points of every vector, resampled to 16 along their closed line."""
    df = table(spark, sf, "embeddings", "vec_id", "embedding").withColumn("v", F.col("embedding").cast("array<double>"))
    flat = lambda v: [c for p in S.resampled([v[i : i + 2] for i in range(0, len(v) - 1, 2)], 16) for c in p]
    return S.map_arrays(df, "vec_id", "v", flat, "points")


def shared_action(spark, sf):
    """Training scenes in which everybody does what is done first: how many events change."""
    df = scenes.parse(table(spark, sf, "scene_train", "pair_id", "dsl"), "dsl").where("parse_error IS NULL")
    same = S.one_action("timeline")
    changed = F.size(F.filter(F.zip_with("timeline", same, lambda a, b: a["act"] != b["act"]), lambda x: x))
    return df.select("pair_id", F.get(same, 0)["act"].alias("act"), changed.cast("bigint").alias("n_changed"))


def list_diff_patch(spark, sf):
    """Steps from each training scene to the next of its origin, and whether they lead there."""
    w = Window.partitionBy("origin").orderBy("pair_id")
    df = table(spark, sf, "scene_train", "pair_id", "origin", "dsl").where("dsl IS NOT NULL")
    pairs = df.withColumn("pair", F.to_json(F.struct(F.split(F.lag("dsl").over(w), " ").alias("a"), F.split("dsl", " ").alias("b"))))
    out = S.map_texts(pairs, "pair_id", "pair", S.diff_report, "report")
    return out.select("pair_id", F.get_json_object("report", "$.steps").cast("int").alias("n_steps"), F.get_json_object("report", "$.ok").cast("boolean").alias("ok"))


def gap_schedule(spark, sf):
    """Three more windows for every training scene, clear of its kicks."""
    df = scenes.parse(table(spark, sf, "scene_train", "pair_id", "dsl"), "dsl").where("parse_error IS NULL")
    kicks = F.filter("timeline", lambda e: e["act"] == "kick")
    draws = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: hash_bucket(F.concat_ws(":", F.col("pair_id").cast("string"), i.cast("string"))) / 10_000)
    packed = F.to_json(F.struct(F.transform(kicks, lambda e: F.array(e["s"], e["e"])).alias("busy"), draws.alias("draws"), F.col("dur").alias("span")))

    def plan(text: str) -> str:
        import json

        row = json.loads(text)
        return json.dumps(S.scheduled([(int(a), int(b)) for a, b in row["busy"]], row["draws"], int(row["span"])))

    return S.map_texts(df.select("pair_id", packed.alias("row")), "pair_id", "row", plan, "windows")


def farthest_point(spark, sf):
    """Four label centres far from each other, by greedy max-min; the centres are as few as the labels."""
    df = table(spark, sf, "embeddings", "label", "embedding")
    centres = vectors.centroids(df, "label", "embedding").orderBy("label").collect()
    chosen = vectors.farthest_points([r.centre for r in centres], 4)
    return spark.createDataFrame([(k, centres[i].label) for k, i in enumerate(chosen)], "place int, label int")


QUERIES = {
    f.__name__: f
    for f in (
        parse_kv_lines, parse_lines_dispatch, structural_score, frame_replay, delta_encode, budget_trim_rounds, measurable_gate, grouped_error,
        gen_specs, compile_timeline, grid_cross, curve_points, round_rewrite, space_out, arc_resample, shared_action,
        list_diff_patch, farthest_point, gap_schedule,
    )
}

_W = r"'[\s\x0B\x1C-\x1F\x{85}\p{Z}]+'"


def _tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, {_W}), lambda w: w <> '')"


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL"
_OPS = rf"""WITH f AS (SELECT doc_id, line_no, CAST(regexp_extract(line, '^@ (\d+)', 1) AS INTEGER) AS frame, regexp_extract_all(replace(line, ' ', '  ') || ' ', '[ ]t\d{{1,6}}  -?\d{{1,9}}  -?\d{{1,9}} |[ ][rso]\d{{1,6}}  -?\d{{1,9}} |[ ][hv]\d{{1,6}} ') AS ops
  FROM ({_LINES}) WHERE regexp_matches(line, '^@ \d{{1,9}} ')),
 o AS (SELECT doc_id, line_no, frame, unnest(ops) AS op, generate_subscripts(ops, 1) - 1 AS seq FROM f),
 ops AS (SELECT doc_id, line_no, frame, seq, trim(op)[1] AS kind, CAST(regexp_extract(op, '[a-z](\d+)', 1) AS INTEGER) AS shape, list_transform(string_split(trim(op), '  ')[2:], lambda x: CAST(x AS INTEGER)) AS args FROM o)"""


def _draw(what: str, n: int, i: str = "") -> str:
    tail = f" || ':' || {i}" if i else ""
    return f"CAST(CAST('0x' || substr(md5('7:{what}:' || item_id{tail}), 1, 15) AS BIGINT) % {n} AS INTEGER)"


def _keep(n: int) -> str:
    before, now = f"k{n - 1}", f"k{n}"
    cost = f"coalesce(list_sum(c[1:{before}]), 0)"
    return f"r{n} AS (SELECT *, CASE WHEN z >= 2 THEN z END AS {now} FROM (SELECT *, CASE WHEN {cost} > 120 THEN CAST(floor({before} * 120 / {cost} * 0.92) AS INTEGER) ELSE {before} END AS z FROM r{n - 1}) )".replace("SELECT *, CASE WHEN z", f"SELECT * EXCLUDE (z), CASE WHEN z")


ORACLE = {
    "shared_action": _TRAIN + " SELECT pair_id, t[1][4] AS act, len(list_filter(t, lambda v: v[4] <> t[1][4])) AS n_changed FROM r WHERE err IS NULL",
    "parse_kv_lines": rf"""SELECT doc_id, line_no, CASE WHEN lower(w[1]) IN ('title', 'background', 'duration', 'cast', 'prop', 'size', 'fps') THEN lower(w[1]) ELSE 'timeline' END AS head, len(w) AS n_words
 FROM (SELECT doc_id, line_no, {_tok("regexp_replace(line, '#.*$', '')")} AS w FROM ({_LINES})) WHERE len(w) > 0 AND (lower(w[1]) IN ('title', 'background', 'duration', 'cast', 'prop', 'size', 'fps') OR regexp_full_match(w[1], '\d+(\.\d+)?'))""",
    "parse_lines_dispatch": _OPS + " SELECT doc_id, line_no, frame, seq, kind, shape, array_to_string(args, ' ') AS args FROM ops",
    "structural_score": _OPS + """ SELECT doc_id, count(*) FILTER (kind = 't') > 0 AND count(DISTINCT shape) >= 2 AS ok, CASE WHEN count(*) FILTER (kind = 't') = 0 THEN 'static' WHEN count(DISTINCT shape) < 2 THEN 'one shape' END AS why,
 count(DISTINCT line_no) AS n_frames, count(DISTINCT shape) AS n_shapes, count(*) AS n_ops FROM ops GROUP BY 1""",
    "frame_replay": _OPS + """ SELECT doc_id, shape, line_no, seq, CAST(sum(args[1]) OVER w AS BIGINT) AS x, CAST(sum(args[2]) OVER w AS BIGINT) AS y FROM ops WHERE kind = 't' WINDOW w AS (PARTITION BY doc_id, shape ORDER BY line_no, seq ROWS UNBOUNDED PRECEDING)""",
    "delta_encode": """SELECT user_id, s.held AS held, s.sent AS sent FROM (SELECT user_id, list_reduce(list_prepend({'held': 0.0::DOUBLE, 'sent': 0, 'v': 0.0::DOUBLE}, list({'held': 0.0::DOUBLE, 'sent': 0, 'v': value} ORDER BY ts, event_id)),
 lambda s, r: CASE WHEN abs(r.v - s.held) >= 2 THEN {'held': s.held + round_even(r.v - s.held, 0), 'sent': s.sent + 1, 'v': 0.0::DOUBLE} ELSE {'held': s.held, 'sent': s.sent, 'v': 0.0::DOUBLE} END) AS s FROM events GROUP BY 1)""",
    "budget_trim_rounds": f"WITH r0 AS (SELECT doc_id, c, len(c) AS k0 FROM (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: len({_tok('x')})) AS c FROM documents)), "
    + ", ".join(_keep(n) for n in (1, 2, 3, 4))
    + " SELECT doc_id, CAST(CASE WHEN coalesce(list_sum(c[1:k4]), 0) <= 120 THEN k4 END AS INTEGER) AS kept FROM r4",
    "measurable_gate": """SELECT label, rate, rate >= 0.5 AS measurable, CASE WHEN rate >= 0.5 THEN round(m, 6) END AS mean_sep FROM (SELECT label, round(count(sep) / count(*), 6) AS rate, avg(sep) AS m FROM
 (SELECT label, CASE WHEN NOT isnan(staging.min_sep) THEN staging.min_sep END AS sep FROM out_of_distribution) GROUP BY 1)""",
    "grouped_error": "SELECT grp, round(avg(abs(staging.staging - staging.span_frac)), 6) AS mae, count(*) AS n FROM out_of_distribution WHERE staging IS NOT NULL AND NOT coalesce(isnan(staging.staging), false) AND NOT coalesce(isnan(staging.span_frac), false) GROUP BY 1",
    "gen_specs": f"""WITH g AS (SELECT item_id, {list(scenes.BACKGROUNDS)}[{_draw('bg', 3)} + 1] AS bg, {_draw('dur', 100)} + 60 AS dur, {_draw('cast', 4)} + 1 AS m FROM ood_prompts)
 SELECT item_id, bg, dur, array_to_string(list_transform(range(m), lambda i: 'c' || i || ' ' || {list(scenes.COLOURS)}[{_draw('colour', 10, 'i')} + 1] || ' ' || ({_draw('x', 93, 'i')} + 4)), ';') AS who,
 array_to_string(list_transform(range(m + 1), lambda i: (i * 20) || ' ' || (i * 20 + 10 + {_draw('len', 10, 'i')}) || ' c' || (i % m) || ' ' || {list(scenes.ACTIONS)}[{_draw('act', 7, 'i')} + 1]), ';') AS what FROM g""",
    "grid_cross": "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(round_even((i * 4 / 40 - 2 + 2) * 160, 0) AS INTEGER) AS px, CAST(round_even((1.5 - (j * 3 / 30 - 1.5)) * 160, 0) AS INTEGER) AS py FROM range(41) a(i), range(31) b(j)",
    "curve_points": "SELECT i, CAST(sum(CASE WHEN i = 100 THEN 1 ELSE 0 END) OVER (ORDER BY i) AS BIGINT) AS run, round(1.0::DOUBLE / (i / 200 - 0.5), 6) AS y FROM range(201) t(i) QUALIFY i <> 100",
}
