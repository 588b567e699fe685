"""Line-oriented texts: scene scripts, delta-coded frames, and generators of scenes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from kinolith.functions.text import hash_bucket, tokens
from kinolith.operators.scenes import ACTIONS, BACKGROUNDS, COLOURS

#: Words that open a line of a scene script; any other first word opens a timeline line.
HEADS = ("title", "background", "duration", "cast", "prop", "size", "fps")


def script_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of scripts: key, line_no (from 1), head, words.

    A '#' starts a comment anywhere; blank lines are left out; the first word, in lower case, says
    what a line is, and a line that opens with a number belongs to the timeline.
    """
    found = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    words = tokens(F.regexp_replace("line", "#.*$", ""))
    found = found.select(key, (F.col("i") + 1).alias("line_no"), words.alias("words")).where(F.size("words") > 0)
    first = F.lower(F.get("words", 0))
    head = F.when(first.isin(*HEADS), first).when(first.rlike(r"^\d+(\.\d+)?$"), "timeline").otherwise("text")
    return found.select(key, "line_no", head.alias("head"), "words")


def frame_ops(df: DataFrame, key: str, text: str) -> DataFrame:
    """Operations of delta-coded frames: key, line_no, frame, seq, kind, shape, args.

    A frame line is ``@ number`` and operations such as ``t3 4 -5``: a letter with the shape's number,
    then whole numbers: two for t, one for r, s, o, none for h and v. An operation that is cut short is
    left out, as is one of an unknown letter.
    """
    found = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    frames = found.where(F.col("line").rlike(r"^@ \d{1,9} ")).withColumn("frame", F.regexp_extract("line", r"^@ (\d+)", 1).cast("int"))
    ops = F.regexp_extract_all(F.concat("line", F.lit(" ")), F.lit(r"t\d{1,6} -?\d{1,9} -?\d{1,9}(?= )|[rso]\d{1,6} -?\d{1,9}(?= )|[hv]\d{1,6}(?= )"), 0)
    rows = frames.select(key, (F.col("i") + 1).alias("line_no"), "frame", F.posexplode(ops).alias("seq", "op"))
    word = F.split("op", " ")
    args = F.transform(F.slice(word, 2, F.greatest(F.size(word) - 1, F.lit(0))), lambda x: x.cast("int"))
    return rows.select(key, "line_no", "frame", "seq", F.substring("op", 1, 1).alias("kind"), F.substring(word[0], 2, 9).cast("int").alias("shape"), args.alias("args"))


def trim_rounds(costs: Column, budget: int, least: int, rounds: int = 4) -> Column:
    """Frames kept by the iterative trim: while the cost is over the budget, keep shrinks to
    floor(frames x budget / cost x 0.92); null where fewer than ``least`` stay or the rounds run out.
    """
    def cost(k: Column) -> Column:
        return F.aggregate(F.slice(costs, 1, F.greatest(k, F.lit(0))), F.lit(0), lambda a, x: a + x)

    def step(keep: Column, _: Column) -> Column:
        n = cost(keep)
        new = F.when(n > budget, F.floor(keep * F.lit(budget) / n * 0.92).cast("int")).otherwise(keep)
        return F.when(new >= least, new)

    keep = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.size(costs), step)
    return F.when(cost(keep) <= budget, keep)


def generated(ids: DataFrame, key: str, seed: int) -> DataFrame:
    """A scene for every id, from hashes of seed and id alone: bg, dur, cast, timeline.

    Made again, in any partitioning, an id gives the same scene.
    """
    draw = lambda what, n: hash_bucket(F.concat(F.lit(f"{seed}:{what}:"), F.col(key).cast("string")), n).cast("int")
    pick = lambda what, values: F.element_at(F.array(*map(F.lit, values)), draw(what, len(values)) + 1)
    many = draw("cast", 4) + 1
    drawn = lambda what, i, n: hash_bucket(F.concat(F.lit(f"{seed}:{what}:"), F.col(key).cast("string"), F.lit(":"), i.cast("string")), n).cast("int")
    member = lambda i: F.struct(
        F.concat(F.lit("c"), i.cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, COLOURS)), drawn("colour", i, len(COLOURS)) + 1).alias("color"), (drawn("x", i, 93) + 4).alias("x")
    )
    event = lambda i: F.struct(
        (i * 20).alias("s"), (i * 20 + 10 + drawn("len", i, 10)).alias("e"), F.concat(F.lit("c"), F.pmod(i, many).cast("string")).alias("who"),
        F.element_at(F.array(*map(F.lit, ACTIONS)), drawn("act", i, len(ACTIONS)) + 1).alias("act"),
    )
    return ids.select(
        key, pick("bg", BACKGROUNDS).alias("bg"), (draw("dur", 100) + 60).alias("dur"),
        F.transform(F.sequence(F.lit(0), many - 1), member).alias("cast"), F.transform(F.sequence(F.lit(0), many), event).alias("timeline"),
    )


_NUMBER = regex.compile(r"-?\d+\.\d+")


def rounded_numbers(text: str, digits: int) -> str:
    """The text with its decimal numbers rounded half-even on their binary value, trailing zeros gone."""

    def plain(m) -> str:
        out = f"{round(float(m.group()), digits):.{digits}f}".rstrip("0").rstrip(".")
        return "0" if out in ("-0", "") else out

    return _NUMBER.sub(plain, text)


def spaced(xs: list[float], gap: float, low: float, high: float, sweeps: int = 200) -> list[float]:
    """Places at least ``gap`` apart as far as the frame allows, in the order they were given.

    Sorted neighbours that are too close are pushed apart by half of what is missing each, again and
    again; the row is then moved into the frame. Rounded to tenths.
    """
    if not xs:
        return []
    order = np.argsort(np.array(xs, float), kind="stable")
    x = np.array(xs, float)[order]
    gap = min(gap, (high - low) / max(1, len(x) - 1))
    for _ in range(sweeps):
        lack = gap - np.diff(x)
        if not (lack > 1e-9).any():
            break
        for i in range(len(x) - 1):
            d = gap - (x[i + 1] - x[i])
            if d > 0:
                x[i], x[i + 1] = x[i] - d / 2, x[i + 1] + d / 2
    x += max(0.0, low - x[0])
    x -= max(0.0, x[-1] - high)
    out = np.empty(len(x))
    out[order] = np.clip(x, low, high)
    return [round(float(v), 1) for v in out]


def resampled(points: list[list[float]], n: int) -> list[list[float]]:
    """n points at equal steps of arc length along the closed line through ``points``."""
    p = np.array(points, float)
    if not len(p):
        return []
    ring = np.vstack([p, p[:1]])
    along = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(ring, axis=0).T))])
    if along[-1] == 0:
        return [p[0].tolist()] * n
    at = np.arange(n) * along[-1] / n
    return np.column_stack([np.interp(at, along, ring[:, k]) for k in (0, 1)]).tolist()


def list_diff(old: list, new: list) -> list[tuple]:
    """Steps from one list to the next: ('=', n) keeps n, ('-', n) drops n, ('+', items) inserts."""
    import difflib

    steps: list[tuple] = []
    for tag, i, j, u, v in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal":
            steps.append(("=", j - i))
        else:
            if j > i:
                steps.append(("-", j - i))
            if v > u:
                steps.append(("+", new[u:v]))
    return steps


def list_patch(old: list, steps: list[tuple]) -> list:
    """The list that ``list_diff`` led to."""
    out, at = [], 0
    for kind, what in steps:
        if kind == "+":
            out += what
        else:
            out += old[at : at + what] if kind == "=" else []
            at += what
    return out


def scheduled(busy: list[tuple[int, int]], draws: list[float], span: int) -> list[tuple[int, int]]:
    """Windows in tenths that keep clear of the busy ones and of each other, up to ``span``.

    ``draws`` are numbers in [0, 1): the first is the start (up to 1.2 seconds), then every window takes
    one for its length (1.4 to 2.8 seconds) and one for the pause behind it (0.1 to 1.1 seconds). A
    window that meets a busy one starts 0.3 seconds after its end. The first that would end after
    ``span`` ends the row.
    """
    at, out = int(draws[0] * 12), []
    for length, pause in zip(draws[1::2], draws[2::2]):
        long = 14 + int(length * 15)
        while hit := max((e for s, e in busy if at < e and s < at + long), default=None):
            at = hit + 3
        if at + long > span:
            break
        out.append((at, at + long))
        at += long + 1 + int(pause * 11)
    return out


def one_action(timeline: str) -> Column:
    """The timeline with every action replaced by the first one."""
    return F.transform(timeline, lambda e: e.withField("act", F.get(F.col(timeline), 0)["act"]))


def diff_report(pair: str) -> str:
    """Of a JSON pair of lists a and b: the number of steps between them, and whether they lead from a to b."""
    import json

    both = json.loads(pair)
    a, b = both.get("a") or [], both.get("b") or []
    steps = list_diff(a, b)
    return json.dumps({"steps": len(steps), "ok": list_patch(a, steps) == b})


def map_texts(df: DataFrame, key: str, text: str, function, name: str) -> DataFrame:
    """``function`` on every text, batch by batch in Arrow; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else function(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, name])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {name} string")


def map_arrays(df: DataFrame, key: str, values: str, function, name: str) -> DataFrame:
    """``function`` on every array of numbers, batch by batch in Arrow; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else function(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, name])

    return df.select(key, values).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {name} array<double>")

