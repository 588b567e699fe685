"""The one-line scene language: strict parse, text form, validation, repair, match, layout, staging.

A scene is ``bg B dur D | cast id colour x scale ; ... | prop kind x scale ; ... | tl s e who act ...``.
Places and times stay in tenths and scales in hundredths, as written, so nothing is rounded. All
rules are array expressions on one row; no scene meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinolith.functions.text import tokens

#: The vocabulary and limits of the language.
BACKGROUNDS = ("park", "night", "studio")
COLOURS = ("cyan", "orange", "pink", "lime", "violet", "amber", "white", "green", "blue", "red")
PROPS = ("tree", "bush", "rock", "box", "cloud", "sun", "ball")
MOVES = ("walk", "run")
ACTIONS = ("walk", "run", "jump", "wave", "dance", "idle", "kick")
LEFT, RIGHT, WIDTH, MAX_CAST = 4, 96, 100, 8

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"


def _quoted(words: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(words, lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", "), F.lit("]"))


def _number_error(*words: Column) -> Column:
    """Message of the first word that is no number, null if all are."""
    return F.coalesce(*[F.when(~w.rlike(NUMBER), F.concat(F.lit("not a number: '"), w, F.lit("'"))) for w in words])


def _value(w: Column) -> Column:
    return w.try_cast("double")


def parse(df: DataFrame, raw: str) -> DataFrame:
    """Add bg, dur, cast, props, timeline and parse_error (the first fault, null for none) of a text.

    Strict: any fault leaves the fields null. Null and blank texts are 'empty output'. An event needs
    four words; a walk or run may name its target, a kick its prop and target. Columns of the same
    names are replaced.
    """
    parts = F.transform(F.split(F.coalesce(F.col(raw), F.lit("")), r"\|"), lambda p: F.trim(p))
    df = df.withColumn("_parts", parts).withColumn("_head", tokens(F.col("_parts")[0]))
    sections = F.filter(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), lambda p: F.size(tokens(p)) > 0)

    def section(p: Column) -> Column:
        body = F.regexp_replace(F.trim(p), r"^\S+\s*", "")
        items = F.filter(F.transform(F.split(body, ";"), tokens), lambda w: F.size(w) > 0)
        return F.struct(tokens(p)[0].alias("kind"), items.alias("items"))

    df = df.withColumn("_sections", F.transform(sections, section))

    def fault(kind: Column, it: Column) -> Column:
        n = F.size(it)
        cast = F.when(n != 4, F.concat(F.lit("bad cast entry "), _quoted(it))).otherwise(_number_error(F.get(it, 2), F.get(it, 3)))
        prop = F.when(n != 3, F.concat(F.lit("bad prop entry "), _quoted(it))).otherwise(_number_error(F.get(it, 1), F.get(it, 2)))
        moving = F.get(it, 3).isin(*MOVES) & (n > 4)
        event = F.when(n < 4, F.concat(F.lit("bad event "), _quoted(it))).otherwise(
            F.coalesce(_number_error(F.get(it, 0), F.get(it, 1)), F.when(moving, _number_error(F.get(it, 4))))
        )
        return F.when(kind == "cast", cast).when(kind == "prop", prop).when(kind == "tl", event)

    def faults(s: Column) -> Column:
        known = s["kind"].isin("cast", "prop", "tl")
        unknown = F.array(F.concat(F.lit("unknown section '"), s["kind"], F.lit("'")))
        return F.when(known, F.array_compact(F.transform(s["items"], lambda it: fault(s["kind"], it)))).otherwise(unknown)

    entries = lambda kind: F.flatten(F.transform(F.filter("_sections", lambda s: s["kind"] == kind), lambda s: s["items"]))
    head_ok = (F.size("_head") >= 4) & (F.get("_head", 0) == "bg") & (F.get("_head", 2) == "dur")
    error = F.coalesce(
        F.when(F.size(tokens(F.col(raw))) == 0, "empty output"),
        F.when(F.size("_parts") < 2, "fewer than 2 sections"),
        F.when(~head_ok, F.concat(F.lit("bad header '"), F.col("_parts")[0], F.lit("'"))),
        _number_error(F.get("_head", 3)),
        F.get(F.flatten(F.transform("_sections", faults)), 0),
        F.when(F.size(entries("cast")) == 0, "empty cast"),
    )
    actor = lambda w: F.struct(w[0].alias("id"), w[1].alias("color"), _value(w[2]).alias("x"), _value(w[3]).alias("scale"))
    thing = lambda w: F.struct(w[0].alias("kind"), _value(w[1]).alias("x"), _value(w[2]).alias("scale"))

    def event(w: Column) -> Column:
        kick = w[3] == "kick"
        return F.struct(
            _value(w[0]).alias("s"), _value(w[1]).alias("e"), w[2].alias("who"), w[3].alias("act"),
            F.when(w[3].isin(*MOVES), _value(F.get(w, 4))).alias("to"),
            F.when(kick, F.coalesce(F.get(w, 4), F.lit("ball"))).alias("prop"),
            F.when(kick, F.coalesce(F.get(w, 5), F.lit(""))).alias("target"),
        )

    ok = F.col("parse_error").isNull()
    df = df.withColumn("parse_error", error)
    df = df.withColumn("bg", F.when(ok, F.get("_head", 1))).withColumn("dur", F.when(ok, _value(F.get("_head", 3))))
    df = df.withColumn("cast", F.when(ok, F.transform(entries("cast"), actor))).withColumn("props", F.when(ok, F.transform(entries("prop"), thing)))
    return df.withColumn("timeline", F.when(ok, F.transform(entries("tl"), event))).drop("_parts", "_head", "_sections")


def text_of() -> Column:
    """The text form of the columns bg, dur, cast, props, timeline; whole numbers as written."""
    number = lambda v: F.rint(v).cast("bigint").cast("string")
    cast = F.array_join(F.transform("cast", lambda c: F.concat_ws(" ", c["id"], c["color"], number(c["x"]), number(c["scale"]))), " ; ")
    props = F.array_join(F.transform("props", lambda p: F.concat_ws(" ", p["kind"], number(p["x"]), number(p["scale"]))), " ; ")
    event = lambda e: F.rtrim(F.concat_ws(" ", number(e["s"]), number(e["e"]), e["who"], e["act"], number(e["to"]), e["prop"], e["target"]))
    return F.concat(
        F.lit("bg "), "bg", F.lit(" dur "), number(F.col("dur")), F.lit(" | cast "), cast, F.lit(" | prop "), props,
        F.lit(" | tl "), F.array_join(F.transform("timeline", event), " ; "),
    )


def problems() -> Column:
    """Structural problems of a parsed scene, in the order of the rules; empty where it is sound."""
    ids, colours = F.col("cast.id"), F.col("cast.color")
    each = lambda a, rule, name: F.transform(F.filter(a, lambda x: rule(x)), lambda x: F.lit(name))
    one = lambda rule, name: F.when(rule, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    ball = F.exists("props", lambda p: p["kind"] == "ball")
    kicks = F.array_sort(F.transform(F.filter("timeline", lambda e: e["act"] == "kick"), lambda e: F.struct(e["s"], e["e"])))
    pairs = F.transform(kicks, lambda k, i: F.coalesce(F.get(kicks, i + 1)["s"] < k["e"], F.lit(False)))
    lost = lambda e: (e["act"] == "kick") & (e["target"] != "") & ~F.array_contains(ids, e["target"]) & ~e["target"].rlike(NUMBER)
    found = [
        one(~F.col("bg").isin(*BACKGROUNDS), "background"),
        one(~F.col("dur").between(20, 400), "duration"),
        one(F.size(F.array_distinct(ids)) != F.size("cast"), "duplicate cast id"),
        one(~F.size("cast").between(1, MAX_CAST), "cast size"),
        each("cast", lambda c: ~c["color"].isin(*COLOURS), "colour"),
        each("cast", lambda c: ~c["x"].between(LEFT, RIGHT), "off frame"),
        each("cast", lambda c: ~c["scale"].between(40, 120), "scale"),
        one(F.size(F.array_distinct(colours)) != F.size("cast"), "two characters share a colour"),
        each("props", lambda p: ~p["kind"].isin(*PROPS), "prop"),
        each("props", lambda p: ~p["x"].between(0, WIDTH), "prop off frame"),
        each("timeline", lambda e: ~F.array_contains(ids, e["who"]), "unknown actor"),
        each("timeline", lambda e: ~e["act"].isin(*ACTIONS), "unknown action"),
        each("timeline", lambda e: ~((e["e"] > e["s"]) & (e["s"] >= 0)), "bad window"),
        each("timeline", lambda e: e["e"] > F.col("dur"), "window past duration"),
        each("timeline", lambda e: ~F.coalesce(e["to"].between(LEFT, RIGHT), F.lit(True)), "target off frame"),
        each("timeline", lambda e: (e["act"] == "kick") & ~ball, "kick without ball"),
        each("timeline", lost, "kick target"),
        F.transform(F.filter(ids, lambda i: ~F.exists("timeline", lambda e: e["who"] == i)), lambda i: F.lit("mannequin")),
        F.transform(F.filter(pairs, lambda p: p), lambda p: F.lit("overlapping kicks")),
    ]
    return F.concat(*found)


def repair(df: DataFrame) -> DataFrame:
    """Make parsed scenes sound as far as the rules reach, and add ``changes``.

    Unknown backgrounds become park; later members of one id and those past the eighth go; a colour
    that is unknown or taken becomes the first free one; places and scales are clamped; unknown props
    and events of unknown actors go; unknown actions become idle; empty windows get 1.5 seconds; a
    kick brings a ball and a target; the duration reaches 0.3 seconds past the last end, between 2
    and 40 seconds; members without an event get an idle one. Overlapping kicks are left.
    """
    no = F.array().cast("array<string>")
    note = lambda rule, name: F.when(rule, F.array(F.lit(name))).otherwise(no)
    kind = "array<struct<id:string,color:string,x:double,scale:double>>"
    first = F.filter(F.slice("cast", 1, MAX_CAST), lambda c, i: F.array_position(F.slice("cast.id", 1, MAX_CAST), c["id"]) == i + 1)

    def recolour(state: Column, c: Column) -> Column:
        taken = state["color"]
        free = F.array_except(F.array(*map(F.lit, COLOURS)), taken)[0]
        colour = F.when(c["color"].isin(*COLOURS) & ~F.array_contains(taken, c["color"]), c["color"]).otherwise(free)
        clamp = lambda v, a, b: F.least(F.greatest(v, F.lit(float(a))), F.lit(float(b)))
        new = F.struct(c["id"].alias("id"), colour.alias("color"), clamp(c["x"], LEFT, RIGHT).alias("x"), clamp(c["scale"], 45, 120).alias("scale"))
        return F.concat(state, F.array(new))

    out = df.withColumn("_cast", F.aggregate(first, F.array().cast(kind), recolour))
    colours = F.transform(first, lambda c, i: c["color"] != F.col("_cast")[i]["color"])
    ids = F.col("_cast.id")
    out = out.withColumn("_kept", F.filter("timeline", lambda e: F.array_contains(ids, e["who"])))

    def mended(e: Column) -> Column:
        act = F.when(e["act"].isin(*ACTIONS), e["act"]).otherwise("idle")
        others = F.filter(ids, lambda i: i != e["who"])
        aim = F.when(F.array_contains(ids, e["target"]) | e["target"].rlike(NUMBER), e["target"]).otherwise(F.coalesce(F.get(others, 0), F.lit("50")))
        return F.struct(
            e["s"].alias("s"), F.when(e["e"] <= e["s"], e["s"] + 15).otherwise(e["e"]).alias("e"), e["who"].alias("who"), act.alias("act"),
            F.when(e["to"].isNotNull(), F.least(F.greatest(e["to"], F.lit(float(LEFT))), F.lit(float(RIGHT)))).alias("to"),
            e["prop"].alias("prop"), F.when(act == "kick", aim).alias("target"),
        )

    out = out.withColumn("_events", F.transform("_kept", mended))
    by_start = F.transform(F.array_sort(F.transform("_events", lambda e, i: F.struct(e["s"].alias("k"), i.alias("i"), e.alias("e")))), lambda x: x["e"])
    good = F.filter("props", lambda p: p["kind"].isin(*PROPS))
    good = F.transform(good, lambda p: F.struct(p["kind"].alias("kind"), F.least(F.greatest(p["x"], F.lit(0.0)), F.lit(float(WIDTH))).alias("x"), F.least(F.greatest(p["scale"], F.lit(30.0)), F.lit(200.0)).alias("scale")))
    needs = F.exists("_events", lambda e: e["act"] == "kick") & ~F.exists("props", lambda p: p["kind"] == "ball")
    ball = F.array(F.struct(F.lit("ball").alias("kind"), F.lit(50.0).alias("x"), F.lit(100.0).alias("scale")))
    last = F.greatest(F.coalesce(F.array_max(F.transform("_events", lambda e: e["e"])), F.lit(30.0)), F.lit(30.0)) + 3
    dur = F.least(F.greatest(F.greatest("dur", last), F.lit(20.0)), F.lit(400.0))
    out = out.withColumn("_dur", dur)
    idle = lambda i: F.struct(
        F.lit(0.0).alias("s"), F.col("_dur").alias("e"), i.alias("who"), F.lit("idle").alias("act"), F.lit(None).cast("double").alias("to"),
        F.lit(None).cast("string").alias("prop"), F.lit(None).cast("string").alias("target"),
    )
    still = F.filter(ids, lambda i: ~F.exists("_events", lambda e: e["who"] == i))
    changes = F.concat(
        note(~F.col("bg").isin(*BACKGROUNDS), "background"),
        note(F.size(first) < F.size("cast"), "cast cut"),
        note(F.exists(colours, lambda x: x), "colour"),
        note(F.size(F.filter("props", lambda p: p["kind"].isin(*PROPS))) < F.size("props"), "prop dropped"),
        note(F.size("_kept") < F.size("timeline"), "event dropped"),
        note(F.exists("_kept", lambda e: ~e["act"].isin(*ACTIONS)), "action"),
        note(F.exists("_kept", lambda e: e["e"] <= e["s"]), "window"),
        note(needs, "ball added"),
        note(F.col("dur") < last, "duration"),
        note(F.size(still) > 0, "idle added"),
    )
    return out.select(
        *[c for c in df.columns if c not in ("bg", "dur", "cast", "props", "timeline")],
        F.when(F.col("bg").isin(*BACKGROUNDS), F.col("bg")).otherwise("park").alias("bg"), F.col("_dur").alias("dur"), F.col("_cast").alias("cast"),
        F.when(needs, F.concat(good, ball)).otherwise(good).alias("props"),
        F.concat(by_start, F.transform(still, idle)).alias("timeline"), changes.alias("changes"),
    )


def stated_match(intent: str) -> dict[str, Column]:
    """Flags of the fields that an intent states against the parsed scene; null where it states nothing."""
    want = lambda f: F.col(f"{intent}.{f}")
    acts = F.transform("timeline", lambda e: e["act"])
    kinds = F.transform("props", lambda p: p["kind"])
    return {
        "cast_count": F.size("cast") == want("n_cast"),
        "background": F.when(want("bg") != "", F.col("bg") == want("bg")),
        "actions_present": F.when(F.size(want("acts_any")) > 0, F.forall(want("acts_any"), lambda a: F.array_contains(acts, a))),
        "ball_interaction": want("kick") == F.array_contains(acts, "kick"),
        "props_present": F.when(F.size(want("props")) > 0, F.forall(want("props"), lambda p: F.array_contains(kinds, p))),
        "colors": F.when(
            F.size(want("colors")) > 0,
            F.forall(F.map_entries(want("colors")), lambda c: F.coalesce(F.get("cast", c["key"].try_cast("int"))["color"] == c["value"], F.lit(False))),
        ),
    }


def layout() -> dict[str, Column]:
    """Places (from 0) of the leftmost, rightmost, back and front member; the first on ties."""
    xs, ss = F.col("cast.x"), F.col("cast.scale")
    at = lambda values, value: (F.array_position(values, value) - 1).cast("int")
    return {
        "leftmost": at(xs, F.array_min(xs)), "rightmost": at(xs, F.array_max(xs)), "back": at(ss, F.array_min(ss)), "front": at(ss, F.array_max(ss)),
        "span": F.array_max(xs) - F.array_min(xs),
    }


def staging(span_target: float = 60.0) -> dict[str, Column]:
    """Smallest gap between members, their span against a target and the evenness of the gaps; null for one member."""
    xs = F.array_sort("cast.x")
    gaps = F.transform(F.sequence(F.lit(0), F.size(xs) - 2), lambda i: F.get(xs, i + 1) - F.get(xs, i))
    gaps = F.when(F.size("cast") > 1, gaps)
    even = (F.array_max(xs) - F.array_min(xs)) / F.greatest(F.size(xs) - 1, F.lit(1))
    rmse = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, g: a + (g - even) * (g - even)) / F.greatest(F.size(xs) - 1, F.lit(1)))
    return {
        "min_sep": F.array_min(gaps) / 10,
        "span_frac": F.when(F.size("cast") > 1, F.round((F.array_max(xs) - F.array_min(xs)) / span_target, 6)),
        "evenness": F.round(rmse, 6),
    }
