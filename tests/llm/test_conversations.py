"""Conversations on late, repeated, timeless and roleless rows; the stream against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from kinolith.llm import conversations as C
from kinolith.session import scratch_path

SCHEMA = "id string, chat_id string, role string, content string, created double"
T = 1_735_689_600.0


def verdicts(spark, rows, chats=(), contents=False):
    path = scratch_path(spark, "messages")
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(path)
    found = C.rebuild(spark, path, contents)
    listed = spark.createDataFrame([(c,) for c in chats], "id string")
    return found, {r.chat_id: r.flaw for r in C.verdicts(found, df, listed).collect()}


def test_each_flaw_has_its_name(spark):
    rows = [
        ("1", "sound", " USER", "hi", T), ("2", "sound", "bot", "yes", T), ("3", "sound", "system", "x", T + 1),
        ("4", "blank", "user", "​", T), ("5", "late", "user", "a", T), ("6", "late", "ai", "b", None),
        ("7", "role", "user", "a", T), ("8", "role", "?", "b", T + 5), ("9", "first", "ai", "a", T), ("10", "first", "user", "b", T + 1), ("11", "first", "ai", "c", T + 2),
        ("12", "reply", "human", "a", T), ("13", "twice", "user", "a", T), ("14", "twice", "user", "b", T + 1), ("15", "twice", "ai", "c", T + 2),
        (None, None, "user", "a", T),
    ]
    _, found = verdicts(spark, rows, ["empty", "sound", None])
    assert found == {"sound": None, "blank": "empty", "empty": "empty", "late": "no time", "role": "no role", "first": "no request first", "reply": "no reply last", "twice": "no alternation"}


def test_repeats_units_and_hour_borders(spark):
    edge = T + 3599.5
    rows = [
        # one message delivered twice, the second time a day later; times in ms and us
        ("1", "a", "user", "q", T), ("1", "a", "user", "q", T + 86_400), ("2", "a", "assistant", "r", (T + 5) * 1e3),
        # submitted twice across the end of an hour, within two seconds
        ("3", "b", "user", "q", edge), ("4", "b", "usr", " q ", edge + 1.5), ("5", "b", "assistant", "r", (edge + 3) * 1e6),
        # the same text after more than two seconds is a turn
        ("6", "c", "user", "q", edge), ("7", "c", "user", "q", edge + 2.5), ("8", "c", "assistant", "r", edge + 9),
        # no time on one delivery, a time on the other
        ("9", "d", "user", "q", None), ("9", "d", "user", "q", T), ("10", "d", "assistant", "r", T + 1),
        # rows without an id
        (None, "e", "user", "q", T), (None, "e", "user", "q", T), (None, "e", "assistant", "r", T + 3),
    ]
    found, flaws = verdicts(spark, rows, contents=True)
    assert flaws == {"a": None, "b": None, "c": "no alternation", "d": None, "e": None}
    turns = [tuple(r) for r in C.conversations(found).where("chat_id = 'b'").select("turn_no", "speaker", "content").orderBy("turn_no").collect()]
    assert turns == [(1, "user", "q"), (2, "assistant", "r")]


def test_a_row_that_comes_after_its_hour_was_closed_amends_the_chat(spark):
    path, folder = scratch_path(spark, "messages"), scratch_path(spark, "stream")
    spark.createDataFrame([("1", "a", "user", "q", T), ("2", "a", "ai", "r", T + 60), ("3", "b", "user", "q", T)], SCHEMA).write.parquet(path)
    C.segments(C.message_stream(spark, path), 2, False, folder)
    # late: a turn between, a reply in another hour, an earlier time of a known message
    spark.createDataFrame([("4", "a", "user", "q2", T + 30), ("5", "b", "ai", "r", T + 7200), ("3", "b", "user", "q", T - 7200)], SCHEMA).write.mode("append").parquet(path)
    found = C.segments(C.message_stream(spark, path), 2, False, folder)
    flaws = {r.chat_id: r.flaw for r in C._stitched(C.whole_segments(found)).collect()}
    assert flaws == {"a": "no alternation", "b": None}


def test_stream_equals_brute_force_with_a_hot_chat(spark):
    rng = random.Random(3)
    rows, turns = [], {}
    for i in range(1500):
        chat = "hot" if i % 3 == 0 else f"c{rng.randint(0, 120)}"
        turns.setdefault(chat, []).append(i)
    for chat, ids in turns.items():
        t = T + rng.randint(0, 10_000)
        for k, i in enumerate(ids):
            t += rng.choice([5, 60, 4000])
            rows.append((str(i), chat, "user" if (k % 2 == 0) != (rng.random() < 0.004) else "assistant", f"m{i}", t))
    rng.shuffle(rows)
    _, found = verdicts(spark, rows)
    for chat in turns:
        roles = [r[2] for r in sorted((r for r in rows if r[1] == chat), key=lambda r: r[4])]
        sound = roles[0] == "user" and roles[-1] == "assistant" and all(a != b for a, b in zip(roles, roles[1:]))
        assert (found[chat] is None) == sound


def test_empty_tables(spark):
    _, found = verdicts(spark, [])
    assert found == {}


@pytest.mark.parametrize("text", ["User", "HUMAN ", "usr"])
def test_speakers(spark, text):
    assert spark.createDataFrame([(text,)], "r string").select(C.speaker(F.col("r"))).first()[0] == "user"
