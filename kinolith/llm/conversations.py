"""Conversations rebuilt from message rows by keyed streaming state.

Two streaming queries, as one may hold a single step of this kind; a table joins them. The first, keyed by a hash of the message id, knows
every id's earliest time: it passes a message on once, and once more only if an earlier time turns
up later. The second, keyed by a hash of chat and hour, buffers the hour's messages in its state while the
event-time watermark has not passed them by the allowed delay; on this timeout, or when a closing
mark ends the stream, it orders the turns, drops repeats, checks that the speakers alternate and
emits the hour as one segment. A row that comes after its hour was closed opens the hour again and
emits a further segment, marked as amended. No chat meets one state: the busiest chat is spread
over its hours. Segments of a chat are then joined at their ends; chats with an amended segment
are checked again from their turns.

Message rows carry no watermark of their own (marks do, which run beside them), so no row is ever
too late to count.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinolith.functions.clean import epoch_micros, strip_invisible
from kinolith.session import scratch_path
from kinolith.streaming.ingest import stream_of

#: Microseconds of a state's time slot, and for how long a repeated text is no further turn.
SLOT, REPEAT = 3_600_000_000, 2_000_000
#: Event time by which a message may come late before its hour is closed.
DELAY = "1 hour"
#: Message rows of one state of either step, on average.
BUCKET_ROWS = 20_000

#: Spellings of the roles, in lower case.
USER = ("user", "usr", "human")
ASSISTANT = ("assistant", "asst", "bot", "ai", "model")
SYSTEM = ("system", "sys")

_COLUMNS = ("id", "chat_id", "role", "content", "created")


def speaker(role: Column) -> Column:
    """user, assistant or system; null where the role means none of them."""
    name = F.lower(strip_invisible(role))
    return (
        F.when(name.isin(*USER), "user").when(name.isin(*ASSISTANT), "assistant").when(name.isin(*SYSTEM), "system")
    )


def _first_times(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows with the earliest known time of their id, unless passed on before."""
    known: dict = pickle.loads(state.get[0]) if state.exists else {}
    best: dict = {}
    for chunk in chunks:
        for row in chunk.itertuples(index=False):
            t = None if pd.isna(row.t) else int(row.t)
            held = best.get(row.id)
            if held is None or (t is not None and (held[0] is None or t < held[0])):
                best[row.id] = (t, row)
    out = []
    # types are stated, as a batch may hold no time or no text at all
    for i, (t, row) in best.items():
        before = known.get(i, False)
        if before is False or (t is not None and (before is None or t < before)):
            known[i] = t
            out.append((i, row.chat_id, row.speaker, row.content, t, before is not False))
    state.update((pickle.dumps(known),))
    yield pd.DataFrame(out, columns=["id", "chat_id", "speaker", "content", "t", "amended"]).astype({"t": "Int64"})


_FIRST = "id string, chat_id string, speaker string, content string, t bigint, amended boolean"
_SEGMENT_COLUMNS = ("chat_id", "slot", "part", "amended", "n_turns", "flaw", "first_role", "last_role", "turns")
_SEGMENT = (
    "chat_id string, slot bigint, part int, amended boolean, n_turns int, flaw string, first_role string, last_role string,"
    " turns array<struct<t:bigint,speaker:string,id:string,content:string>>"
)


def ordered_turns(rows: list[tuple], slot: int | None) -> list[tuple]:
    """Turns (t, speaker, id, content) of a slot: by time, the user first at equal times, without repeats.

    ``rows`` also hold the last two seconds of the slot before, which only tell repeats.
    """
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] != "user", r[1] or "", r[3], r[2]))
    seen: dict = {}
    turns = []
    for r in rows:
        t, who, _, text = r
        last = seen.get((who, text))
        if t is not None:
            seen[who, text] = t
            if t // SLOT != slot or (last is not None and t - last <= REPEAT):
                continue
        turns.append(r)
    return turns


def flaw_of(turns: list[tuple]) -> str | None:
    """What breaks the turns by themselves: no time, no role, or a speaker twice in a row."""
    if any(t[0] is None for t in turns):
        return "no time"
    if any(t[1] is None for t in turns):
        return "no role"
    if any(a[1] == b[1] for a, b in zip(turns, turns[1:])):
        return "no alternation"
    return None


def _segment(chat: str, slot: int | None, part: int, amended: bool, rows: list[tuple]) -> tuple:
    """One row of ``_SEGMENT``."""
    turns = ordered_turns(rows, slot)
    ends = (turns[0][1], turns[-1][1]) if turns else (None, None)
    held = [{"t": t, "speaker": w, "id": i, "content": c} for t, w, i, c in turns]
    return (chat, slot, part, amended, len(turns), flaw_of(turns), *ends, held)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_SEGMENT_COLUMNS).astype({"slot": "Int64"})


def _segments(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Buffer chat hours; emit each as a segment once the watermark has passed it."""
    hours: dict = pickle.loads(state.get[0]) if state.exists else {}
    if not state.hasTimedOut:
        for chunk in chunks:
            for r in chunk.itertuples(index=False):
                hour = hours.setdefault((r.chat_id, None if pd.isna(r.slot) else int(r.slot)), [0, False, []])
                hour[1] = hour[1] or bool(r.amended)
                hour[2].append((None if pd.isna(r.t) else int(r.t), r.speaker, r.id, r.content))
    now = state.getCurrentWatermarkMs()
    ends = {k: 1 if k[1] is None else max(1, (k[1] + 1) * SLOT // 1000) for k, hour in hours.items() if hour[2]}
    # on a timeout, or at once where the watermark is past the hour already
    done = [k for k, end in ends.items() if end <= now]
    if done:
        yield _frame([_segment(*k, hours[k][0], hours[k][1] or hours[k][0] > 0, hours[k][2]) for k in done])
    for k in done:
        # the hour stays known, so that a later row is told to amend it
        hours[k] = [hours[k][0] + 1, False, []]
        del ends[k]
    state.update((pickle.dumps(hours),))
    if ends:
        state.setTimeoutTimestamp(max(min(ends.values()), now + 1))


def _mark_folder(spark: SparkSession) -> str:
    """A stream of one row whose event time is past all others: it closes what is open."""
    folder = scratch_path(spark, "closing-mark")
    spark.sql("SELECT timestamp_micros(32503680000000000) AS mark").write.parquet(folder)
    return folder


def message_stream(spark: SparkSession, path: str) -> DataFrame:
    """The messages under ``path`` (a parquet file or folder) as a stream."""
    return stream_of(spark, path, *_COLUMNS)


def _run(stream: DataFrame, folder: str, name: str) -> None:
    """Append what the stream yields of the input that is there to a table of ``folder``."""
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/{name}")
    sink = sink.option("checkpointLocation", f"{folder}/checkpoint-{name}").outputMode("append")
    sink.trigger(availableNow=True).start().awaitTermination()


def segments(messages: DataFrame, n_buckets: int, contents: bool, folder: str, close: bool = True) -> DataFrame:
    """Run the stream of ``messages`` to its end and return the segments it wrote to ``folder``.

    With ``contents`` false, texts are replaced by a hash of theirs before they reach any state.
    A second call with the same folder goes on from where the last one ended. With ``close`` a mark past
    all times ends the stream and closes every hour; without it, hours stay open until later messages
    have moved the watermark past them.
    """
    spark = messages.sparkSession
    text = strip_invisible(F.col("content"))
    who = speaker(F.col("role"))
    counted = F.col("chat_id").isNotNull() & (text != "") & (F.coalesce(who, F.lit("")) != "system")
    turns = messages.where(counted).select(
        # a row without an id is told by all it holds
        F.coalesce(F.col("id"), F.concat(F.lit("\u0000"), F.hex(F.xxhash64("chat_id", "role", "content", "created")))).alias("id"),
        "chat_id",
        who.alias("speaker"),
        (text if contents else F.hex(F.xxhash64(text))).alias("content"),
        epoch_micros(F.col("created")).alias("t"),
    )
    first = (
        turns.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(n_buckets)))
        .groupBy("bucket")
        .applyInPandasWithState(_first_times, _FIRST, "known binary", "append", GroupStateTimeout.NoTimeout)
    )
    _run(first, folder, "messages")

    first = spark.readStream.schema(_FIRST).parquet(f"{folder}/messages")
    slot = F.expr(f"(t - pmod(t, {SLOT})) div {SLOT}")
    near = F.pmod("t", F.lit(SLOT)) >= SLOT - REPEAT
    first = first.withColumn("slot", F.explode(F.when(near, F.array(slot, slot + 1)).otherwise(F.array(slot))))
    # every message beside a mark: the marks move the watermark and go no further
    no_mark = F.lit(None).cast("timestamp")
    pair = F.when(F.col("t").isNull(), F.array(no_mark)).otherwise(F.array(no_mark, F.timestamp_micros("t")))
    marked = first.select("*", F.explode(pair).alias("mark"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema.fields]
    if close:
        marks = spark.readStream.schema("mark timestamp").parquet(_mark_folder(spark)).select(*empty, "mark")
        marked = marked.unionByName(marks)
    dealt = marked.withColumn("bucket", F.pmod(F.xxhash64("chat_id", "slot"), F.lit(n_buckets)))
    keyed = dealt.withWatermark("mark", DELAY).where("mark IS NULL").groupBy("bucket")
    found = keyed.applyInPandasWithState(_segments, _SEGMENT, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    _run(found, folder, "segments")
    return spark.read.schema(_SEGMENT).parquet(f"{folder}/segments")


def _stitched(found: DataFrame) -> DataFrame:
    """Chats of unamended segments: chat_id, n_turns, flaw (null for a sound conversation).

    A chat has a row a segment here, not a row a message; each meets its predecessor only.
    """
    full = found.where("n_turns > 0")
    by_time = Window.partitionBy("chat_id").orderBy(F.col("slot").asc_nulls_last())
    joint = F.when(F.lag("last_role").over(by_time) == F.col("first_role"), "no alternation")
    first = F.when(F.row_number().over(by_time) == 1, F.col("first_role"))
    last = F.when(F.lead("n_turns").over(by_time).isNull(), F.col("last_role"))
    chats = (
        full.select("chat_id", "n_turns", "flaw", joint.alias("joint"), first.alias("first"), last.alias("last"))
        .groupBy("chat_id")
        .agg(
            F.sum("n_turns").alias("n_turns"),
            F.max("flaw").alias("flaw"),  # no time before no role before no alternation
            F.min("joint").alias("joint"),
            F.max("first").alias("first"),
            F.max("last").alias("last"),
        )
    )
    ends = F.when(F.col("first") != "user", "no request first").when(F.col("last") != "assistant", "no reply last")
    return chats.select("chat_id", "n_turns", F.coalesce("flaw", "joint", ends).alias("flaw"))


def _renewed(found: DataFrame) -> DataFrame:
    """Segments of amended chats, made again from all turns these ever had, each at its earliest time."""
    turns = found.select("chat_id", F.explode("turns").alias("m")).select("chat_id", "m.*")
    best = turns.groupBy("chat_id", "id").agg(
        F.min_by(F.struct("t", "speaker", "content"), F.coalesce("t", F.lit(1 << 62))).alias("m")
    )
    slot = F.expr(f"(m.t - pmod(m.t, {SLOT})) div {SLOT}")
    near = F.pmod("m.t", F.lit(SLOT)) >= SLOT - REPEAT
    dealt = best.select("chat_id", "id", "m.*", F.explode(F.when(near, F.array(slot, slot + 1)).otherwise(F.array(slot))).alias("slot"))

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        number = lambda x: None if pd.isna(x) else int(x)
        held = [(number(r.t), r.speaker, r.id, r.content) for r in rows.itertuples(index=False)]
        return _frame([_segment(key[0], number(key[1]), 0, False, held)])

    return dealt.groupBy("chat_id", "slot").applyInPandas(again, _SEGMENT)


def whole_segments(found: DataFrame) -> DataFrame:
    """Segments of all chats, those of amended chats made anew."""
    late = found.where("amended").select("chat_id").distinct()
    return found.join(late, "chat_id", "left_anti").unionByName(_renewed(found.join(late, "chat_id", "left_semi")))


def rebuild(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """Segments of all chats in the messages under ``path``."""
    n_buckets = max(16, -(-spark.read.parquet(path).count() // BUCKET_ROWS))
    found = segments(message_stream(spark, path), n_buckets, contents, scratch_path(spark, "conversations"))
    return whole_segments(found)


def verdicts(found: DataFrame, messages: DataFrame, chats: DataFrame) -> DataFrame:
    """Every chat of ``chats`` or ``messages``: chat_id, n_turns, flaw; flaw is null where it is sound.

    flaw, the first that holds: empty (no turns), no time, no role, no alternation, no request first, no
    reply last.
    Null chat ids name no chat. Blank and null contents and system rows are no turns; rows of one id
    count once, at their earliest known time; a text repeated by its speaker within two seconds is no
    further turn. Rows without an id are told apart by their contents. Empty tables give no rows.
    """
    known = messages.select("chat_id").unionByName(chats.select(F.col("id").alias("chat_id"))).where("chat_id IS NOT NULL").distinct()
    judged = _stitched(found)
    joined = known.join(judged, "chat_id", "left")
    flaw = F.when(F.col("n_turns").isNull(), "empty").otherwise(F.col("flaw"))
    return joined.select("chat_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), flaw.alias("flaw"))


def conversations(found: DataFrame) -> DataFrame:
    """Turns of the sound conversations: chat_id, turn_no (from 1), speaker, at_micros, content."""
    sound = _stitched(found).where("flaw IS NULL").select("chat_id")
    kept = found.where("n_turns > 0").join(sound, "chat_id", "left_semi")
    before = Window.partitionBy("chat_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.select("chat_id", "turns", F.coalesce(F.sum("n_turns").over(before), F.lit(0)).alias("base"))
    turns = placed.select("chat_id", "base", F.posexplode("turns").alias("i", "m"))
    return turns.select(
        "chat_id", (F.col("base") + F.col("i") + 1).alias("turn_no"), "m.speaker", F.col("m.t").alias("at_micros"), "m.content"
    )
