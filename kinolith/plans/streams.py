"""Queries that run a stream to the end of its input and return the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolith.functions.text import clean
from kinolith.operators.corpus import reject_cascade
from kinolith.session import scratch_path
from kinolith.streaming.folds import smooth
from kinolith.streaming.ingest import ingest, stream_of


def stream_ingest(spark, sf):
    """Documents with their reject reason, ingested file by file."""

    def step(df):
        rules = (("no text", F.col("text").isNull()), ("short", F.length(clean(F.col("text"))) < 15), ("no scene", F.col("scene_name").isNull()))
        return reject_cascade(df, *rules).select("doc_id", "reason")

    return ingest(stream_of(spark, f"{sf}/documents.parquet", "doc_id", "text", "scene_name"), step, scratch_path(spark, "ingest"))


def stream_ema(spark, sf):
    """Smoothed level of each user's events after the last batch."""
    stream = stream_of(spark, f"{sf}/events.parquet", "user_id", "ts", "event_id", "value")
    levels = ingest(stream, lambda df: smooth(df, "user_id", ["ts", "event_id"], "value", 0.5), scratch_path(spark, "ema"))
    last = levels.groupBy("user_id").agg(F.max_by("level", "n").alias("level"), F.max("n").alias("n"))
    return last.select("user_id", F.round("level", 6).alias("level"), "n")


QUERIES = {"stream_ingest": stream_ingest, "stream_ema": stream_ema}

ORACLE = {
    "stream_ingest": r"""SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN length(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'), ' ')) < 15 THEN 'short' WHEN scene_name IS NULL THEN 'no scene' END AS reason FROM documents""",
    "stream_ema": "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, v: coalesce(s + (v - s) * 0.5, v, s)), 6) AS level, count(*) AS n FROM events GROUP BY 1",
}
