"""Queries that write with a sink and read back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolith.session import scratch_path
from kinolith.sources import files
from kinolith.sources.tables import table


def json_shards(spark, sf):
    """Documents written as gzip JSON shards by source, twice; the second run adds nothing."""
    path = scratch_path(spark, "shards")
    df = table(spark, sf, "documents", "doc_id", "source", "text").where("source IS NOT NULL")
    for _ in range(2):
        files.write_shards(df, path, "source")
    back = files.json_lines(spark, path, "doc_id bigint, text string, source string")
    return back.select("doc_id", "source", F.md5("text").alias("text_md5"))


def split_sink(spark, sf):
    path = scratch_path(spark, "split")
    files.write_split(table(spark, sf, "scene_train", "pair_id", "dsl"), path, "pair_id", 0.1)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.length("dsl")).alias("n_chars"))


QUERIES = {"json_shards": json_shards, "split_sink": split_sink}

ORACLE = {
    "json_shards": "SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE source IS NOT NULL",
    "split_sink": "SELECT CASE WHEN CAST('0x' || substr(md5(CAST(pair_id AS VARCHAR)), 1, 15) AS BIGINT) % 10000 < 1000 THEN 'val' ELSE 'train' END AS split, count(*) AS n, CAST(sum(length(dsl)) AS BIGINT) AS n_chars FROM scene_train GROUP BY 1",
}
