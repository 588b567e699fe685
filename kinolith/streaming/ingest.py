"""Incremental ingestion of files into a table, resumable at any point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stream_of(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The parquet file or folder ``path`` as a stream of the given columns."""
    df = spark.read.parquet(path)
    schema = df.select(*columns).schema if columns else df.schema
    # as a glob, the path may also name a single file
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def ingest(stream: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """Apply ``step`` to everything that arrived since the last call and append it to ``folder``.

    The checkpoint beside the table knows which files are done, and the file sink commits a batch as
    a whole: a call that is killed and repeated neither loses nor repeats a row. Without new files the
    table stays as it is. ``step`` must work row by row.
    """
    out = step(stream)
    sink = out.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(out.schema).parquet(f"{folder}/table")
