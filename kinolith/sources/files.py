"""Sources and sinks: JSON lines, JSON documents, sharded and split outputs, reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from kinolith.functions.text import split_of


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of JSON-lines files, plain or gzip, with their file; blank lines are skipped.

    A malformed line becomes a row of nulls whose ``corrupt`` holds it, so no line is lost.
    """
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = StructType(full.fields).add("corrupt", "string")
    reader = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    return reader.json(path).withColumn("file", F.input_file_name())


def json_documents(spark: SparkSession, path: str, schema: StructType | str, rows: str = "rows") -> DataFrame:
    """The records in the list ``rows`` of whole-document JSON files."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(rows).alias("r")).select("r.*")


def schema_probe(df: DataFrame, column: str) -> str:
    """Schema of the JSON texts of a column, merged over all rows; texts that are no JSON are left out."""
    return df.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0]


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """Gzip JSON lines, one folder a shard; shards that are there already are kept and skipped.

    A shard's folder appears only when its job commits, so a killed run leaves no half shard.
    """
    try:
        done = df.sparkSession.read.json(path).select(shard).distinct()
        df = df.join(F.broadcast(done.withColumn(shard, F.col(shard).cast(df.schema[shard].dataType))), shard, "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    df.write.mode("append").partitionBy(shard).option("compression", "gzip").json(path)


def write_split(df: DataFrame, path: str, name: str, share: float) -> None:
    """Parquet in the folders split=train and split=val, by a hash of the name."""
    df.withColumn("split", split_of(F.col(name).cast("string"), share)).write.mode("overwrite").partitionBy("split").parquet(path)


def write_report(df: DataFrame, path: str, **facts: object) -> None:
    """A report as JSON with the given facts on every row, such as the parameters of the run."""
    df.withColumns({k: F.lit(v) for k, v in facts.items()}).coalesce(1).write.mode("overwrite").json(path)


def write_frames(df: DataFrame, path: str, position: str, sample: int) -> None:
    """All frames as JSON lines below ``path``/frames, and about ``sample`` of them, evenly spread by their
    position, as readable text below ``path``/text.
    """
    df.write.mode("overwrite").json(f"{path}/frames")
    n = df.agg(F.max(position)).first()[0]
    if sample and n is not None:
        step = max(1, (n + 1) // sample)
        lines = [F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns if c != position]
        text = F.concat_ws("\n", F.concat(F.lit("--- frame "), F.col(position).cast("string"), F.lit(" ---")), *lines)
        df.where(F.pmod(position, F.lit(step)) == 0).select(text.alias("value")).write.mode("overwrite").text(f"{path}/text")


def text_table(df: DataFrame, rows: int = 1000) -> str:
    """A report of at most ``rows`` rows as a fixed-width text; numbers to the right, texts to the left."""
    held = [[("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in df.take(rows)]
    wide = [max(len(c), *(len(r[i]) for r in held), 0) if held else len(c) for i, c in enumerate(df.columns)]
    number = [t.startswith(("int", "bigint", "double", "float", "decimal", "smallint")) for _, t in df.dtypes]
    line = lambda r: "  ".join(v.rjust(w) if right else v.ljust(w) for v, w, right in zip(r, wide, number)).rstrip()
    return "\n".join([line(df.columns), *map(line, held)])


def replayed(open_shard: Callable[[], Iterable[str]], retries: int = 6, base: float = 3.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Lines of a shard over a connection that may drop: it is opened again and the lines seen are skipped.

    The n-th wait takes base x 2^n seconds, ``most`` at most; progress starts the count anew. A refused
    permission ends at once, as does the last failed attempt.
    """
    done, attempt = 0, 0
    while True:
        try:
            for i, line in enumerate(open_shard()):
                if i >= done:
                    done, attempt = i + 1, 0
                    yield line
            return
        except PermissionError:
            raise
        except OSError:
            if attempt >= retries:
                raise
            sleep(min(most, base * 2**attempt))
            attempt += 1


def remote_lines(shards: DataFrame, name: str, open_shard: Callable[[str], Iterable[str]], batch: int = 1000, **how: float) -> DataFrame:
    """Lines of the named shards: shard, line_no (from 1), line; one shard is read by one task, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names in batches:
            for shard in names.column(0).to_pylist():
                held: list[str] = []
                first = 1
                for line in replayed(lambda: open_shard(shard), **how):  # noqa: B023
                    held.append(line)
                    if len(held) == batch:
                        yield _numbered(shard, first, held)
                        first, held = first + batch, []
                yield _numbered(shard, first, held)

    listed = shards.select(name)
    return listed.repartition(name).mapInArrow(run, "shard string, line_no bigint, line string")


def _numbered(shard: str, first: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    columns = [pa.array([shard] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "line_no", "line"])
