"""Operators on vectors held as arrays: similarity, nearest centre, clustering, geometry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def most_similar(df: DataFrame, key: str, vector: str, every: int = 100, block: int = 2000) -> DataFrame:
    """For every row whose key is divisible by ``every``: the other row of greatest cosine, the least key on ties.

    The stated query rows are dealt into blocks of about ``block`` rows; a block and a partition of
    rows meet in one array product, of which each query keeps its best. Null vectors and null keys
    are left out; vectors of no length have cosine 0 with all. Columns: query_id, best_id, cosine.
    """
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    stated = rows.where(F.pmod("id", F.lit(every)) == 0)
    n_blocks = max(1, -(-stated.count() // block))
    stated = stated.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    parts = max(1, -(-rows.count() // 20_000))
    dealt = rows.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    left = stated.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("b", "p")
    right = dealt.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).groupBy("b", "p")

    def best(key: tuple, queries: pa.Table, others: pa.Table) -> pa.Table:
        ids, q = _matrix(queries)
        keys, m = _matrix(others)
        if not len(ids) or not len(keys):
            return pa.table({"query_id": pa.array([], pa.int64()), "best_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        order = np.argsort(keys)
        keys, m = keys[order], m[order]
        c = np.round(q @ m.T, 9)
        c[ids[:, None] == keys[None, :]] = -2
        at = c.argmax(axis=1)
        found = c[np.arange(len(ids)), at]
        kept = found > -2
        return pa.table({"query_id": ids[kept], "best_id": keys[at][kept], "cosine": found[kept]})

    pairs = left.cogroup(right).applyInArrow(best, "query_id bigint, best_id bigint, cosine double")
    top = pairs.groupBy("query_id").agg(F.max_by(F.struct("best_id", "cosine"), F.struct("cosine", -F.col("best_id"))).alias("m"))
    return top.select("query_id", "m.best_id", F.round("m.cosine", 6).alias("cosine"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    v = np.array(table.column("v").to_pylist(), float)
    if len(v):
        length = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
    return ids, v


def nearest(df: DataFrame, vector: str, centres: DataFrame, name: str, centre: str) -> DataFrame:
    """Add the nearest of the centres by squared distance, the least name on ties.

    ``centres`` is a palette: few rows that become one array literal of the plan's broadcast.
    """
    listed = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(centre).alias("c")))).alias("_centres"))
    away = F.transform("_centres", lambda x: F.struct(F.round(squared_distance(F.col(vector), x["c"]), 9).alias("d"), x["n"].alias("n")))
    best = F.array_min(away)
    return df.join(F.broadcast(listed)).withColumn("nearest", best["n"]).withColumn("distance", best["d"]).drop("_centres")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, element by element."""
    cells = df.select(group, F.posexplode(vector).alias("i", "x"))
    means = cells.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def farthest_points(points: list[list[float]], k: int) -> list[int]:
    """Indices of a greedy max-min selection from the first point; the least index on ties."""
    v = np.array(points, float)
    if not len(v):
        return []
    chosen, away = [0], ((v - v[0]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(v)):
        i = int(away.argmax())
        chosen.append(i)
        away = np.minimum(away, ((v - v[i]) ** 2).sum(axis=1))
    return chosen
