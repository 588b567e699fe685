"""Queries of the vector operators over ``embeddings``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kinolith.operators import vectors as V
from kinolith.sources.tables import table


def _vectors(spark, sf):
    return table(spark, sf, "embeddings", "vec_id", "label", "embedding").withColumn("v", F.col("embedding").cast("array<double>"))


def scan_vectors(spark, sf):
    return _vectors(spark, sf).select("vec_id", F.size("v").alias("n"), F.round(V.norm(F.col("v")), 6).alias("norm"))


def pairwise_cosine(spark, sf):
    return V.most_similar(_vectors(spark, sf), "vec_id", "v")


def nearest_centroid(spark, sf):
    """Nearest label centre of every vector."""
    df = _vectors(spark, sf)
    return V.nearest(df, "v", V.centroids(df, "label", "v"), "label", "centre").select("vec_id", F.col("nearest").alias("nearest_label"))


def kmeans_step(spark, sf):
    """One assignment and update from the label centres: sizes and the new centres' first coordinate."""
    df = _vectors(spark, sf)
    dealt = V.nearest(df, "v", V.centroids(df, "label", "v"), "label", "centre")
    return dealt.groupBy(F.col("nearest").alias("cluster")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("v")[0]), 6).alias("c0"))


def support_filter(spark, sf):
    """Vectors with at least 32 coordinates of 0.02 or more."""
    k = F.size(F.filter("v", lambda x: x >= 0.02))
    return _vectors(spark, sf).where(k >= 32).select("vec_id", k.alias("support"))


def bbox_area_filter(spark, sf):
    """Vectors, read as 32 points, whose bounding box covers at least 0.2."""
    even = F.filter("v", lambda x, i: i % 2 == 0)
    odd = F.filter("v", lambda x, i: i % 2 == 1)
    area = (F.array_max(even) - F.array_min(even)) * (F.array_max(odd) - F.array_min(odd))
    return _vectors(spark, sf).where(area >= 0.2).select("vec_id", F.round(area, 6).alias("area"))


def ink_fraction(spark, sf):
    share = F.size(F.filter("v", lambda x: x < -0.2)) / F.size("v")
    return _vectors(spark, sf).where(share >= 0.04).select("vec_id", F.round(share, 6).alias("ink"))


def zip_positions(spark, sf):
    """Mean absolute difference between coordinates and the next ones."""
    pairs = F.zip_with(F.slice("v", 1, F.size("v") - 1), F.slice("v", 2, F.size("v") - 1), lambda a, b: F.abs(a - b))
    return _vectors(spark, sf).select("vec_id", F.round(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs), 6).alias("change"))


def affine_points(spark, sf):
    """Centroid of the 32 points turned by 30 degrees, scaled by 2 and moved by (1, -1)."""
    n = F.size("v") / 2
    x = F.aggregate(F.filter("v", lambda a, i: i % 2 == 0), F.lit(0.0), lambda s, a: s + a) / n
    y = F.aggregate(F.filter("v", lambda a, i: i % 2 == 1), F.lit(0.0), lambda s, a: s + a) / n
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    return _vectors(spark, sf).select("vec_id", F.round((x * c - y * s) * 2 + 1, 6).alias("x"), F.round((x * s + y * c) * 2 - 1, 6).alias("y"))


def permute_sign(spark, sf):
    """Mirror: neighbours change places, odd coordinates their sign."""
    flipped = F.transform("v", lambda x, i: F.when(i % 2 == 0, F.col("v")[(i + 1).cast("int")]).otherwise(-F.col("v")[(i - 1).cast("int")]))
    return _vectors(spark, sf).select("vec_id", F.transform(F.slice(flipped, 1, 4), lambda x: F.round(x, 6)).alias("head"))


def keypoint_vector(spark, sf):
    """Limb angle of the first two points, a neutral one where they coincide."""
    dx, dy = F.col("v")[2] - F.col("v")[0], F.col("v")[3] - F.col("v")[1]
    return _vectors(spark, sf).select("vec_id", F.round(F.when((dx == 0) & (dy == 0), 0.0).otherwise(F.atan2(dy, dx) / math.pi), 6).alias("angle"))


def dft_coefficient(spark, sf):
    """Magnitude of the fifth frequency of the coordinates."""
    term = lambda g: F.aggregate(F.transform("v", lambda x, i: x * g(i * (2 * math.pi * 5 / 64))), F.lit(0.0), lambda s, x: s + x)
    re, im = term(F.cos), term(F.sin)
    return _vectors(spark, sf).select("vec_id", F.round(F.sqrt(re * re + im * im) / F.size("v"), 6).alias("magnitude"))


def similarity_fit(spark, sf):
    """Rotation and scale that take the first 16 points of a vector to its last 16, from sums of products."""
    p = lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("v")[(i * 2 + k).cast("int")])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 16
    xs, ys, us, vs = p(0), p(1), p(32), p(33)
    df = _vectors(spark, sf).select("vec_id", xs.alias("x"), ys.alias("y"), us.alias("a"), vs.alias("b"))
    df = df.withColumns({f"m{c}": mean(F.col(c)) for c in "xyab"})
    moved = lambda c: F.transform(F.col(c), lambda t: t - F.col(f"m{c}"))
    df = df.withColumns({c: moved(c) for c in "xyab"})
    cos, sin = V.dot(F.col("x"), F.col("a")) + V.dot(F.col("y"), F.col("b")), V.dot(F.col("x"), F.col("b")) - V.dot(F.col("y"), F.col("a"))
    size = V.dot(F.col("x"), F.col("x")) + V.dot(F.col("y"), F.col("y"))
    return df.select("vec_id", F.round(F.atan2(sin, cos), 6).alias("angle"), F.round(F.coalesce(F.try_divide(F.hypot(sin, cos), size), F.lit(1.0)), 6).alias("scale"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_vectors, pairwise_cosine, nearest_centroid, kmeans_step, support_filter, bbox_area_filter, ink_fraction, zip_positions,
        affine_points, permute_sign, keypoint_vector, dft_coefficient, similarity_fit,
    )
}

_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_CENTRE = f"""c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {_E}) GROUP BY 1, 2) GROUP BY 1),
 d AS (SELECT vec_id, v, arg_min(c.label, round(list_sum(list_transform(list_zip(v, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) * 1e6 + c.label * 1e-6) AS nearest FROM {_E} e, c GROUP BY ALL)"""
_EVEN, _ODD = "list_filter(v, lambda x, i: i % 2 = 1)", "list_filter(v, lambda x, i: i % 2 = 0)"
ORACLE = {
    "scan_vectors": f"SELECT vec_id, len(v) AS n, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM {_E}",
    "pairwise_cosine": f"""SELECT q.vec_id AS query_id, o.vec_id AS best_id, round(list_cosine_similarity(q.v, o.v), 6) AS cosine FROM {_E} q JOIN {_E} o ON q.vec_id <> o.vec_id WHERE q.vec_id % 100 = 0
 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, o.v), 9) DESC, o.vec_id) = 1""",
    "nearest_centroid": f"WITH {_CENTRE} SELECT vec_id, nearest AS nearest_label FROM d",
    "kmeans_step": f"WITH {_CENTRE} SELECT nearest AS cluster, count(*) AS n, round(avg(v[1]), 6) AS c0 FROM d GROUP BY 1",
    "support_filter": f"SELECT vec_id, CAST(len(list_filter(v, lambda x: x >= 0.02)) AS INTEGER) AS support FROM {_E} WHERE len(list_filter(v, lambda x: x >= 0.02)) >= 32",
    "bbox_area_filter": f"SELECT vec_id, round(a, 6) AS area FROM (SELECT vec_id, (list_max({_EVEN}) - list_min({_EVEN})) * (list_max({_ODD}) - list_min({_ODD})) AS a FROM {_E}) WHERE a >= 0.2",
    "ink_fraction": f"SELECT vec_id, round(k / n, 6) AS ink FROM (SELECT vec_id, len(list_filter(v, lambda x: x < -0.2)) AS k, len(v) AS n FROM {_E}) WHERE k / n >= 0.04",
    "zip_positions": f"SELECT vec_id, round(list_sum(list_transform(range(1, len(v)), lambda i: abs(v[i] - v[i + 1]))) / (len(v) - 1), 6) AS change FROM {_E}",
    "affine_points": f"SELECT vec_id, round((x * cos(pi() / 6) - y * sin(pi() / 6)) * 2 + 1, 6) AS x, round((x * sin(pi() / 6) + y * cos(pi() / 6)) * 2 - 1, 6) AS y FROM (SELECT vec_id, list_sum({_EVEN}) / (len(v) / 2) AS x, list_sum({_ODD}) / (len(v) / 2) AS y FROM {_E})",
    "permute_sign": f"SELECT vec_id, [round(v[2], 6), round(-v[1], 6), round(v[4], 6), round(-v[3], 6)] AS head FROM {_E}",
    "keypoint_vector": f"SELECT vec_id, round(CASE WHEN v[3] = v[1] AND v[4] = v[2] THEN 0.0 ELSE atan2(v[4] - v[2], v[3] - v[1]) / pi() END, 6) AS angle FROM {_E}",
    "dft_coefficient": f"SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x, i: x * cos((i - 1) * 2 * pi() * 5 / 64))) ** 2 + list_sum(list_transform(v, lambda x, i: x * sin((i - 1) * 2 * pi() * 5 / 64))) ** 2) / len(v), 6) AS magnitude FROM {_E}",
    "similarity_fit": f"""WITH p AS (SELECT vec_id, list_transform(range(16), lambda i: v[2 * i + 1]) AS x, list_transform(range(16), lambda i: v[2 * i + 2]) AS y, list_transform(range(16), lambda i: v[2 * i + 33]) AS a, list_transform(range(16), lambda i: v[2 * i + 34]) AS b FROM {_E}),
 m AS (SELECT vec_id, list_transform(x, lambda t: t - list_avg(x)) AS x, list_transform(y, lambda t: t - list_avg(y)) AS y, list_transform(a, lambda t: t - list_avg(a)) AS a, list_transform(b, lambda t: t - list_avg(b)) AS b FROM p),
 s AS (SELECT vec_id, list_inner_product(x, a) + list_inner_product(y, b) AS c, list_inner_product(x, b) - list_inner_product(y, a) AS s, list_inner_product(x, x) + list_inner_product(y, y) AS n FROM m)
 SELECT vec_id, round(atan2(s, c), 6) AS angle, round(coalesce(sqrt(s * s + c * c) / n, 1), 6) AS scale FROM s""",
}
