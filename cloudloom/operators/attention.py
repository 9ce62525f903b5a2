"""Local vector attention over nearest neighbours, with keys and values from a sparser cloud. Weights are arguments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.views import POINTS_SQL, cloud, features, points
from .neighbors import _knn_sql, knn

Matrix = Sequence[Sequence[float]]


def linear(vector: str, weights: Matrix) -> Column:
    """The product of a matrix (a row for each output) and a short vector."""
    term = lambda d, w: F.get(vector, d) * F.lit(float(w))
    return F.array(*[reduce(lambda a, b: a + b, [term(d, w) for d, w in enumerate(row)]) for row in weights])


def regrouped(sparse: DataFrame, dim: int) -> DataFrame:
    """k, i, f: the numbers of sparse vectors (k, i from 0, f), in order of i, read anew as vectors of dim numbers."""
    rows = sparse.select("k", "i", F.size("f").alias("width"), F.posexplode("f").alias("at", "v"))
    at = F.col("i").cast("long") * F.col("width") + F.col("at")
    rows = rows.select("k", F.floor(at / dim).cast("int").alias("i"), F.struct((at % dim).alias("c"), "v").alias("x"))
    return rows.groupBy("k", "i").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("f"))


def vector_attention(near: DataFrame, dense: DataFrame, queries: DataFrame, keys: DataFrame, values: DataFrame, first: Matrix, second: Matrix) -> DataFrame:
    """k, i, f: for each point the sum of value + feature over its neighbours (near: k, i, j), weighted in each channel by a
    softmax of second * relu(first * (query - key + feature)). The other tables are vectors (k, i, f); a point's
    neighbours without a key or value don't count. Neighbours are few, so they are gathered in one row."""
    dim = len(second)
    of = lambda df, at, f: df.select("k", F.col("i").alias(at), F.col("f").alias(f))
    source = of(dense, "j", "d").join(of(keys, "j", "key"), ["k", "j"]).join(of(values, "j", "value"), ["k", "j"])
    source = source.select("k", "j", F.zip_with("d", "key", lambda d, x: d - x).alias("shift"), F.zip_with("d", "value", lambda d, x: d + x).alias("u"))
    rows = near.select("k", "i", "j").join(of(queries, "i", "q"), ["k", "i"]).join(source, ["k", "j"])
    rows = rows.withColumn("relation", F.zip_with("q", "shift", lambda q, x: q + x))
    rows = rows.withColumn("hidden", F.transform(linear("relation", first), lambda x: F.greatest(x, F.lit(0.0)))).withColumn("s", linear("hidden", second))
    rows = rows.groupBy("k", "i").agg(F.collect_list(F.struct("s", "u")).alias("near"), *[F.max(F.get("s", c)).alias(f"top{c}") for c in range(dim)])

    def mixed(c: int) -> Column:
        weight = lambda x: F.exp(x["s"][c] - F.col(f"top{c}"))
        total = F.aggregate("near", F.lit(0.0), lambda a, x: a + weight(x))
        return F.aggregate("near", F.lit(0.0), lambda a, x: a + weight(x) * x["u"][c]) / total

    return rows.select("k", "i", F.array(*[mixed(c) for c in range(dim)]).alias("f"))


# Stand-in weights of the query: no trained ones come with the data.
_QUERY = [[0.5, 0.25], [-0.5, 1]]
_KEYS = [[1, 0], [0, 1], [1, 1], [1, -1]]
_VALUES = [[0, 1], [1, 0], [-1, 1], [0.5, 0]]
_FIRST, _SECOND = [[1, -0.5], [0.5, 1]], [[2, 0], [-1, 1.5]]


@query(f"""WITH {POINTS_SQL}, {_knn_sql('c', 'c', 16)}, ft AS (SELECT label AS k, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, {', '.join(f'CAST(embedding[{9 + j}] AS DOUBLE) AS f{j}' for j in range(4))} FROM embeddings),
src AS (SELECT d.k AS k, d.i AS j, CASE WHEN d.i % 2 = 0 THEN s.f2 ELSE s.f2 + s.f3 END AS k0, CASE WHEN d.i % 2 = 0 THEN s.f3 ELSE s.f2 - s.f3 END AS k1,
  CASE WHEN d.i % 2 = 0 THEN s.f3 ELSE s.f3 - s.f2 END AS v0, CASE WHEN d.i % 2 = 0 THEN s.f2 ELSE 0.5 * s.f2 END AS v1, d.f0 AS d0, d.f1 AS d1 FROM ft d JOIN ft s ON d.k = s.k AND s.i = d.i - d.i % 2),
re AS (SELECT n.k AS k, n.i AS i, 0.5 * q.f0 + 0.25 * q.f1 - k0 + d0 AS r0, q.f1 - 0.5 * q.f0 - k1 + d1 AS r1, v0 + d0 AS u0, v1 + d1 AS u1 FROM knn n JOIN ft q ON n.k = q.k AND n.i = q.i JOIN src ON n.k = src.k AND n.j = src.j),
hi AS (SELECT *, greatest(r0 - 0.5 * r1, 0) AS h0, greatest(0.5 * r0 + r1, 0) AS h1 FROM re), si AS (SELECT *, 2 * h0 AS s0, 1.5 * h1 - h0 AS s1 FROM hi),
ex AS (SELECT *, exp(s0 - max(s0) OVER (PARTITION BY k, i)) AS e0, exp(s1 - max(s1) OVER (PARTITION BY k, i)) AS e1 FROM si)
SELECT k, i, floor(sum(e0 * u0) / sum(e0) * 1e5 + 0.5) / 1e5 AS y0, floor(sum(e1 * u1) / sum(e1) * 1e5 + 0.5) / 1e5 AS y1 FROM ex GROUP BY k, i""")
def local_cross_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 neighbours of each point; keys and values are projected from every second point and regrouped for all points."""
    f = features(spark, sf_dir, 4)
    c = cloud(points(spark, sf_dir), "c")
    dense = f.select("k", "i", F.array("f0", "f1").alias("f"))
    sparse = f.filter("i % 2 = 0").select("k", F.expr("i div 2").alias("i"), F.array("f2", "f3").alias("f"))
    wide = [regrouped(sparse.withColumn("f", linear("f", w)), 2) for w in (_KEYS, _VALUES)]
    out = vector_attention(knn(c, c, 16), dense, dense.withColumn("f", linear("f", _QUERY)), *wide, _FIRST, _SECOND)
    return out.select("k", "i", *[(F.floor(F.get("f", c) * 1e5 + 0.5) / 1e5).alias(f"y{c}") for c in (0, 1)])
