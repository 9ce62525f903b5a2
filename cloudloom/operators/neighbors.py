"""Joins by nearness: k nearest neighbours, Chamfer distance, point to surface, inverse-distance interpolation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import exact, exact_mean, exact_sum, mean_sql, q6, squared, sum_sql
from ..sources.views import LARGE_SQL, POINTS_SQL, TRIANGLES_SQL, cloud, features, large_clouds, points, predicted, triangles
from ..staging import alone, staged
from .grid import checked, corners, large, searches, triangle_searches


_CUBE = ["k", "level", "cx", "cy", "cz"]
#: Points of the clouds that in_turns searches at once, about.
TURN = 2_000_000


def in_turns(clouds: DataFrame, find: Callable[[DataFrame], DataFrame], size: int | None = None) -> DataFrame:
    """find(clouds), whose rows are each of one cloud k, over whole clouds of about `size` points at a time (TURN): a search
    writes many times its points, and after each turn only its result stays.

    Clouds of a hundredth of that or more are packed in order of size, smaller ones dealt by hash."""
    size = size or TURN
    spark, least = clouds.sparkSession, max(1, size // 100)
    sizes = alone(spark, lambda: clouds.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "sizes")
    big, small = sizes.filter(F.col("n") >= least), sizes.filter(F.col("n") < least)
    turns, some = (-(-(df.agg(F.sum("n")).first()[0] or 0) // size) for df in (big, small))
    after = Window.orderBy("n", "k")  # at most a hundred rows for each turn
    middle = F.sum("n").over(after) - F.col("n") / 2
    packed = big.select("k", F.floor(middle * turns / F.sum("n").over(Window.partitionBy())).alias("turn"))
    dealt = small.select("k", (-1 - F.pmod(F.xxhash64("k"), F.lit(max(some, 1)))).alias("turn"))
    turn = alone(spark, lambda: packed.unionByName(dealt), "turns")
    found = []
    for t in sorted(r.turn for r in turn.select("turn").distinct().collect()):
        own = F.broadcast(turn.filter(F.col("turn") == t).select("k"))
        found.append(alone(spark, lambda own=own: find(staged(clouds.join(own, "k", "left_semi"), "turn")), "found"))
    return reduce(DataFrame.unionAll, found) if found else find(clouds)


def by_place(queries: DataFrame, reference: DataFrame, find: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """find (of queries k, i, x, y, z; its rows have k and i), where clouds in which most queries share their place with others
    are searched for one of each place, which all that are there get the rows of."""
    if not large(queries, reference):
        return find(queries, reference)
    sizes = queries.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct(*"xyz")).alias("places"))
    shared = staged(sizes.filter("2 * places < n").select("k"), "shared")
    if shared.isEmpty():
        return find(queries, reference)
    many, rest = queries.join(shared, "k", "left_semi"), queries.join(shared, "k", "left_anti")
    one = staged(many.groupBy("k", *"xyz").agg(F.min("i").alias("i")), "places").select("k", "i", *"xyz")
    near = staged(find(rest.unionByName(one), reference), "near")
    of_one = near.join(one, ["k", "i"]).drop("i")
    every = many.join(of_one, ["k", *"xyz"]).select(*near.columns)
    return near.join(shared, "k", "left_anti").unionByName(every)


def knn(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """The k nearest reference points of each query point of the same cloud: k, i, j, d2, rank (from 0); ties to the lower
    index. A point that is not finite is an error.

    Candidates come from the cubes about a point; the window keeps k rows before it shuffles."""

    def find(queries: DataFrame, reference: DataFrame) -> DataFrame:
        q, r = searches(queries, reference, k)
        pairs = q.join(r, _CUBE).withColumn("d2", squared("q", "r")).filter(F.col("d2") <= F.col("bound"))
        rank = F.row_number().over(Window.partitionBy("k", "i").orderBy("d2", "j")) - 1
        return pairs.withColumn("rank", rank).filter(F.col("rank") < k).select("k", "i", "j", "d2", "rank")

    return by_place(checked(queries.select("k", "i", *"xyz")), checked(reference.select("k", F.col("i").alias("j"), *"xyz")), find)


def nearest(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """k, i, d2 of the nearest reference point, from the cubes about each point. A point that is not finite is an error."""

    def find(queries: DataFrame, reference: DataFrame) -> DataFrame:
        q, r = searches(queries, reference, 1)
        pairs = q.join(r, _CUBE).withColumn("d2", squared("q", "r")).filter(F.col("d2") <= F.col("bound"))
        return pairs.groupBy("k", "i").agg(F.min("d2").alias("d2"))

    return by_place(checked(queries.select("k", "i", *"xyz")), checked(reference.select("k", *"xyz")), find)


def tagged(df: DataFrame, *tags: str) -> DataFrame:
    """df once for each tag, as clouds of their own: k is a struct of the old k and the tag. So one search does several."""
    k = F.explode(F.array(*[F.struct("k", F.lit(t).alias("tag")) for t in tags]))
    return df.select(k.alias("k"), *[c for c in df.columns if c != "k"])


def both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """k, side, i, d2: of the points of a (side a) the nearest of b, and of those of b (side b) the nearest of a."""
    a, b = a.select("k", "i", *"xyz"), b.select("k", "i", *"xyz")
    near = nearest(tagged(a, "a").union(tagged(b, "b")), tagged(b, "a").union(tagged(a, "b")))
    return near.select("k.k", F.col("k.tag").alias("side"), "i", "d2")


def chamfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """k, forward, backward, cd: both directed means of squared nearest distances, and their sum."""
    mean = lambda side: F.sum(F.when(F.col("side") == side, exact("d2"))).cast("double") / F.count_if(F.col("side") == side)
    means = both_ways(a, b).groupBy("k").agg(mean("a").alias("forward"), mean("b").alias("backward"))
    return means.filter("forward is not null and backward is not null").withColumn("cd", F.col("forward") + F.col("backward"))


def frame(df: DataFrame) -> DataFrame:
    """k, ox, oy, oz, scale of each cloud: the middle of its box, and the greatest distance from there."""
    box = df.groupBy("k").agg(*[f(a).alias(n + a) for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    middle = box.select("k", *[((F.col("lo" + a) + F.col("hi" + a)) * 0.5).alias("o" + a) for a in "xyz"])
    far = df.join(middle, "k").withColumn("d2", squared("", "o")).groupBy("k").agg(F.max(F.sqrt("d2")).alias("scale"))
    return middle.join(far, "k")


def framed(df: DataFrame, frames: DataFrame) -> DataFrame:
    return df.join(frames, "k").select("k", "i", *[((F.col(a) - F.col("o" + a)) / F.col("scale")).alias(a) for a in "xyz"])


def normalized_chamfer(a: DataFrame, b: DataFrame) -> DataFrame:
    """k, cd in the frame of b; 0 where that has no extent."""
    frames = frame(b)
    flat = frames.select("k", (F.col("scale") < 1e-12).alias("flat"))
    solid = frames.filter("scale >= 1e-12")
    cd = chamfer(framed(a, solid), framed(b, solid)).select("k", "cd")
    return flat.join(cd, "k", "left").select("k", F.when(F.col("flat"), 0.0).otherwise(F.col("cd")).alias("cd"))


def with_triangle_d2(pairs: DataFrame) -> DataFrame:
    """pairs of points q and triangles a, b, g with d2: the plane's distance above the triangle, else its nearest edge's.

    Edges are m = b - a, n = g - a, o = g - b; s = q - a, u = q - b. Steps are columns of their own, so that none is
    computed twice; a flat edge or triangle counts as what is left of it."""
    corner = lambda p, c: "by_" if (p, c) == ("b", "y") else p + c
    ends = (("m", "b", "a"), ("n", "g", "a"), ("o", "g", "b"), ("s", "q", "a"), ("u", "q", "b"))
    dot = lambda x, y: " + ".join(f"{x}_{c} * {y}_{c}" for c in "xyz")
    rest = lambda p, *steps: " + ".join(f"pow({p}_{c} - {' - '.join(f'{t} * {e}_{c}' for t, e in steps)}, 2)" for c in "xyz")
    part = lambda x, y: f"if({y} > 0, greatest(0.0D, least(1.0D, {x} / {y})), 0.0D)"
    d = pairs.selectExpr("k", "i", *[f"{corner(p, c)} - {corner(q, c)} as {n}_{c}" for n, p, q in ends for c in "xyz"])
    d = d.selectExpr("*", *[f"{dot(*x)} as {x}" for x in ("mm", "mn", "nn", "oo", "ms", "ns", "ou")])
    d = d.selectExpr("*", f"{part('ms', 'mm')} as tm", f"{part('ns', 'nn')} as tn", f"{part('ou', 'oo')} as to", "nullif(mm * nn - mn * mn, 0.0D) as area")
    d = d.selectExpr("*", "(nn * ms - mn * ns) / area as y", "(mm * ns - mn * ms) / area as z")
    edges = f"least({rest('s', ('tm', 'm'))}, {rest('s', ('tn', 'n'))}, {rest('u', ('to', 'o'))})"
    d = d.selectExpr("k", "i", f"{edges} as edges", f"if(y >= 0 and z >= 0 and y + z <= 1, {rest('s', ('y', 'm'), ('z', 'n'))}, null) as plane")
    return d.selectExpr("k", "i", "least(edges, plane) as d2")  # least skips null


def surface_distances(cloud_: DataFrame, mesh: DataFrame) -> DataFrame:
    """k, i, d2: the squared distance of each point to the nearest triangle of its mesh.

    The nearest corner bounds it; only triangles that come within that bound are compared, through the cubes they meet."""
    points_ = checked(cloud_.select("k", "i", *"xyz"))
    reach = nearest(points_, corners(mesh)).select("k", "i", F.sqrt("d2").alias("reach"))
    above, below = (q.join(t, _CUBE) for q, t in triangle_searches(points_, mesh, reach))
    return with_triangle_d2(above.unionByName(below)).groupBy("k", "i").agg(F.min("d2").alias("d2"))


def point_to_surface(cloud_: DataFrame, mesh: DataFrame) -> DataFrame:
    """k, p2s: the mean squared distance of a cloud's points to the nearest triangle of its mesh, in doubles."""
    return surface_distances(cloud_, mesh).groupBy("k").agg(exact_mean("d2").alias("p2s"))


def framed_mesh(mesh: DataFrame, frames: DataFrame) -> DataFrame:
    """The corners of all triangles in the frame of their cloud."""
    at = [(c, c[1]) for c in ("ax", "ay", "az", "bx", "by_", "bz", "gx", "gy", "gz")]
    return mesh.join(frames, "k").select("k", "f", *[((F.col(c) - F.col("o" + a)) / F.col("scale")).alias(c) for c, a in at])


def normalized_point_to_surface(cloud_: DataFrame, mesh: DataFrame, clean: DataFrame) -> DataFrame:
    """k, p2s of the cloud to its mesh, both in the frame of the clean cloud; 0 where that has no extent."""
    frames = staged(frame(clean), "frames")
    solid = frames.filter("scale >= 1e-12")
    p2s = point_to_surface(framed(cloud_, solid), framed_mesh(mesh, solid))
    flat = cloud_.select("k").distinct().join(frames.filter("scale < 1e-12"), "k").select("k", F.lit(0.0).alias("p2s"))
    return p2s.union(flat)


_D2 = "(q.{p}x - r.{s}x) * (q.{p}x - r.{s}x) + (q.{p}y - r.{s}y) * (q.{p}y - r.{s}y) + (q.{p}z - r.{s}z) * (q.{p}z - r.{s}z)"


def _knn_sql(p: str, s: str, k: int) -> str:
    return f"knn AS (SELECT * FROM (SELECT k, i, j, d2, CAST(row_number() OVER (PARTITION BY k, i ORDER BY d2, j) - 1 AS INTEGER) AS rank FROM (SELECT q.k AS k, q.i AS i, r.i AS j, {_D2.format(p=p, s=s)} AS d2 FROM pts q JOIN pts r ON q.k = r.k)) WHERE rank < {k})"


def _near_sql(name: str, p: str, s: str, table: str = "pts") -> str:
    return f"{name} AS (SELECT k, {mean_sql('d2')} AS v FROM (SELECT q.k AS k, q.i AS i, min({_D2.format(p=p, s=s)}) AS d2 FROM {table} q JOIN {table} r ON q.k = r.k GROUP BY q.k, q.i) GROUP BY k)"


@query(f"WITH {POINTS_SQL}, {_knn_sql('c', 'c', 3)} SELECT k, i, j, rank, floor(d2 * 1e6 + 0.5) / 1e6 AS d2 FROM knn")
def knn_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cloud(points(spark, sf_dir), "c")
    return knn(c, c, 3).select("k", "i", "j", "rank", q6("d2").alias("d2"))


@query(f"WITH {POINTS_SQL}, {_knn_sql('c', 'c', 16)} SELECT k, rank, count(*) AS n, CAST(sum(CAST(floor(d2 * 1e9 + 0.5) AS BIGINT)) AS BIGINT) AS total FROM knn GROUP BY k, rank")
def knn_top16_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cloud(points(spark, sf_dir), "c")
    return knn(c, c, 16).groupBy("k", "rank").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("d2") * 1e9 + 0.5)).alias("total"))


@query(f"WITH {POINTS_SQL}, {_knn_sql('p', 'c', 4)} SELECT k, i, j, rank FROM knn")
def knn_cross_pred_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return knn(cloud(p, "p"), cloud(p, "c"), 4).select("k", "i", "j", "rank")


@query(f"WITH {POINTS_SQL}, {_knn_sql('c', 'c', 2)} SELECT n.k AS k, n.i AS i, floor(g.px * 1e6 + 0.5) / 1e6 AS gx, floor(g.py * 1e6 + 0.5) / 1e6 AS gy, floor(g.pz * 1e6 + 0.5) / 1e6 AS gz FROM knn n JOIN pts g ON n.k = g.k AND n.j = g.i WHERE n.rank = 1")
def gather_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    c = cloud(p, "c")
    chosen = knn(c, c, 2).filter("rank = 1").select("k", "i", "j")
    return chosen.join(p.select("k", F.col("i").alias("j"), "px", "py", "pz"), ["k", "j"]).select("k", "i", *[q6("p" + a).alias("g" + a) for a in "xyz"])


_CD = f"WITH {POINTS_SQL}, {_near_sql('a', 'p', 'c')}, {_near_sql('b', 'c', 'p')} SELECT a.k AS k, floor(a.v * 1e6 + 0.5) / 1e6 AS forward, floor(b.v * 1e6 + 0.5) / 1e6 AS backward, floor((a.v + b.v) * 1e6 + 0.5) / 1e6 AS cd FROM a JOIN b ON a.k = b.k"


@query(_CD)
def chamfer_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return chamfer(cloud(p, "p"), cloud(p, "c")).select("k", q6("forward").alias("forward"), q6("backward").alias("backward"), q6("cd").alias("cd"))


@query(_CD)
def chamfer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As chamfer_raw (both go by cubes)."""
    p = points(spark, sf_dir)
    return chamfer(cloud(p, "p"), cloud(p, "c")).select("k", q6("forward").alias("forward"), q6("backward").alias("backward"), q6("cd").alias("cd"))


@query(f"WITH {LARGE_SQL}, {_knn_sql('c', 'c', 4)} SELECT k, rank, count(*) AS n, CAST(sum(CAST(floor(d2 * 1e9 + 0.5) AS BIGINT)) AS BIGINT) AS total, CAST(sum(j) AS BIGINT) AS sum_j FROM knn GROUP BY k, rank")
def knn_large_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4 nearest points of each point in clouds of many points, with many ties."""
    def totals(clouds: DataFrame) -> DataFrame:
        c = cloud(clouds, "c")
        return knn(c, c, 4).groupBy("k", "rank").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("d2") * 1e9 + 0.5)).alias("total"), F.sum("j").alias("sum_j"))

    return in_turns(large_clouds(spark, sf_dir), totals, 2 * TURN)  # one search, where Chamfer has two


@query(f"WITH {LARGE_SQL}, {_near_sql('a', 'p', 'c')}, {_near_sql('b', 'c', 'p')} SELECT a.k AS k, floor(a.v * 1e6 + 0.5) / 1e6 AS forward, floor(b.v * 1e6 + 0.5) / 1e6 AS backward FROM a JOIN b ON a.k = b.k")
def chamfer_large_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(clouds: DataFrame) -> DataFrame:
        p = predicted(clouds)
        return chamfer(cloud(p, "p"), cloud(p, "c")).select("k", q6("forward").alias("forward"), q6("backward").alias("backward"))

    return in_turns(large_clouds(spark, sf_dir), both)


FRAME_SQL = """
mid AS (SELECT k, (min(cx) + max(cx)) * 0.5 AS ox, (min(cy) + max(cy)) * 0.5 AS oy, (min(cz) + max(cz)) * 0.5 AS oz FROM pts GROUP BY k),
fr AS (SELECT p.k AS k, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz,
  max(sqrt((cx - ox) * (cx - ox) + (cy - oy) * (cy - oy) + (cz - oz) * (cz - oz))) AS scale FROM pts p JOIN mid m ON p.k = m.k GROUP BY p.k),
nrm AS (SELECT p.k AS k, i, """ + ", ".join(f"({p}{a} - o{a}) / scale AS {p}{a}" for p in "cnp" for a in "xyz") + " FROM pts p JOIN fr ON p.k = fr.k)"


@query(f"WITH {POINTS_SQL}, {FRAME_SQL}, {_near_sql('a', 'p', 'c', 'nrm')}, {_near_sql('b', 'c', 'p', 'nrm')} SELECT a.k AS k, floor((a.v + b.v) * 1e6 + 0.5) / 1e6 AS cd FROM a JOIN b ON a.k = b.k")
def chamfer_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return normalized_chamfer(cloud(p, "p"), cloud(p, "c")).select("k", q6("cd").alias("cd"))


@query(f"WITH {POINTS_SQL}, {FRAME_SQL} SELECT k, floor(ox * 1e6 + 0.5) / 1e6 AS ox, floor(oy * 1e6 + 0.5) / 1e6 AS oy, floor(oz * 1e6 + 0.5) / 1e6 AS oz, floor(scale * 1e6 + 0.5) / 1e6 AS scale FROM fr")
def unit_sphere_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(cloud(points(spark, sf_dir), "c")).select("k", *[q6(c).alias(c) for c in ("ox", "oy", "oz", "scale")])


@query(f"WITH {POINTS_SQL}, {FRAME_SQL} SELECT n.k AS k, i, floor(px * 1e6 + 0.5) / 1e6 AS x, floor((px * scale + ox) * 1e6 + 0.5) / 1e6 AS back FROM nrm n JOIN fr ON n.k = fr.k")
def unit_sphere_apply_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    frames = frame(cloud(p, "c"))
    return framed(cloud(p, "p"), frames).join(frames, "k").select("k", "i", q6("x").alias("x"), q6(F.col("x") * F.col("scale") + F.col("ox")).alias("back"))


def _region_sql() -> str:
    dot = lambda a, b: f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"
    return f"""
e0 AS (SELECT p.k AS k, i, f, bx - ax AS abx, by_ - ay AS aby, bz - az AS abz, gx - ax AS acx, gy - ay AS acy, gz - az AS acz, px - ax AS apx, py - ay AS apy, pz - az AS apz FROM pts p JOIN tri t ON p.k = t.k),
e1 AS (SELECT *, {dot('ab', 'ap')} AS d1, {dot('ac', 'ap')} AS d2, {dot('ab', 'ab')} AS bb, {dot('ab', 'ac')} AS bc, {dot('ac', 'ac')} AS cc FROM e0),
e2 AS (SELECT *, d1 - bb AS d3, d2 - bc AS d4, d1 - bc AS d5, d2 - cc AS d6 FROM e1),
e3 AS (SELECT *, d1 * d4 - d3 * d2 AS vc, d5 * d2 - d1 * d6 AS vb, d3 * d6 - d5 * d4 AS va FROM e2),
e4 AS (SELECT *, CASE WHEN d1 <= 0 AND d2 <= 0 THEN 0 WHEN d3 >= 0 AND d4 <= d3 THEN 1 WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN 2 WHEN d6 >= 0 AND d5 <= d6 THEN 3 WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN 4 WHEN va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0 THEN 5 ELSE 6 END AS region FROM e3),
e5 AS (SELECT *, CASE region WHEN 1 THEN 1.0 WHEN 2 THEN d1 / (d1 - d3) WHEN 5 THEN 1 - (d4 - d3) / ((d4 - d3) + (d5 - d6)) WHEN 6 THEN vb / (va + vb + vc) ELSE 0.0 END AS u,
  CASE region WHEN 3 THEN 1.0 WHEN 4 THEN d2 / (d2 - d6) WHEN 5 THEN (d4 - d3) / ((d4 - d3) + (d5 - d6)) WHEN 6 THEN vc / (va + vb + vc) ELSE 0.0 END AS w FROM e4),
e6 AS (SELECT k, i, apx - u * abx - w * acx AS rx, apy - u * aby - w * acy AS ry, apz - u * abz - w * acz AS rz FROM e5),
e7 AS (SELECT k, i, min(rx * rx + ry * ry + rz * rz) AS d2 FROM e6 GROUP BY k, i)"""


@query(f"WITH {POINTS_SQL}, {TRIANGLES_SQL}, {_region_sql()} SELECT k, floor({mean_sql('d2')} * 1e6 + 0.5) / 1e6 AS p2s FROM e7 GROUP BY k")
def p2s_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return point_to_surface(cloud(points(spark, sf_dir), "p"), triangles(spark, sf_dir)).select("k", q6("p2s").alias("p2s"))


@query(f"""WITH {POINTS_SQL}, {TRIANGLES_SQL},
n AS (SELECT k, f, (by_ - ay) * (gz - az) - (bz - az) * (gy - ay) AS nx, (bz - az) * (gx - ax) - (bx - ax) * (gz - az) AS ny, (bx - ax) * (gy - ay) - (by_ - ay) * (gx - ax) AS nz FROM tri)
SELECT k, f, floor(0.5 * sqrt(nx * nx + ny * ny + nz * nz) * 1e6 + 0.5) / 1e6 AS area FROM n""")
def triangle_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triangles(spark, sf_dir)
    b, g = ({c: F.col({"by": "by_"}.get(p + c, p + c)) - F.col("a" + c) for c in "xyz"} for p in "bg")
    n = [b[u] * g[v] - b[v] * g[u] for u, v in (("y", "z"), ("z", "x"), ("x", "y"))]
    return t.select("k", "f", q6(0.5 * F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])).alias("area"))


_FEATURE_SQL = "ft AS (SELECT label AS k, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS i, CAST(embedding[9] AS DOUBLE) AS f0, CAST(embedding[10] AS DOUBLE) AS f1 FROM embeddings)"


@query(f"""WITH {POINTS_SQL}, {_knn_sql('p', 'c', 8)}, {_FEATURE_SQL},
w AS (SELECT *, 1 / sqrt(greatest(d2, 1e-24)) AS w FROM knn)
SELECT w.k AS k, w.i AS i, floor(sum(w * f0) / sum(w) * 1e5 + 0.5) / 1e5 AS v0, floor(sum(w * f1) / sum(w) * 1e5 + 0.5) / 1e5 AS v1 FROM w JOIN ft ON w.k = ft.k AND w.j = ft.i GROUP BY w.k, w.i""")
def idw_interpolate_8nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the 8 nearest, weighted by inverse distance; where one is met exactly, its own."""
    p = points(spark, sf_dir)
    near = knn(cloud(p, "p"), cloud(p, "c"), 8)
    hit = F.min(F.when(F.col("d2") == 0, F.col("rank"))).over(Window.partitionBy("k", "i"))
    weight = F.when(F.col("hit").isNull(), 1 / F.sqrt(F.greatest("d2", F.lit(1e-24)))).otherwise((F.col("rank") == F.col("hit")).cast("double"))
    w = near.withColumn("hit", hit).withColumn("w", weight)
    f = features(spark, sf_dir, 2).select("k", F.col("i").alias("j"), "f0", "f1")
    out = w.join(f, ["k", "j"]).groupBy("k", "i").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in ("f0", "f1")])
    return out.select("k", "i", *[(F.floor(F.col(f"f{j}") * 1e5 + 0.5) / 1e5).alias(f"v{j}") for j in (0, 1)])


def _pair_sql(p: str, s: str, name: str) -> str:
    return f"{name} AS (SELECT q.k AS k, q.i AS i, min({_D2.format(p=p, s=s)}) AS d2 FROM pts q JOIN pts r ON q.k = r.k GROUP BY q.k, q.i)"


@query(f"""WITH {POINTS_SQL}, {_pair_sql('p', 'c', 'x')}, {_pair_sql('c', 'p', 'y')}, u AS (SELECT 0 AS side, * FROM x UNION ALL SELECT 1 AS side, * FROM y),
z AS (SELECT side, k, ln(sum(exp(-0.5 * d2))) AS lse FROM u GROUP BY side, k), l AS (SELECT u.side AS side, u.k AS k, avg(0.5 * d2 + lse) AS v FROM u JOIN z ON u.side = z.side AND u.k = z.k GROUP BY u.side, u.k)
SELECT k, floor(sum(v) * 0.5 * 1e5 + 0.5) / 1e5 AS infocd FROM l GROUP BY k""")
def infocd_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the sum over both directions of the mean of -log softmax(-d2 / 2)."""
    p = points(spark, sf_dir)
    a, b = cloud(p, "p"), cloud(p, "c")
    both = both_ways(a, b)
    lse = both.groupBy("side", "k").agg(F.log(F.sum(F.exp(-0.5 * F.col("d2")))).alias("lse"))
    mean = both.join(lse, ["side", "k"]).groupBy("side", "k").agg(F.avg(0.5 * F.col("d2") + F.col("lse")).alias("v"))
    return mean.groupBy("k").agg((F.floor(F.sum("v") * 0.5 * 1e5 + 0.5) / 1e5).alias("infocd"))


def _code_sql(t: str) -> str:
    return f"""WITH {POINTS_SQL}, {_pair_sql('p', 'c', 'x')}, {_pair_sql('c', 'p', 'y')}, u AS (SELECT 0 AS side, k, {t} AS t FROM x UNION ALL SELECT 1 AS side, k, {t} AS t FROM y),
l AS (SELECT side, k, sum(0.5 * t) + count(*) * 1e-7 * ln(sum(exp(-0.5 * t) + 1e-7)) AS v FROM u GROUP BY side, k)
SELECT k, floor(sum(v) * 0.5 * 1e4 + 0.5) / 1e4 AS infocd FROM l GROUP BY k"""


def summed_infocd(spark: SparkSession, sf_dir: str, square_root: bool) -> DataFrame:
    p = points(spark, sf_dir)
    a, b = cloud(p, "p"), cloud(p, "c")
    t = F.sqrt(F.greatest("d2", F.lit(1e-9))) if square_root else F.col("d2")
    both = both_ways(a, b).withColumn("t", t)
    side = both.groupBy("side", "k").agg((F.sum(0.5 * F.col("t")) + F.count(F.lit(1)) * 1e-7 * F.log(F.sum(F.exp(-0.5 * F.col("t")) + 1e-7))).alias("v"))
    return side.groupBy("k").agg((F.floor(F.sum("v") * 0.5 * 1e4 + 0.5) / 1e4).alias("infocd"))


@query(_code_sql("sqrt(greatest(d2, 1e-9))"))
def infocd_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed_infocd(spark, sf_dir, True)


@query(_code_sql("d2"))
def infocd_sqdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed_infocd(spark, sf_dir, False)


_RES = "res AS (SELECT k, i, (px - cx) * (px - cx) + (py - cy) * (py - cy) + (pz - cz) * (pz - cz) AS r2 FROM pts)"


@query(f"WITH {POINTS_SQL}, {_RES}, h AS (SELECT k, sqrt(greatest(r2, 1e-24)) AS r, r2 FROM res) SELECT k, floor({mean_sql('CASE WHEN r2 <= 0.005 * 0.005 THEN 0.5 * r * r / 0.005 ELSE r - 0.5 * 0.005 END')} * 1e6 + 0.5) / 1e6 AS huber FROM h GROUP BY k")
def huber_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = points(spark, sf_dir).withColumn("r2", squared("p", "c")).withColumn("r", F.sqrt(F.greatest("r2", F.lit(1e-24))))
    loss = F.when(F.col("r2") <= 0.005 * 0.005, 0.5 * F.col("r") * F.col("r") / 0.005).otherwise(F.col("r") - 0.5 * 0.005)
    return h.withColumn("loss", loss).groupBy("k").agg(q6(exact_mean("loss")).alias("huber"))


@query(f"WITH {POINTS_SQL}, {_RES} SELECT k, floor({sum_sql('r2')} * 1e6 + 0.5) / 1e6 AS total, count(*) AS n FROM res GROUP BY k")
def point_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("r2", squared("p", "c")).groupBy("k").agg(q6(exact_sum("r2")).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {POINTS_SQL}, {_RES} SELECT k, floor(quantile_disc(sqrt(r2), 0.95) * 1e6 + 0.5) / 1e6 AS p95, floor(max(sqrt(r2)) * 1e6 + 0.5) / 1e6 AS largest FROM res GROUP BY k")
def displacement_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = points(spark, sf_dir).withColumn("d", F.sqrt(squared("p", "c")))
    return d.groupBy("k").agg(q6(F.expr("percentile_disc(0.95) within group (order by d)")).alias("p95"), q6(F.max("d")).alias("largest"))


@query(f"WITH {POINTS_SQL}, {_near_sql('a', 'p', 'c')}, {_near_sql('b', 'c', 'p')}, {_near_sql('c', 'n', 'c')}, {_near_sql('d', 'c', 'n')} SELECT a.k AS k, floor((a.v + b.v) / greatest(c.v + d.v, 1e-12) * 1e5 + 0.5) / 1e5 AS relative FROM a JOIN b ON a.k = b.k JOIN c ON a.k = c.k JOIN d ON a.k = d.k")
def relative_squared_chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    cd = chamfer(tagged(cloud(p, "p"), "own").union(tagged(cloud(p, "n"), "base")), tagged(cloud(p, "c"), "own", "base"))
    both = cd.groupBy("k.k").agg(*[F.max(F.when(F.col("k.tag") == t, F.col("cd"))).alias(t) for t in ("own", "base")])
    return both.select("k", (F.floor(F.col("own") / F.greatest("base", F.lit(1e-12)) * 1e5 + 0.5) / 1e5).alias("relative"))
