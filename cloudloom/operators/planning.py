"""Which samples, centres, views and patches an epoch takes: selections and plans from hashes, the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import exact_mean, mean_sql, q6, uniform
from ..sources.views import POINTS_SQL, TRIANGLES_SQL, UNIVERSE_SQL, cloud, points, read, train_log, triangles, universe
from .grid import corners
from .neighbors import tagged
from .patches import farthest_points, fps_sql
from .sampling import _VAL_SQL, _u_sql, digest, samples_sql, split_problems, stratified_split, surface_samples


def selection_problems(ids: DataFrame, requested: DataFrame) -> DataFrame:
    """problem, id: requested ids that are unknown, or asked for twice."""
    unknown = requested.join(ids, "id", "left_anti").select(F.lit("unknown").alias("problem"), "id").distinct()
    twice = requested.groupBy("id").count().filter("count > 1").select(F.lit("repeated").alias("problem"), "id")
    return unknown.unionByName(twice)


def selected(ids: DataFrame, requested: DataFrame, first: int | None = None) -> DataFrame:
    """The requested ids that are known, or the first few of them in id order."""
    out = ids.join(requested.select("id").distinct(), "id", "left_semi")
    return out if first is None else out.orderBy("id").limit(first)


_REQUESTED = "rq AS (SELECT l_partkey + CASE WHEN l_linenumber = 1 THEN 1000000 ELSE 0 END AS id FROM lineitem WHERE l_quantity < 3)"


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").filter("l_quantity < 3")
    return line.select((F.col("l_partkey") + F.when(F.col("l_linenumber") == 1, 1000000).otherwise(0)).alias("id"))


@query(f"WITH {UNIVERSE_SQL}, {_REQUESTED} SELECT id, synset FROM uni WHERE id IN (SELECT id FROM rq)")
def id_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(universe(spark, sf_dir), _requested(spark, sf_dir))


@query(f"WITH {UNIVERSE_SQL}, {_REQUESTED} SELECT id, synset FROM uni WHERE id IN (SELECT id FROM rq) ORDER BY id LIMIT 20")
def id_selection_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selected(universe(spark, sf_dir), _requested(spark, sf_dir), 20)


@query(f"WITH {UNIVERSE_SQL}, {_REQUESTED} SELECT DISTINCT 'unknown' AS problem, id FROM rq WHERE id NOT IN (SELECT id FROM uni) UNION ALL SELECT 'repeated' AS problem, id FROM rq GROUP BY id HAVING count(*) > 1")
def id_selection_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection_problems(universe(spark, sf_dir).select("id"), _requested(spark, sf_dir))


def all_train(train: DataFrame, validation: DataFrame, known: DataFrame) -> DataFrame:
    """id, problem: the union of both splits as training ids; a problem where the splits aren't a partition of the known ids."""
    problems = split_problems(train, validation, known)
    return train.union(validation).distinct().join(problems, "id", "full_outer").select("id", "problem")


@query(f"WITH {_VAL_SQL} SELECT id, CASE WHEN id % 97 = 5 THEN 'missing' END AS problem FROM sv")
def all_train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recomputed split, joined to all-train, with some validation and training ids lost on the way."""
    u = universe(spark, sf_dir)
    split = stratified_split(u, 0.05, 7).filter("id % 97 <> 5")
    return all_train(split.filter("not validation").select("id"), split.filter("validation").select("id"), u.select("id"))


def epoch_plan(samples: DataFrame, points_: int | Column, seed: int, epoch: int, patches: int = 4) -> DataFrame:
    """position, id, patch_rank, center: samples (id) in hashed order, of each `patches` different centres out of `points_`, in
    hashed order. The position follows from counts by bucket of the digest (two hexadecimal digits), so no task sorts all."""
    d = samples.select("id", digest(F.lit("shape"), F.lit(seed), F.lit(epoch), F.col("id")).alias("digest")).withColumn("bucket", F.substring("digest", 1, 2))
    before = F.sum("c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # 256 rows
    offsets = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("digest", "id")) - 1 + F.col("before")
    d = d.join(F.broadcast(offsets), "bucket").withColumn("shape", place)
    n = points_ if isinstance(points_, Column) else F.lit(points_)
    every = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.struct(digest(F.lit("centre"), F.lit(seed), F.lit(epoch), F.col("id"), c).alias("h"), c.alias("c"))))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(patches - 1)), lambda r: F.struct(digest(F.lit("patch"), F.lit(seed), F.lit(epoch), F.col("id"), r).alias("h"), r.alias("r"))))
    d = d.select("id", "shape", F.slice(every, 1, patches).alias("centres"), F.posexplode(order).alias("at", "o"))
    return d.select((F.col("shape") * patches + F.col("at")).alias("position"), "id", F.col("o.r").alias("patch_rank"), F.get("centres", F.col("o.r"))["c"].alias("center"))


@query(f"""WITH {UNIVERSE_SQL}, sh AS (SELECT id, row_number() OVER (ORDER BY sha256('shape:5:2:' || CAST(id AS VARCHAR)), id) - 1 AS shape FROM uni),
ce AS (SELECT id, CAST(range AS INTEGER) AS center, row_number() OVER (PARTITION BY id ORDER BY sha256('centre:5:2:' || CAST(id AS VARCHAR) || ':' || CAST(range AS VARCHAR)), range) - 1 AS r FROM uni, range(0, 40)),
od AS (SELECT id, CAST(range AS INTEGER) AS r, row_number() OVER (PARTITION BY id ORDER BY sha256('patch:5:2:' || CAST(id AS VARCHAR) || ':' || CAST(range AS VARCHAR)), range) - 1 AS place FROM uni, range(0, 4))
SELECT shape * 4 + place AS position, sh.id AS id, od.r AS patch_rank, center FROM sh JOIN od ON sh.id = od.id JOIN ce ON ce.id = sh.id AND ce.r = od.r""")
def patch_epoch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epoch_plan(universe(spark, sf_dir).select("id"), 40, 5, 2)


def view_schedule(epochs: DataFrame, views: int, view_offset: int, center_offset: int, centers: int) -> DataFrame:
    """epochs (epoch) with view, visit, center_rank, and whether the plan has that many centres."""
    at = F.col("epoch") + view_offset
    out = epochs.select("epoch", F.pmod(at, F.lit(views)).alias("view"), F.floor(at / views).alias("visit"))
    return out.withColumn("center_rank", F.col("visit") + center_offset).withColumn("planned", F.col("center_rank") < centers)


@query("SELECT epoch, (epoch + 3) % 2 AS view, (epoch + 3) // 2 AS visit, (epoch + 3) // 2 + 4 AS center_rank, (epoch + 3) // 2 + 4 < 10 AS planned FROM (SELECT DISTINCT event_id // 500 AS epoch FROM events)")
def view_center_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epochs of the log, over two views and plans of ten centres."""
    epochs = train_log(spark, sf_dir).select("epoch").distinct()
    return view_schedule(epochs, 2, 3, 4, 10)


def center_plan(views: DataFrame, centers: int) -> DataFrame:
    """k (a struct of cloud and view), rank, i: the first farthest-point samples of each view, from its first point."""
    first = views.groupBy("k").agg(F.min("i").alias("s")).select(F.lit("index0").alias("plan"), "k", "s")
    return farthest_points(first, views, centers).drop("plan")


def center_plan_problems(plan: DataFrame, views: DataFrame, centers: int) -> DataFrame:
    """problem, k: views whose plan does not begin with the first point, has a point twice, out of range, or too few."""
    known = plan.join(views.select("k", "i", F.lit(1).alias("known")), ["k", "i"], "left")
    sums = known.groupBy("k").agg(F.min_by("i", "rank").alias("first"), F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("different"), F.count("known").alias("known"))
    tests = {"first": F.col("first") != 0, "repeated": F.col("different") < F.col("n"), "range": F.col("known") < F.col("n"), "count": F.col("n") != centers}
    return sums.select("k", F.explode(F.filter(F.array(*[F.when(t, p) for p, t in tests.items()]), lambda x: x.isNotNull())).alias("problem")).select("problem", "k")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return tagged(cloud(p, "c"), "0").union(tagged(cloud(p, "n"), "1"))


def _fps_of(p: str, name: str) -> str:
    return fps_sql(p, "10").replace("st AS (", f"{name}st AS (", 1).replace("FROM st JOIN", f"FROM {name}st st JOIN").replace("fps AS (", f"{name} AS (", 1).replace("FROM fps)", f"FROM {name})")


@query(f"WITH RECURSIVE {POINTS_SQL}, {_fps_of('c', 'fa')}, {_fps_of('n', 'fb')} SELECT DISTINCT k, '0' AS view, CAST(rank AS INTEGER) AS rank, CAST(cur AS INTEGER) AS i FROM fa UNION ALL SELECT DISTINCT k, '1' AS view, CAST(rank AS INTEGER) AS rank, CAST(cur AS INTEGER) AS i FROM fb")
def fps_center_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten centres of each cloud's clean and noisy view."""
    return center_plan(_views(spark, sf_dir), 10).select("k.k", F.col("k.tag").alias("view"), "rank", "i")


@query(f"""WITH {POINTS_SQL}, ks AS (SELECT DISTINCT k FROM pts) SELECT 'first' AS problem, k FROM ks WHERE k % 3 = 1 UNION ALL SELECT 'repeated' AS problem, k FROM ks WHERE k % 3 = 1
UNION ALL SELECT 'range' AS problem, k FROM ks WHERE k % 3 = 2""")
def center_plan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan in which some clouds' first centre is the second, and some have a centre that isn't a point."""
    c = tagged(cloud(points(spark, sf_dir), "c"), "0")
    plan = center_plan(c, 6)
    wrong = F.when((F.col("k.k") % 3 == 1) & (F.col("rank") == 0), F.col("i1")).when((F.col("k.k") % 3 == 2) & (F.col("rank") == 5), 1 << 30).otherwise(F.col("i"))
    second = plan.filter("rank = 1").select("k", F.col("i").alias("i1"))
    plan = plan.join(second, "k").select("k", "rank", wrong.alias("i"))
    return center_plan_problems(plan, c, 6).select("problem", "k.k")


#: Visits that one task takes, about.
VISITS = 250_000


def visited(visits: DataFrame, each: int = VISITS) -> DataFrame:
    """stream, batch, covered of visits (stream, batch, item). They are dealt by stream into as many tasks as their number asks
    for, so that what a task holds doesn't grow with it; counts, joins and sums stay where their stream is."""
    spark = visits.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-visits.count() // each))
    mine = visits.repartition(parts, "stream")
    # a batch's first visits and its own row come from one pass
    first = mine.groupBy("stream", "item").agg(F.min("batch").alias("batch")).select("stream", "batch", F.lit(1).alias("fresh"))
    rows = first.unionByName(mine.select("stream", "batch", F.lit(0).alias("fresh"))).repartition(parts, "stream")
    sums = rows.groupBy("stream", "batch").agg(F.sum("fresh").alias("fresh"))
    return sums.select("stream", "batch", F.sum("fresh").over(Window.partitionBy("stream").orderBy("batch")).alias("covered"))


@query("""WITH v AS (SELECT l_suppkey AS stream, l_partkey AS item, min(l_orderkey // 100) AS batch FROM lineitem GROUP BY l_suppkey, l_partkey),
b AS (SELECT DISTINCT l_suppkey AS stream, l_orderkey // 100 AS batch FROM lineitem), n AS (SELECT stream, batch, count(*) AS fresh FROM v GROUP BY stream, batch)
SELECT b.stream AS stream, b.batch AS batch, CAST(sum(coalesce(fresh, 0)) OVER (PARTITION BY b.stream ORDER BY b.batch) AS BIGINT) AS covered FROM b LEFT JOIN n ON b.stream = n.stream AND b.batch = n.batch""")
def prefix_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different items that each stream has seen up to each of its batches: running counts of first visits."""
    line = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stream"), F.expr("l_orderkey div 100").alias("batch"), F.col("l_partkey").alias("item"))
    return visited(line)


def mesh_vertices(mesh: DataFrame, with_area: bool) -> DataFrame:
    """k, x, y, z: the different corners of a mesh, or those of triangles that have an area."""
    if with_area:
        cross = [f"(b{u} - a{u}) * (g{v} - a{v}) - (b{v} - a{v}) * (g{u} - a{u})".replace("by ", "by_ ") for u, v in (("y", "z"), ("z", "x"), ("x", "y"))]
        mesh = mesh.filter(" or ".join(f"{c} <> 0" for c in cross))
    return corners(mesh).distinct()


def vertex_mix(mesh: DataFrame, count: int, vertices: int, seed: str, with_area: bool = True, paired: bool = False) -> DataFrame:
    """k, n, is_vertex, x, y, z: `count` points of each mesh, of which `vertices` (or all, if there are fewer) are corners.

    Mixed: the corners come first, the rest from the surface. Paired: the whole surface sample, in which hashed places are
    replaced by corners; all other points stay what they are without. Streams are independent hashes."""
    own = mesh_vertices(mesh, with_area)
    rank = F.row_number().over(Window.partitionBy("k").orderBy(digest(F.lit(seed + "v"), F.col("k"), *[F.format_string("%.9f", a) for a in "xyz"]), *"xyz")) - 1
    chosen = own.withColumn("rank", rank).filter(F.col("rank") < vertices)
    surface = surface_samples(mesh, count, seed).select("k", "n", *"xyz")
    have = chosen.groupBy("k").agg(F.count(F.lit(1)).alias("have"))
    if not paired:
        rest = surface.join(have, "k").filter(F.col("n") < count - F.col("have")).select("k", (F.col("n") + F.col("have")).alias("n"), F.lit(False).alias("is_vertex"), *"xyz")
        return chosen.select("k", F.col("rank").alias("n"), F.lit(True).alias("is_vertex"), *"xyz").unionByName(rest.withColumn("n", F.col("n").cast("int")))
    place = F.row_number().over(Window.partitionBy("k").orderBy(digest(F.lit(seed + "p"), F.col("k"), F.col("n")), "n")) - 1
    both = surface.withColumn("rank", place).join(chosen.select("k", "rank", *[F.col(a).alias("v" + a) for a in "xyz"]), ["k", "rank"], "left")
    return both.select("k", "n", F.col("vx").isNotNull().alias("is_vertex"), *[F.coalesce("v" + a, a).alias(a) for a in "xyz"])


_VERTICES = """vx AS (SELECT DISTINCT k, x, y, z FROM (SELECT k, ax AS x, ay AS y, az AS z FROM tri UNION ALL SELECT k, bx, by_, bz FROM tri UNION ALL SELECT k, gx, gy, gz FROM tri))"""


def _with_flat(mesh: DataFrame) -> DataFrame:
    """The mesh with every third triangle made flat: its last corner is where its second one is."""
    flat = F.col("f") % 9 == 0
    return mesh.withColumns({f"g{a}": F.when(flat, F.col("by_" if a == "y" else f"b{a}")).otherwise(F.col(f"g{a}")) for a in "xyz"})


@query(f"""WITH {POINTS_SQL}, {TRIANGLES_SQL}, fl AS (SELECT k, f, ax, ay, az, bx, by_, bz, {', '.join(f"CASE WHEN f % 9 = 0 THEN {'by_' if a == 'y' else 'b' + a} ELSE g{a} END AS g{a}" for a in 'xyz')} FROM tri),
{_VERTICES.replace('FROM tri', 'FROM fl WHERE f % 9 <> 0')} SELECT k, count(*) AS n, floor({mean_sql('x')} * 1e6 + 0.5) / 1e6 AS mean_x FROM vx GROUP BY k""")
def positive_area_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of triangles that have an area, of meshes with flat ones."""
    v = mesh_vertices(_with_flat(triangles(spark, sf_dir)), True)
    return v.groupBy("k").agg(F.count(F.lit(1)).alias("n"), q6(exact_mean("x")).alias("mean_x"))


_MIX_SQL = f"""WITH {POINTS_SQL}, {TRIANGLES_SQL}, {_VERTICES}, {samples_sql('m', 40)},
ch AS (SELECT k, x, y, z, row_number() OVER (PARTITION BY k ORDER BY sha256('mv:' || CAST(k AS VARCHAR) || ':' || printf('%.9f', x) || ':' || printf('%.9f', y) || ':' || printf('%.9f', z)), x, y, z) - 1 AS r FROM vx),
h AS (SELECT k, least(count(*), 8) AS have FROM vx GROUP BY k)"""
_XYZ = ", ".join(f"floor({a} * 1e6 + 0.5) / 1e6 AS {a}" for a in "xyz")


@query(f"{_MIX_SQL} SELECT k, n, is_vertex, {_XYZ} FROM (SELECT k, CAST(r AS INTEGER) AS n, true AS is_vertex, x, y, z FROM ch WHERE r < 8 UNION ALL SELECT sm.k, CAST(n + have AS INTEGER), false, x, y, z FROM sm JOIN h ON sm.k = h.k WHERE n < 40 - have)")
def vertex_mix_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex_mix(triangles(spark, sf_dir), 40, 8, "m").select("k", "n", "is_vertex", *[q6(a).alias(a) for a in "xyz"])


@query(f"""{_MIX_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sha256('mp:' || CAST(k AS VARCHAR) || ':' || CAST(n AS VARCHAR)), n) - 1 AS place FROM sm)
SELECT k, n, is_vertex, {_XYZ} FROM (SELECT p.k AS k, n, ch.k IS NOT NULL AS is_vertex, {', '.join(f'coalesce(ch.{a}, p.{a}) AS {a}' for a in 'xyz')} FROM p LEFT JOIN ch ON p.k = ch.k AND p.place = ch.r AND ch.r < 8)""")
def paired_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex_mix(triangles(spark, sf_dir), 40, 8, "m", paired=True).select("k", "n", "is_vertex", *[q6(a).alias(a) for a in "xyz"])


def euler(angles: list[Column]) -> list[list[Column]]:
    """The matrix of Rz Ry Rx for angles about x, y, z."""
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(a), F.sin(a)) for a in angles)
    return [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]


def rotated_pairs(pairs: DataFrame, seed: str) -> DataFrame:
    """Clean (c) and noisy (n) points of a cloud, turned by one matrix from the cloud's hashed angles."""
    turn = pairs.select("k").distinct().withColumns({f"a{c}": 2 * F.pi() * uniform(seed + c, F.col("k")) for c in "xyz"})
    m = euler([F.col("a" + c) for c in "xyz"])
    turn = turn.select("k", *[m[r][c].alias(f"m{r}{c}") for r in range(3) for c in range(3)])
    out = pairs.join(turn, "k")
    return out.select("k", "i", *[(F.col(f"m{r}0") * F.col(p + "x") + F.col(f"m{r}1") * F.col(p + "y") + F.col(f"m{r}2") * F.col(p + "z")).alias(p + a) for p in "cn" for r, a in enumerate("xyz")])


@query(f"""WITH {POINTS_SQL}, an AS (SELECT k, {', '.join(f"2 * pi() * {_u_sql(chr(39) + 'e' + c + chr(39), 'CAST(k AS VARCHAR)')} AS a{c}" for c in 'xyz')} FROM (SELECT DISTINCT k FROM pts)),
m AS (SELECT k, cos(ax) AS cx, sin(ax) AS sx, cos(ay) AS cy, sin(ay) AS sy, cos(az) AS cz, sin(az) AS sz FROM an)
SELECT p.k AS k, i, {', '.join(f"floor((m.cz * m.cy * p.{v}x + (m.cz * m.sy * m.sx - m.sz * m.cx) * p.{v}y + (m.cz * m.sy * m.cx + m.sz * m.sx) * p.{v}z) * 1e5 + 0.5) / 1e5 AS {v}x, floor((-m.sy * p.{v}x + m.cy * m.sx * p.{v}y + m.cy * m.cx * p.{v}z) * 1e5 + 0.5) / 1e5 AS {v}z" for v in 'cn')} FROM pts p JOIN m ON p.k = m.k""")
def euler_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rotated_pairs(points(spark, sf_dir), "e")
    return r.select("k", "i", *[(F.floor(F.col(c) * 1e5 + 0.5) / 1e5).alias(c) for c in ("cx", "cz", "nx", "nz")])
