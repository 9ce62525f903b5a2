"""Splits, selections, seeds, permutations and epoch plans: all from hashes, so the same under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import q6, uniform
from ..sources.views import POINTS_SQL, TRIANGLES_SQL, UNIVERSE_SQL, cloud, points, read, triangles, universe
from ..staging import staged
from .digests import of_text, ordered_digest


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def stratified_split(ids: DataFrame, ratio: float, seed: int) -> DataFrame:
    """ids (id, synset) with validation: in each synset clamp(floor(n ratio + 0.5), 1, n - 1) of them, none of a single one."""
    own = Window.partitionBy("synset")
    n = F.count(F.lit(1)).over(own)
    rank = F.row_number().over(own.orderBy(digest(F.lit(seed), F.col("id")), "id"))
    wanted = F.when(F.col("n") == 1, 0).otherwise(F.least(F.col("n") - 1, F.greatest(F.lit(1), F.floor(F.col("n") * ratio + 0.5))))
    return ids.withColumns({"n": n, "rank": rank}).select("id", "synset", (F.col("rank") <= wanted).alias("validation"))


def coverage_first(ids: DataFrame, count: int, seed: int) -> DataFrame:
    """id, synset of `count` selected: one of each synset, then shares of the rest by largest remainder, by digest rank."""
    sizes = ids.groupBy("synset").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.agg(F.count(F.lit(1)).alias("t"), F.sum(F.col("n") - 1).alias("spare")).first()
    free = count - whole["t"]
    if free < 0 or free > whole["spare"]:
        raise ValueError("the count must be between the number of synsets and the number of ids")
    top = F.lit(free) * (F.col("n") - 1)
    spare = max(whole["spare"], 1)
    shares = sizes.withColumns({"share": 1 + F.floor(top / spare), "left": top % spare})
    given = shares.agg(F.sum("share")).first()[0]
    # a row for each synset: the number of categories bounds this one window
    place = F.row_number().over(Window.orderBy(F.desc("left"), "synset"))
    quota = shares.withColumn("quota", F.col("share") + (place <= count - given).cast("long")).select("synset", "quota")
    rank = F.row_number().over(Window.partitionBy("synset").orderBy(digest(F.lit(seed), F.col("id")), "id"))
    return ids.withColumn("rank", rank).join(F.broadcast(quota), "synset").filter("rank <= quota").select("id", "synset")


def with_places(ids: DataFrame) -> DataFrame:
    """ids (id) with p, the place in sorted order: from a range sort and the sizes of its partitions, so no task sorts all."""
    # written before it is read twice, so that rows lost with an executor can't get other numbers
    ids = staged(ids.repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()), "placed")
    parts = ids.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    offset = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = ids.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(offset), "part")
    return placed.withColumn("p", F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")).drop("part", "at", "before")


def permutation(ids: DataFrame, seed: int, epoch: int, batch: int = 64) -> DataFrame:
    """id, digest, bucket-wise position: every id once, in the order of its digest. The position is the count of
    smaller digests' buckets (two hexadecimal digits) and the rank in the own bucket, so no task sorts all."""
    d = ids.select("id", digest(F.lit(seed), F.lit(epoch), F.col("id")).alias("digest")).withColumn("bucket", F.substring("digest", 1, 2))
    sizes = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # 256 rows
    offsets = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("digest", "id")) - 1
    out = d.withColumn("rank", rank).join(F.broadcast(offsets), "bucket").withColumn("position", F.col("rank") + F.col("before"))
    return out.select("id", "position", F.expr(f"position div {batch}").alias("batch"))


_VAL_SQL = f"""{UNIVERSE_SQL}, sp AS (SELECT id, synset, count(*) OVER (PARTITION BY synset) AS n, row_number() OVER (PARTITION BY synset ORDER BY sha256('7:' || CAST(id AS VARCHAR)), id) AS r FROM uni),
sv AS (SELECT id, synset, r <= CASE WHEN n = 1 THEN 0 ELSE least(n - 1, greatest(1, floor(n * 0.05 + 0.5))) END AS validation FROM sp)"""


@query(f"WITH {_VAL_SQL} SELECT * FROM sv")
def stratified_split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(universe(spark, sf_dir), 0.05, 7)


@query(f"""WITH {UNIVERSE_SQL}, sz AS (SELECT synset, count(*) AS n FROM uni GROUP BY synset), tt AS (SELECT count(*) AS t, CAST(sum(n - 1) AS BIGINT) AS spare FROM sz),
sh AS (SELECT synset, 1 + ((150 - t) * (n - 1)) // spare AS share, ((150 - t) * (n - 1)) % spare AS lft FROM sz, tt),
qu AS (SELECT synset, share + CASE WHEN row_number() OVER (ORDER BY lft DESC, synset) <= 150 - (SELECT sum(share) FROM sh) THEN 1 ELSE 0 END AS quota FROM sh),
rk AS (SELECT id, synset, row_number() OVER (PARTITION BY synset ORDER BY sha256('11:' || CAST(id AS VARCHAR)), id) AS r FROM uni)
SELECT id, rk.synset AS synset FROM rk JOIN qu ON rk.synset = qu.synset WHERE r <= quota""")
def coverage_first_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_first(universe(spark, sf_dir), 150, 11)


@query(f"WITH {UNIVERSE_SQL} SELECT synset, count(*) AS n FROM uni GROUP BY synset")
def synset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe(spark, sf_dir).groupBy("synset").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_VAL_SQL} SELECT id, synset FROM uni WHERE id NOT IN (SELECT id FROM sv WHERE validation)")
def exclusion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = universe(spark, sf_dir)
    return u.join(stratified_split(u, 0.05, 7).filter("validation").select("id"), "id", "left_anti")


def split_problems(train: DataFrame, validation: DataFrame, known: DataFrame) -> DataFrame:
    """problem, id: ids in both splits, unknown ids, ids in none."""
    overlap = train.intersect(validation).withColumn("problem", F.lit("overlap"))
    unknown = train.union(validation).join(known, "id", "left_anti").withColumn("problem", F.lit("unknown"))
    missing = known.join(train.union(validation), "id", "left_anti").withColumn("problem", F.lit("missing"))
    return overlap.unionByName(unknown).unionByName(missing).distinct()


_SPLITS = "tr AS (SELECT id FROM uni WHERE id % 10 < 7), va AS (SELECT id FROM uni WHERE id % 10 >= 6 AND id % 10 < 9 UNION ALL SELECT -1 AS id)"


@query(f"WITH {UNIVERSE_SQL}, {_SPLITS} SELECT 'overlap' AS problem, id FROM (SELECT id FROM tr INTERSECT SELECT id FROM va) UNION ALL SELECT 'unknown' AS problem, id FROM va WHERE id NOT IN (SELECT id FROM uni) UNION ALL SELECT 'missing' AS problem, id FROM uni WHERE id % 10 >= 9")
def split_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = universe(spark, sf_dir).select("id")
    extra = spark.range(-1, 0).select("id")
    return split_problems(ids.filter("id % 10 < 7"), ids.filter("id % 10 >= 6 and id % 10 < 9").union(extra), ids)


@query(f"WITH {UNIVERSE_SQL} SELECT 'p' || CAST(id AS VARCHAR) AS id FROM uni UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier")
def universe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = universe(spark, sf_dir).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"))
    b = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return a.unionByName(b)


@query(f"WITH {UNIVERSE_SQL}, u2 AS (SELECT DISTINCT l_partkey + CASE WHEN l_partkey % 41 = 7 THEN 5000000 ELSE 0 END AS id FROM lineitem) SELECT 'only_left' AS side, id FROM uni WHERE id NOT IN (SELECT id FROM u2) UNION ALL SELECT 'only_right' AS side, id FROM u2 WHERE id NOT IN (SELECT id FROM uni)")
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of only one of two inventories; some ids of the second are put out of place."""
    a = universe(spark, sf_dir).select("id")
    b = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.when(F.col("l_partkey") % 41 == 7, 5000000).otherwise(0)).alias("id")).distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("only_left")).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit("only_right")))


@query(f"WITH {UNIVERSE_SQL} SELECT id, CAST(row_number() OVER (ORDER BY sha256('3:1:' || CAST(id AS VARCHAR)), id) - 1 AS BIGINT) AS position, (row_number() OVER (ORDER BY sha256('3:1:' || CAST(id AS VARCHAR)), id) - 1) // 64 AS batch FROM uni")
def epoch_permutation_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation(universe(spark, sf_dir), 3, 1)


@query(f"WITH {UNIVERSE_SQL}, p AS (SELECT id, (row_number() OVER (ORDER BY sha256('3:2:' || CAST(id AS VARCHAR)), id) - 1) // 64 AS batch FROM uni) SELECT batch, count(*) AS n, min(id) AS lo, max(id) AS hi FROM p WHERE batch >= 3 GROUP BY batch")
def epoch_batches_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of an epoch from the third on, the last one short."""
    p = permutation(universe(spark, sf_dir), 3, 2).filter("batch >= 3")
    return p.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query("SELECT l_suppkey AS stream, count(DISTINCT l_partkey) AS seen, count(*) - count(DISTINCT l_partkey) AS repeats, (SELECT count(*) FROM part) - count(DISTINCT l_partkey) AS missing FROM lineitem GROUP BY l_suppkey")
def epoch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = read(spark, sf_dir, "part").count()
    seen = F.count_distinct("l_partkey")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("stream")).agg(seen.alias("seen"), (F.count(F.lit(1)) - seen).alias("repeats"), (total - seen).alias("missing"))


@query(f"WITH {UNIVERSE_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM uni) SELECT p // 512 AS chunk, count(*) AS n, min(id) AS first, max(id) AS last FROM r GROUP BY p // 512")
def chunk_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 512 ids in sorted order."""
    placed = with_places(universe(spark, sf_dir).select("id"))
    return placed.groupBy(F.expr("p div 512").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"WITH {UNIVERSE_SQL} SELECT id FROM uni WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0)")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("id"))
    return universe(spark, sf_dir).select("id").join(done, "id", "left_anti")


def little_endian_u64(hexed: Column) -> Column:
    """The first eight bytes of a hexadecimal digest, least byte first, as decimal(20, 0)."""
    pairs = F.concat(*[F.substring(hexed, 2 * k + 1, 2) for k in reversed(range(8))])
    return F.conv(pairs, 16, 10).cast("decimal(20,0)")


@query(f"WITH {UNIVERSE_SQL}, h AS (SELECT id, sha256('20260726:' || CAST(id AS VARCHAR)) AS d FROM uni) SELECT id, d AS digest, substr(d, 15, 2) || substr(d, 13, 2) || substr(d, 11, 2) || substr(d, 9, 2) || substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2) AS seed_hex FROM h")
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = digest(F.lit(20260726), F.col("id"))
    u = universe(spark, sf_dir).select("id", d.alias("digest"))
    return u.withColumn("seed_hex", F.lower(F.lpad(F.conv(little_endian_u64(F.col("digest")).cast("string"), 10, 16), 16, "0")))


@query(f"WITH {UNIVERSE_SQL} SELECT synset, sha256(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY id) || chr(10)) AS digest FROM uni GROUP BY synset")
def ids_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each category's sorted ids, a line each."""
    rows = universe(spark, sf_dir).withColumn("line", F.concat(F.col("id").cast("string"), F.lit("\n")))
    return ordered_digest(rows, "synset", ["id"], of_text("line")).select("synset", F.col("sha256").alias("digest"))


@query(f"WITH {UNIVERSE_SQL} SELECT id, 'b' || lpad(lower(to_hex(id)), 31, '0') AS mapped, regexp_matches('b' || lpad(lower(to_hex(id)), 31, '0'), '^b[0-9a-f]{{31}}$') AS valid FROM uni")
def id_mapping_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = F.concat(F.lit("b"), F.lpad(F.lower(F.hex("id")), 31, "0"))
    return universe(spark, sf_dir).select("id", mapped.alias("mapped"), mapped.rlike("^b[0-9a-f]{31}$").alias("valid"))


def _u_sql(*parts: str) -> str:
    return "((CAST(('0x' || substr(sha256(" + " || ':' || ".join(parts) + "), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query(f"""WITH {POINTS_SQL}, u AS (SELECT k, i, cx, {_u_sql("'noise'", 'CAST(k AS VARCHAR)', 'CAST(i AS VARCHAR)')} AS u FROM pts)
SELECT k, i, floor((cx - 0.01 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5))) * 1e6 + 0.5) / 1e6 AS x FROM u""")
def laplace_hash_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplace noise of scale 0.01 from a hashed uniform by the inverse of the distribution."""
    u = uniform("noise", F.col("k"), F.col("i")) - 0.5
    p = points(spark, sf_dir).withColumn("u", u)
    return p.select("k", "i", q6(F.col("cx") - 0.01 * F.signum("u") * F.log(1 - 2 * F.abs("u"))).alias("x"))


@query(f"""WITH {POINTS_SQL}, u AS (SELECT k, i, cx, {_u_sql("'r'", 'CAST(k AS VARCHAR)', 'CAST(i AS VARCHAR)')} AS u, {_u_sql("'t'", 'CAST(k AS VARCHAR)', 'CAST(i AS VARCHAR)')} AS t FROM pts)
SELECT k, i, floor((cx + 0.01 * sqrt(-2 * ln(u)) * cos(2 * pi() * t)) * 1e6 + 0.5) / 1e6 AS x FROM u""")
def gaussian_hash_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, t = (uniform(s, F.col("k"), F.col("i")) for s in "rt")
    p = points(spark, sf_dir).withColumns({"u": u, "t": t})
    return p.select("k", "i", q6(F.col("cx") + 0.01 * F.sqrt(-2 * F.log("u")) * F.cos(2 * F.pi() * F.col("t"))).alias("x"))


def surface_samples(mesh: DataFrame, count: int, seed: str) -> DataFrame:
    """k, n, f, x, y, z: points on the mesh's faces, chosen by area with hashed uniforms and square-root weights.

    A face takes the uniforms in its stretch of cumulative area: both are put into equal cells of [0, 1), as many as the mesh has
    faces, so a cell meets a face or two of even size, and the join is an equi-join."""
    b, g = ({c: F.col({"by": "by_"}.get(p + c, p + c)) - F.col("a" + c) for c in "xyz"} for p in "bg")
    nx, ny, nz = (b[u] * g[v] - b[v] * g[u] for u, v in (("y", "z"), ("z", "x"), ("x", "y")))
    area = F.floor(0.5 * F.sqrt(nx * nx + ny * ny + nz * nz) * 1e9 + 0.5)
    own = Window.partitionBy("k")
    faces = mesh.withColumn("area", area).filter("area > 0").withColumn("upto", F.sum("area").over(own.orderBy("f"))).withColumn("total", F.sum("area").over(own))
    faces = faces.withColumns({"lo": (F.col("upto") - F.col("area")) / F.col("total"), "hi": F.col("upto") / F.col("total")})
    faces = faces.withColumn("cells", F.count(F.lit(1)).over(own))
    faces = faces.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * F.col("cells")), F.floor(F.col("hi") * F.col("cells"))))).drop("cells")
    n = mesh.filter(area > 0).groupBy("k").agg(F.count(F.lit(1)).alias("cells")).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    draws = n.withColumns({c: uniform(seed + c, F.col("k"), F.col("n")) for c in "fuv"}).withColumnRenamed("f", "pick").withColumn("cell", F.floor(F.col("pick") * F.col("cells"))).drop("cells")
    hit = draws.join(faces, ["k", "cell"]).filter("pick >= lo and pick < hi")
    r = F.sqrt("u")
    w = {"a": 1 - r, "b": r * (1 - F.col("v")), "g": r * F.col("v")}
    corner = lambda p, c: F.col({"by": "by_"}.get(p + c, p + c))
    return hit.select("k", "n", "f", *[(w["a"] * corner("a", c) + w["b"] * corner("b", c) + w["g"] * corner("g", c)).alias(c) for c in "xyz"])


def samples_sql(seed: str, count: int) -> str:
    """CTEs over tri that end in sm (k, n, f, x, y, z): surface samples."""
    return f"""
sn AS (SELECT *, (by_ - ay) * (gz - az) - (bz - az) * (gy - ay) AS nx, (bz - az) * (gx - ax) - (bx - ax) * (gz - az) AS ny, (bx - ax) * (gy - ay) - (by_ - ay) * (gx - ax) AS nz FROM tri),
sa AS (SELECT *, CAST(floor(0.5 * sqrt(nx * nx + ny * ny + nz * nz) * 1e9 + 0.5) AS BIGINT) AS area FROM sn),
su AS (SELECT *, CAST(sum(area) OVER (PARTITION BY k ORDER BY f) AS BIGINT) AS upto, CAST(sum(area) OVER (PARTITION BY k) AS BIGINT) AS total FROM sa WHERE area > 0),
sd AS (SELECT k, CAST(range AS INTEGER) AS n, {', '.join(_u_sql(f"'{seed}{c}'", 'CAST(k AS VARCHAR)', 'CAST(range AS VARCHAR)') + f' AS d{c}' for c in 'fuv')} FROM (SELECT DISTINCT k FROM tri) t, range(0, {count})),
sm AS (SELECT sd.k AS k, n, f, {', '.join(f"(1 - sqrt(du)) * a{a} + sqrt(du) * (1 - dv) * {'by_' if a == 'y' else 'b' + a} + sqrt(du) * dv * g{a} AS {a}" for a in 'xyz')} FROM sd JOIN su ON sd.k = su.k AND df >= (upto - area) / total AND df < upto / total)"""


@query(f"WITH {POINTS_SQL}, {TRIANGLES_SQL}, {samples_sql('s', 40)} SELECT k, n, f, " + ", ".join(f"floor({a} * 1e6 + 0.5) / 1e6 AS {a}" for a in "xyz") + " FROM sm")
def surface_sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface_samples(triangles(spark, sf_dir), 40, "s").select("k", "n", "f", *[q6(a).alias(a) for a in "xyz"])


@query(f"WITH {UNIVERSE_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS p FROM uni) SELECT id, CAST(p % 8 AS BIGINT) AS bin, CAST(0.005 AS DOUBLE) + (p % 8 + CAST(0.5 AS DOUBLE)) * ((CAST(0.02 AS DOUBLE) - CAST(0.005 AS DOUBLE)) / 8) AS scale FROM r")
def noise_scale_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins dealt in id order; each has the midpoint of its eighth of [0.005, 0.02]."""
    place = with_places(universe(spark, sf_dir).select("id"))
    b = (F.col("p") % 8).cast("long")
    return place.select("id", b.alias("bin"), (0.005 + (b + 0.5) * ((0.02 - 0.005) / 8)).alias("scale"))


def cube_rotations() -> list[list[list[int]]]:
    """The 24 signed permutation matrices of determinant 1, sorted."""
    from itertools import permutations, product

    out = []
    for p in permutations(range(3)):
        parity = 1 if p in ((0, 1, 2), (1, 2, 0), (2, 0, 1)) else -1
        for s in product((-1, 1), repeat=3):
            if parity * s[0] * s[1] * s[2] == 1:
                out.append([[s[r] if c == p[r] else 0 for c in range(3)] for r in range(3)])
    return sorted(out)


_CUBE_SQL = "cube AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {', '.join(str(x) for row in r for x in row)})" for n, r in enumerate(cube_rotations())) + ") t(turn, " + ", ".join(f"m{r}{c}" for r in range(3) for c in range(3)) + "))"


@query(f"""WITH {POINTS_SQL}, {_CUBE_SQL}, t AS (SELECT k, i, cx, cy, cz, CAST(floor({_u_sql("'turn'", 'CAST(k AS VARCHAR)')} * 24) AS INTEGER) AS turn FROM pts)
SELECT k, i, t.turn AS turn, {', '.join(f"floor((0.0 + m{r}0 * cx + m{r}1 * cy + m{r}2 * cz) * 1e6 + 0.5) / 1e6 AS {a}" for r, a in enumerate('xyz'))} FROM t JOIN cube ON t.turn = cube.turn""")
def cube24_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clean point, turned by the rotation that its cloud's hash picks."""
    m = spark.createDataFrame([(n, *[float(x) for row in r for x in row]) for n, r in enumerate(cube_rotations())], "turn int, " + ", ".join(f"m{r}{c} double" for r in range(3) for c in range(3)))
    c = cloud(points(spark, sf_dir), "c").withColumn("turn", F.floor(uniform("turn", F.col("k")) * 24).cast("int"))
    turned = c.join(F.broadcast(m), "turn")
    return turned.select("k", "i", "turn", *[q6(sum((F.col(f"m{r}{j}") * F.col(a) for j, a in enumerate("xyz")), F.lit(0.0))).alias(o) for r, o in enumerate("xyz")])
