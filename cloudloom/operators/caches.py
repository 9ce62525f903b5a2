"""Caches of sampled clouds: built in committed batches that a later run takes up, verified by making them again, merged.

A cache is a folder: contract (what it is made from), data/batch=N (points) and ledger/batch=N (a row for each cloud, made
from what was written). A batch counts once its ledger is written whole; a run that was ended leaves at most one batch
without a ledger, which is written again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import q6, uniform
from ..sources.views import POINTS_SQL, TRIANGLES_SQL, cloud, points, triangles
from ..staging import shared_dir, staged
from .digests import _float_bits_sql, _hex_sql, _LE8, _u64_sql, cloud_digests, of_text, ordered_digest, view_seed
from .neighbors import FRAME_SQL, frame, framed
from .sampling import _u_sql, surface_samples, with_places

#: Clouds of a batch.
BATCH = 256
_ROWS = "k {k}, view int, i int, x float, y float, z float"


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose ledger was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path(f"{folder}/ledger")):
        return []
    found = [s.getPath().getName() for s in system.listStatus(path(f"{folder}/ledger"))]
    return sorted(int(n.partition("=")[2]) for n in found if n.startswith("batch=") and system.exists(path(f"{folder}/ledger/{n}/_SUCCESS")))


def _batches(spark: SparkSession, folder: str, table: str, numbers: list[int]) -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{table}").parquet(*[f"{folder}/{table}/batch={n}" for n in numbers])


def clouds_of(spark: SparkSession, folder: str) -> DataFrame:
    """k, view, i, x, y, z, batch of the committed batches."""
    return _batches(spark, folder, "data", committed(spark, folder))


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """k, view, seed, n, sha256, batch: a row for each cloud of the committed batches."""
    return _batches(spark, folder, "ledger", committed(spark, folder))


def content(clouds: DataFrame) -> DataFrame:
    """k, view, n, sha256 of the NPY payload of each cloud."""
    named = clouds.select(F.struct("k", "view").alias("k"), "i", *"xyz")
    return cloud_digests(named).select("k.k", "k.view", "n", "sha256")


def _differences(claimed: DataFrame, found: DataFrame) -> DataFrame:
    a, b = (df.select("k", "view", F.struct("n", "sha256").alias(name)) for df, name in ((claimed, "a"), (found, "b")))
    return a.join(b, ["k", "view"], "full_outer").filter("not a <=> b")


def build(ids: DataFrame, folder: str, contract: dict[str, object], make: Callable[[DataFrame], DataFrame], seeds: Callable[[DataFrame], DataFrame], size: int = BATCH) -> DataFrame:
    """The manifest of a cache of the clouds that make gives for ids (k): k, view, i, x, y, z. seeds gives k, view, seed.

    Batches are ids in order, `size` a batch. A folder that was begun is taken up: its contract, with the digest of the ids,
    must be the same, and what its ledgers say must be what is there; the batches that it lacks are made."""
    spark = ids.sparkSession
    ids = staged(with_places(ids.select("k").distinct().withColumnRenamed("k", "id")).select(F.col("id").alias("k"), F.expr(f"cast(p div {size} as int)").alias("batch")), "ids")
    lines = ids.select(F.lit(0).alias("one"), "k", F.concat(F.col("k").cast("string"), F.lit("\n")).alias("line"))
    digest = ordered_digest(lines, "one", ["k"], of_text("line")).first()
    terms = {**{k: str(v) for k, v in contract.items()}, "batch size": str(size), "ids sha256": digest["sha256"] if digest else ""}
    path = spark._jvm.org.apache.hadoop.fs.Path
    if path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(f"{folder}/contract/_SUCCESS")):
        held = {r["term"]: r["value"] for r in spark.read.parquet(f"{folder}/contract").collect()}
        if held != terms:
            raise ValueError(f"{folder} was begun with another contract: {sorted(set(held.items()) ^ set(terms.items()))}")
    else:
        spark.createDataFrame(sorted(terms.items()), "term string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/contract")
    done = committed(spark, folder)
    if done:
        wrong = _differences(_batches(spark, folder, "ledger", done), content(_batches(spark, folder, "data", done)))
        bad = wrong.first()
        if bad:
            raise ValueError(f"{folder}: what was committed has changed, such as cloud {bad['k']}, view {bad['view']}")
    numbers = [r["batch"] for r in ids.select("batch").distinct().collect()]  # a number for each batch
    kind = ids.schema["k"].dataType.simpleString()
    for n in sorted(set(numbers) - set(done)):
        own = ids.filter(F.col("batch") == n).select("k")
        rows = make(own).select("k", F.col("view").cast("int").alias("view"), F.col("i").cast("int").alias("i"), *[F.col(a).cast("float").alias(a) for a in "xyz"])
        rows.write.mode("overwrite").parquet(f"{folder}/data/batch={n}")
        written = spark.read.schema(_ROWS.format(k=kind)).parquet(f"{folder}/data/batch={n}")
        content(written).join(seeds(own), ["k", "view"]).write.mode("overwrite").parquet(f"{folder}/ledger/batch={n}")
    return manifest_of(spark, folder)


def surface_views(mesh: DataFrame, count: int, views: int, unit_sphere: bool = True) -> DataFrame:
    """k, view, i, x, y, z: so many points on each mesh for each view, raw or in the unit sphere about the view's own points."""
    out = None
    for v in range(views):
        s = surface_samples(mesh, count, f"view{v}").select("k", F.col("n").alias("i"), *"xyz")
        if unit_sphere:
            s = staged(s, "samples")  # read for the frame, too
            s = framed(s, frame(s))
        s = s.select("k", F.lit(v).alias("view"), "i", *"xyz")
        out = s if out is None else out.union(s)
    return out


def view_seeds_of(ids: DataFrame, views: int, seed: int) -> DataFrame:
    rows = ids.select("k", F.explode(F.array(*[F.lit(v) for v in range(views)])).alias("view"))
    return rows.select("k", "view", view_seed(F.lit(seed).cast("long"), F.col("k").cast("string"), F.col("view").cast("long")).alias("seed"))


def noisy_views(clean: DataFrame, scales: DataFrame) -> DataFrame:
    """k, view (0: clean, 1: noisy), i, x, y, z: clean clouds in their unit sphere, and with Laplace noise of their scale, both to
    a millionth."""
    unit = framed(clean, frame(clean))
    u = {f"u{a}": uniform(f"val{a}", F.col("k"), F.col("i")) - 0.5 for a in "xyz"}
    noisy = unit.join(scales.select("k", "scale"), "k").withColumns(u)
    noisy = noisy.select("k", F.lit(1).alias("view"), "i", *[q6(F.col(a) - F.col("scale") * F.signum(f"u{a}") * F.log(1 - 2 * F.abs(f"u{a}"))).alias(a) for a in "xyz"])
    return unit.select("k", F.lit(0).alias("view"), "i", *[q6(a).alias(a) for a in "xyz"]).union(noisy)


def binned_scales(ids: DataFrame, low: float = 0.005, high: float = 0.02, bins: int = 8) -> DataFrame:
    """k, bin, scale: ids in order are dealt to bins in turn; a bin has the midpoint of its part of [low, high]."""
    place = with_places(ids.select(F.col("k").alias("id")))
    b = (F.col("p") % bins).cast("long")
    return place.select(F.col("id").alias("k"), b.alias("bin"), (low + (b + 0.5) * ((high - low) / bins)).alias("scale"))


def problems(manifest: DataFrame, made: DataFrame, there: DataFrame) -> DataFrame:
    """k, view, problem: a manifest (k, view, seed, n, sha256) against the same made again from the source, and against the
    contents that are there (k, view, n, sha256)."""
    both = manifest.select("k", "view", F.struct("seed", "n", "sha256").alias("claimed")).join(made.select("k", "view", F.struct("seed", "n", "sha256").alias("own")), ["k", "view"], "full_outer")
    both = both.join(there.select("k", "view", F.struct("n", "sha256").alias("found")), ["k", "view"], "full_outer")
    c, o, f = (F.col(x) for x in ("claimed", "own", "found"))
    tests = {
        "no record": c.isNull() & o.isNotNull(),
        "record of nothing": c.isNotNull() & o.isNull(),
        "no content": c.isNotNull() & f.isNull(),
        "content without record": c.isNull() & f.isNotNull(),
        "seed": c["seed"] != o["seed"],
        "points": c["n"] != o["n"],
        "digest": c["sha256"] != o["sha256"],
        "content": c["sha256"] != f["sha256"],
    }
    found = F.filter(F.array(*[F.when(t, F.lit(p)) for p, t in tests.items()]), lambda x: x.isNotNull())
    return both.select("k", "view", F.explode(found).alias("problem"))


def merged(chunks: DataFrame, expected: DataFrame, binding: str, points_: int) -> tuple[DataFrame, DataFrame]:
    """(samples, conflicts) of the outputs of chunks (chunk, id, binding, n, sha256), of which each expected id must have one:
    conflicts (id, problem) are ids that are lost, doubled, foreign, of another binding or of another number of points; samples
    the rows of all other ids. Both go by one grouping of the ids."""
    rows = chunks.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.count_if(F.col("binding") != binding).alias("other"), F.count_if(F.col("n") != points_).alias("short"), F.min(F.struct("chunk", "sha256")).alias("row"))
    both = rows.join(expected.select("id", F.lit(True).alias("wanted")), "id", "full_outer")
    tests = {"lost": F.col("times").isNull(), "doubled": F.col("times") > 1, "foreign": F.col("wanted").isNull(), "binding": F.col("other") > 0, "points": F.col("short") > 0}
    both = both.withColumn("problems", F.filter(F.array(*[F.when(t, F.lit(p)) for p, t in tests.items()]), lambda x: x.isNotNull()))
    return both.filter("size(problems) = 0").select("id", "row.chunk", "row.sha256"), both.select("id", F.explode("problems").alias("problem"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_SEED, _COUNT = 20260726, 48
_VIEWS_SQL = f"""
n AS (SELECT *, (by_ - ay) * (gz - az) - (bz - az) * (gy - ay) AS nx, (bz - az) * (gx - ax) - (bx - ax) * (gz - az) AS ny, (bx - ax) * (gy - ay) - (by_ - ay) * (gx - ax) AS nz FROM tri),
ar AS (SELECT *, CAST(floor(0.5 * sqrt(nx * nx + ny * ny + nz * nz) * 1e9 + 0.5) AS BIGINT) AS area FROM n),
cu AS (SELECT *, CAST(sum(area) OVER (PARTITION BY k ORDER BY f) AS BIGINT) AS upto, CAST(sum(area) OVER (PARTITION BY k) AS BIGINT) AS total FROM ar WHERE area > 0),
dr AS (SELECT k, v AS view, CAST(range AS INTEGER) AS i, {', '.join(_u_sql(f"'view' || v || '{c}'", 'CAST(k AS VARCHAR)', 'CAST(range AS VARCHAR)') + f' AS d{c}' for c in 'fuv')} FROM (SELECT DISTINCT k FROM tri) t, (VALUES (0), (1)) w(v), range(0, {_COUNT})),
sm AS (SELECT dr.k AS k, view, i, {', '.join(f"(1 - sqrt(du)) * a{a} + sqrt(du) * (1 - dv) * {'by_' if a == 'y' else 'b' + a} + sqrt(du) * dv * g{a} AS {a}" for a in 'xyz')} FROM dr JOIN cu ON dr.k = cu.k AND df >= (upto - area) / total AND df < upto / total),
mi AS (SELECT k, view, {', '.join(f'(min({a}) + max({a})) * 0.5 AS o{a}' for a in 'xyz')} FROM sm GROUP BY k, view),
sc AS (SELECT sm.k AS k, sm.view AS view, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz, max(sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz))) AS scale FROM sm JOIN mi ON sm.k = mi.k AND sm.view = mi.view GROUP BY sm.k, sm.view),
un AS (SELECT sm.k AS k, sm.view AS view, i, {', '.join(f'(x - ox) / scale AS {a}'.replace('x - ox', f'{a} - o{a}') for a in 'xyz')} FROM sm JOIN sc ON sm.k = sc.k AND sm.view = sc.view)"""


def _content_sql(table: str) -> str:
    """CTEs that end in dg (k, view, n, sha256) of the NPY payloads of table (k, view, i, x, y, z)."""
    return f"""
fb AS (SELECT k, view, i, {', '.join(f'{_float_bits_sql(a)} AS v{a}' for a in 'xyz')} FROM {table}),
hx AS (SELECT k, view, count(*) AS n, string_agg({_hex_sql('vx', 4)} || {_hex_sql('vy', 4)} || {_hex_sql('vz', 4)}, '' ORDER BY i) AS body FROM fb GROUP BY k, view),
hd AS (SELECT *, '{{''descr'': ''<f4'', ''fortran_order'': False, ''shape'': (' || n || ', 3), }}' AS head FROM hx),
hs AS (SELECT *, CAST(ceil((length(head) + 11) / 64.0) * 64 - 10 AS BIGINT) AS size FROM hd),
dg AS (SELECT k, view, n, sha256(unhex('934e554d50590100' || {_hex_sql('size', 2)} || hex(encode(rpad(head, CAST(size - 1 AS INTEGER), ' ') || chr(10))) || body)) AS sha256 FROM hs)"""


def _seed_sql(view: str, k: str = "k") -> str:
    seed = _LE8.format(f"CAST({_SEED} AS BIGINT)")
    own = f"sha256(unhex({seed} || hex(encode(chr(0) || 'surface-cache-sampling-v1' || chr(0) || {k}))))"
    more = f"sha256(unhex({seed} || hex(encode(chr(0) || 'surface-cache-view-v2' || chr(0) || {k} || chr(0))) || {_LE8.format(f'CAST({view} AS BIGINT)')}))"
    return f"CASE WHEN {view} = 0 THEN {_u64_sql(own)} ELSE {_u64_sql(more)} END"


def surface_cache(mesh: DataFrame, folder: str, count: int, views: int, seed: int, size: int = BATCH) -> DataFrame:
    """The manifest of a cache of clean clouds: so many points of each view of each mesh, in the unit sphere."""
    contract = {"format": "clean surface", "points": count, "views": views, "seed": seed, "frame": "unit sphere"}
    return build(mesh.select("k"), folder, contract, lambda ids: surface_views(mesh.join(ids, "k"), count, views), lambda ids: view_seeds_of(ids, views, seed), size)


@query(f"WITH {POINTS_SQL}, {TRIANGLES_SQL}, {_VIEWS_SQL}, {_content_sql('un')} SELECT k, view, {_seed_sql('view')} AS seed, n, sha256 FROM dg")
def surface_cache_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of two views of each mesh, in batches of four: its manifest, made from what was written."""
    return surface_cache(triangles(spark, sf_dir), _folder(spark, "surface"), _COUNT, 2, _SEED, 4).drop("batch")


_UNIT_SQL = "un AS (SELECT k, i, " + ", ".join(f"c{a} AS {a}" for a in "xyz") + " FROM nrm), bn AS (SELECT k, (row_number() OVER (ORDER BY k) - 1) % 8 AS bin FROM (SELECT DISTINCT k FROM pts)), bs AS (SELECT k, CAST(0.005 AS DOUBLE) + (bin + CAST(0.5 AS DOUBLE)) * ((CAST(0.02 AS DOUBLE) - CAST(0.005 AS DOUBLE)) / 8) AS scale FROM bn)"
_NOISY_SQL = (
    "nz AS (SELECT un.k AS k, un.i AS i, scale, x, y, z, " + ", ".join(_u_sql(f"'val{a}'", "CAST(un.k AS VARCHAR)", "CAST(un.i AS VARCHAR)") + f" - 0.5 AS u{a}" for a in "xyz") + " FROM un JOIN bs ON un.k = bs.k), "
    "vw AS (SELECT k, 0 AS view, i, " + ", ".join(f"floor({a} * 1e6 + 0.5) / 1e6 AS {a}" for a in "xyz") + " FROM un UNION ALL "
    "SELECT k, 1 AS view, i, " + ", ".join(f"floor(({a} - scale * sign(u{a}) * ln(1 - 2 * abs(u{a}))) * 1e6 + 0.5) / 1e6 AS {a}" for a in "xyz") + " FROM nz)"
)


@query(f"WITH {POINTS_SQL}, {FRAME_SQL}, {_UNIT_SQL}, {_NOISY_SQL}, {_content_sql('vw')} SELECT k, view, {_seed_sql('view')} AS seed, n, sha256 FROM dg")
def validation_cache_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of clean clouds and of their noisy ones, whose noise goes by bins: its manifest."""
    c = cloud(points(spark, sf_dir), "c")
    scales = staged(binned_scales(c.select("k").distinct()), "scales")
    contract = {"format": "validation", "noise": "laplace", "scales": "midpoints of 8 bins of 0.005 to 0.02", "seed": _SEED}
    made = build(c.select("k"), _folder(spark, "validation"), contract, lambda ids: noisy_views(c.join(ids, "k"), scales), lambda ids: view_seeds_of(ids, 2, _SEED), 5)
    return made.drop("batch")


@query("""WITH ks AS (SELECT DISTINCT label AS k FROM embeddings), m AS (SELECT k, v AS view FROM ks, (VALUES (0), (1)) w(v))
SELECT k, view, 'seed' AS problem FROM m WHERE k % 5 = 0 AND view = 1 UNION ALL SELECT k, view, 'no record' FROM m WHERE k % 5 = 1 AND view = 0
UNION ALL SELECT k, view, 'content without record' FROM m WHERE k % 5 = 1 AND view = 0 UNION ALL SELECT k, view, 'digest' FROM m WHERE k % 5 = 2 UNION ALL SELECT k, view, 'content' FROM m WHERE k % 5 = 2
UNION ALL SELECT k, view, 'points' FROM m WHERE k % 5 = 3 AND view = 0 UNION ALL SELECT k, view, 'no content' FROM m WHERE k % 5 = 4 AND view = 1
UNION ALL SELECT k, view, 'content' FROM m WHERE k % 5 = 4 AND view = 0 UNION ALL SELECT k + 1000, view, x FROM m, (VALUES ('record of nothing'), ('no content')) w(x) WHERE k % 5 = 0 AND view = 0""")
def surface_cache_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with an error of each kind planted, against the same made again from the meshes."""
    mesh, folder = triangles(spark, sf_dir), _folder(spark, "surface")
    manifest = surface_cache(mesh, folder, _COUNT, 2, _SEED, 4).select("k", "view", "seed", "n", "sha256")
    k, v = F.col("k") % 5, F.col("view")
    moved = F.when((k == 4) & (v == 0) & (F.col("i") == 0), F.col("x") + 0.5).otherwise(F.col("x"))
    there = content(clouds_of(spark, folder).filter("not (k % 5 = 4 and view = 1)").withColumn("x", moved))
    planted = manifest.filter(~((k == 1) & (v == 0))).withColumns({
        "seed": F.when((k == 0) & (v == 1), F.col("seed") + 1).otherwise(F.col("seed")).cast("decimal(20,0)"),
        "sha256": F.when(k == 2, F.reverse("sha256")).otherwise(F.col("sha256")),
        "n": F.when((k == 3) & (v == 0), F.col("n") + 1).otherwise(F.col("n")),
    })
    extra = manifest.filter((k == 0) & (v == 0)).withColumn("k", F.col("k") + 1000)
    ids = mesh.select("k").distinct()
    made = content(surface_views(mesh, _COUNT, 2).select("k", "view", "i", *[F.col(a).cast("float").alias(a) for a in "xyz"])).join(view_seeds_of(ids, 2, _SEED), ["k", "view"])
    return problems(planted.unionByName(extra), made, there)


_CHUNKS_SQL = """
ch AS (SELECT o_orderkey % 7 AS chunk, o_orderkey AS id, CASE WHEN o_orderkey % 31 = 3 THEN 'old' ELSE 'new' END AS binding, CASE WHEN o_orderkey % 37 = 5 THEN 40 ELSE 50 END AS n, sha256(CAST(o_orderkey AS VARCHAR)) AS sha256 FROM orders WHERE o_orderkey % 23 <> 1),
al AS (SELECT * FROM ch UNION ALL SELECT 7, id, binding, n, sha256 FROM ch WHERE id % 29 = 2 UNION ALL SELECT 8, -id, binding, n, sha256 FROM ch WHERE id % 41 = 6)"""


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    id_ = F.col("o_orderkey")
    ch = o.filter(id_ % 23 != 1).select((id_ % 7).alias("chunk"), id_.alias("id"), F.when(id_ % 31 == 3, "old").otherwise("new").alias("binding"), F.when(id_ % 37 == 5, 40).otherwise(50).alias("n"), F.sha2(id_.cast("string").cast("binary"), 256).alias("sha256"))
    again = ch.filter("id % 29 = 2").withColumn("chunk", F.lit(7).cast("long"))
    foreign = ch.filter("id % 41 = 6").withColumns({"chunk": F.lit(8).cast("long"), "id": -F.col("id")})
    return ch.union(again).union(foreign), o.select(id_.alias("id"))


@query(f"""WITH {_CHUNKS_SQL}, g AS (SELECT id, count(*) AS times, sum((binding <> 'new')::INT) AS other, sum((n <> 50)::INT) AS short FROM al GROUP BY id)
SELECT o_orderkey AS id, 'lost' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT id FROM g) UNION ALL SELECT id, 'doubled' FROM g WHERE times > 1
UNION ALL SELECT id, 'foreign' FROM g WHERE id NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT id, 'binding' FROM g WHERE other > 0 UNION ALL SELECT id, 'points' FROM g WHERE short > 0""")
def chunk_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(*_chunks(spark, sf_dir), "new", 50)[1]


@query(f"WITH {_CHUNKS_SQL} SELECT id, min(chunk) AS chunk, any_value(sha256) AS sha256 FROM al WHERE id IN (SELECT o_orderkey FROM orders) GROUP BY id HAVING count(*) = 1 AND bool_and(binding = 'new') AND bool_and(n = 50)")
def chunk_merge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(*_chunks(spark, sf_dir), "new", 50)[0]
