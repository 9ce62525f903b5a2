"""Verifiers as tables of violations: no rows mean that a cache, route table, ledger or id list is what it says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.views import LOG_SQL, POINTS_SQL, cloud, points, read, train_log
from ..staging import staged
from .neighbors import FRAME_SQL, frame, framed
from .patches import noise_route_summary
from .sampling import digest


def named_problems(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """problem, key: a row for each test that holds for a row."""
    found = F.filter(F.array(*[F.when(t, F.lit(p)) for p, t in tests.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(found).alias("problem"), F.col(key).alias("key"))


def aligned(clean: DataFrame, noisy: DataFrame, denoised: DataFrame) -> DataFrame:
    """id of the samples that all three tables hold, each made from the other's very bytes: clean (id, sha), noisy (id, sha,
    source_sha), denoised (id, input_sha)."""
    both = clean.select("id", F.col("sha").alias("source_sha")).join(noisy.select("id", "sha", "source_sha"), ["id", "source_sha"])
    return both.select("id", F.col("sha").alias("input_sha")).join(denoised.select("id", "input_sha"), ["id", "input_sha"]).select("id")


def alignment_problems(clean: DataFrame, noisy: DataFrame, denoised: DataFrame) -> DataFrame:
    """problem, key: samples that a table lacks, or that were made from other bytes."""
    every = clean.select("id", F.col("sha").alias("c")).join(noisy.select("id", F.col("sha").alias("n"), "source_sha"), "id", "full_outer").join(denoised.select("id", "input_sha"), "id", "full_outer")
    lacks = {f"no {t}": F.col(c).isNull() for t, c in (("clean", "c"), ("noisy", "n"), ("denoised", "input_sha"))}
    return named_problems(every, "id", lacks | {"other clean": F.col("c") != F.col("source_sha"), "other noisy": F.col("n") != F.col("input_sha")})


_ALIGNED_SQL = """c AS (SELECT c_custkey AS id, sha256(c_name) AS sha FROM customer WHERE c_custkey % 50 <> 1),
n AS (SELECT c_custkey AS id, sha256(c_name || 'n') AS sha, sha256(CASE WHEN c_custkey % 70 = 3 THEN c_name || '!' ELSE c_name END) AS source_sha FROM customer WHERE c_custkey % 60 <> 2),
d AS (SELECT c_custkey AS id, sha256(CASE WHEN c_custkey % 90 = 4 THEN c_name || '!' ELSE c_name || 'n' END) AS input_sha FROM customer WHERE c_custkey % 40 <> 3)"""


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey"))
    name, changed = F.col("c_name"), F.concat("c_name", F.lit("!"))
    noisy = F.concat("c_name", F.lit("n"))
    return (
        c.filter("id % 50 <> 1").select("id", F.sha2(name, 256).alias("sha")),
        c.filter("id % 60 <> 2").select("id", F.sha2(noisy, 256).alias("sha"), F.sha2(F.when(F.col("id") % 70 == 3, changed).otherwise(name), 256).alias("source_sha")),
        c.filter("id % 40 <> 3").select("id", F.sha2(F.when(F.col("id") % 90 == 4, changed).otherwise(noisy), 256).alias("input_sha")),
    )


@query(f"WITH {_ALIGNED_SQL} SELECT c.id AS id FROM c JOIN n ON c.id = n.id AND c.sha = n.source_sha JOIN d ON n.id = d.id AND n.sha = d.input_sha")
def hash_aligned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(*_three(spark, sf_dir))


@query(f"""WITH {_ALIGNED_SQL}, e AS (SELECT coalesce(c.id, n.id, d.id) AS key, c.sha AS c, n.sha AS n, source_sha, input_sha FROM c FULL OUTER JOIN n ON c.id = n.id FULL OUTER JOIN d ON coalesce(c.id, n.id) = d.id)
SELECT 'no clean' AS problem, key FROM e WHERE c IS NULL UNION ALL SELECT 'no noisy', key FROM e WHERE n IS NULL UNION ALL SELECT 'no denoised', key FROM e WHERE input_sha IS NULL
UNION ALL SELECT 'other clean', key FROM e WHERE c <> source_sha UNION ALL SELECT 'other noisy', key FROM e WHERE n <> input_sha""")
def paired_cache_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_problems(*_three(spark, sf_dir))


def cache_problems(manifest: DataFrame, clouds: DataFrame, seed: int, tolerance: float = 3e-6) -> DataFrame:
    """problem, key: of a cache of clouds in the unit sphere (k, i, x, y, z) and its manifest (k, derived_seed, n): samples
    that one side lacks, other counts or seeds than declared, and clouds that aren't centred or of radius 1."""
    box = clouds.groupBy("k").agg(F.count(F.lit(1)).alias("actual"), *[F.expr(f"abs(min({a}) + max({a})) / 2 as o{a}") for a in "xyz"], F.max(F.expr("sqrt(x * x + y * y + z * z)")).alias("radius"))
    both = manifest.join(box, "k", "full_outer")
    return named_problems(
        both,
        "k",
        {
            "missing": F.col("actual").isNull(),
            "unexpected": F.col("n").isNull(),
            "count": F.col("n") != F.col("actual"),
            "seed": F.col("derived_seed") != digest(F.lit(seed), F.col("k")),
            "centre": F.greatest("ox", "oy", "oz") > tolerance,
            "radius": F.abs(F.col("radius") - 1) > tolerance,
        },
    )


@query(f"""WITH {POINTS_SQL}, {FRAME_SQL}, cl AS (SELECT k, i, cx * CASE WHEN k % 3 = 1 THEN 1.001 ELSE 1 END AS x, cy * CASE WHEN k % 3 = 1 THEN 1.001 ELSE 1 END AS y, (cz + CASE WHEN k % 4 = 2 THEN 0.01 ELSE 0 END) * CASE WHEN k % 3 = 1 THEN 1.001 ELSE 1 END AS z FROM nrm),
b AS (SELECT k, abs(min(x) + max(x)) / 2 AS ox, abs(min(y) + max(y)) / 2 AS oy, abs(min(z) + max(z)) / 2 AS oz, max(sqrt(x * x + y * y + z * z)) AS radius FROM cl GROUP BY k)
SELECT 'centre' AS problem, k AS key FROM b WHERE greatest(ox, oy, oz) > 3e-6 UNION ALL SELECT 'radius', k FROM b WHERE abs(radius - 1) > 3e-6 UNION ALL SELECT 'seed', k FROM b WHERE k % 5 = 2
UNION ALL SELECT 'count', k FROM b WHERE k % 4 = 3 UNION ALL SELECT 'missing', max(k) + 1 FROM b""")
def surface_cache_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache with errors of every kind but one: too large or moved clouds, other seeds and counts, a sample not there."""
    c = cloud(points(spark, sf_dir), "c")
    k = F.col("k")
    unit = framed(c, frame(c)).withColumn("z", F.col("z") + F.when(k % 4 == 2, 0.01).otherwise(0.0))
    unit = unit.withColumns({a: F.col(a) * F.when(k % 3 == 1, 1.001).otherwise(1.0) for a in "xyz"})
    n = c.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    more = n.agg((F.max("k") + 1).alias("k"), F.lit(1).cast("long").alias("n"))
    manifest = n.union(more).select("k", digest(F.when(k % 5 == 2, 8).otherwise(7), k).alias("derived_seed"), (F.col("n") + F.when(k % 4 == 3, 1).otherwise(0)).alias("n"))
    return cache_problems(manifest, unit, 7)


def table_problems(declared: DataFrame, actual: DataFrame, key: str, tolerance: float = 0.0) -> DataFrame:
    """problem, key: rows of declared that actual lacks or has with other numbers, and rows it does not declare."""
    values = [c for c in declared.columns if c != key]
    both = declared.withColumn("_d", F.lit(True)).join(actual.select(key, *[F.col(c).alias("_" + c) for c in values], F.lit(True).alias("_a")), key, "full_outer")
    differs = reduce(lambda x, y: x | y, [F.abs(F.col(c) - F.col("_" + c)) > tolerance for c in values])
    return named_problems(both, key, {"missing": F.col("_a").isNull(), "unexpected": F.col("_d").isNull(), "differs": differs})


@query(f"WITH {POINTS_SQL}, ks AS (SELECT DISTINCT k FROM pts) SELECT 'differs' AS problem, k AS key FROM ks WHERE k % 3 = 0 AND k % 4 <> 1 UNION ALL SELECT 'unexpected', k FROM ks WHERE k % 4 = 1")
def route_table_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route table in which some quantiles were changed and some rows lost, against the statistics made anew."""
    actual = staged(noise_route_summary(spark, sf_dir), "route")
    q75 = F.col("q75") + F.when(F.col("k") % 3 == 0, 0.001).otherwise(0.0)
    declared = actual.filter("k % 4 <> 1").withColumn("q75", q75)
    return table_problems(declared, actual, "k", 1e-9)


def ledger_problems(log: DataFrame, per_epoch: int) -> DataFrame:
    """problem, epoch, n: steps (epoch, step; step = epoch * per_epoch + place, from 1) that occur twice, lie outside their
    epoch, or are missing before the last one. Counted by epoch, so no task sorts the log."""
    low = F.col("epoch") * per_epoch
    inside = (F.col("step") > low) & (F.col("step") <= low + per_epoch)
    by = log.groupBy("epoch").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("step").alias("steps"), F.count_if(~inside).alias("outside"), F.max("step").alias("last"))
    last = log.agg(F.max("epoch").alias("m")).first()["m"] or 0
    want = F.when(F.col("epoch") == last, F.col("last") - low).otherwise(per_epoch)
    counts = {"repeated": F.col("rows") - F.col("steps"), "outside": F.col("outside"), "missing": want - F.col("steps") + F.col("outside")}
    each = F.array(*[F.struct(F.lit(p).alias("problem"), n.cast("long").alias("n")) for p, n in counts.items()])
    return by.select("epoch", F.explode(each).alias("p")).select("p.problem", "epoch", "p.n").filter("n > 0")


@query(f"""WITH {LOG_SQL}, w AS (SELECT epoch, step FROM log WHERE step % 1000 <> 7 UNION ALL SELECT epoch, step FROM log WHERE step % 1000 = 9),
b AS (SELECT epoch, count(*) AS c, count(DISTINCT step) AS s, max(step) AS l FROM w GROUP BY epoch), m AS (SELECT max(epoch) AS m FROM b)
SELECT 'repeated' AS problem, epoch, c - s AS n FROM b WHERE c > s UNION ALL SELECT 'missing', epoch, CASE WHEN epoch = m THEN l - epoch * 500 ELSE 500 END - s FROM b, m WHERE CASE WHEN epoch = m THEN l - epoch * 500 ELSE 500 END > s""")
def resume_log_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step log that lacks some steps and has some twice."""
    log = train_log(spark, sf_dir).select("epoch", "step")
    return ledger_problems(log.filter("step % 1000 <> 7").union(log.filter("step % 1000 = 9")), 500)


def id_problems(ids: DataFrame, pattern: str = "^[0-9]{8}/[0-9a-f]{28,32}$") -> DataFrame:
    """problem, key: ids (id) that don't look as they should, or occur twice."""
    bad = ids.filter(~F.col("id").rlike(pattern)).select(F.lit("format").alias("problem"), F.col("id").alias("key")).distinct()
    return bad.unionByName(ids.groupBy("id").count().filter("count > 1").select(F.lit("repeated").alias("problem"), F.col("id").alias("key")))


_IDS_SQL = "ids AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 8, '0') || CASE WHEN s_suppkey % 7 = 2 THEN '-' ELSE '/' END || substr(sha256(CAST(s_suppkey // 2 * 2 * (s_suppkey % 10) AS VARCHAR)), 1, 30) AS id FROM supplier)"


@query(f"WITH {_IDS_SQL} SELECT DISTINCT 'format' AS problem, id AS key FROM ids WHERE NOT regexp_matches(id, '^[0-9]{{8}}/[0-9a-f]{{28,32}}$') UNION ALL SELECT 'repeated', id FROM ids GROUP BY id HAVING count(*) > 1")
def sample_id_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    tail = F.substring(F.sha2(F.expr("s_suppkey div 2 * 2 * (s_suppkey % 10)").cast("string"), 256), 1, 30)
    return id_problems(s.select(F.concat(F.lpad(F.col("s_nationkey").cast("string"), 8, "0"), F.when(F.col("s_suppkey") % 7 == 2, "-").otherwise("/"), tail).alias("id")))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS archive, count(*) AS members, CAST(sum(strlen(html)) AS BIGINT) AS bytes, CAST(sum(CASE WHEN url LIKE '%/' THEN 1 ELSE 0 END) AS BIGINT) AS directories FROM pages GROUP BY 1")
def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, bytes and directories of each archive."""
    p = read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("archive"))
    return p.agg(F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("html")).alias("bytes"), F.count_if(F.col("url").endswith("/")).alias("directories"))


@query("SELECT l_orderkey AS k, count(*) AS n, min(l_partkey) AS least, max(l_partkey) AS most, sha256(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS digest FROM lineitem GROUP BY l_orderkey")
def array_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, ends and digest of each short index list."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("least"), F.max("l_partkey").alias("most"), F.sha2(joined, 256).alias("digest"))


def json_digest(*columns: str) -> Column:
    """SHA-256 of a row's compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


@query("""SELECT n_nationkey AS id, sha256('{"n_name":"' || n_name || '","n_nationkey":' || CAST(n_nationkey AS VARCHAR) || ',"n_regionkey":' || CAST(n_regionkey AS VARCHAR) || '}') AS digest FROM nation""")
def canonical_json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), json_digest("n_regionkey", "n_nationkey", "n_name").alias("digest"))
