"""Constraint queries: each gives the rows that break a rule; no rows mean that all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.views import POINTS_SQL, points, read


def cloud_problems(clouds: DataFrame, limit: float = 1e18) -> DataFrame:
    """problem, k, i: coordinates that are not finite or too large, and repeated point numbers. clouds: k, i, x, y, z."""
    bad = F.lit(False)
    for a in "xyz":
        bad = bad | F.isnan(a) | F.col(a).isNull() | (F.abs(a) > limit)
    values = clouds.filter(bad).select(F.lit("coordinate").alias("problem"), "k", "i")
    twice = clouds.groupBy("k", "i").count().filter("count > 1").select(F.lit("repeated").alias("problem"), "k", "i")
    return values.unionByName(twice)


def manifest_problems(manifest: DataFrame, files: DataFrame, key: str, value: str) -> DataFrame:
    """problem, key of what is missing, unexpected or of another digest, of two tables with key and value."""
    a = manifest.select(F.col(key).alias("key"), F.col(value).alias("declared"), F.lit(True).alias("in_a"))
    b = files.select(F.col(key).alias("key"), F.col(value).alias("actual"), F.lit(True).alias("in_b"))
    both = a.join(b, "key", "full_outer")
    problem = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(~F.col("declared").eqNullSafe(F.col("actual")), "differs")
    return both.select(problem.alias("problem"), "key").filter("problem is not null")


@query("WITH a AS (SELECT c_custkey AS key, sha256(c_name) AS v FROM customer WHERE c_custkey % 50 <> 1), b AS (SELECT c_custkey AS key, sha256(CASE WHEN c_custkey % 70 = 3 THEN c_name || '!' ELSE c_name END) AS v FROM customer WHERE c_custkey % 60 <> 2) SELECT CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'unexpected' ELSE 'differs' END AS problem, coalesce(a.key, b.key) AS key FROM a FULL OUTER JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.v <> b.v")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    a = c.filter("c_custkey % 50 <> 1").select("c_custkey", F.sha2("c_name", 256).alias("sha"))
    changed = F.when(F.col("c_custkey") % 70 == 3, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    b = c.filter("c_custkey % 60 <> 2").select("c_custkey", F.sha2(changed, 256).alias("sha"))
    return manifest_problems(a, b, "c_custkey", "sha")


@query(f"WITH {POINTS_SQL}, w AS (SELECT k, i, CASE WHEN i % 17 = 3 THEN CAST('NaN' AS DOUBLE) WHEN i % 19 = 4 THEN 1e19 ELSE cx END AS x FROM pts UNION ALL SELECT k, i, cx AS x FROM pts WHERE i = 5) SELECT 'coordinate' AS problem, k, i FROM w WHERE isnan(x) OR abs(x) > 1e18 UNION ALL SELECT 'repeated' AS problem, k, i FROM w GROUP BY k, i HAVING count(*) > 1")
def id_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    x = F.when(F.col("i") % 17 == 3, F.lit(float("nan"))).when(F.col("i") % 19 == 4, 1e19).otherwise(F.col("cx"))
    clouds = p.select("k", "i", x.alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    again = p.filter("i = 5").select("k", "i", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return cloud_problems(clouds.union(again))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that all three aligned tables have."""
    line = read(spark, sf_dir, "lineitem")
    ids = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    for n in (1, 2):
        ids = ids.join(line.filter(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("id")), "id", "left_semi")
    return ids
