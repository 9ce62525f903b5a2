"""Clouds, meshes, universes and logs as views over the driver's tables, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import alone

POINTS_SQL = """
raw AS (SELECT label AS k, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS i,
  CAST(embedding[1] AS DOUBLE) AS cx, CAST(embedding[2] AS DOUBLE) AS cy, CAST(embedding[3] AS DOUBLE) AS cz,
  CAST(embedding[4] AS DOUBLE) AS dx, CAST(embedding[5] AS DOUBLE) AS dy, CAST(embedding[6] AS DOUBLE) AS dz FROM embeddings),
pts AS (SELECT k, i, cx, cy, cz, cx + 0.1 * dx AS nx, cy + 0.1 * dy AS ny, cz + 0.1 * dz AS nz,
  cx + 0.04 * dx AS px, cy + 0.04 * dy AS py, cz + 0.04 * dz AS pz FROM raw)"""

TRIANGLES_SQL = """
tri AS (SELECT a.k AS k, a.i AS f, a.cx AS ax, a.cy AS ay, a.cz AS az, b.cx AS bx, b.cy AS by_, b.cz AS bz, c.cx AS gx, c.cy AS gy, c.cz AS gz
  FROM pts a JOIN pts b ON a.k = b.k AND b.i = a.i + 1 JOIN pts c ON a.k = c.k AND c.i = a.i + 2 WHERE a.i % 3 = 0)"""

LARGE_SQL = """
big AS (SELECT s_nationkey AS k, l_quantity / 50 AS cx, l_extendedprice / 100000 AS cy, l_discount * 10 AS cz,
  CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 AS INTEGER) AS i
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
pts AS (SELECT k, i, cx, cy, cz, cx + 0.003 * (i % 7) AS px, cy + 0.002 * (i % 5) AS py, cz - 0.001 * (i % 3) AS pz FROM big)"""

#: Suppliers, of two numbers each, that are sent to all executors at most.
BROADCAST = 1_000_000

UNIVERSE_SQL = "uni AS (SELECT p_partkey AS id, p_brand AS synset FROM part)"
LOG_SQL = "log AS (SELECT event_id + 1 AS step, event_id // 500 AS epoch, 1 + event_id % 7 AS weight, value AS metric, event_type FROM events)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, i and the clean (c), noisy (n) and predicted (p) coordinates of each point."""
    e = read(spark, sf_dir, "embeddings")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    raw = e.select(F.col("label").alias("k"), place.alias("i"), *[F.get("embedding", j).cast("double").alias(c) for j, c in enumerate(("cx", "cy", "cz", "dx", "dy", "dz"))])
    moved = {f"{p}{a}": F.col(f"c{a}") + s * F.col(f"d{a}") for p, s in (("n", 0.1), ("p", 0.04)) for a in "xyz"}
    return raw.withColumns(moved).drop("dx", "dy", "dz")


def large_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, i, clean (c) coordinates: order lines by the nation of their supplier. Staged in order; places come from a range
    sort and the sizes of its partitions, so that no task sorts a whole cloud."""
    order = [F.col(c).asc_nulls_last() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")]
    nation = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    nation = F.broadcast(nation) if nation.count() <= BROADCAST else nation  # else all order lines are shuffled once more
    line = read(spark, sf_dir, "lineitem").join(nation, F.col("l_suppkey") == F.col("s_suppkey"))
    line = line.repartitionByRange("k", *order).sortWithinPartitions("k", *order)
    big = [(F.col("l_quantity") / 50).alias("cx"), (F.col("l_extendedprice") / 100000).alias("cy"), (F.col("l_discount") * 10).alias("cz")]
    rows = alone(spark, lambda: line.select("k", *big, F.monotonically_increasing_id().alias("at")), "ordered")
    rows = rows.select("k", "cx", "cy", "cz", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at"))
    runs = rows.groupBy("k", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each cloud and partition
    before = F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = alone(spark, lambda: runs.select("k", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")), "runs")
    return rows.join(F.broadcast(runs), ["k", "part"]).select("k", (F.col("at") + F.col("shift")).cast("int").alias("i"), "cx", "cy", "cz")


def predicted(clouds: DataFrame) -> DataFrame:
    """large_clouds with predicted (p) coordinates, which needn't be stored as they follow from the others."""
    moved = {"px": F.col("cx") + 0.003 * (F.col("i") % 7), "py": F.col("cy") + 0.002 * (F.col("i") % 5), "pz": F.col("cz") - 0.001 * (F.col("i") % 3)}
    return clouds.withColumns(moved)


def cloud(df: DataFrame, p: str) -> DataFrame:
    """k, i, x, y, z of one of the clouds c, n, p."""
    return df.select("k", "i", *[F.col(f"{p}{a}").alias(a) for a in "xyz"])


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, f and the corners a, b, g: consecutive triplets of the clean cloud."""
    w = Window.partitionBy("k").orderBy("i")
    c = cloud(points(spark, sf_dir), "c").select("k", "i", F.struct("x", "y", "z").alias("a"))
    c = c.withColumns({"b": F.lead("a", 1).over(w), "g": F.lead("a", 2).over(w)}).filter("i % 3 = 0 and b is not null and g is not null")
    names = {"b": ("bx", "by_", "bz")}
    return c.select("k", F.col("i").alias("f"), *[F.col(f"{p}.{a}").alias(names[p][j] if p in names else p + a) for p in "abg" for j, a in enumerate("xyz")])


def features(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").alias("k"), place.alias("i"), "vec_id", *[F.get("embedding", 8 + j).cast("double").alias(f"f{j}") for j in range(n)])


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("synset"))


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("step"), F.expr("event_id div 500").alias("epoch"), (1 + F.col("event_id") % 7).alias("weight"), F.col("value").alias("metric"), "event_type")
