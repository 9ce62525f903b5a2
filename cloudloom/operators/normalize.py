"""Normalisation of noisy clouds in three modes around a pass, statistics of displacements, and checked gathering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import exact_mean, mean_sql, q6, squared
from ..sources.views import POINTS_SQL, cloud, points
from .neighbors import frame, framed

# The names of the modes (fixed values).
MODES = ("noisy_max", "identity", "robust_quantile")


def transforms(clouds: DataFrame, mode: str = "noisy_max", quantile: float | None = None) -> DataFrame:
    """k, ox, oy, oz, scale of each cloud (k, i, x, y, z): the middle of its box and the greatest radius, nothing at all, or
    the medians and a quantile of the radii about them. A quantile belongs to the last mode only, which must have one; a
    cloud without extent is an error in the first and the last."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if (mode == "robust_quantile") != (quantile is not None) or (quantile is not None and not 0 < quantile <= 1):
        raise ValueError("a quantile in (0, 1] is for robust_quantile, and only for it")
    if mode == "identity":
        return clouds.groupBy("k").agg(*[F.lit(0.0).alias("o" + a) for a in "xyz"], F.lit(1.0).alias("scale"))
    if mode == "noisy_max":
        out = frame(clouds)
    else:
        middle = clouds.groupBy("k").agg(*[F.percentile(a, F.lit(0.5)).alias("o" + a) for a in "xyz"])
        radius = clouds.join(middle, "k").withColumn("r", F.sqrt(squared("", "o")))
        out = middle.join(radius.groupBy("k").agg(F.percentile("r", F.lit(quantile)).alias("scale")), "k")
    flat = F.raise_error(F.concat(F.lit("a cloud without extent: "), F.col("k").cast("string"))).cast("double")
    return out.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(flat))


def normalised_pass(clouds: DataFrame, refine: Callable[[DataFrame], DataFrame], mode: str = "noisy_max", quantile: float | None = None) -> DataFrame:
    """k, i, x, y, z of clouds that were put into their frames, refined there, and put back."""
    frames = transforms(clouds, mode, quantile)
    back = [(F.col(a) * F.col("scale") + F.col("o" + a)).alias(a) for a in "xyz"]
    return refine(framed(clouds, frames)).join(frames, "k").select("k", "i", *back)


def drawn_in(df: DataFrame) -> DataFrame:
    """A stand-in for a denoiser that depends on the frame: each point moves inwards, outer ones by more."""
    r2 = F.least(F.lit(4.0), sum((F.col(a) * F.col(a) for a in "yz"), F.col("x") * F.col("x")))
    return df.withColumn("f", 1 - 0.05 * r2).select("k", "i", *[(F.col(a) * F.col("f")).alias(a) for a in "xyz"])


_AXES = "xyz"
_LIST = lambda t: ", ".join(t.format(a=a) for a in _AXES)
_R = "sqrt(" + " + ".join(f"(n{a} - o{a}) * (n{a} - o{a})" for a in _AXES) + ")"


@query(f"""WITH {POINTS_SQL}, nm0 AS (SELECT k, {_LIST("(min(n{a}) + max(n{a})) * 0.5 AS o{a}")} FROM pts GROUP BY k),
rq0 AS (SELECT k, {_LIST("quantile_cont(n{a}, 0.5) AS o{a}")} FROM pts GROUP BY k),
fr AS (SELECT 'noisy_max' AS mode, p.k AS k, {_LIST("any_value(o{a}) AS o{a}")}, max({_R}) AS scale FROM pts p JOIN nm0 m ON p.k = m.k GROUP BY p.k
UNION ALL SELECT 'robust_quantile', p.k, {_LIST("any_value(o{a})")}, quantile_cont({_R}, 0.95) FROM pts p JOIN rq0 m ON p.k = m.k GROUP BY p.k
UNION ALL SELECT 'identity', k, 0, 0, 0, 1 FROM pts GROUP BY k),
s AS (SELECT mode, p.k AS k, i, {_LIST("(n{a} - o{a}) / scale AS {a}")}, {_LIST("o{a}")}, scale FROM pts p JOIN fr f ON p.k = f.k),
d AS (SELECT *, 1 - 0.05 * least(4.0, x * x + y * y + z * z) AS f FROM s)
SELECT mode, k, i, {_LIST("floor(({a} * f * scale + o{a}) * 1e6 + 0.5) / 1e6 AS {a}")} FROM d""")
def normalization_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noisy clouds after one pass in each mode."""
    noisy = cloud(points(spark, sf_dir), "n")
    passes = [normalised_pass(noisy, drawn_in, m, 0.95 if m == "robust_quantile" else None).withColumn("mode", F.lit(m)) for m in MODES]
    return passes[0].unionByName(passes[1]).unionByName(passes[2]).select("mode", "k", "i", *[q6(a).alias(a) for a in _AXES])


def displacement_statistics_of(moved: DataFrame) -> DataFrame:
    """k, mean, p95 (nearest rank) and largest of the distances between points p and c; none counts as under 1e-12."""
    d = moved.select("k", F.sqrt(F.greatest(squared("p", "c"), F.lit(1e-24))).alias("d"))
    p95 = F.expr("percentile_disc(0.95) within group (order by d)")
    return d.groupBy("k").agg(exact_mean("d").alias("mean"), p95.alias("p95"), F.max("d").alias("largest"))


@query(f"""WITH {POINTS_SQL}, d AS (SELECT k, CASE WHEN i % 50 = 3 THEN 1e-12 ELSE sqrt((px - cx) * (px - cx) + (py - cy) * (py - cy) + (pz - cz) * (pz - cz)) END AS d FROM pts)
SELECT k, floor({mean_sql("d")} * 1e6 + 0.5) / 1e6 AS mean, floor(quantile_disc(d, 0.95) * 1e6 + 0.5) / 1e6 AS p95, floor(max(d) * 1e6 + 0.5) / 1e6 AS largest FROM d GROUP BY k""")
def displacement_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far predictions lie from the clean points, some of which did not move."""
    p = points(spark, sf_dir)
    still = {f"p{a}": F.when(F.col("i") % 50 == 3, F.col(f"c{a}")).otherwise(F.col(f"p{a}")) for a in _AXES}
    return displacement_statistics_of(p.withColumns(still)).select("k", *[q6(c).alias(c) for c in ("mean", "p95", "largest")])


def index_problems(values: DataFrame, indices: DataFrame) -> DataFrame:
    """k, slot, j of the indices (k, slot, j) that name no point (k, i) of their cloud; a null names none."""
    return indices.join(values.select("k", F.col("i").alias("j")), ["k", "j"], "left_anti").select("k", "slot", "j")


def gathered(values: DataFrame, indices: DataFrame) -> DataFrame:
    """k, slot and the columns of the point that each index names; an index outside its cloud is an error."""
    columns = [c for c in values.columns if c not in ("k", "i")]
    found = indices.join(values.withColumnRenamed("i", "j").withColumn("_there", F.lit(True)), ["k", "j"], "left")
    outside = F.raise_error(F.concat_ws(" ", F.lit("an index outside its cloud:"), F.col("k").cast("string"), F.col("j").cast("string")))
    slot = F.when(F.col("_there"), F.col("slot")).otherwise(outside.cast("int"))
    return found.select("k", slot.alias("slot"), *columns)


@query(f"WITH {POINTS_SQL}, w AS (SELECT k, i AS slot, CASE WHEN i % 23 = 4 THEN -1 - i WHEN i % 29 = 6 THEN i + 1000000 ELSE i * 7 % 5 END AS j FROM pts) SELECT k, slot, j FROM w WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.k = w.k AND p.i = w.j)")
def gather_index_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of which some are negative and some too large."""
    p = points(spark, sf_dir).select("k", "i")
    j = F.when(F.col("i") % 23 == 4, -1 - F.col("i")).when(F.col("i") % 29 == 6, F.col("i") + 1000000).otherwise(F.col("i") * 7 % 5)
    return index_problems(p, p.select("k", F.col("i").alias("slot"), j.alias("j")))
