"""Training clouds and patches: noise, rotation and normalisation in one plan, then the points nearest to a seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import squared, uniform
from ..sources.views import POINTS_SQL, cloud, points
from ..staging import shipped, staged
from .neighbors import frame
from .sampling import _CUBE_SQL, _u_sql, cube_rotations

PATCH = 16


def prepared(clean: DataFrame, low: float, high: float, normalise: bool = True) -> DataFrame:
    """k, i, nx, ny, nz, cx, cy, cz, noise_scale, source_scale of clean clouds (k, i, x, y, z).

    Each cloud gets a scale of [low, high) and Laplace noise of it, is turned by one of the 24 rotations of the cube with its
    clean points, and both are put into the unit sphere of the noisy points (if wanted; a cloud without extent stays). The
    noise scale that a network sees is divided by that sphere's radius."""
    spark = clean.sparkSession
    scale = low + (high - low) * uniform("train-scale", F.col("k"))
    noisy = clean.withColumn("source_scale", scale)
    u = {a: uniform(f"train-{a}", F.col("k"), F.col("i")) - 0.5 for a in "xyz"}
    noisy = noisy.withColumns({f"u{a}": u[a] for a in "xyz"}).withColumns({f"n{a}": F.col(a) - F.col("source_scale") * F.signum(f"u{a}") * F.log(1 - 2 * F.abs(f"u{a}")) for a in "xyz"})
    turns = spark.createDataFrame([(n, *[float(x) for row in r for x in row]) for n, r in enumerate(cube_rotations())], "turn int, " + ", ".join(f"m{r}{c} double" for r in range(3) for c in range(3)))
    turned = noisy.withColumn("turn", F.floor(uniform("train-turn", F.col("k")) * 24).cast("int")).join(F.broadcast(turns), "turn")
    dot = lambda r, p: F.col(f"m{r}0") * F.col(p + "x") + F.col(f"m{r}1") * F.col(p + "y") + F.col(f"m{r}2") * F.col(p + "z")
    both = turned.select("k", "i", "source_scale", *[dot(r, p).alias(o + a) for p, o in (("n", "n"), ("", "c")) for r, a in enumerate("xyz")])
    if not normalise:
        return both.withColumn("noise_scale", F.col("source_scale"))
    both = staged(both, "turned")  # read for the frame, too
    frames = frame(cloud(both, "n")).withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    inside = both.join(frames, "k")
    return inside.select("k", "i", *[((F.col(p + a) - F.col("o" + a)) / F.col("scale")).alias(p + a) for p in "nc" for a in "xyz"], (F.col("source_scale") / F.col("scale")).alias("noise_scale"), "source_scale")


def least_of_each(rows: DataFrame, group: str, order: list[str], count: int) -> DataFrame:
    """The `count` first rows of each group by number columns, with their place (from 0).

    Each batch of rows keeps only its own candidates before anything is shuffled, whatever the number of groups."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(group).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            at = np.lexsort((*[batch.column(c).to_numpy(zero_copy_only=False) for c in reversed(order)], key))
            first = np.flatnonzero(np.append(True, key[at][1:] != key[at][:-1])) if len(at) else at
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            yield batch.take(pa.array(np.sort(at[place < count])))

    shipped(rows.sparkSession)
    kept = rows.mapInArrow(few, rows.schema)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return kept.withColumn("local", rank).filter(F.col("local") < count)


def training_patches(clouds: DataFrame, size: int = PATCH) -> DataFrame:
    """k, local, i, nx .. cz, noise_scale: the `size` points nearest to a seed of each prepared cloud among its noisy points, by
    (distance, index), from the seed; the seed is picked by the cloud's hash. A cloud of fewer points is an error."""
    clouds = staged(clouds, "clouds")
    picks = clouds.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.floor(uniform("train-seed", F.col("k")) * F.col("n")).cast("int"))
    small = F.raise_error(F.concat(F.lit("a cloud under a patch: "), F.col("k").cast("string"))).cast("int")
    picks = picks.withColumn("i", F.when(F.col("n") >= size, F.col("i")).otherwise(small))
    seeds = clouds.join(picks, ["k", "i"]).select("k", *[F.col("n" + a).alias("s" + a) for a in "xyz"])
    rows = clouds.join(seeds, "k").withColumn("d2", squared("n", "s"))
    near = least_of_each(rows, "k", ["d2", "i"], size)
    return near.select("k", "local", "i", *[(F.col(p + a) - F.col("s" + a)).alias(p + a) for p in "nc" for a in "xyz"], "noise_scale")


def _train_u(name: str, *parts: str) -> str:
    return _u_sql(f"'train-{name}'", *(f"CAST({p} AS VARCHAR)" for p in parts))


_TRAIN_SQL = f"""{POINTS_SQL}, {_CUBE_SQL},
tk AS (SELECT k, count(*) AS n, 0.005 + (0.02 - 0.005) * {_train_u('scale', 'k')} AS b, CAST(floor({_train_u('turn', 'k')} * 24) AS INTEGER) AS turn, {_train_u('seed', 'k')} AS su FROM pts GROUP BY k),
tu AS (SELECT p.k AS k, i, cx, cy, cz, b, turn, {', '.join(f"{_train_u(a, 'p.k', 'i')} - 0.5 AS u{a}" for a in 'xyz')} FROM pts p JOIN tk ON p.k = tk.k),
tn AS (SELECT *, {', '.join(f'c{a} - b * sign(u{a}) * ln(1 - 2 * abs(u{a})) AS n{a}' for a in 'xyz')} FROM tu),
tt AS (SELECT k, i, b, {', '.join(f'm{r}0 * {p}x + m{r}1 * {p}y + m{r}2 * {p}z AS {p}{a}' for p in 'nc' for r, a in enumerate('xyz'))} FROM tn JOIN cube ON tn.turn = cube.turn),
tm AS (SELECT k, {', '.join(f'(min(n{a}) + max(n{a})) * 0.5 AS o{a}' for a in 'xyz')} FROM tt GROUP BY k),
tf AS (SELECT tt.k AS k, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz, max(sqrt((nx - ox) * (nx - ox) + (ny - oy) * (ny - oy) + (nz - oz) * (nz - oz))) AS scale FROM tt JOIN tm ON tt.k = tm.k GROUP BY tt.k),
tr AS (SELECT tt.k AS k, i, {', '.join(f'({p}{a} - o{a}) / scale AS {p}{a}' for p in 'nc' for a in 'xyz')}, b / scale AS noise_scale, b AS source_scale FROM tt JOIN tf ON tt.k = tf.k)"""


def _r6(*names: str) -> str:
    return ", ".join(f"floor({n} * 1e6 + 0.5) / 1e6 AS {n}" for n in names)


_SIDES = tuple(p + a for p in "nc" for a in "xyz")


@query(f"WITH {_TRAIN_SQL} SELECT k, i, {_r6(*_SIDES, 'noise_scale', 'source_scale')} FROM tr")
def training_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prepared(cloud(points(spark, sf_dir), "c"), 0.005, 0.02)
    return out.select("k", "i", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in (*_SIDES, "noise_scale", "source_scale")])


@query(f"""WITH {_TRAIN_SQL}, ts AS (SELECT tr.k AS k, nx AS sx, ny AS sy, nz AS sz FROM tr JOIN tk ON tr.k = tk.k AND tr.i = floor(su * n)),
td AS (SELECT tr.*, sx, sy, sz, row_number() OVER (PARTITION BY tr.k ORDER BY (nx - sx) * (nx - sx) + (ny - sy) * (ny - sy) + (nz - sz) * (nz - sz), i) - 1 AS local FROM tr JOIN ts ON tr.k = ts.k),
tp AS (SELECT k, CAST(local AS INTEGER) AS local, i, {', '.join(f'{p}{a} - s{a} AS {p}{a}' for p in 'nc' for a in 'xyz')}, noise_scale FROM td WHERE local < {PATCH})
SELECT k, local, i, {_r6(*_SIDES, 'noise_scale')} FROM tp""")
def training_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch of each training cloud."""
    out = training_patches(prepared(cloud(points(spark, sf_dir), "c"), 0.005, 0.02))
    return out.select("k", "local", "i", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in (*_SIDES, "noise_scale")])
