"""Farthest-point sampling, overlapping patches, hard-best fusion and the noise route's summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import exact_mean, q6, squared
from ..sources.views import POINTS_SQL, cloud, points
from ..staging import staged
from .farthest import farthest_points
from .neighbors import _D2, knn

#: Ways to choose the first of the sampled points.
STRATEGIES = ("index0", "centroid_far", "x_min", "x_max")
PATCH, SEED_K = 16, 3
TINY = 2.2250738585072014e-308


def starts(clouds: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """plan, k, s: the start point of each strategy; the first index wins ties."""
    middle = clouds.groupBy("k").agg(*[exact_mean(a).alias("m" + a) for a in "xyz"])
    d = clouds.join(middle, "k").withColumn("far", squared("", "m"))
    first = {
        "index0": F.min("i"),
        "centroid_far": F.max_by("i", F.struct("far", -F.col("i"))),
        "x_min": F.min_by("i", F.struct("x", "i")),
        "x_max": F.max_by("i", F.struct("x", -F.col("i"))),
    }
    wide = d.groupBy("k").agg(*[first[s].alias(s) for s in strategies])
    return wide.unpivot("k", list(strategies), "plan", "s").select("plan", "k", "s")


def patches(clouds: DataFrame, seeds: DataFrame, size: int = PATCH) -> DataFrame:
    """plan, k, patch, local, i, dist, nd2: the `size` nearest points of each seed, by (distance, index); squared distance
    over that of the farthest."""
    chosen = seeds.join(clouds, ["k", "i"]).select("k", F.struct("plan", "rank").alias("i"), "x", "y", "z")
    near = knn(chosen, clouds, size).select("k", "i.plan", F.col("i.rank").alias("patch"), F.col("j").alias("i"), F.sqrt("d2").alias("dist"))
    w = Window.partitionBy("plan", "k", "patch")
    d2 = F.col("dist") * F.col("dist")
    local = F.row_number().over(w.orderBy("dist", "i")) - 1
    return near.withColumn("local", local).withColumn("nd2", d2 / F.greatest(F.max(d2).over(w), F.lit(TINY)))


def owners(plan: DataFrame) -> DataFrame:
    """plan, k, i, patch, local, nd2: the patch that owns each covered point: least (nd2, patch)."""
    best = F.row_number().over(Window.partitionBy("plan", "k", "i").orderBy("nd2", "patch"))
    return plan.withColumn("best", best).filter("best = 1").drop("best", "dist")


def seed_count(clouds: DataFrame, seed_k: float = SEED_K, size: int = PATCH) -> DataFrame:
    return clouds.groupBy("k").agg(F.floor(F.lit(seed_k) * F.count(F.lit(1)) / size).cast("int").alias("seeds"))


def too_small(clouds: DataFrame, size: int = PATCH) -> DataFrame:
    """k, points of the clouds under one patch: they have no patches, and passes over patches leave them unmoved."""
    return clouds.groupBy("k").agg(F.count(F.lit(1)).alias("points")).filter(F.col("points") < size)


def plan(clouds: DataFrame, strategies: tuple[str, ...] = ("index0",), size: int = PATCH) -> DataFrame:
    """Patches of every cloud of `size` points or more (see too_small): floor(seed_k n / size) seeds by farthest-point
    sampling, from each strategy's start."""
    count = clouds.groupBy("k").agg(F.count(F.lit(1)).alias("points"), F.floor(F.lit(SEED_K) * F.count(F.lit(1)) / size).cast("int").alias("n"))
    seeds = starts(clouds, strategies).join(count.filter(F.col("points") >= size).drop("points"), "k")
    return patches(clouds, staged(farthest_points(seeds, clouds), "seeds"), size)  # each step of the search reads them


def shrunk(clouds: DataFrame, plan_: DataFrame, rate: float = 0.5) -> DataFrame:
    """The stand-in denoiser: each point of a patch moves towards the patch's mean by `rate` times its nearness.
    plan, k, patch, i, ex, ey, ez (moves)."""
    p = plan_.join(clouds, ["k", "i"])
    mean = p.groupBy("plan", "k", "patch").agg(*[exact_mean(a).alias("m" + a) for a in "xyz"])
    move = {f"e{a}": (F.col("m" + a) - F.col(a)) * rate * (1 - F.col("nd2")) for a in "xyz"}
    return p.join(mean, ["plan", "k", "patch"]).withColumns(move).select("plan", "k", "patch", "i", "ex", "ey", "ez")


def fuse(clouds: DataFrame, plan_: DataFrame, moves: DataFrame, strategies: tuple[str, ...] = ("index0",)) -> DataFrame:
    """plan, k, i, x, y, z for each of the plans: each point moved as its owner says; points without an owner stay, and so
    do clouds without patches."""
    own = owners(plan_).join(moves, ["plan", "k", "patch", "i"]).select("plan", "k", "i", "ex", "ey", "ez")
    every = clouds.withColumn("plan", F.explode(F.array(*map(F.lit, strategies))))
    moved = [(F.col(a) + F.coalesce("e" + a, F.lit(0.0))).alias(a) for a in "xyz"]
    return every.join(own, ["plan", "k", "i"], "left").select("plan", "k", "i", *moved)


def fps_sql(p: str, count: str, start: str = "SELECT k, 0 AS s FROM pts GROUP BY k") -> str:
    """Recursive: each step carries all points of a cloud with their least distance to what is taken."""
    d = f"(a.{p}x - b.{p}x) * (a.{p}x - b.{p}x) + (a.{p}y - b.{p}y) * (a.{p}y - b.{p}y) + (a.{p}z - b.{p}z) * (a.{p}z - b.{p}z)"
    return f"""
st AS ({start}),
fps AS (SELECT st.k AS k, 0 AS rank, st.s AS cur, a.i AS i, CASE WHEN a.i = st.s THEN -1.0 ELSE {d} END AS md FROM st JOIN pts a ON a.k = st.k JOIN pts b ON b.k = st.k AND b.i = st.s
  UNION ALL
  SELECT n.k, n.rank + 1, n.c, n.i, CASE WHEN n.md < 0 OR n.i = n.c THEN -1.0 ELSE least(n.md, {d}) END
  FROM (SELECT *, first_value(i) OVER (PARTITION BY k ORDER BY md DESC, i) AS c FROM fps) n JOIN pts a ON a.k = n.k AND a.i = n.i JOIN pts b ON b.k = n.k AND b.i = n.c WHERE n.rank + 1 < {count})"""


_PLAN_SQL = f"""WITH RECURSIVE {POINTS_SQL}, {fps_sql('n', '(SELECT max(floor(3 * c / 16)) FROM (SELECT count(*) AS c FROM pts GROUP BY k))')},
cnt AS (SELECT k, floor(3.0 * count(*) / 16) AS seeds FROM pts GROUP BY k),
sd AS (SELECT DISTINCT fps.k AS k, rank, cur FROM fps JOIN cnt ON fps.k = cnt.k WHERE rank < seeds),
pr AS (SELECT sd.k AS k, sd.rank AS patch, r.i AS i, sqrt({_D2.format(p='n', s='n')}) AS dist FROM sd JOIN pts q ON q.k = sd.k AND q.i = sd.cur JOIN pts r ON r.k = sd.k),
pa AS (SELECT *, row_number() OVER (PARTITION BY k, patch ORDER BY dist, i) - 1 AS local FROM pr),
pl AS (SELECT k, patch, local, i, dist, dist * dist / greatest(max(dist * dist) OVER (PARTITION BY k, patch), {TINY}) AS nd2 FROM pa WHERE local < 16),
ow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY nd2, patch) AS best FROM pl) WHERE best = 1)"""


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(cloud(points(spark, sf_dir), "n"), "noisy")  # each step of a pass reads it


@query(f"WITH RECURSIVE {POINTS_SQL}, {fps_sql('n', '12')} SELECT DISTINCT k, CAST(rank AS INTEGER) AS rank, CAST(cur AS INTEGER) AS i FROM fps")
def fps_index0(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _noisy(spark, sf_dir)
    return farthest_points(starts(c, ("index0",)), c, 12).drop("plan")


_START = "SELECT k, CAST(min(i) AS INTEGER) AS s FROM (SELECT p.k AS k, p.i AS i, rank() OVER (PARTITION BY p.k ORDER BY {0}) AS r FROM pts p JOIN md ON p.k = md.k) WHERE r = 1 GROUP BY k"
_MIDDLE = "md AS (SELECT k, " + ", ".join(f"CAST(sum(CAST(n{a} AS DECIMAL(38, 24))) AS DOUBLE) / count(*) AS m{a}" for a in "xyz") + " FROM pts GROUP BY k)"
_FAR = "(nx - mx) * (nx - mx) + (ny - my) * (ny - my) + (nz - mz) * (nz - mz) DESC"


@query(f"WITH {POINTS_SQL}, {_MIDDLE} SELECT 'index0' AS plan, k, CAST(0 AS INTEGER) AS s FROM md UNION ALL " + " UNION ALL ".join(f"SELECT '{n}' AS plan, k, s FROM ({_START.format(o)})" for n, o in (("centroid_far", _FAR), ("x_min", "nx"), ("x_max", "nx DESC"))))
def fps_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starts(_noisy(spark, sf_dir))


@query(f"WITH RECURSIVE {POINTS_SQL}, {_MIDDLE}, {fps_sql('n', '8', _START.format('nx DESC'))} SELECT DISTINCT k, CAST(rank AS INTEGER) AS rank, CAST(cur AS INTEGER) AS i FROM fps")
def fps_x_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _noisy(spark, sf_dir)
    return farthest_points(starts(c, ("x_max",)), c, 8).drop("plan")


@query(f"{_PLAN_SQL} SELECT k, CAST(patch AS INTEGER) AS patch, CAST(local AS INTEGER) AS local, i, floor(nd2 * 1e6 + 0.5) / 1e6 AS nd2 FROM pl")
def patch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(_noisy(spark, sf_dir)).select("k", "patch", "local", "i", q6("nd2").alias("nd2"))


@query(f"{_PLAN_SQL} SELECT k, i, CAST(patch AS INTEGER) AS patch, CAST(local AS INTEGER) AS local FROM ow")
def patch_owner_hard_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return owners(plan(_noisy(spark, sf_dir))).select("k", "i", "patch", "local")


@query(f"{_PLAN_SQL} SELECT p.k AS k, count(*) AS total, count(o.i) AS owned, 100 * count(o.i) >= 99 * count(*) AS passes FROM pts p LEFT JOIN ow o ON p.k = o.k AND p.i = o.i GROUP BY p.k")
def patch_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points owned by some patch, and the gate 100 owned >= 99 total."""
    c = _noisy(spark, sf_dir)
    own = owners(plan(c)).select("k", "i", F.lit(1).alias("o"))
    out = c.join(own, ["k", "i"], "left").groupBy("k").agg(F.count(F.lit(1)).alias("total"), F.count("o").alias("owned"))
    return out.withColumn("passes", 100 * F.col("owned") >= 99 * F.col("total"))


_MOVE_SQL = """,
mn AS (SELECT pl.k AS k, pl.patch AS patch, """ + ", ".join(f"CAST(sum(CAST(n{a} AS DECIMAL(38, 24))) AS DOUBLE) / count(*) AS m{a}" for a in "xyz") + """ FROM pl JOIN pts p ON pl.k = p.k AND pl.i = p.i GROUP BY pl.k, pl.patch),
fu AS (SELECT p.k AS k, p.i AS i, """ + ", ".join(f"n{a} + coalesce((m{a} - n{a}) * 0.5 * (1 - nd2), 0.0) AS {a}" for a in "xyz") + """ FROM pts p LEFT JOIN ow o ON p.k = o.k AND p.i = o.i LEFT JOIN mn ON mn.k = o.k AND mn.patch = o.patch)"""


@query(f"{_PLAN_SQL}{_MOVE_SQL} SELECT k, i, " + ", ".join(f"floor({a} * 1e5 + 0.5) / 1e5 AS {a}" for a in "xyz") + " FROM fu")
def patch_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _noisy(spark, sf_dir)
    p = staged(plan(c), "plan")  # read for moves and owners
    return fuse(c, p, shrunk(c, p)).select("k", "i", *[(F.floor(F.col(a) * 1e5 + 0.5) / 1e5).alias(a) for a in "xyz"])


@query(f"""{_PLAN_SQL}, sc AS (SELECT k, patch, floor(max(dist) * 1e6 + 0.5) / 1e6 AS scale FROM pl GROUP BY k, patch),
po AS (SELECT o.k AS k, s.scale AS scale FROM ow o JOIN sc s ON o.k = s.k AND o.patch = s.patch),
q AS (SELECT k, quantile_disc(scale, 0.5) AS q50, quantile_disc(scale, 0.75) AS q75, quantile_disc(scale, 0.9) AS q90, count(*) AS owned FROM po GROUP BY k)
SELECT q.k AS k, any_value(q50) AS q50, any_value(q75) AS q75, any_value(q90) AS q90, quantile_disc(floor(abs(scale - q50) * 1e6 + 0.5) / 1e6, 0.5) AS mad, any_value(owned) AS owned FROM q JOIN po ON q.k = po.k GROUP BY q.k""")
def noise_route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner-weighted quantiles of the patches' scales (inverted CDF), by cumulative owner counts; not by expanded rows."""
    p = staged(plan(_noisy(spark, sf_dir)), "plan")  # read for scales and owners
    scale = p.groupBy("plan", "k", "patch").agg(q6(F.max("dist")).alias("v"))
    weight = owners(p).groupBy("plan", "k", "patch").agg(F.count(F.lit(1)).alias("w"))
    rows = scale.join(weight, ["plan", "k", "patch"]).select("k", "v", "w")
    q = weighted_quantiles(rows, (0.5, 0.75, 0.9)).withColumnsRenamed({"q0": "q50", "q1": "q75", "q2": "q90"})
    off = rows.join(q, "k").select("k", q6(F.abs(F.col("v") - F.col("q50"))).alias("v"), "w")
    return q.join(weighted_quantiles(off, (0.5,)).select("k", F.col("q0").alias("mad")), "k").select("k", "q50", "q75", "q90", "mad", F.col("total").alias("owned"))


def weighted_quantiles(rows: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """k, total, q0, q1, ..: the least v whose cumulative weight w reaches level * total."""
    byv = rows.groupBy("k", "v").agg(F.sum("w").alias("w"))
    run = Window.partitionBy("k").orderBy("v")
    c = byv.withColumns({"cum": F.sum("w").over(run), "total": F.sum("w").over(Window.partitionBy("k"))})
    return c.groupBy("k").agg(F.max("total").alias("total"), *[F.min(F.when(F.col("cum") >= q * F.col("total"), F.col("v"))).alias(f"q{j}") for j, q in enumerate(levels)])


def cascade_pass(clouds: DataFrame, rate: float, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """One refinement: the mean of the fused results of all plans, and x + rate (mean - x)."""
    p = staged(plan(clouds, strategies), "plan")  # read for moves and owners
    fused = fuse(clouds, p, shrunk(clouds, p), strategies)
    mean = fused.groupBy("k", "i").agg(*[exact_mean(a).alias("r" + a) for a in "xyz"])
    return clouds.join(mean, ["k", "i"]).select("k", "i", *[(F.col(a) + rate * (F.col("r" + a) - F.col(a))).alias(a) for a in "xyz"])


def _pass_sql(t: str, src: str, rate: str, strategies: tuple[str, ...]) -> str:
    """CTEs of a pass over the table src (k, i, nx, ny, nz); their result is the table {t}out."""
    middle = f"{t}md AS (SELECT k, " + ", ".join(f"CAST(sum(CAST(n{a} AS DECIMAL(38, 24))) AS DOUBLE) / count(*) AS m{a}" for a in "xyz") + f" FROM {src} GROUP BY k)"
    order = {"index0": "i", "centroid_far": _FAR, "x_min": "nx", "x_max": "nx DESC"}
    parts, fused = [middle], []
    for n, s in enumerate(strategies):
        u = f"{t}{n}"
        start = f"SELECT k, CAST(min(i) AS INTEGER) AS s FROM (SELECT p.k AS k, p.i AS i, rank() OVER (PARTITION BY p.k ORDER BY {order[s]}) AS r FROM {src} p JOIN {t}md md ON p.k = md.k) WHERE r = 1 GROUP BY k"
        fps = fps_sql("n", f"(SELECT max(floor(3 * c / 16)) FROM (SELECT count(*) AS c FROM {src} GROUP BY k))", start)
        fps = fps.replace("st AS (", f"{u}st AS (", 1).replace("FROM st JOIN", f"FROM {u}st st JOIN").replace("fps AS (", f"{u}fps AS (", 1).replace("FROM fps)", f"FROM {u}fps)").replace("JOIN pts ", f"JOIN {src} ")
        parts.append(f"""{fps},
{u}sd AS (SELECT DISTINCT f.k AS k, rank, cur FROM {u}fps f JOIN (SELECT k, floor(3.0 * count(*) / 16) AS seeds FROM {src} GROUP BY k) c ON f.k = c.k WHERE rank < seeds),
{u}pr AS (SELECT sd.k AS k, sd.rank AS patch, r.i AS i, sqrt({_D2.format(p='n', s='n')}) AS dist FROM {u}sd sd JOIN {src} q ON q.k = sd.k AND q.i = sd.cur JOIN {src} r ON r.k = sd.k),
{u}pa AS (SELECT *, row_number() OVER (PARTITION BY k, patch ORDER BY dist, i) - 1 AS local FROM {u}pr),
{u}pl AS MATERIALIZED (SELECT k, patch, local, i, dist * dist / greatest(max(dist * dist) OVER (PARTITION BY k, patch), {TINY}) AS nd2 FROM {u}pa WHERE local < 16),
{u}ow AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY nd2, patch) AS best FROM {u}pl) WHERE best = 1),
{u}mn AS (SELECT l.k AS k, l.patch AS patch, """ + ", ".join(f"CAST(sum(CAST(n{a} AS DECIMAL(38, 24))) AS DOUBLE) / count(*) AS m{a}" for a in "xyz") + f""" FROM {u}pl l JOIN {src} p ON l.k = p.k AND l.i = p.i GROUP BY l.k, l.patch)""")
        fused.append("SELECT p.k AS k, p.i AS i, " + ", ".join(f"n{a} + coalesce((m{a} - n{a}) * 0.5 * (1 - nd2), 0.0) AS {a}" for a in "xyz") + f" FROM {src} p LEFT JOIN {u}ow o ON p.k = o.k AND p.i = o.i LEFT JOIN {u}mn mn ON mn.k = o.k AND mn.patch = o.patch")
    mean = f"{t}mean AS (SELECT k, i, " + ", ".join(f"CAST(sum(CAST({a} AS DECIMAL(38, 24))) AS DOUBLE) / count(*) AS r{a}" for a in "xyz") + f" FROM ({' UNION ALL '.join(fused)}) GROUP BY k, i)"
    out = f"{t}out AS MATERIALIZED (SELECT p.k AS k, p.i AS i, " + ", ".join(f"n{a} + {rate} * (r{a} - n{a}) AS n{a}" for a in "xyz") + f" FROM {src} p JOIN {t}mean m ON p.k = m.k AND p.i = m.i)"
    return ", ".join([*parts, mean, out])


@query(f"WITH RECURSIVE {POINTS_SQL}, {_pass_sql('u', 'pts', '1.12', STRATEGIES)}, {_pass_sql('w', 'uout', '0.59', STRATEGIES)} SELECT k, i, " + ", ".join(f"floor(n{a} * 1e5 + 0.5) / 1e5 AS {a}" for a in "xyz") + " FROM wout")
def cascade_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two refinements over four plans, by 1.12 and 0.59."""
    once = staged(cascade_pass(_noisy(spark, sf_dir), 1.12), "pass")
    return cascade_pass(once, 0.59).select("k", "i", *[(F.floor(F.col(a) * 1e5 + 0.5) / 1e5).alias(a) for a in "xyz"])


def damped_passes(clouds: DataFrame, passes: int, damping: float) -> DataFrame:
    """k, i, x, y, z after so many passes over one plan each; from the second pass on only a share of the move is made."""
    for n in range(passes):
        clouds = staged(cascade_pass(clouds, damping if n else 1.0, ("index0",)), "pass")
    return clouds


@query(f"WITH RECURSIVE {POINTS_SQL}, {_pass_sql('u', 'pts', '1.0', ('index0',))}, {_pass_sql('w', 'uout', '0.5', ('index0',))} SELECT k, i, " + ", ".join(f"floor(n{a} * 1e5 + 0.5) / 1e5 AS {a}" for a in "xyz") + " FROM wout")
def damped_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damped_passes(_noisy(spark, sf_dir), 2, 0.5).select("k", "i", *[(F.floor(F.col(a) * 1e5 + 0.5) / 1e5).alias(a) for a in "xyz"])


def centred(plan_: DataFrame, clouds: DataFrame) -> DataFrame:
    """plan, k, patch, local, i, x, y, z: the points of each patch, from its seed (the patch's nearest point, local 0)."""
    p = plan_.join(clouds, ["k", "i"]).select("plan", "k", "patch", "local", "i", *"xyz")
    seed = p.filter("local = 0").select("plan", "k", "patch", *[F.col(a).alias("s" + a) for a in "xyz"])
    return p.join(seed, ["plan", "k", "patch"]).select("plan", "k", "patch", "local", "i", *[(F.col(a) - F.col("s" + a)).alias(a) for a in "xyz"])


@query(f"{_PLAN_SQL} SELECT pl.k AS k, CAST(pl.patch AS INTEGER) AS patch, CAST(pl.local AS INTEGER) AS local, floor((p.nx - s.nx) * 1e6 + 0.5) / 1e6 AS x, floor((p.nz - s.nz) * 1e6 + 0.5) / 1e6 AS z FROM pl JOIN pts p ON pl.k = p.k AND pl.i = p.i JOIN sd ON sd.k = pl.k AND sd.rank = pl.patch JOIN pts s ON s.k = sd.k AND s.i = sd.cur")
def patch_center_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _noisy(spark, sf_dir)
    return centred(staged(plan(c), "plan"), c).select("k", "patch", "local", q6("x").alias("x"), q6("z").alias("z"))


def route_summary(scales: DataFrame, owner_counts: DataFrame, points_: DataFrame, most: float) -> DataFrame:
    """One row for each cloud of a noise route: weighted quantiles of the patches' scales (scales: k, patch, v) by the points
    they own (owner_counts: k, patch, w), their spread, the share of owned points in patches at the greatest scale, patches
    that own nothing, uncovered points, coverage and whether it is 99 of 100 (points_: k, total)."""
    every = scales.join(owner_counts, ["k", "patch"], "left").withColumn("w", F.coalesce("w", F.lit(0)))
    top = F.lit(most).cast("float").cast("double")
    sums = every.groupBy("k").agg(F.sum("w").alias("owned"), F.count_if(F.col("w") == 0).alias("zero_owner_patches"), F.sum(F.when(F.col("v") >= top, F.col("w")).otherwise(0)).alias("at_top"))
    rows = every.filter("w > 0").select("k", "v", "w")
    q = weighted_quantiles(rows, (0.5, 0.75, 0.9)).withColumnsRenamed({"q0": "q50", "q1": "q75", "q2": "q90"}).drop("total")
    off = rows.join(q, "k").select("k", q6(F.abs(F.col("v") - F.col("q50"))).alias("v"), "w")
    out = sums.join(q, "k").join(weighted_quantiles(off, (0.5,)).select("k", F.col("q0").alias("mad")), "k").join(points_, "k")
    passes = 100 * F.col("owned") >= 99 * F.col("total")
    return out.select("k", F.col("q75").alias("route_score"), "q50", "q75", "q90", "mad", (F.col("at_top") / F.col("owned")).alias("saturation"), "owned", "zero_owner_patches", (F.col("total") - F.col("owned")).alias("uncovered"), (F.col("owned") / F.col("total")).alias("coverage"), passes.alias("passes"))


@query(f"""{_PLAN_SQL}, sc AS (SELECT k, patch, floor(max(dist) * 1e6 + 0.5) / 1e6 AS scale FROM pl GROUP BY k, patch),
oc AS (SELECT k, patch, count(*) AS w FROM ow GROUP BY k, patch), ev AS (SELECT s.k AS k, s.patch AS patch, scale, coalesce(w, 0) AS w FROM sc s LEFT JOIN oc ON s.k = oc.k AND s.patch = oc.patch),
po AS (SELECT o.k AS k, s.scale AS scale FROM ow o JOIN sc s ON o.k = s.k AND o.patch = s.patch), q AS (SELECT k, quantile_disc(scale, 0.5) AS q50, quantile_disc(scale, 0.75) AS q75, quantile_disc(scale, 0.9) AS q90, count(*) AS owned FROM po GROUP BY k),
m AS (SELECT po.k AS k, quantile_disc(floor(abs(scale - q50) * 1e6 + 0.5) / 1e6, 0.5) AS mad, sum(CASE WHEN scale >= CAST(CAST(0.2 AS FLOAT) AS DOUBLE) THEN 1 ELSE 0 END) AS top FROM po JOIN q ON po.k = q.k GROUP BY po.k),
t AS (SELECT k, count(*) AS total FROM pts GROUP BY k), z AS (SELECT k, CAST(sum(CASE WHEN w = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_owner_patches FROM ev GROUP BY k)
SELECT q.k AS k, q75 AS route_score, q50, q75, q90, mad, top / owned AS saturation, owned, zero_owner_patches, total - owned AS uncovered, owned / total AS coverage, 100 * owned >= 99 * total AS passes FROM q JOIN m ON q.k = m.k JOIN t ON q.k = t.k JOIN z ON q.k = z.k""")
def noise_route_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _noisy(spark, sf_dir)
    p = staged(plan(c), "plan")
    scale = p.groupBy("k", "patch").agg(q6(F.max("dist")).alias("v"))
    counts = owners(p).groupBy("k", "patch").agg(F.count(F.lit(1)).alias("w"))
    return route_summary(scale, counts, c.groupBy("k").agg(F.count(F.lit(1)).alias("total")), 0.2)


_SMALL_SQL = POINTS_SQL.replace("pts AS (", "every AS (") + ", pts AS (SELECT * FROM every WHERE k % 3 <> 0 OR i < 4 + k)"


@query(f"""{_PLAN_SQL.replace(POINTS_SQL, _SMALL_SQL).replace("FROM pts GROUP BY k),", "FROM pts GROUP BY k HAVING count(*) >= 16),", 1).replace("seeds FROM pts GROUP BY k)", "seeds FROM pts GROUP BY k HAVING count(*) >= 16)")}{_MOVE_SQL},
c AS (SELECT k, count(*) AS points FROM pts GROUP BY k) SELECT fu.k AS k, fu.i AS i, """ + ", ".join(f"floor({a} * 1e5 + 0.5) / 1e5 AS {a}" for a in "xyz") + ", points < 16 AS too_small FROM fu JOIN c ON fu.k = c.k")
def patch_fuse_small_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds of which every third has fewer points than a patch: these stay as they are, and are told apart."""
    c = staged(_noisy(spark, sf_dir).filter("k % 3 <> 0 or i < 4 + k"), "clouds")
    p = staged(plan(c), "plan")
    small = too_small(c).select("k", F.lit(True).alias("too_small"))
    moved = fuse(c, p, shrunk(c, p)).select("k", "i", *[(F.floor(F.col(a) * 1e5 + 0.5) / 1e5).alias(a) for a in "xyz"])
    return moved.join(small, "k", "left").withColumn("too_small", F.coalesce("too_small", F.lit(False)))


@query(f"{_PLAN_SQL}{_MOVE_SQL} SELECT f.k AS k, f.i AS i, floor((nx + 1.12 * (x - nx)) * 1e5 + 0.5) / 1e5 AS x FROM fu f JOIN pts p ON f.k = p.k AND f.i = p.i")
def cascade_one_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cascade_pass(_noisy(spark, sf_dir), 1.12, ("index0",))
    return c.select("k", "i", (F.floor(F.col("x") * 1e5 + 0.5) / 1e5).alias("x"))

