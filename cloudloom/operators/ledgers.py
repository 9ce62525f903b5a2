"""Training ledgers: learning rates, epoch summaries, running bests, cursor checks; and codebooks and attention maths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import q6
from ..sources.views import LOG_SQL, POINTS_SQL, cloud, features, points, read, train_log
from .neighbors import _FEATURE_SQL, _knn_sql, knn

PER_EPOCH = 500
BASE, FLOOR, START = 1e-3, 1e-5, 1e-4


def warmup_cosine(step: Column, warm: int, steps: int, base: float = BASE, least: float = FLOOR) -> Column:
    """base step / warm, then a half cosine to least at the last step. Steps count from 1."""
    progress = (step - warm) / float(steps - warm)
    return F.when(step <= warm, base * step / warm).otherwise(least + (base - least) * 0.5 * (1 + F.cos(F.pi() * progress)))


def warmup_hold_cosine(step: Column, warm: int, hold: int, steps: int, start: float = START, base: float = BASE, least: float = FLOOR) -> Column:
    """From start to base over warm steps (both ends exact), base up to hold, a half cosine to least at the last step."""
    rise = F.when(step == warm, base).otherwise(start + (base - start) * (step - 1) / float(max(warm - 1, 1)))
    progress = (step - hold - 1) / float(max(steps - hold - 1, 1))
    fall = F.when(step == steps, least).otherwise(least + (base - least) * 0.5 * (1 + F.cos(F.pi() * progress)))
    return F.when(step <= warm, rise).when(step <= hold, base).otherwise(fall)


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int, int]:
    """The steps of a run's log, its last step, and where a tenth and half of it end."""
    log = train_log(spark, sf_dir).select("step", "epoch")
    last = log.agg(F.max("step")).first()[0] or 0
    return log, last, max(last // 10, 1), last // 2


_RUN_SQL = f"WITH {LOG_SQL}, t AS (SELECT max(step) AS n, greatest(max(step) // 10, 1) AS w, max(step) // 2 AS h FROM log)"


@query(f"{_RUN_SQL} SELECT step, CAST({BASE} AS DOUBLE) AS lr FROM log")
def lr_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)[0].select("step", F.lit(BASE).alias("lr"))


def _q9(sql: str) -> str:
    return f"floor(({sql}) * 1e9 + 0.5) / 1e9"


@query(f"{_RUN_SQL} SELECT step, {_q9(f'CASE WHEN step <= w THEN {BASE} * step / w ELSE {FLOOR} + ({BASE} - {FLOOR}) * 0.5 * (1 + cos(pi() * ((step - w) / CAST(n - w AS DOUBLE)))) END')} AS lr FROM log, t")
def lr_warmup_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, last, warm, _ = _run(spark, sf_dir)
    return log.select("step", (F.floor(warmup_cosine(F.col("step"), warm, last) * 1e9 + 0.5) / 1e9).alias("lr"))


@query(f"{_RUN_SQL} SELECT step, {_q9(f'CASE WHEN step <= w THEN CASE WHEN step = w THEN {BASE} ELSE {START} + ({BASE} - {START}) * (step - 1) / CAST(greatest(w - 1, 1) AS DOUBLE) END WHEN step <= h THEN {BASE} WHEN step = n THEN {FLOOR} ELSE {FLOOR} + ({BASE} - {FLOOR}) * 0.5 * (1 + cos(pi() * ((step - h - 1) / CAST(greatest(n - h - 1, 1) AS DOUBLE)))) END')} AS lr FROM log, t")
def lr_warmup_hold_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, last, warm, hold = _run(spark, sf_dir)
    return log.select("step", (F.floor(warmup_hold_cosine(F.col("step"), warm, hold, last) * 1e9 + 0.5) / 1e9).alias("lr"))


@query(f"WITH {LOG_SQL} SELECT step, (step - 1) // {PER_EPOCH} AS cursor_epoch, (step - 1) % {PER_EPOCH} AS batch, (step - 1) // {PER_EPOCH} = epoch AS agrees FROM log")
def step_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each step of a log stands in its epoch, and whether the log says the same epoch."""
    s = _run(spark, sf_dir)[0].withColumns({"cursor_epoch": F.expr(f"(step - 1) div {PER_EPOCH}"), "batch": F.expr(f"(step - 1) % {PER_EPOCH}")})
    return s.select("step", "cursor_epoch", "batch", (F.col("cursor_epoch") == F.col("epoch")).alias("agrees"))


@query(f"WITH {LOG_SQL} SELECT epoch, count(*) AS n, floor(CAST(sum(CAST(floor(metric * weight * 1e6 + 0.5) AS BIGINT)) AS BIGINT) / CAST(sum(weight) AS BIGINT) / 1e6 * 1e5 + 0.5) / 1e5 AS weighted_mean, floor(quantile_cont(metric, 0.5) * 1e5 + 0.5) / 1e5 AS median, min(metric) AS least, max(metric) AS most FROM log GROUP BY epoch")
def epoch_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = F.sum(F.floor(F.col("metric") * F.col("weight") * 1e6 + 0.5)) / F.sum("weight") / 1e6
    g = train_log(spark, sf_dir).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), weighted.alias("w"), F.percentile("metric", F.lit(0.5)).alias("m"), F.min("metric").alias("least"), F.max("metric").alias("most"))
    return g.select("epoch", "n", (F.floor(F.col("w") * 1e5 + 0.5) / 1e5).alias("weighted_mean"), (F.floor(F.col("m") * 1e5 + 0.5) / 1e5).alias("median"), "least", "most")


_EPOCHS = "ep AS (SELECT epoch, max(metric) AS score FROM log GROUP BY epoch)"


@query(f"WITH {LOG_SQL}, {_EPOCHS} SELECT epoch, score, coalesce(score > max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS best FROM ep")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs (few: a row for each validation) and whether each is better than all before it."""
    e = train_log(spark, sf_dir).groupBy("epoch").agg(F.max("metric").alias("score"))
    before = F.max("score").over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("best", F.coalesce(F.col("score") > before, F.lit(True)))


@query(f"WITH {LOG_SQL} SELECT event_type, arg_max(step, (metric, -step)) AS step, max(metric) AS metric FROM log GROUP BY event_type")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_log(spark, sf_dir).groupBy("event_type").agg(F.max_by("step", F.struct("metric", -F.col("step"))).alias("step"), F.max("metric").alias("metric"))


@query(f"WITH {LOG_SQL}, p AS (SELECT event_type, step, lag(step) OVER (PARTITION BY event_type ORDER BY step) AS before FROM log) SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN before >= step THEN 1 ELSE 0 END) AS BIGINT) AS backward, max(step - before) AS widest FROM p GROUP BY event_type")
def ledger_prefix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("step").over(Window.partitionBy("event_type").orderBy("step"))
    p = train_log(spark, sf_dir).withColumn("before", before)
    return p.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") >= F.col("step")).alias("backward"), F.max(F.col("step") - F.col("before")).alias("widest"))


# A codebook of the features of the first 16 vectors; soft assignment by cosine at a temperature of 0.1.
_DIM, _CODES, _HEAT = 8, 16, 0.1
_VEC = ", ".join(f"CAST(embedding[{9 + j}] AS DOUBLE) AS f{j}" for j in range(_DIM))
_VQ_SQL = f"""
fv AS (SELECT vec_id, {_VEC} FROM embeddings), fn AS (SELECT *, sqrt(greatest({' + '.join(f'f{j} * f{j}' for j in range(_DIM))}, 1e-24)) AS norm FROM fv),
co AS (SELECT v.vec_id AS v, c.vec_id AS c, ({' + '.join(f'v.f{j} * c.f{j}' for j in range(_DIM))}) / v.norm / c.norm AS s FROM fn v JOIN fn c ON c.vec_id < {_CODES}),
ex AS (SELECT v, c, s, exp((s - max(s) OVER (PARTITION BY v)) / {_HEAT}) AS e FROM co), sa AS (SELECT v, c, s, e / sum(e) OVER (PARTITION BY v) AS w FROM ex)"""


def soft_assignment(vectors: DataFrame, codes: DataFrame, heat: float = _HEAT) -> DataFrame:
    """v, c, s, w: cosine and softmax weight of each vector to each code. Codes are few (broadcast: a bounded codebook);
    the softmax is taken within the row, over an array of codes, so vectors aren't shuffled."""
    book = codes.agg(F.array_sort(F.collect_list(F.struct("c", "f"))).alias("book"))
    norm = lambda f: F.sqrt(F.greatest(F.aggregate(f, F.lit(0.0), lambda a, x: a + x * x), F.lit(1e-24)))
    dot = lambda f, g: F.aggregate(F.zip_with(f, g, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rows = vectors.withColumn("one", F.lit(1)).join(F.broadcast(book.withColumn("one", F.lit(1))), "one")
    rows = rows.withColumn("s", F.transform("book", lambda b: dot(F.col("f"), b["f"]) / norm(F.col("f")) / norm(b["f"])))
    rows = rows.withColumn("e", F.transform("s", lambda x: F.exp((x - F.array_max("s")) / heat)))
    rows = rows.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return rows.select("v", F.inline(F.zip_with("book", F.arrays_zip("s", "e"), lambda b, x: F.struct(b["c"].alias("c"), x["s"].alias("s"), x["e"].alias("e")))), "total", "f").select("v", "c", "s", (F.col("e") / F.col("total")).alias("w"), "f")


def _vq(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir, _DIM).select(F.col("vec_id").alias("v"), F.array(*[f"f{j}" for j in range(_DIM)]).alias("f"))
    return soft_assignment(f, f.filter(f"v < {_CODES}").select(F.col("v").alias("c"), "f"))


@query(f"WITH {_VQ_SQL} SELECT v, c, floor(w * 1e6 + 0.5) / 1e6 AS w FROM sa")
def vq_soft_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vq(spark, sf_dir).select("v", "c", q6("w").alias("w"))


@query(f"WITH {_VQ_SQL} SELECT v, CAST(arg_max(c, (s, -c)) AS BIGINT) AS code FROM sa GROUP BY v")
def vq_hard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vq(spark, sf_dir).groupBy("v").agg(F.max_by("c", F.struct("s", -F.col("c"))).alias("code"))


_MASS = "ma AS (SELECT c, CAST(sum(CAST(floor(w * 1e9 + 0.5) AS BIGINT)) AS BIGINT) / 1e9 AS m FROM sa GROUP BY c), pp AS (SELECT c, m, m / sum(m) OVER () AS p FROM ma)"


EPSILON = 1e-5


def codebook_health(assigned: DataFrame) -> DataFrame:
    """One row for an assignment (v, c, w): how far the weights of a vector are from 1, perplexity, and codes in use and not."""
    sums = assigned.groupBy("v").agg(F.sum("w").alias("t")).agg(F.avg("t").alias("weight_sum_mean"), F.max(F.abs(F.col("t") - 1)).alias("weight_sum_max_error"))
    mass = assigned.groupBy("c").agg((F.sum(F.floor(F.col("w") * 1e9 + 0.5)) / 1e9).alias("m"))
    one = mass.agg(F.collect_list("m").alias("m"), F.sum("m").alias("t"))  # a row of one number for each code: a bounded codebook
    p = F.transform("m", lambda m: m / F.col("t"))
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(F.greatest(x, F.lit(EPSILON))))
    used = F.size(F.filter("m", lambda m: m > EPSILON))
    out = one.select(F.exp(entropy).alias("perplexity"), (used / F.size("m")).alias("utilisation"), (F.size("m") - used).cast("long").alias("dead_codes"), F.size("m").cast("long").alias("codes"))
    return out.crossJoin(sums)  # one row and one row


@query(f"""WITH {_VQ_SQL}, {_MASS}, ws AS (SELECT v, sum(w) AS t FROM sa GROUP BY v) SELECT floor(exp(-sum(p * ln(greatest(p, 1e-5)))) * 1e4 + 0.5) / 1e4 AS perplexity, avg(CASE WHEN m > 1e-5 THEN 1.0 ELSE 0.0 END) AS utilisation, CAST(sum(CASE WHEN m > 1e-5 THEN 0 ELSE 1 END) AS BIGINT) AS dead_codes, count(*) AS codes,
(SELECT floor(avg(t) * 1e6 + 0.5) / 1e6 FROM ws) AS weight_sum_mean, (SELECT max(abs(t - 1)) < 1e-9 FROM ws) AS sums_are_one FROM pp""")
def vq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = codebook_health(_vq(spark, sf_dir))
    return h.select((F.floor(F.col("perplexity") * 1e4 + 0.5) / 1e4).alias("perplexity"), "utilisation", "dead_codes", "codes", q6("weight_sum_mean").alias("weight_sum_mean"), (F.col("weight_sum_max_error") < 1e-9).alias("sums_are_one"))


def ema_update(book: DataFrame, assigned: DataFrame, momentum: float = 0.99) -> DataFrame:
    """c, dim, size, total, value: a codebook (c, dim, size, total, value) after one step of its moving averages over an
    assignment (v, c, w, f), in all dimensions."""
    units = lambda x: F.sum(F.floor(x * 1e9 + 0.5)) / 1e9
    flat = assigned.select("c", "w", F.posexplode("f").alias("dim", "x")).groupBy("c", "dim").agg(units(F.col("w")).alias("n"), units(F.col("w") * F.col("x")).alias("s"))
    new = book.join(flat, ["c", "dim"], "left").fillna(0.0, ["n", "s"])
    new = new.select("c", "dim", (momentum * F.col("size") + (1 - momentum) * F.col("n")).alias("size"), (momentum * F.col("total") + (1 - momentum) * F.col("s")).alias("total"), "value")
    return new.withColumn("value", F.when(F.col("size") > EPSILON, F.col("total") / (F.col("size") + EPSILON)).otherwise(F.col("value")))


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir, _DIM).filter(f"vec_id < {_CODES}").select(F.col("vec_id").alias("c"), F.posexplode(F.array(*[f"f{j}" for j in range(_DIM)])).alias("dim", "value"))
    return f.select("c", "dim", F.lit(1.0).alias("size"), F.col("value").alias("total"), "value")


_DIMS = ", ".join(f"({j})" for j in range(_DIM))
_F = "CASE dim " + " ".join(f"WHEN {j} THEN f{j}" for j in range(_DIM)) + " END"


@query(f"""WITH {_VQ_SQL}, ds AS (SELECT * FROM (VALUES {_DIMS}) t(dim)), lf AS (SELECT vec_id, dim, {_F} AS x FROM fv, ds),
st AS (SELECT sa.c AS c, dim, CAST(sum(CAST(floor(w * 1e9 + 0.5) AS BIGINT)) AS BIGINT) / 1e9 AS n, CAST(sum(CAST(floor(w * x * 1e9 + 0.5) AS BIGINT)) AS BIGINT) / 1e9 AS s FROM sa JOIN lf ON sa.v = lf.vec_id GROUP BY sa.c, dim),
em AS (SELECT st.c AS c, st.dim AS dim, 0.99 * 1.0 + 0.01 * n AS size, 0.99 * o.x + 0.01 * s AS total, o.x AS old FROM st JOIN lf o ON o.vec_id = st.c AND o.dim = st.dim)
SELECT c, dim, floor(size * 1e6 + 0.5) / 1e6 AS size, floor(CASE WHEN size > 1e-5 THEN total / (size + 1e-5) ELSE old END * 1e6 + 0.5) / 1e6 AS value FROM em""")
def vq_ema_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of the moving averages: sizes and sums of the codes by 0.99 and 0.01, from sizes of 1."""
    return ema_update(_book(spark, sf_dir), _vq(spark, sf_dir)).select("c", "dim", q6("size").alias("size"), q6("value").alias("value"))


def dead_codes_reset(codes: DataFrame, step: int, dead_steps: int = 5000, every: int = 1000) -> DataFrame:
    """codes (c, usage, last_usage) with source, the code each dead one is made anew from, and the counters after it.

    At every so many steps, codes unused for more than dead_steps are paired, in order, with the most used ones (ties to
    the lower code); their counters start again. A row of new values is the source's row plus noise, normalised; a source
    that is itself a dead code of a lower rank was made anew before. The codebook is bounded, so its ranks are one window."""
    if step % every:
        return codes.withColumns({"dead": F.lit(False), "source": F.lit(None).cast("long")})
    dead = F.lit(step) - F.col("last_usage") > dead_steps
    rank = F.row_number().over(Window.orderBy(F.desc("usage"), "c"))
    nth = F.sum(dead.cast("int")).over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    flat = codes.withColumns({"dead": dead, "rank": rank, "nth": nth})
    source = flat.select(F.col("rank").alias("nth"), F.col("c").alias("source"), F.lit(True).alias("dead"))
    out = flat.drop("rank").join(source, ["nth", "dead"], "left")
    kept = {"usage": F.when(F.col("dead"), 0).otherwise(F.col("usage")), "last_usage": F.when(F.col("dead"), step).otherwise(F.col("last_usage"))}
    return out.drop("nth").withColumns(kept)


@query("""WITH u AS (SELECT user_id % 64 AS c, count(*) AS usage, max(event_id) AS last_usage FROM events WHERE user_id % 64 > 5 OR event_id < 300 GROUP BY user_id % 64),
s AS (SELECT *, 1000 - last_usage > 600 AS dead, row_number() OVER (ORDER BY usage DESC, c) AS r FROM (SELECT c, usage, least(last_usage, 1000) AS last_usage FROM u)),
n AS (SELECT *, row_number() OVER (PARTITION BY dead ORDER BY c) AS nth FROM s)
SELECT n.c AS c, n.dead AS dead, CASE WHEN n.dead THEN 0 ELSE n.usage END AS usage, CASE WHEN n.dead THEN 1000 ELSE n.last_usage END AS last_usage, CASE WHEN n.dead THEN o.c END AS source FROM n LEFT JOIN s o ON n.dead AND o.r = n.nth""")
def vq_dead_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 64).alias("c"), "event_id").filter("c > 5 or event_id < 300")
    codes = e.groupBy("c").agg(F.count(F.lit(1)).alias("usage"), F.least(F.max("event_id"), F.lit(1000)).alias("last_usage"))
    return dead_codes_reset(codes, 1000, 600).select("c", "dead", "usage", "last_usage", "source")


#: Of the noise of remade codes (fixed values of its formula).
PHASE, FIRST_WAVE, SECOND_WAVE = (0.754877666, 0.569840296), (12.9898, 78.233, 43758.5453), (39.3467, 11.135, 24634.6345)


def remade_codes(codes: DataFrame, vectors: DataFrame, step: int, seed: int, dead_steps: int = 5000, every: int = 1000) -> DataFrame:
    """c, f: vectors (c, f) after the dead codes were made anew: each is its source plus a tenth of normal noise, normalised. Dead
    codes go in order, and one may be the source of a later one: so one task goes through the codebook, whose size a model
    bounds. The noise depends on seed, step, the dead code's rank and the dimension only; it is computed in doubles."""

    def remake(t: pa.Table) -> pa.Table:
        t = t.sort_by("c")
        book = dict(zip(t.column("c").to_pylist(), np.array(t.column("f").to_pylist(), float)))
        dead = [(c, s) for c, s, d in zip(*(t.column(x).to_pylist() for x in ("c", "source", "dead"))) if d]
        for rank, (c, source) in enumerate(dead):
            width = len(book[source])
            phase = rank * width + np.arange(width) + seed * PHASE[0] + step * PHASE[1]
            u, v = ((x := np.sin(phase * a + b) * m) - np.floor(x) for a, b, m in (FIRST_WAVE, SECOND_WAVE))
            new = book[source] + 0.1 * np.sqrt(-2 * np.log(np.clip(u, 1e-7, 1 - 1e-7))) * np.cos(2 * np.pi * v)
            book[c] = new / max(float(np.sqrt((new * new).sum())), 1e-12)
        return pa.table({"c": t.column("c"), "f": pa.array([book[c].tolist() for c in t.column("c").to_pylist()], pa.list_(pa.float64()))})

    told = dead_codes_reset(codes, step, dead_steps, every).select("c", "dead", F.col("source").cast("long").alias("source"))
    return told.join(vectors, "c").select(F.col("c").cast("long").alias("c"), "dead", "source", F.col("f").cast("array<double>").alias("f")).withColumn("book", F.lit(0)).groupBy("book").applyInArrow(remake, "c long, f array<double>")


def _wave_sql(phase: str, wave: tuple[float, float, float]) -> str:
    x = f"(sin(({phase}) * {wave[0]}::DOUBLE + {wave[1]}::DOUBLE) * {wave[2]}::DOUBLE)"
    return f"({x} - floor({x}))"


_REMADE_PHASE = f"((nth - 1) * 8 + d - 1 + 7 * {PHASE[0]}::DOUBLE + 1000 * {PHASE[1]}::DOUBLE)"


@query(f"""WITH RECURSIVE cb AS (SELECT vec_id AS c, [{", ".join(f"CAST(embedding[{9 + j}] AS DOUBLE)" for j in range(8))}] AS f, (vec_id * 29) % 64 AS usage, (vec_id * 37) % 64 * 20 AS last_usage FROM embeddings WHERE vec_id < 64),
fl AS (SELECT *, 1000 - last_usage > 600 AS dead, row_number() OVER (ORDER BY usage DESC, c) AS r FROM cb), nn AS (SELECT *, row_number() OVER (PARTITION BY dead ORDER BY c) AS nth FROM fl),
dd AS (SELECT n.c AS c, n.nth AS nth, o.c AS source FROM nn n JOIN nn o ON n.dead AND o.r = n.nth),
no AS (SELECT nth, list(sqrt(-2 * ln(least(greatest({_wave_sql(_REMADE_PHASE, FIRST_WAVE)}, 1e-7), 1 - 1e-7))) * cos(2 * pi() * {_wave_sql(_REMADE_PHASE, SECOND_WAVE)}) ORDER BY d) AS z FROM dd, range(1, 9) g(d) GROUP BY nth),
bk AS (SELECT CAST(0 AS BIGINT) AS step, (SELECT list(f ORDER BY c) FROM cb) AS book
  UNION ALL SELECT step + 1, list_transform(book, lambda x, i: CASE WHEN i = dd.c + 1 THEN list_transform(list_zip(book[dd.source + 1], no.z), lambda p: (p[1] + 0.1 * p[2]) / greatest(sqrt(list_sum(list_transform(list_zip(book[dd.source + 1], no.z), lambda q: (q[1] + 0.1 * q[2]) * (q[1] + 0.1 * q[2])))), 1e-12)) ELSE x END)
  FROM bk JOIN dd ON dd.nth = bk.step + 1 JOIN no ON no.nth = dd.nth),
la AS (SELECT book FROM bk ORDER BY step DESC LIMIT 1), un AS (SELECT unnest(range(len(book))) AS c, unnest(book) AS f FROM la)
SELECT c, CAST(d AS INTEGER) AS dim, floor(f[d + 1] * 1e5 + 0.5) / 1e5 AS value FROM un, range(0, 8) g(d)""")
def vq_remade_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A codebook of which many codes are dead, some of them sources of others."""
    f = features(spark, sf_dir, 8).filter("vec_id < 64")
    c = F.col("vec_id")
    codes = f.select(c.alias("c"), (c * 29 % 64).alias("usage"), (c * 37 % 64 * 20).alias("last_usage"))
    out = remade_codes(codes, f.select(c.alias("c"), F.array(*[f"f{j}" for j in range(8)]).alias("f")), 1000, 7, 600)
    return out.select("c", F.posexplode("f").alias("dim", "v")).select("c", "dim", (F.floor(F.col("v") * 1e5 + 0.5) / 1e5).alias("value"))


@query("SELECT u AS code, uses FROM (SELECT user_id % 64 AS u, count(*) AS uses FROM events GROUP BY user_id % 64) ORDER BY uses DESC, u LIMIT 5")
def vq_dead_reset_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most used codes, from which dead ones are reset."""
    uses = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 64).alias("code")).agg(F.count(F.lit(1)).alias("uses"))
    return uses.orderBy(F.desc("uses"), "code").limit(5)


@query(f"WITH {POINTS_SQL}, {_knn_sql('c', 'c', 8)} SELECT n.k AS k, n.i AS i, rank, floor((r.cx - q.cx) * 1e6 + 0.5) / 1e6 AS dx, floor(sqrt(d2) * 1e6 + 0.5) / 1e6 AS dist FROM knn n JOIN pts q ON n.k = q.k AND n.i = q.i JOIN pts r ON n.k = r.k AND n.j = r.i")
def rfe_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of each point to its neighbours: offset and distance."""
    c = cloud(points(spark, sf_dir), "c")
    n = knn(c, c, 8)
    n = n.join(c.select("k", "i", F.col("x").alias("qx")), ["k", "i"]).join(c.select("k", F.col("i").alias("j"), F.col("x").alias("rx")), ["k", "j"])
    return n.select("k", "i", "rank", q6(F.col("rx") - F.col("qx")).alias("dx"), q6(F.sqrt("d2")).alias("dist"))


@query(f"""WITH {POINTS_SQL}, {_knn_sql('c', 'c', 8)}, {_FEATURE_SQL}, a AS (SELECT n.k AS k, n.i AS i, f0, exp(-10 * sqrt(d2)) AS e FROM knn n JOIN ft ON n.k = ft.k AND n.j = ft.i)
SELECT k, i, floor(sum(e * f0) / sum(e) * 1e5 + 0.5) / 1e5 AS pooled FROM a GROUP BY k, i""")
def attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of 8 neighbours, weighted by the softmax of -10 times their distance (the nearest is at 0)."""
    c = cloud(points(spark, sf_dir), "c")
    n = knn(c, c, 8).join(features(spark, sf_dir, 1).select("k", F.col("i").alias("j"), "f0"), ["k", "j"]).withColumn("e", F.exp(-10 * F.sqrt("d2")))
    return n.groupBy("k", "i").agg((F.floor(F.sum(F.col("e") * F.col("f0")) / F.sum("e") * 1e5 + 0.5) / 1e5).alias("pooled"))


@query(f"WITH {_FEATURE_SQL} SELECT k, i, floor((f0 * (1 + sin(f1)) + cos(f1)) * 1e6 + 0.5) / 1e6 AS film, floor((1 / (1 + exp(-(f0 + ln(19.0)))) / (1 / (1 + exp(-ln(19.0))))) * 1e6 + 0.5) / 1e6 AS gate, floor(exp(ln(0.005) + 1 / (1 + exp(-f0)) * (ln(0.02) - ln(0.005))) * 1e6 + 0.5) / 1e6 AS noise_scale FROM ft")
def feature_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-wise modulation, displacement gate and log-interpolated noise scale, with fixed stand-in weights."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    c = F.log(F.lit(19.0))
    f = features(spark, sf_dir, 2)
    lo, hi = F.log(F.lit(0.005)), F.log(F.lit(0.02))
    return f.select("k", "i", q6(F.col("f0") * (1 + F.sin("f1")) + F.cos("f1")).alias("film"), q6(sigmoid(F.col("f0") + c) / sigmoid(c)).alias("gate"), q6(F.exp(lo + sigmoid(F.col("f0")) * (hi - lo))).alias("noise_scale"))


@query(f"WITH {POINTS_SQL} SELECT k, floor(quantile_cont(nx, 0.5) * 1e6 + 0.5) / 1e6 AS mx, floor(quantile_cont(ny, 0.5) * 1e6 + 0.5) / 1e6 AS my FROM pts GROUP BY k")
def robust_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of each axis, the centre of robust normalisation."""
    return points(spark, sf_dir).groupBy("k").agg(*[q6(F.percentile("n" + a, F.lit(0.5))).alias("m" + a) for a in "xy"])


@query(f"""WITH {POINTS_SQL}, m AS (SELECT k, quantile_cont(nx, 0.5) AS mx, quantile_cont(ny, 0.5) AS my, quantile_cont(nz, 0.5) AS mz FROM pts GROUP BY k)
SELECT p.k AS k, floor(quantile_cont(sqrt((nx - mx) * (nx - mx) + (ny - my) * (ny - my) + (nz - mz) * (nz - mz)), 0.95) * 1e6 + 0.5) / 1e6 AS scale FROM pts p JOIN m ON p.k = m.k GROUP BY p.k""")
def robust_quantile_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cloud(points(spark, sf_dir), "n")
    middle = p.groupBy("k").agg(*[F.percentile(a, F.lit(0.5)).alias("m" + a) for a in "xyz"])
    d = [F.col(a) - F.col("m" + a) for a in "xyz"]
    r = p.join(middle, "k").withColumn("r", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    return r.groupBy("k").agg(q6(F.percentile("r", F.lit(0.95))).alias("scale"))


#: The metrics of a training step (names that a step log must have).
STEP_METRICS = (
    "total_loss", "infocd_loss_raw", "infocd_loss_weighted", "point_mse_raw", "point_mse_weighted", "correspondence_huber_loss_raw", "correspondence_huber_loss_weighted",
    "commitment_loss", "gradient_norm", "displacement_mean", "displacement_p95", "displacement_max", "learning_rate",
)


def step_metric_summary(log: DataFrame) -> DataFrame:
    """epoch, metric, n, patches and five measures of each of the STEP_METRICS of a step log (epoch, batch_size, metrics)."""
    long = log.unpivot(["epoch", "batch_size"], list(STEP_METRICS), "metric", "value")
    weighted = F.sum(F.floor(F.col("value") * F.col("batch_size") * 1e6 + 0.5)) / F.sum("batch_size") / 1e6
    mean = F.sum(F.floor(F.col("value") * 1e6 + 0.5)) / F.count(F.lit(1)) / 1e6
    return long.groupBy("epoch", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("batch_size").alias("patches"), weighted.alias("patch_weighted_mean"), mean.alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"))


# Stand-ins for a real log: each metric is the event's value times its place in the list.
_STEP_SQL = "st AS (" + " UNION ALL ".join(f"SELECT epoch, weight AS batch_size, '{m}' AS metric, metric * {j + 1} AS value FROM log" for j, m in enumerate(STEP_METRICS)) + ")"
_FIVE = ("patch_weighted_mean", "mean", "median")


@query(f"WITH {LOG_SQL}, {_STEP_SQL} SELECT epoch, metric, count(*) AS n, CAST(sum(batch_size) AS BIGINT) AS patches, floor(CAST(sum(CAST(floor(value * batch_size * 1e6 + 0.5) AS BIGINT)) AS BIGINT) / CAST(sum(batch_size) AS BIGINT) / 1e6 * 1e4 + 0.5) / 1e4 AS patch_weighted_mean, floor(CAST(sum(CAST(floor(value * 1e6 + 0.5) AS BIGINT)) AS BIGINT) / count(*) / 1e6 * 1e4 + 0.5) / 1e4 AS mean, floor(quantile_cont(value, 0.5) * 1e4 + 0.5) / 1e4 AS median, min(value) AS least, max(value) AS most FROM st GROUP BY epoch, metric")
def step_metrics_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = train_log(spark, sf_dir).select("epoch", F.col("weight").alias("batch_size"), *[(F.col("metric") * (j + 1)).alias(m) for j, m in enumerate(STEP_METRICS)])
    s = step_metric_summary(log)
    return s.select("epoch", "metric", "n", "patches", *[(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in _FIVE], "least", "most")


def total_loss(parts: DataFrame, weights: dict[str, float], commitment: str = "commitment_loss") -> DataFrame:
    """parts with <part>_weighted for each weight, and total_loss: their sum and the commitment loss."""
    out = parts.withColumns({f"{p}_weighted": F.col(f"{p}_raw") * w for p, w in weights.items()})
    return out.withColumn("total_loss", sum((F.col(f"{p}_weighted") for p in weights), F.lit(0.0)) + F.col(commitment))


@query(f"WITH {LOG_SQL} SELECT step, floor((0.0 + metric * 1.0 + metric * metric * 0.5 + sqrt(abs(metric)) * 0.25 + 0.125) * 1e6 + 0.5) / 1e6 AS total_loss FROM log")
def weighted_total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metric")
    parts = train_log(spark, sf_dir).select("step", m.alias("infocd_raw"), (m * m).alias("mse_raw"), F.sqrt(F.abs(m)).alias("huber_raw"), F.lit(0.125).alias("commitment_loss"))
    return total_loss(parts, {"infocd": 1.0, "mse": 0.5, "huber": 0.25}).select("step", q6("total_loss").alias("total_loss"))


def log_scale_mse(scales: DataFrame) -> DataFrame:
    """k, mse: mean squared difference of the logarithms of estimated and true noise scales."""
    d = F.log("estimated") - F.log("teacher")
    return scales.groupBy("k").agg((F.sum(F.floor(d * d * 1e9 + 0.5)) / F.count(F.lit(1)) / 1e9).alias("mse"))


def scale_problems(scales: DataFrame, low: float, high: float) -> DataFrame:
    """k, teacher of the true scales outside the range whose ends are rounded to 32-bit floats, as they are trained with."""
    lo, hi = (F.lit(x).cast("float").cast("double") for x in (low, high))
    return scales.filter((F.col("teacher") < lo) | (F.col("teacher") > hi) | F.isnan("teacher")).select("k", "teacher")


_SCALES_SQL = "sc AS (SELECT l_suppkey AS k, 0.005 + l_discount / 5 AS estimated, 0.005 + l_tax / 4 AS teacher FROM lineitem)"


def _scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (0.005 + F.col("l_discount") / 5).alias("estimated"), (0.005 + F.col("l_tax") / 4).alias("teacher"))


@query(f"WITH {_SCALES_SQL} SELECT k, floor(CAST(sum(CAST(floor((ln(estimated) - ln(teacher)) * (ln(estimated) - ln(teacher)) * 1e9 + 0.5) AS BIGINT)) AS BIGINT) / count(*) / 1e9 * 1e6 + 0.5) / 1e6 AS mse FROM sc GROUP BY k")
def log_scale_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_scale_mse(_scales(spark, sf_dir)).select("k", q6("mse").alias("mse"))


@query(f"WITH {_SCALES_SQL} SELECT k, teacher FROM sc WHERE teacher > 0.0199 OR teacher < 0.0051")
def teacher_scale_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale_problems(_scales(spark, sf_dir), 0.0051, 0.0199)


def relation_features(clouds: DataFrame, k: int = 16) -> DataFrame:
    """k, i, rank and ten numbers for each neighbour: the point, the neighbour, the offset and its length."""
    n = knn(clouds, clouds, k)
    n = n.join(clouds.select("k", "i", *[F.col(a).alias("q" + a) for a in "xyz"]), ["k", "i"]).join(clouds.select("k", F.col("i").alias("j"), *[F.col(a).alias("p" + a) for a in "xyz"]), ["k", "j"])
    return n.select("k", "i", "rank", *["q" + a for a in "xyz"], *["p" + a for a in "xyz"], *[(F.col("p" + a) - F.col("q" + a)).alias("d" + a) for a in "xyz"], F.sqrt("d2").alias("length"))


@query(f"WITH {POINTS_SQL}, {_knn_sql('c', 'c', 16)} SELECT n.k AS k, n.i AS i, rank, floor(q.cz * 1e6 + 0.5) / 1e6 AS qz, floor(r.cy * 1e6 + 0.5) / 1e6 AS py, floor((r.cy - q.cy) * 1e6 + 0.5) / 1e6 AS dy, floor((r.cz - q.cz) * 1e6 + 0.5) / 1e6 AS dz, floor(sqrt(d2) * 1e6 + 0.5) / 1e6 AS length FROM knn n JOIN pts q ON n.k = q.k AND n.i = q.i JOIN pts r ON n.k = r.k AND n.j = r.i")
def relation_features_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = relation_features(cloud(points(spark, sf_dir), "c"))
    return r.select("k", "i", "rank", *[q6(c).alias(c) for c in ("qz", "py", "dy", "dz", "length")])


# Stand-in weights of a pointwise layer, from a rule: sin(1 + 3 row + column), and a norm of mean 0.1 and variance 2.
def _weight(r: int, c: int) -> str:
    return f"sin(1 + 3 * {r} + {c})"


def pointwise_layer(clouds: DataFrame, out: int = 4) -> DataFrame:
    """k, i, h0..: each point through a linear layer, a norm and a leaky rectifier of slope 0.2, with stand-in weights."""
    linear = [" + ".join(f"{_weight(r, c)} * {a}" for c, a in enumerate("xyz")) for r in range(out)]
    normed = clouds.selectExpr("k", "i", *[f"(({x}) - 0.1D) / sqrt(2D + 1e-5D) as n{r}" for r, x in enumerate(linear)])
    return normed.selectExpr("k", "i", *[f"if(n{r} > 0, n{r}, 0.2D * n{r}) as h{r}" for r in range(out)])


@query(f"WITH {POINTS_SQL}, l AS (SELECT k, i, " + ", ".join("((" + " + ".join(f"{_weight(r, c)} * c{a}" for c, a in enumerate("xyz")) + f") - 0.1) / sqrt(2.0 + 1e-5) AS n{r}" for r in range(4)) + ") FROM pts)".replace(") FROM", " FROM") + " SELECT k, i, " + ", ".join(f"floor(CASE WHEN n{r} > 0 THEN n{r} ELSE 0.2 * n{r} END * 1e6 + 0.5) / 1e6 AS h{r}" for r in range(4)) + " FROM l")
def pointwise_linear_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = pointwise_layer(cloud(points(spark, sf_dir), "c"))
    return h.select("k", "i", *[q6(f"h{r}").alias(f"h{r}") for r in range(4)])


def shape_ledger(sizes: DataFrame) -> DataFrame:
    """sizes (id, points) with counts, the points of each level of a net that keeps s of s + 1 points (s = 4, 3, 2, 1), and whether
    all are whole."""
    step = F.aggregate(F.array(*[F.lit(s) for s in (4, 3, 2, 1)]), F.array(F.col("points")), lambda a, s: F.array_append(a, F.floor(F.element_at(a, -1) * s / (s + 1)).cast("long")))
    return sizes.select("id", "points", step.alias("counts"), ((F.col("points") % 5 == 0) & (F.col("points") >= 45)).alias("valid"))


@query("SELECT id, points, [points, points * 4 // 5, points * 4 // 5 * 3 // 4, points * 4 // 5 * 3 // 4 * 2 // 3, points * 4 // 5 * 3 // 4 * 2 // 3 // 2] AS counts, points % 5 = 0 AND points >= 45 AS valid FROM (SELECT l_suppkey AS id, count(*) AS points FROM lineitem GROUP BY l_suppkey)")
def point_count_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds of order lines by supplier."""
    return shape_ledger(read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("points")))
