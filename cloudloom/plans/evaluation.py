"""The evaluation query: Chamfer and surface scores of predictions, missing ones zero-filled, rolled up by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.columns import exact_mean, exact_sum, mean_sql, q6, score, sum_sql
from ..operators.neighbors import FRAME_SQL, _near_sql, _region_sql, chamfer, frame, framed, framed_mesh, point_to_surface, tagged
from ..sources.views import POINTS_SQL, TRIANGLES_SQL, cloud, points, triangles
from ..staging import staged


KINDS = ("pred", "noisy")


def of_kinds(metric: DataFrame, name: str) -> DataFrame:
    """k, <name>_pred, <name>_noisy of a metric of clouds tagged by kind, where both are there."""
    wide = metric.groupBy("k.k").agg(*[F.max(F.when(F.col("k.tag") == t, F.col(name))).alias(f"{name}_{t}") for t in KINDS])
    return wide.filter(f"{name}_pred is not null and {name}_noisy is not null")


def score_rows(metrics: DataFrame, require_p2s: bool) -> DataFrame:
    """metrics (k, cd_pred, cd_noisy[, p2s_pred, p2s_noisy]) with cd_score, p2s_score, total_score: half and half, or the CD
    score alone if P2S is not required. Of the P2S values both or none must be there, and both if they are required."""
    out = metrics.withColumn("cd_score", score(F.col("cd_pred"), F.col("cd_noisy")))
    if "p2s_pred" not in metrics.columns:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("p2s_pred", "p2s_noisy")})
    some, both = (f(F.col("p2s_pred").isNotNull(), F.col("p2s_noisy").isNotNull()) for f in (lambda x, y: x | y, lambda x, y: x & y))
    bad = (some & ~both) | (~both & F.lit(require_p2s))
    value = F.when(bad, F.raise_error(F.concat(F.lit("P2S values are missing of "), F.col("k").cast("string"))).cast("double")).otherwise(score(F.col("p2s_pred"), F.col("p2s_noisy")))
    out = out.withColumn("p2s_score", value if require_p2s else F.when(bad, value))
    return out.withColumn("total_score", 0.5 * F.col("cd_score") + 0.5 * F.col("p2s_score") if require_p2s else F.col("cd_score"))


def scored(predicted: DataFrame, noisy: DataFrame, clean: DataFrame, mesh: DataFrame | None = None) -> DataFrame:
    """k, cd_pred, cd_noisy, p2s_pred, p2s_noisy, cd_score, p2s_score, total_score of each predicted cloud. Both clouds go
    through one search, in the frame of the clean cloud, and so does the mesh; metrics are 0 where that has no extent. P2S is
    measured, and required, where a mesh is given. A prediction of another number of points than the noisy cloud is an error."""
    frames = staged(frame(clean), "frames")
    solid = frames.filter("scale >= 1e-12")
    both = tagged(predicted.select("k", "i", *"xyz"), "pred").union(tagged(noisy.select("k", "i", *"xyz"), "noisy"))
    of_k = lambda df: df.withColumns({"tag": F.col("k.tag"), "k": F.col("k.k")})
    every = of_k(both).union(clean.select("k", "i", *"xyz", F.lit("clean").alias("tag")))
    inside = [((F.col(a) - F.col("o" + a)) / F.col("scale")).alias(a) for a in "xyz"]
    inside = staged(every.join(solid, "k").select("k", "i", "tag", *inside), "framed")
    both_in = inside.filter("tag <> 'clean'").select(F.struct("k", "tag").alias("k"), "i", *"xyz")
    clean_in = inside.filter("tag = 'clean'").select("k", "i", *"xyz")
    sizes = of_kinds(both.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "n")
    flat = frames.filter("scale < 1e-12").select("k", *[F.lit(0.0).alias(f"cd_{t}") for t in KINDS])
    out = of_kinds(chamfer(both_in, tagged(clean_in, *KINDS)), "cd").union(flat)
    if mesh is not None:
        flat = flat.select("k", *[F.lit(0.0).alias(f"p2s_{t}") for t in KINDS])
        p2s = of_kinds(point_to_surface(both_in, tagged(framed_mesh(mesh, solid), *KINDS)), "p2s").union(flat)
        out = out.join(p2s, "k", "left")
    wrong = F.raise_error(F.concat(F.lit("another number of points than the noisy cloud has: "), F.col("k").cast("string"))).cast("double")
    out = out.join(sizes, "k").withColumn("cd_pred", F.when(F.col("n_pred") == F.col("n_noisy"), F.col("cd_pred")).otherwise(wrong)).drop("n_pred", "n_noisy")
    return score_rows(out, mesh is not None)


def zero_filled(expected: DataFrame, scores: DataFrame) -> DataFrame:
    """expected (k, synset) with the scores of each; what was not predicted is missing and scores 0."""
    out = expected.join(scores, "k", "left").withColumn("missing", F.col("total_score").isNull())
    zero = {"cd_score": F.coalesce("cd_score", F.lit(0.0)), "total_score": F.coalesce("total_score", F.lit(0.0)), "p2s_score": F.when(F.col("missing"), 0.0).otherwise(F.col("p2s_score"))}
    return out.withColumns(zero)


def rolled_up(rows: DataFrame) -> DataFrame:
    """By synset and in all (synset null): counts, means of the scores over all expected samples, and of the raw metrics
    over those present. P2S means are null where P2S was not scored; the total is then the CD mean."""
    has_p2s = F.count_if(~F.col("missing") & F.col("p2s_score").isNotNull()) > 0
    mean = lambda c: exact_sum(c) / F.count(F.lit(1))
    raw = {c: F.when(~F.col("missing"), F.col(c)) for c in ("cd_pred", "cd_noisy", "p2s_pred", "p2s_noisy")}
    out = rows.rollup("synset").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("missing")).alias("n_valid"),
        F.count_if("missing").alias("n_missing"),
        mean("cd_score").alias("mean_cd_score"),
        F.when(has_p2s, mean("p2s_score")).alias("mean_p2s_score"),
        *[exact_mean(v).alias(f"mean_{c}") for c, v in raw.items()],
    )
    total = F.when(F.col("mean_p2s_score").isNull(), F.col("mean_cd_score")).otherwise(0.5 * F.col("mean_cd_score") + 0.5 * F.col("mean_p2s_score"))
    return out.withColumn("total_score", total)


def missing_ids(rows: DataFrame) -> DataFrame:
    """k, synset of the expected samples that were not predicted: a table, not a list, so of any length."""
    return rows.filter("missing").select("k", "synset")


#: Columns of the score table in the order of its CSV.
SCORE_COLUMNS = ("sample_id", "synset", "missing", "cd_pred", "cd_noisy", "cd_score", "p2s_pred", "p2s_noisy", "p2s_score", "total_score")


def write_scores(rows: DataFrame, path: str) -> None:
    """The score table as CSV with a header, in order of sample_id; an existing path is an error."""
    rows.select(F.col("k").cast("string").alias("sample_id"), *SCORE_COLUMNS[1:]).orderBy("sample_id").write.mode("errorifexists").csv(path, header=True)


def unexpected(expected: DataFrame, scores: DataFrame) -> DataFrame:
    return scores.join(expected, "k", "left_anti").select("k")


_SCORE = "CASE WHEN {n} < 1e-15 THEN CASE WHEN {p} < 1e-15 THEN 100.0 ELSE 0.0 END ELSE greatest(0.0, least(100.0, 100.0 * (1.0 - {p} / {n}))) END"
_EVAL_SQL = f"""WITH {POINTS_SQL}, {FRAME_SQL}, {_near_sql('pa', 'p', 'c', 'nrm')}, {_near_sql('pb', 'c', 'p', 'nrm')}, {_near_sql('na', 'n', 'c', 'nrm')}, {_near_sql('nb', 'c', 'n', 'nrm')},
cd AS (SELECT pa.k AS k, pa.v + pb.v AS cd_pred, na.v + nb.v AS cd_noisy FROM pa JOIN pb ON pa.k = pb.k JOIN na ON pa.k = na.k JOIN nb ON pa.k = nb.k),
sc AS (SELECT *, {_SCORE.format(p='cd_pred', n='cd_noisy')} AS cd_score FROM cd)"""


def _scores(spark: SparkSession, sf_dir: str, mesh: bool = False) -> DataFrame:
    p = points(spark, sf_dir)
    return scored(cloud(p, "p"), cloud(p, "n"), cloud(p, "c"), triangles(spark, sf_dir) if mesh else None)


@query(f"{_EVAL_SQL} SELECT k, floor(cd_pred * 1e6 + 0.5) / 1e6 AS cd_pred, floor(cd_noisy * 1e6 + 0.5) / 1e6 AS cd_noisy, floor(cd_score * 1e4 + 0.5) / 1e4 AS cd_score FROM sc")
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("k", q6("cd_pred").alias("cd_pred"), q6("cd_noisy").alias("cd_noisy"), (F.floor(F.col("cd_score") * 1e4 + 0.5) / 1e4).alias("cd_score"))


# The triangles in the frame of the clean cloud.
_FRAMED_SQL = f"{TRIANGLES_SQL}, trn AS (SELECT t.k AS k, f, " + ", ".join(f"({c} - o{c[1]}) / scale AS {c}" for c in ("ax", "ay", "az", "bx", "by_", "bz", "gx", "gy", "gz")) + " FROM tri t JOIN fr ON t.k = fr.k)"


def _surface(s: str) -> str:
    sql = _region_sql().replace("px - ax", f"{s}x - ax").replace("py - ay", f"{s}y - ay").replace("pz - az", f"{s}z - az")
    for k in range(8):
        sql = sql.replace(f"e{k} ", f"{s}e{k} ").replace(f"FROM e{k})", f"FROM {s}e{k})")
    sql = sql.replace("FROM pts p JOIN tri t", "FROM nrm p JOIN trn t")
    return sql + f", {s}v AS (SELECT k, {mean_sql('d2')} AS v FROM {s}e7 GROUP BY k)"


@query(f"{_EVAL_SQL}, {_FRAMED_SQL}, {_surface('p')}, {_surface('n')}, ss AS (SELECT pv.k AS k, {_SCORE.format(p='pv.v', n='nv.v')} AS p2s_score FROM pv JOIN nv ON pv.k = nv.k) SELECT sc.k AS k, floor((0.5 * cd_score + 0.5 * p2s_score) * 1e3 + 0.5) / 1e3 AS total_score FROM sc JOIN ss ON sc.k = ss.k")
def eval_total_with_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, True).select("k", (F.floor(F.col("total_score") * 1e3 + 0.5) / 1e3).alias("total_score"))


# The universe: all samples there are, and two more that nobody predicts.
_EXPECTED_SQL = "ks AS (SELECT k FROM pts UNION SELECT max(k) + 1 FROM pts UNION SELECT max(k) + 2 FROM pts), ex AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'a' WHEN k % 3 = 1 THEN 'b' ELSE 'c' END AS synset FROM ks)"


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    more = p.agg(F.max("k").alias("m")).select(F.explode(F.array(F.col("m") + 1, F.col("m") + 2)).alias("k"))
    k = F.col("k")
    return p.select("k").distinct().union(more).select("k", F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").otherwise("c").alias("synset"))


def _mean_sql(v: str, digits: str, alias: str, over: str = "count(*)") -> str:
    return f"floor({sum_sql(v)} / {over} * {digits} + 0.5) / {digits} AS {alias}"


_Z = f"{_EXPECTED_SQL}, z AS (SELECT synset, sc.k IS NULL AS missing, coalesce(cd_score, 0.0) AS s, cd_pred, cd_noisy FROM ex LEFT JOIN sc ON ex.k = sc.k)"


@query(f"{_EVAL_SQL}, {_Z} SELECT synset, count(*) AS n, CAST(sum(CASE WHEN missing THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, {_mean_sql('s', '1e3', 'mean_score')}, {_mean_sql('cd_pred', '1e5', 'mean_cd', 'count(cd_pred)')} FROM z GROUP BY ROLLUP (synset)")
def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rolled_up(zero_filled(_expected(spark, sf_dir), _scores(spark, sf_dir)))
    return r.select("synset", "n", "n_missing", (F.floor(F.col("total_score") * 1e3 + 0.5) / 1e3).alias("mean_score"), (F.floor(F.col("mean_cd_pred") * 1e5 + 0.5) / 1e5).alias("mean_cd"))


_SURFACE_SQL = f"{_EVAL_SQL}, {_FRAMED_SQL}, {_surface('p')}, {_surface('n')}, ss AS (SELECT pv.k AS k, pv.v AS p2s_pred, nv.v AS p2s_noisy, {_SCORE.format(p='pv.v', n='nv.v')} AS p2s_score FROM pv JOIN nv ON pv.k = nv.k)"
_ROUNDED = {"mean_cd_score": "1e2", "mean_p2s_score": "1e2", "mean_cd_pred": "1e5", "mean_cd_noisy": "1e5", "mean_p2s_pred": "1e5", "mean_p2s_noisy": "1e5", "total_score": "1e2"}


@query(f"""{_SURFACE_SQL}, {_EXPECTED_SQL}, z AS (SELECT synset, sc.k IS NULL AS missing, coalesce(cd_score, 0.0) AS cs, coalesce(p2s_score, 0.0) AS ps, cd_pred, cd_noisy, p2s_pred, p2s_noisy FROM ex LEFT JOIN sc ON ex.k = sc.k LEFT JOIN ss ON ex.k = ss.k),
r AS (SELECT synset, count(*) AS n, CAST(sum(CASE WHEN missing THEN 0 ELSE 1 END) AS BIGINT) AS n_valid, CAST(sum(CASE WHEN missing THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
  {sum_sql('cs')} / count(*) AS c, CASE WHEN sum(CASE WHEN missing THEN 0 ELSE 1 END) > 0 THEN {sum_sql('ps')} / count(*) END AS p,
  {', '.join(_mean_sql(m, '1e5', 'mean_' + m, f'count({m})') for m in ('cd_pred', 'cd_noisy', 'p2s_pred', 'p2s_noisy'))} FROM z GROUP BY ROLLUP (synset))
SELECT synset, n, n_valid, n_missing, floor(c * 1e2 + 0.5) / 1e2 AS mean_cd_score, floor(p * 1e2 + 0.5) / 1e2 AS mean_p2s_score, mean_cd_pred, mean_cd_noisy, mean_p2s_pred, mean_p2s_noisy, floor((CASE WHEN p IS NULL THEN c ELSE 0.5 * c + 0.5 * p END) * 1e2 + 0.5) / 1e2 AS total_score FROM r""")
def eval_rollup_with_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole roll-up: both scores and the raw metrics, by category and in all."""
    r = rolled_up(zero_filled(_expected(spark, sf_dir), _scores(spark, sf_dir, True)))
    return r.select("synset", "n", "n_valid", "n_missing", *[(F.floor(F.col(c) * float(d) + 0.5) / float(d)).alias(c) for c, d in _ROUNDED.items()])


@query(f"{_EVAL_SQL}, {_EXPECTED_SQL} SELECT ex.k AS k, synset, sc.k IS NULL AS missing FROM ex LEFT JOIN sc ON ex.k = sc.k")
def eval_missing_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_filled(_expected(spark, sf_dir), _scores(spark, sf_dir)).select("k", "synset", "missing")


@query(f"{_EVAL_SQL}, {_EXPECTED_SQL} SELECT k, synset FROM ex WHERE k NOT IN (SELECT k FROM sc)")
def eval_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_ids(zero_filled(_expected(spark, sf_dir), _scores(spark, sf_dir)))


def rollup_problems(expected: DataFrame, scores: DataFrame) -> DataFrame:
    """k, problem of what a roll-up can't take: ids that were scored twice or aren't expected or are null, scores out of 0 to 100,
    metrics that are negative or no numbers, and one P2S value without the other."""
    fine = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf")))
    rows = scores.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("k"))).join(expected.select("k", F.lit(True).alias("wanted")), "k", "left")
    percent = lambda c: F.col(c).isNull() | F.col(c).between(0, 100)
    tests = {
        "no id": F.col("k").isNull(),
        "repeated": F.col("k").isNotNull() & (F.col("times") > 1),
        "unexpected": F.col("k").isNotNull() & F.col("wanted").isNull(),
        "score": ~(percent("cd_score") & percent("p2s_score") & percent("total_score")),
        "metric": ~(fine("cd_pred") & fine("cd_noisy") & fine("p2s_pred") & fine("p2s_noisy")) | F.col("cd_pred").isNull() | F.col("cd_noisy").isNull(),
        "one P2S value": F.col("p2s_pred").isNull() != F.col("p2s_noisy").isNull(),
    }
    found = F.filter(F.array(*[F.when(t, F.lit(p)) for p, t in tests.items()]), lambda x: x.isNotNull())
    return rows.select("k", F.explode(found).alias("problem")).distinct()


@query("""WITH s AS (SELECT CASE WHEN o_orderkey % 97 = 3 THEN NULL WHEN o_orderkey % 89 = 4 THEN -o_orderkey ELSE o_orderkey END AS k, o_orderkey % 83 = 5 AS high, o_orderkey % 79 = 6 AS bad, o_orderkey % 73 = 7 AS one, o_orderkey % 71 = 8 AS twice FROM orders),
t AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE twice)
SELECT DISTINCT k, problem FROM (SELECT k, 'no id' AS problem FROM t WHERE k IS NULL UNION ALL SELECT k, 'repeated' FROM t WHERE twice AND k IS NOT NULL UNION ALL SELECT k, 'unexpected' FROM t WHERE k < 0
UNION ALL SELECT k, 'score' FROM t WHERE high UNION ALL SELECT k, 'metric' FROM t WHERE bad UNION ALL SELECT k, 'one P2S value' FROM t WHERE one)""")
def eval_rollup_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score table with an error of each kind planted."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    i = F.col("o_orderkey")
    k = F.when(i % 97 == 3, None).when(i % 89 == 4, -i).otherwise(i)
    row = o.select(
        k.alias("k"), (i % 71 == 8).alias("twice"), F.when(i % 79 == 6, float("nan")).otherwise(0.25).alias("cd_pred"), F.lit(1.0).alias("cd_noisy"), F.when(i % 73 == 7, None).otherwise(0.5).alias("p2s_pred"), F.lit(1.0).alias("p2s_noisy"),
        F.when(i % 83 == 5, 100.5).otherwise(75.0).alias("cd_score"), F.lit(50.0).alias("p2s_score"), F.lit(62.5).alias("total_score"),
    )
    return rollup_problems(o.select(i.alias("k")), row.union(row.filter("twice")).drop("twice"))


@query(f"{_EVAL_SQL} SELECT count(*) AS n, floor({mean_sql('cd_pred')} * 1e6 + 0.5) / 1e6 AS mean_cd FROM sc")
def chamfer_batch_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean Chamfer distance of all clouds, each in its clean frame."""
    return _scores(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), q6(exact_mean("cd_pred")).alias("mean_cd"))


_OPTIONAL_SQL = "o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 IN (0, 2) THEN 1.0 + o_orderkey % 7 END AS p, CASE WHEN o_orderkey % 4 IN (0, 3) THEN 4.0 + o_orderkey % 5 END AS q FROM orders)"


@query(f"WITH {_OPTIONAL_SQL} SELECT k, CASE WHEN p IS NULL THEN NULL ELSE floor({_SCORE.format(p='p', n='q')} * 1e6 + 0.5) / 1e6 END AS p2s_score, CASE WHEN p IS NULL THEN 'none' ELSE 'both' END AS p2s FROM o WHERE (p IS NULL) = (q IS NULL) UNION ALL SELECT k, NULL, 'one' FROM o WHERE (p IS NULL) <> (q IS NULL)")
def p2s_both_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows with both, none or one of two optional values: those with both through the scores that require them, those
    with none through the scores that don't, and those with one as the error that they are."""
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), F.lit(1.0).alias("cd_pred"), F.lit(2.0).alias("cd_noisy"), F.when(k % 4 % 2 == 0, 1.0 + k % 7).alias("p2s_pred"), F.when((k % 4).isin(0, 3), 4.0 + k % 5).alias("p2s_noisy"))
    bad = rollup_problems(o.select("k"), o.withColumns({c: F.lit(None).cast("double") for c in ("cd_score", "p2s_score", "total_score")})).filter("problem = 'one P2S value'")
    good = o.join(bad, "k", "left_anti")
    both = score_rows(good.filter("p2s_pred is not null"), True).select("k", q6("p2s_score").alias("p2s_score"), F.lit("both").alias("p2s"))
    none = score_rows(good.filter("p2s_pred is null"), False).select("k", "p2s_score", F.lit("none").alias("p2s"))
    return both.union(none).union(bad.select("k", F.lit(None).cast("double"), F.lit("one")))


@query(f"WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice / 1000 END AS n, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_custkey / 10.0 END AS p FROM orders) SELECT id, floor({_SCORE.format(p='p', n='n')} * 1e6 + 0.5) / 1e6 AS score FROM m")
def metric_to_score_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.when(F.col("o_orderkey") % 5 == 0, 0.0).otherwise(F.col("o_totalprice") / 1000)
    p = F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_custkey") / 10.0)
    return o.select(F.col("o_orderkey").alias("id"), q6(score(p, n)).alias("score"))
