"""Edge rows: duplicates, single points, flat clouds, zero baselines, files."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions.columns import score
from cloudloom.operators import grid
from cloudloom.operators.neighbors import chamfer, knn, nearest, normalized_chamfer, surface_distances
from cloudloom.operators.farthest import farthest_points
from cloudloom.operators.patches import starts, weighted_quantiles
from cloudloom.plans.evaluation import score_rows, scored, write_scores, zero_filled
from cloudloom.sources.files import list_archive, read_clouds, read_ids, read_ledger, repeated_keys, scan_tree
from cloudloom.sources.views import cloud as cloud_of
from cloudloom.sources.views import points
from cloudloom.streaming.ledger import drained, rolling_summary


def cloud(spark, xyz, k=0):
    return spark.createDataFrame([(k, i, *map(float, p)) for i, p in enumerate(xyz)], "k int, i int, x double, y double, z double")


def test_ties_go_to_the_lower_index(spark):
    c = cloud(spark, [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (1, 0, 0)])
    assert [r.j for r in knn(c.filter("i = 0"), c, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert [r.i for r in farthest_points(starts(c, ("index0",)), c, 4).orderBy("rank").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("one_cube", [8, 512])
def test_search_through_cubes_is_exact(spark, monkeypatch, one_cube):
    """Clusters, outliers, duplicates and a cloud of fewer points than neighbours asked for."""
    monkeypatch.setattr(grid, "ONE_CUBE", one_cube)
    g = np.random.default_rng(3)
    b = np.concatenate([g.normal(size=(150, 3)) * 0.01, g.normal(size=(100, 3)), [[40, 0, 0], [40, 0, 0]]])
    a = np.concatenate([b[:60], g.normal(size=(60, 3)) * 2, [[-30, 5, 9], [0, 0, 90]]])
    q, r = cloud(spark, a).union(cloud(spark, a[:3], 1)), cloud(spark, b).union(cloud(spark, b[:2], 1))
    d2 = ((a[:, None] - b[None]) ** 2 @ [1.0, 1.0, 1.0])
    want = {(0, i, j) for i, row in enumerate(d2) for j in sorted(range(len(b)), key=lambda j: (row[j], j))[:5]} | {(1, i, j) for i in range(3) for j in range(2)}
    assert {(x.k, x.i, x.j) for x in knn(q, r, 5).collect()} == want
    got = {x.i: x.d2 for x in nearest(q, r).filter("k = 0").collect()}
    assert len(got) == len(a) and np.allclose([got[i] for i in range(len(a))], d2.min(1))


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), None])
def test_a_point_that_is_no_number_is_an_error(spark, bad):
    c = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 1.0, bad)], "k int, i int, x double, y double, z double")
    for find in (lambda: knn(c, c, 1), lambda: nearest(c.filter("i = 0"), c), lambda: chamfer(c, c.filter("i = 0"))):
        with pytest.raises(Exception, match="not finite"):
            find().collect()


def met(q, r):
    """Pairs that a join of searches makes, per query, and the most under one key."""
    keys = ["k", "level", "cx", "cy", "cz"]
    pairs = q.groupBy(*keys).count().join(r.groupBy(*keys).agg(F.count(F.lit(1)).alias("there")), keys).select((F.col("count") * F.col("there")).alias("n"))
    return pairs.agg(F.sum("n"), F.max("n")).first()


@pytest.mark.parametrize("shape", ["far point", "dense spot", "volume", "coincident"])
def test_cubes_follow_density(spark, shape):
    g = np.random.default_rng(8)
    n = 4000
    xyz = g.uniform(size=(n, 3))
    if shape == "far point":
        xyz[0] = 5000
    if shape == "dense spot":
        xyz[: n // 2] *= 0.001
    if shape == "coincident":
        xyz[: n // 2] = 0.5
    c = cloud(spark, xyz)
    pairs, most = met(*grid.searches(c, c.select("k", F.col("i").alias("j"), *"xyz"), 4))
    assert pairs < 200 * n and most < 100_000
    i = np.arange(0, n, 97)
    d2 = ((xyz[i][:, None] - xyz[None]) ** 2).sum(2)
    got = {(r.i, r["rank"]): r.d2 for r in knn(c.filter("i % 97 = 0"), c, 4).collect()}
    want = np.sort(d2, axis=1)[:, :4]
    assert np.allclose([[got[a, b] for b in range(4)] for a in i.tolist()], want)


def test_surface_search_meets_only_pairs_that_it_compares(spark):
    g = np.random.default_rng(6)
    base = g.normal(size=(1000, 3))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    tri = base[:, None] + g.normal(size=(1000, 3, 3)) * 0.02
    mesh = spark.createDataFrame([(0, f, *map(float, t.reshape(-1))) for f, t in enumerate(tri)], "k int, f int, ax double, ay double, az double, bx double, by_ double, bz double, gx double, gy double, gz double")
    pts = cloud(spark, base[g.integers(0, 1000, 2000)] + g.normal(size=(2000, 3)) * 0.02)
    reach = nearest(pts, grid.corners(mesh)).select("k", "i", F.sqrt("d2").alias("reach"))
    found = [met(q, t) for q, t in grid.triangle_searches(pts, mesh, reach)]
    assert sum(p or 0 for p, _ in found) < 100 * 2000 and max(m or 0 for _, m in found) < 100_000


def test_scores_of_small_distances(spark):
    """Clouds whose distances are far under a billionth squared: 100 (1 - (1.8 / 2)^2) and 100 (1 - (2 / 3)^2)."""
    clean = spark.createDataFrame([(k, i, float(i % 5), float(i // 5), 0.0) for k in (0, 1) for i in range(25)], "k int, i int, x double, y double, z double")
    moved = lambda a, b: clean.withColumn("z", F.when(F.col("k") == 0, a).otherwise(b))
    corner = clean.filter("i in (0, 4, 20)").groupBy("k").agg(*[F.max(F.when(F.col("i") == i, F.col(a))).alias(p + a + ("_" if p + a == "by" else "")) for p, i in (("a", 0), ("b", 4), ("g", 20)) for a in "xyz"])
    other = clean.filter("i in (4, 20, 24)").groupBy("k").agg(*[F.max(F.when(F.col("i") == i, F.col(a))).alias(p + a + ("_" if p + a == "by" else "")) for p, i in (("a", 4), ("b", 20), ("g", 24)) for a in "xyz"])
    mesh = corner.withColumn("f", F.lit(0)).unionByName(other.withColumn("f", F.lit(1)))
    got = {r.k: r for r in scored(moved(1.8e-5, 2e-5), moved(2e-5, 3e-5), clean, mesh).collect()}
    for k, want in ((0, 19.0), (1, 100 * 5 / 9)):
        assert got[k].cd_score == pytest.approx(want) and got[k].p2s_score == pytest.approx(want)
    scale2 = 8.0  # of the frame: half the diagonal, squared
    assert got[0].p2s_noisy == pytest.approx(4e-10 / scale2) and got[0].cd_noisy == pytest.approx(8e-10 / scale2)


def test_a_prediction_of_another_size_is_an_error(spark):
    c = cloud(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)])
    with pytest.raises(Exception, match="another number of points"):
        scored(c.filter("i < 2"), c, c).collect()


def stepwise(xyz, start, count):
    least, taken, at = np.full(len(xyz), np.inf), [], start
    for _ in range(count):
        taken.append(at)
        d = xyz - xyz[at]
        least = np.minimum(least, d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
        least[taken] = -1
        at = int(least.argmax())
    return taken


@pytest.mark.parametrize("shape", ["sphere", "lattice", "far point", "coincident"])
def test_farthest_points_over_blocks(spark, shape):
    """A cloud in many blocks: the same points in the same order as step by step, with ties, outliers and equal points."""
    g = np.random.default_rng(12)
    n = 1500
    xyz = g.normal(size=(n, 3))
    if shape == "sphere":
        xyz /= np.linalg.norm(xyz, axis=1, keepdims=True)
    if shape == "lattice":
        xyz = g.permutation(np.array([(a, b, c) for a in range(12) for b in range(12) for c in range(11)], float))[:n]
    if shape == "far point":
        xyz[5] = 1000
    if shape == "coincident":
        xyz[: n - 20] = 0.25
    c = cloud(spark, xyz).union(cloud(spark, xyz[:40], 7))
    s = spark.createDataFrame([("a", 0, 3), ("b", 0, 11), ("a", 7, 0)], "plan string, k int, s int")
    got = {(r.plan, r.k, r["rank"]): r.i for r in farthest_points(s, c, 16, block=400).collect()}
    for plan, k, start, pts in (("a", 0, 3, xyz), ("b", 0, 11, xyz), ("a", 7, 0, xyz[:40])):
        m = min(16, len(pts))
        assert [got[plan, k, r] for r in range(m)] == stepwise(pts, start, m)
    assert len(got) == 3 * 16


@pytest.mark.parametrize("one_cube", [8, 512])
def test_surface_distance_is_exact(spark, monkeypatch, one_cube):
    """Small, large and flat triangles; points near and far; against a fine sampling and a flat triangle's edge."""
    monkeypatch.setattr(grid, "ONE_CUBE", one_cube)
    g = np.random.default_rng(5)
    base = g.uniform(-1, 1, size=(60, 1, 3))
    tri = base + g.normal(size=(60, 3, 3)) * g.choice([0.02, 0.2, 2.0], size=(60, 1, 1))
    tri[0, 2] = tri[0, 1]  # no area
    tri[1] = tri[1, :1]  # one point
    names = "ax ay az bx by_ bz gx gy gz".split()
    mesh = spark.createDataFrame([(0, f, *map(float, t.reshape(-1))) for f, t in enumerate(tri)], "k int, f int, " + ", ".join(f"{n} double" for n in names))
    pts = np.concatenate([g.uniform(-1, 1, size=(40, 3)), [[9, 9, 9]], tri[:3, 0]])
    got = {r.i: r.d2 for r in surface_distances(cloud(spark, pts), mesh).collect()}
    n = 60
    w = np.array([(i / n, j / n, 1 - (i + j) / n) for i in range(n + 1) for j in range(n + 1 - i)])
    samples = np.einsum("wc,tcx->twx", w, tri).reshape(-1, 3)
    for i, p in enumerate(pts):
        near = np.sqrt(((samples - p) ** 2).sum(1).min())
        assert near - 0.15 <= np.sqrt(got[i]) <= near + 1e-9


def test_flat_cloud_scores_nothing(spark):
    c = cloud(spark, [(1, 1, 1), (1, 1, 1)])
    assert normalized_chamfer(c, c).first().cd == 0.0
    assert chamfer(c, c).first().cd == 0.0


def test_score_edges(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (2.0, 1.0), (0.25, 1.0)], "p double, n double")
    assert [r[0] for r in rows.select(score(F.col("p"), F.col("n"))).collect()] == [100.0, 0.0, 0.0, 75.0]


def test_weighted_quantiles(spark):
    g = np.random.default_rng(1)
    v, w = g.integers(0, 9, 40), g.integers(0, 5, 40)
    df = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(v, w)], "k int, v double, w long")
    got = weighted_quantiles(df.filter("w > 0"), (0.5, 0.75, 0.9)).first()
    assert [got.q0, got.q1, got.q2] == list(np.quantile(np.repeat(v, w), [0.5, 0.75, 0.9], method="inverted_cdf"))


def test_files(spark, tmp_path):
    sample = "00000001/" + "a" * 30
    os.makedirs(tmp_path / sample)
    xyz = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / sample / "clean.npy", xyz)
    back = read_clouds(spark, str(tmp_path)).orderBy("point_idx").collect()
    assert [(r.x, r.y, r.z) for r in back] == [tuple(p) for p in xyz.tolist()] and back[0].sample_id == sample
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/b.txt", "x")
        z.writestr("../c.txt", "y")
    files = spark.createDataFrame([("z", bytearray(out.getvalue()))], "path string, content binary")
    assert {r.member: r.problem for r in list_archive(files).collect()} == {"a/b.txt": "", "../c.txt": "unsafe path"}


def test_ledger(spark):
    lines = spark.createDataFrame([(1, '{"step": 1}'), (2, '{"step": 2}'), (3, '{"st')], "line_no long, line string")
    assert [r.step for r in read_ledger(lines, "step long").collect()] == [1, 2]
    with pytest.raises(Exception, match="bad ledger line"):
        read_ledger(lines.withColumn("line_no", -F.col("line_no")), "step long").collect()
    twice = spark.createDataFrame([(1, '{"a": 1, "a": 2}'), (2, '{"a": 1}')], "id long, json string")
    assert [tuple(r) for r in repeated_keys(twice).collect()] == [(1, "a")]


def test_id_lists_and_trees(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert {r.id for r in read_ids(spark, str(tmp_path / "ids.txt")).collect()} == {"a", "b"}
    (tmp_path / "ids.txt").write_text("a\na\n")
    with pytest.raises(Exception, match="repeated id a"):
        read_ids(spark, str(tmp_path / "ids.txt")).collect()
    sample = "00000001/" + "a" * 30
    for top in ("x", "y"):
        os.makedirs(tmp_path / top / sample)
        (tmp_path / top / sample / "clean.npy").write_bytes(b"12345")
    assert [(r.sample_id, r.bytes) for r in scan_tree(spark, str(tmp_path / "x"), "clean.npy").collect()] == [(sample, 5)]
    with pytest.raises(Exception, match="repeated sample"):
        scan_tree(spark, str(tmp_path), "clean.npy").collect()


def test_late_rows_are_dropped(spark, tmp_path):
    for n, hours in enumerate([(1, 2, 12), (13, 20), (1, 20, 30)]):
        rows = [(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:30:00", "e", 1.0) for h in hours]
        spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        files = sorted((tmp_path / "in").glob("part-*"), key=os.path.getmtime)
        os.utime(files[-1], (1000 + n, 1000 + n))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(rolling_summary(stream), "start timestamp, event_type string, n long, micros long")
    assert {(r.start.day, r.start.hour): r.n for r in got.collect()} == {(1, 1): 1, (1, 2): 1, (1, 12): 1, (1, 13): 1, (1, 20): 2}


def test_scores_need_both_p2s_values(spark):
    m = spark.createDataFrame([(1, 1.0, 2.0, 1.0, 4.0)], "k int, cd_pred double, cd_noisy double, p2s_pred double, p2s_noisy double")
    r = score_rows(m, True).first()
    assert (r.cd_score, r.p2s_score, r.total_score) == (50.0, 75.0, 62.5)
    assert score_rows(m, False).first().total_score == 50.0
    for require in (True, False):
        with pytest.raises(Exception, match="P2S values are missing"):
            score_rows(m.withColumn("p2s_pred", F.lit(None).cast("double")), require).collect()


def test_score_table_is_csv_in_order(spark, tmp_path):
    p = points(spark, "/root/testdata/sf0.001")
    rows = zero_filled(p.select("k").distinct().withColumn("synset", F.lit("a")), scored(cloud_of(p, "p"), cloud_of(p, "n"), cloud_of(p, "c")))
    write_scores(rows, str(tmp_path / "scores"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "scores").glob("part-*.csv"))).splitlines()
    assert text[0] == "sample_id,synset,missing,cd_pred,cd_noisy,cd_score,p2s_pred,p2s_noisy,p2s_score,total_score"
    assert [x.split(",")[0] for x in text[1:]] == [str(k) for k in range(10)]


def test_a_place_is_searched_for_once(spark, monkeypatch):
    """Forty points at each of 600 places, and a cloud whose points share none."""
    from cloudloom.operators import neighbors

    g = np.random.default_rng(4)
    xyz = np.repeat(g.uniform(size=(600, 3)), 40, axis=0)
    alone = g.uniform(size=(700, 3))
    c = cloud(spark, xyz).union(cloud(spark, alone, 1)).localCheckpoint()
    asked = []
    monkeypatch.setattr(neighbors, "searches", lambda q, r, need: asked.append(q.count()) or grid.searches(q, r, need))
    got = {(r.k, r.i): r.d2 for r in nearest(c, cloud(spark, alone, 0).union(cloud(spark, alone, 1))).collect()}
    assert asked == [600 + 700] and len(got) == 40 * 600 + 700
    want = ((xyz[::40][:, None] - alone[None]) ** 2).sum(2).min(1)
    assert np.allclose([got[0, 40 * p + 39] for p in range(600)], want) and not any(got[1, i] for i in range(700))


def test_cubes_end_where_points_are_few(spark):
    g = np.random.default_rng(4)
    c = cloud(spark, g.uniform(size=(2000, 3)))
    r = c.join(grid.cubes(c, c), "k").selectExpr("k", "depth", *grid._each(f"{grid._cube('{a}')} as o{{a}}"))
    assert 0 < grid.crowded(r, grid.FULL).count() < 2000 // 4


def test_large_triangles_are_not_compared_with_all_points(spark):
    g = np.random.default_rng(6)
    tri = g.normal(size=(600, 3, 3))
    mesh = spark.createDataFrame([(0, f, *map(float, t.reshape(-1))) for f, t in enumerate(tri)], "k int, f int, ax double, ay double, az double, bx double, by_ double, bz double, gx double, gy double, gz double")
    pts = cloud(spark, tri.reshape(-1, 3))
    reach = pts.select("k", "i", F.lit(0.05).alias("reach"))
    assert sum(met(q, t)[0] or 0 for q, t in grid.triangle_searches(pts, mesh, reach)) < 600 * 1800 // 2
