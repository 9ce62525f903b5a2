"""Tasks of farthest-point sampling and of the passes that use it."""

import numpy as np
from pyspark.sql import functions as F

from cloudloom.operators import farthest
from cloudloom.operators.farthest import farthest_points
from cloudloom.operators.patches import plan, starts


def clouds(spark, n, points):
    rng = np.random.default_rng(7)
    return spark.createDataFrame([(k, i, *map(float, p)) for k in range(n) for i, p in enumerate(rng.normal(size=(points, 3)))], "k int, i int, x double, y double, z double")


def test_sampling_is_dealt_by_points(spark):
    """A task gets about as many points as a block has, and not all clouds because these are small."""
    c = clouds(spark, 48, 100)
    out = farthest_points(starts(c, ("index0", "x_max")), c, 3, block=400)
    tasks = out.select("plan", "k", F.spark_partition_id().alias("task")).distinct().groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 96
    assert len(tasks) > 8 and max(r["count"] for r in tasks) <= 16  # of 100 points each, in 96 tasks


def test_a_cloud_of_some_size_needs_no_rounds(spark, monkeypatch):
    """A cloud as large as those of six times the largest tables is sampled by a task, not in hundreds of rounds of jobs."""
    monkeypatch.setattr(farthest, "_in_rounds", None)
    c = spark.range(70_000).selectExpr("0 as k", "cast(id as int) as i", "double(id) as x", "0D as y", "0D as z")
    assert [r.i for r in farthest_points(starts(c, ("index0",)), c, 3).orderBy("rank").collect()] == [0, 69_999, 34_999]


def test_plan_samples_once(spark, monkeypatch):
    """The seeds are read by each step of the search, so they are not drawn anew in each."""
    c = clouds(spark, 2, 600)
    p = plan(c, ("index0", "x_max"))
    assert p.count() == 2 * 2 * 16 * (3 * 600 // 16)
    drawn = []
    from cloudloom.operators import patches

    near = patches.knn
    monkeypatch.setattr(patches, "knn", lambda q, r, k: (drawn.append(q), near(q, r, k))[1])
    plan(c)
    assert "FlatMapGroupsInArrow" not in drawn[0]._jdf.queryExecution().optimizedPlan().toString()


def test_sampling_in_place_takes_the_same_points(spark):
    """Coincident points and ties: as the step-by-step method takes them."""
    rng = np.random.default_rng(3)
    xyz = rng.integers(0, 4, size=(90, 3)).astype(float)
    c = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(xyz)], "k int, i int, x double, y double, z double")
    least, want, at = np.full(90, np.inf), [], 0
    for _ in range(90):
        want.append(at)
        least = np.minimum(least, ((xyz - xyz[at]) ** 2).sum(axis=1))
        least[want] = -1.0
        at = int(least.argmax())
    assert [r.i for r in farthest_points(starts(c, ("index0",)), c, 90).orderBy("rank").collect()] == want
