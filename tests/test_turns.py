"""Searches over some clouds at a time: the same rows, and of a search's files only its result stays."""

import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF

from cloudloom.operators import neighbors
from cloudloom.operators.neighbors import in_turns, knn
from cloudloom.sources.views import LARGE_SQL, large_clouds
from cloudloom.staging import alone, shared_dir, staged


def kept(spark):
    """Labels of the tables in the shared folder, and the number of shuffle files."""
    folder = os.path.join(shared_dir(spark).removeprefix("file://"), spark.sparkContext.applicationId)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return {x for x in names if not x.startswith(".")}, sum("shuffle_" in blocks.apply(i).name() for i in range(blocks.size()))


def settled(spark, shuffled):
    """What is kept when so many shuffle files are left, or after ten seconds (they go a moment after their job)."""
    for _ in range(100):
        if kept(spark)[1] <= shuffled:
            break
        time.sleep(0.1)
    return kept(spark)


@pytest.mark.parametrize("turn", [700, 10_000])
def test_turns_find_the_same(spark, monkeypatch, turn):
    g = np.random.default_rng(5)
    sizes = [600, 130, 1, 90, 40, 700]
    rows = [(k, i, *map(float, p)) for k, n in enumerate(sizes) for i, p in enumerate(np.round(g.uniform(size=(n, 3)), 1 if k == 1 else 3))]
    c = staged(spark.createDataFrame(rows, "k int, i int, x double, y double, z double"), "given")
    want = sorted(map(tuple, knn(c, c, 3).select("k", "i", "j", "rank").collect()))
    monkeypatch.setattr(neighbors, "TURN", turn)
    assert sorted(map(tuple, in_turns(c, lambda c: knn(c, c, 3).select("k", "i", "j", "rank")).collect())) == want


def test_small_clouds_are_dealt_by_hash(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "TURN", 1000)
    c = staged(spark.range(6000).selectExpr("cast(if(id < 3000, id div 3, 5000 + id div 500) as int) as k", "id"), "given")
    most = []

    def find(own):
        most.append(own.count())
        return own.groupBy("k").count()

    got = {r.k: r["count"] for r in in_turns(c, find).collect()}
    assert got == {k: 3 for k in range(1000)} | {5000 + k: 500 for k in range(6, 12)}
    assert sum(most) == 6000 and len(most) == 6 and max(most) <= 1500


def test_no_clouds_at_all(spark):
    c = spark.createDataFrame([], "k int, id long")
    assert in_turns(c, lambda own: own.groupBy("k").count()).collect() == []


def test_only_results_stay(spark):
    tables, shuffled = kept(spark)

    def make():
        a = staged(spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").count(), "step")
        return alone(spark, lambda: staged(a.repartition(3), "inner"), "outer").groupBy("count").agg(F.sum("k"))

    out = alone(spark, make, "result")
    assert sum(r["sum(k)"] for r in out.collect()) == 21
    after, files = settled(spark, shuffled)
    assert {x.rsplit("-", 1)[0] for x in after - tables} == {"result"} and files <= shuffled


def test_a_search_of_large_clouds_leaves_its_result(spark):
    from __spark_entry__ import queries

    for name in ("knn_large_clouds", "chamfer_large_clouds"):
        tables, shuffled = kept(spark)
        df = queries()[name](spark, SF)
        after, files = settled(spark, shuffled)
        labels = {x.rsplit("-", 1)[0] for x in after - tables}
        assert labels <= {"ordered", "runs", "sizes", "turns", "found"} and files <= shuffled
        assert df.count() > 0


def test_large_clouds_are_numbered_as_in_sql(spark):
    c = large_clouds(spark, SF)
    cols = ["k", "i", "cx", "cy", "cz"]
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(f"with {LARGE_SQL} select {', '.join(cols)} from pts").fetchall()
    assert sorted(map(tuple, c.select(*cols).collect())) == sorted(want)


def test_large_clouds_with_nulls_are_numbered_as_in_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy (select * replace (if(l_orderkey % 5 = 0, null, l_orderkey) as l_orderkey, if(l_linenumber % 3 = 0, null, l_linenumber) as l_linenumber) from '{SF}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    con.sql(f"copy (select * from '{SF}/supplier.parquet') to '{tmp_path}/supplier.parquet'")
    for t in ("lineitem", "supplier"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = con.sql(f"with {LARGE_SQL} select k, i, cx, cy, cz from pts").fetchall()
    assert sorted(map(tuple, large_clouds(spark, str(tmp_path)).collect())) == sorted(want)
