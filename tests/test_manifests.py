"""Edge rows of archives, score files, colours, caches and runs."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from cloudloom.operators.manifests import cache_views, coloured, extracted, in_volumes, packed, route_file_problems, run_problems, run_states, shortest_17, view_problems, write_route_scores


def test_packed_bytes_are_always_the_same(spark):
    rows = [("a", "y.txt", bytearray(b"1")), ("a", "x.txt", bytearray(b"")), ("b", "x.txt", bytearray(b"2" * 9999))]
    one, two = ({r.path: bytes(r.content) for r in packed(spark.createDataFrame(x, "path string, member string, content binary")).collect()} for x in (rows, rows[::-1]))
    assert one == two and zipfile.ZipFile(io.BytesIO(one["a"])).namelist() == ["x.txt", "y.txt"]
    back = extracted(spark.createDataFrame([(k, bytearray(v)) for k, v in one.items()], "path string, content binary"))
    assert {(r.path, r.member, bytes(r.content)) for r in back.collect()} == {(p, m, bytes(c)) for p, m, c in rows}


def test_extraction_stays_in_its_folder(spark):
    def archive(*members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, kind in members:
                info = tarfile.TarInfo(name)
                info.type = kind
                t.addfile(info)
        return spark.createDataFrame([("t", bytearray(out.getvalue()))], "path string, content binary")

    good = archive(("d", tarfile.DIRTYPE), ("d/f", tarfile.REGTYPE))
    assert [(r.member, r.bytes) for r in extracted(good).collect()] == [("d/f", 0)]
    for bad in ([("../f", tarfile.REGTYPE)], [("/f", tarfile.REGTYPE)], [("l", tarfile.SYMTYPE)], [("f", tarfile.REGTYPE)] * 2):
        with pytest.raises(Exception, match="can't extract"):
            extracted(archive(*bad)).collect()


def test_scores_come_back_exactly(spark, tmp_path):
    values = [0.1, 1e300, 5e-324, -0.0, 1 / 3, 2.0, 123456789.123456789, None]
    scores = spark.createDataFrame(list(enumerate(values)), "sample_id long, route_score double")
    assert [r[0] for r in scores.orderBy("sample_id").select(shortest_17("route_score")).collect()] == [None if v is None else "%.17g" % v for v in values]
    write_route_scores(scores, str(tmp_path / "s"))
    assert route_file_problems(scores, str(tmp_path / "s")).isEmpty()
    off = scores.withColumn("route_score", F.when(F.col("sample_id") == 4, 0.33333333333333337).otherwise(F.col("route_score")))
    assert [tuple(r) for r in route_file_problems(off, str(tmp_path / "s")).collect()] == [("differs", 4)]


def test_colours(spark):
    inf = float("inf")
    rows = [(0, 0, 1e39, 0.0, 0.0, 1.0, 1.0, 1.0), (0, 1, 0.0, inf, 0.0, None, None, None), (0, 2, 0.0, 0.0, 0.0, None, 1.0, 1.0), (0, 3, 0.0, 0.0, 0.0, -1.0, 1.0, 1.0), (0, 4, 0.0, 0.0, 0.0, None, None, None), (0, 5, 0.0, 0.0, 0.0, 255.0, 0.0, 7.0), (0, 6, 0.0, 0.0, None, 1.0, 1.0, 1.0)]
    got = coloured(spark.createDataFrame(rows, "k int, i int, x double, y double, z double, r double, g double, b double")).collect()
    assert {(r.i, r.r, r.g, r.b) for r in got} == {(4, 64, 160, 255), (5, 255, 0, 7)}


def test_caches_without_views(spark):
    files = spark.createDataFrame([("s", "clean.npy", "p"), ("s", "other.npy", "q")], "sample_id string, filename string, path string")
    assert [tuple(r) for r in cache_views(files).collect()] == [("s", 0, "p")]
    manifest = spark.createDataFrame([("s", [])], "sample_id string, views array<struct<view_id: int, filename: string>>")
    assert [tuple(r) for r in view_problems(files, manifest, 1).collect()] == [("views", "s")]
    assert cache_views(files, manifest).isEmpty()


def test_runs(spark):
    log = spark.createDataFrame([(1, 1, "running"), (2, 1, "running"), (2, 5, "failed"), (2, 6, "completed"), (3, 1, "note")], "run int, at int, status string")
    assert {tuple(r) for r in run_states(log).collect()} == {(1, 1, None, "running"), (2, 1, 5, "failed"), (3, None, None, "running")}
    assert {tuple(r) for r in run_problems(log).collect()} == {("ended again", 2), ("no start", 3)}
    assert run_states(log.limit(0)).isEmpty()


def test_volumes_of_an_archive_are_small(spark):
    """A path of 3,000 members in volumes of some 100, which come back whole; equal names are still an error."""
    rows = spark.range(3000).select(F.lit("a").alias("path"), F.format_string("%05d.txt", "id").alias("member"), F.col("id").cast("string").cast("binary").alias("content"))
    files = packed(in_volumes(rows, 100 << 10)).localCheckpoint()
    sizes = [len(zipfile.ZipFile(io.BytesIO(bytes(r.content))).namelist()) for r in files.collect()]
    assert sum(sizes) == 3000 and max(sizes) < 200
    back = extracted(files).select(F.get_json_object("path", "$.path").alias("path"), "member", "content")
    assert back.exceptAll(rows).isEmpty() and back.count() == 3000
    with pytest.raises(Exception, match="can't extract"):
        extracted(packed(in_volumes(rows.union(rows.limit(1)), 100 << 10))).collect()
