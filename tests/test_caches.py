"""Caches that are taken up after an end half-way; what was committed and changed; archives; streams of draws against numpy."""

import io
import os
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions.streams import epoch_permutations, laplace_noise, permutation_seed
from cloudloom.operators.caches import build, clouds_of, committed, manifest_of, view_seeds_of
from cloudloom.sources.archives import ranges, read_archives, write_tars


@pytest.fixture
def ids(spark):
    return spark.range(8).select(F.col("id").alias("k"))


def made(own, fail=None):
    rows = own.select("k", F.lit(0).alias("view"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    x = F.col("k") * 10 + F.col("i")
    if fail is not None:
        x = F.when(F.col("k") == fail, F.raise_error("the run was ended").cast("double")).otherwise(x)
    return rows.select("k", "view", "i", x.alias("x"), (x * 0.5).alias("y"), F.lit(1.0).alias("z"))


def run(ids, folder, fail=None, **terms):
    return build(ids, folder, {"seed": 1} | terms, lambda own: made(own, fail), lambda own: view_seeds_of(own, 1, 1), 3)


def table(df):
    return sorted(map(tuple, df.collect()))


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}


def test_a_run_that_was_ended_is_taken_up(spark, ids, tmp_path):
    whole = table(run(ids, str(tmp_path / "whole")))
    assert len(whole) == 8
    folder = str(tmp_path / "cut")
    with pytest.raises(Exception, match="the run was ended"):
        run(ids, folder, fail=7)  # in the last of three batches
    assert committed(spark, folder) == [0, 1]
    before = files(f"{folder}/data/batch=0") | files(f"{folder}/ledger/batch=1")
    again = table(run(ids, folder))
    assert again == whole and table(manifest_of(spark, folder)) == whole
    assert table(clouds_of(spark, folder)) == table(clouds_of(spark, str(tmp_path / "whole")))
    assert {p: t for p, t in files(folder).items() if p in before} == before
    assert table(run(ids, folder)) == whole  # nothing is left to make


def test_what_was_committed_is_verified(spark, ids, tmp_path):
    folder = str(tmp_path / "cache")
    run(ids, folder)
    with pytest.raises(ValueError, match="another contract"):
        run(ids, folder, seed=2)
    with pytest.raises(ValueError, match="another contract"):
        run(ids.filter("k < 7"), folder)
    own = clouds_of(spark, folder).filter("batch = 1").drop("batch").withColumn("x", F.when(F.col("i") == 2, F.col("x") + 1).otherwise(F.col("x")).cast("float"))
    own.write.parquet(str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "other")).write.mode("overwrite").parquet(f"{folder}/data/batch=1")
    with pytest.raises(ValueError, match="has changed"):
        run(ids, folder)


def test_archives_of_each_kind(spark, tmp_path):
    g = np.random.default_rng(1)
    data = [(f"d{i // 10}/f{i}.txt", g.bytes(int(g.integers(0, 4000)))) for i in range(60)]
    with tarfile.open(tmp_path / "a.tar", "w") as t, tarfile.open(tmp_path / "b.tar.gz", "w:gz") as tz, zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for tar in (t, tz):
            folder = tarfile.TarInfo("d0")
            folder.type = tarfile.DIRTYPE
            tar.addfile(folder)
        for name, content in [*data, ("x" * 150 + "/long.txt", b"long"), ("../out.txt", b"out"), data[3]]:
            for tar in (t, tz):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
            z.writestr(name, content)
        for tar in (t, tz):
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.SYMTYPE, "a"
            tar.addfile(link)
    (tmp_path / "d.bin").write_bytes(b"neither" * 100)
    (tmp_path / "cut.tar").write_bytes((tmp_path / "a.tar").read_bytes()[:40_100])
    whole = (tmp_path / "c.zip").read_bytes()
    at = whole.index(b"f17.txt") + 10
    (tmp_path / "e.zip").write_bytes(whole[:at] + bytes(200) + whole[at + 200 :])
    names = ("a.tar", "b.tar.gz", "c.zip", "d.bin", "cut.tar", "e.zip")
    df = read_archives(spark, [str(tmp_path / n) for n in names], range_bytes=10_000)
    assert sum(len(list(ranges(str(tmp_path / n), 10_000))) for n in names) > 30
    rows = {n: df.filter(F.col("path") == str(tmp_path / n)).orderBy("ordinal").collect() for n in names}
    for n in ("a.tar", "b.tar.gz", "c.zip"):
        good = [(r.member, bytes(r.content)) for r in rows[n] if r.problem == ""]
        assert good == [*data, ("x" * 150 + "/long.txt", b"long")]
        bad = [(r.member, r.problem) for r in rows[n] if r.problem]
        assert bad == [("../out.txt", "unsafe path"), (data[3][0], "duplicate"), *([("link", "not a file")] if n != "c.zip" else [])]
    assert [r.problem.split(":")[0] for r in rows["d.bin"]] == ["not an archive"]
    good = [(r.member, bytes(r.content)) for r in rows["cut.tar"] if r.problem == ""]
    bad = [r.problem.split(":")[0] for r in rows["cut.tar"][len(good) :]]
    assert 10 < len(good) < 40 and good == data[: len(good)] and bad and set(bad) <= {"truncated", "broken archive"}
    assert any(r.problem.startswith("broken member") for r in rows["e.zip"]) and sum(r.problem == "" for r in rows["e.zip"]) > 50
    assert all(r.content is None for r in read_archives(spark, [str(tmp_path / "a.tar")], content=False).collect())


def test_archives_are_written_as_a_stream(spark, tmp_path):
    rows = [(str(i % 3), f"m{i:03d}", bytes([i]) * i, None) for i in range(90)] + [("1", "to", None, "m001")]
    df = spark.createDataFrame(rows, "path string, member string, content binary, link string").repartition(5)
    got = {r.path: (r.file, r.members) for r in write_tars(df, str(tmp_path)).collect()}
    assert {k: n for k, (_, n) in got.items()} == {"0": 30, "1": 31, "2": 30} and not [f for f in os.listdir(tmp_path) if f.endswith(".tmp")]
    with tarfile.open(got["1"][0]) as t:
        assert [m.name for m in t] == [f"m{i:03d}" for i in range(1, 90, 3)] + ["to"]
        assert t.extractfile("m004").read() == bytes([4]) * 4


@pytest.mark.parametrize("parts", [1, 7])
def test_noise_is_that_of_one_generator(spark, parts):
    g = np.random.default_rng(5)
    seed = (123 << 90) + 77
    clean = g.normal(size=(35_000, 3)).astype(np.float32)
    df = spark.createDataFrame([(9, i, *map(float, p)) for i, p in enumerate(clean)], "k long, i int, x double, y double, z double").repartition(parts)
    seeds = spark.createDataFrame([(9, f"{seed:032x}")], "k long, seed string")
    got = laplace_noise(df, seeds, 0.005, 0.02).orderBy("i").toPandas()
    r = np.random.default_rng(seed)
    scale = r.uniform(0.005, 0.02)
    want = (clean.astype(np.float64) + r.laplace(0.0, scale, clean.shape)).astype(np.float32)
    assert np.array_equal(got[["x", "y", "z"]].to_numpy(np.float32), want) and set(got["scale"]) == {scale}


def test_permutations_are_those_of_numpy(spark):
    epochs = spark.createDataFrame([(0,), (3,), (3,)], "epoch int")
    got = epoch_permutations(epochs, 1000, 42, b"d\0").orderBy("epoch", "position").collect()
    for n, e in enumerate((0, 3)):
        want = np.random.default_rng(permutation_seed(b"d\0", 42, e)).permutation(1000)
        assert [r.item for r in got[1000 * n : 1000 * n + 1000]] == want.tolist()
