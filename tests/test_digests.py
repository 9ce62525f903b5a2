"""Ordered digests against files and hashlib, whatever the partitions; packed fields and derived seeds."""

import hashlib
import io

import numpy as np
from pyspark.sql import functions as F

from cloudloom.operators.digests import cloud_digests, derived_u128, little_endian, of_text, ordered_digest, view_seed


def test_cloud_digest_is_that_of_the_npy_file(spark):
    g = np.random.default_rng(2)
    clouds, want = [], {}
    for k, n in enumerate((1, 7, 2500)):
        xyz = g.normal(size=(n, 3)).astype(np.float32)
        out = io.BytesIO()
        np.save(out, xyz, allow_pickle=False)
        want[k] = (n, hashlib.sha256(out.getvalue()).hexdigest())
        clouds += [(k, i, *map(float, p)) for i, p in enumerate(xyz)]
    df = spark.createDataFrame(clouds, "k int, i int, x double, y double, z double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert {r.k: (r.n, r.sha256) for r in cloud_digests(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_text_digests_with_null_groups_and_texts(spark):
    rows = [("a", 2, "x"), ("a", 1, None), ("a", 3, "é"), (None, 1, "n"), ("b", 1, "")]
    df = spark.createDataFrame(rows, "g string, o int, t string")
    got = {r.g: (r.n, r.sha256) for r in ordered_digest(df, "g", ["o"], of_text("t")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {"a": (3, sha("xé")), None: (1, sha("n")), "b": (1, sha(""))}
    assert ordered_digest(df.limit(0), "g", ["o"], of_text("t")).count() == 0


def test_seeds(spark):
    df = spark.createDataFrame([(5, "ab", 0), (1 << 62, "c", 3)], "seed long, shape string, view long")
    got = df.select(view_seed(F.col("seed"), F.col("shape"), F.col("view")).alias("s"), derived_u128(little_endian("seed", 8), F.col("shape").cast("binary")).alias("w"), little_endian("seed", 3).alias("b")).collect()
    for r, (seed, shape, view) in zip(got, ((5, b"ab", 0), (1 << 62, b"c", 3))):
        domain = b"\0surface-cache-sampling-v1\0" + shape if view == 0 else b"\0surface-cache-view-v2\0" + shape + b"\0" + view.to_bytes(8, "little")
        assert int(r.s) == int.from_bytes(hashlib.sha256(seed.to_bytes(8, "little") + domain).digest()[:8], "little")
        assert int(r.w, 16) == int.from_bytes(hashlib.sha256(seed.to_bytes(8, "little") + shape).digest()[:16], "little")
        assert bytes(r.b) == seed.to_bytes(8, "little")[:3]
