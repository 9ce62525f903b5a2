"""Canonical JSON against the json module; modes, gathering and ids at their edges."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cloudloom.operators.canonical import canonical_json, content_digests, training_ids
from cloudloom.operators.normalize import displacement_statistics_of, gathered, index_problems, normalised_pass, transforms


def test_canonical_json_as_python_writes_it(spark):
    texts = ["", None, "plain", 'q"b\\s/', "a\nb\tc\r\b\f\x00\x1f\x7f", "äß漢字", "pair \U0001f600 x\U00010000", " ~"]
    rows = [(i, t, [t, "z"], {"b": i, "a": None, "é": 3}, (i % 2 == 0, [(t,)])) for i, t in enumerate(texts)]
    rows.append((99, None, None, None, None))
    df = spark.createDataFrame(rows, "id long, `z a` string, list array<string>, m map<string,int>, s struct<flag: boolean, inner: array<struct<t: string>>>")
    want = {}
    for i, t, items, m, s in rows:
        value = {"z a": t, "list": items, "m": m, "s": s and {"flag": s[0], "inner": [{"t": x[0]} for x in s[1]]}}
        want[i] = hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()
    assert {r.id: r.digest for r in content_digests(df, "id").collect()} == want
    with pytest.raises(TypeError):
        canonical_json(F.lit(0.5), spark.createDataFrame([(0.5,)], "x double").schema["x"].dataType)


def test_long_text_is_written_whole(spark):
    text = "ä\n" * 200_000
    got = content_digests(spark.createDataFrame([(1, text)], "id long, t string"), "id").first().digest
    assert got == hashlib.sha256(json.dumps({"t": text}, separators=(",", ":")).encode()).hexdigest()


def test_training_ids(spark):
    a, b = "shapenet/00000000/btrain_" + "0a" * 12, "shapenet/00000000/btrain_" + "1b" * 12
    lines = [a, f" {b} ", b, "", "  ", "shapenet/00000000/btrain_XYZ"]
    got = {tuple(r) for r in training_ids(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert got == {(a, "00000000/b0000000" + "0a" * 12, None), (b, "00000000/b0000000" + "1b" * 12, "repeated"), (lines[-1], None, "format")}


CLOUD = "k int, i int, x double, y double, z double"


def test_modes(spark):
    clouds = spark.createDataFrame([(1, i, float(i), 2.0 * i, -1.0) for i in range(5)] + [(2, 0, 1e6, 0.0, 0.0), (2, 1, 1e6 + 2, 0.0, 0.0)], CLOUD)
    same = sorted(tuple(r) for r in clouds.collect())
    for mode, q in (("noisy_max", None), ("identity", None), ("robust_quantile", 0.5)):
        assert sorted(tuple(r) for r in normalised_pass(clouds, lambda df: df, mode, q).collect()) == [pytest.approx(r) for r in same]
    assert {r.k: r.scale for r in transforms(clouds, "robust_quantile", 0.5).collect()} == {1: pytest.approx(5**0.5), 2: 1.0}
    for mode, q in (("median", None), ("robust_quantile", None), ("identity", 0.5), ("robust_quantile", 0.0)):
        with pytest.raises(ValueError):
            transforms(clouds, mode, q)
    with pytest.raises(Exception, match="without extent"):
        transforms(spark.createDataFrame([(3, 0, 1.0, 1.0, 1.0)], CLOUD), "robust_quantile", 0.5).collect()
    assert transforms(clouds.limit(0)).count() == 0


def test_displacements_and_gathering(spark):
    moved = spark.createDataFrame([(1, float(i), 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(20)], "k int, px double, py double, pz double, cx double, cy double, cz double")
    assert displacement_statistics_of(moved).first()[1:] == (pytest.approx(9.5), 18.0, 19.0)
    values = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "k int, i int, v string")
    index = lambda rows: spark.createDataFrame(rows, "k int, slot int, j int")
    assert sorted(tuple(r) for r in gathered(values, index([(1, 0, 1), (1, 1, 1), (1, 2, 0)])).collect()) == [(1, 0, "b"), (1, 1, "b"), (1, 2, "a")]
    bad = [(1, 0, -1), (1, 1, 2), (2, 0, 0), (1, 2, None)]
    assert {tuple(r) for r in index_problems(values, index([*bad, (1, 3, 0)])).collect()} == set(bad)
    with pytest.raises(Exception, match="outside its cloud"):
        gathered(values, index([(1, 0, 2)])).collect()
