"""Vector attention against numpy, with large scores and points without neighbours of their own."""

import numpy as np

from cloudloom.operators.attention import regrouped, vector_attention


def vectors(spark, a):
    return spark.createDataFrame([(0, i, [float(x) for x in row]) for i, row in enumerate(a)], "k int, i int, f array<double>")


def test_against_numpy(spark):
    g = np.random.default_rng(4)
    d, q, key, value = (g.normal(size=(6, 3)) * s for s in (1, 1, 30, 1))
    first, second = g.normal(size=(5, 3)), g.normal(size=(3, 5)) * 40  # scores of thousands: exp overflows without a shift
    near = [(0, i, j) for i in range(5) for j in g.permutation(6)[:4].tolist()]
    got = vector_attention(spark.createDataFrame(near, "k int, i int, j int"), *(vectors(spark, a) for a in (d, q, key, value)), first.tolist(), second.tolist())
    got = {r.i: r.f for r in got.collect()}
    assert sorted(got) == list(range(5))
    for i in got:
        js = [j for _, a, j in near if a == i]
        s = np.maximum((q[i] - key[js] + d[js]) @ first.T, 0) @ second.T
        e = np.exp(s - s.max(0))
        assert np.allclose(got[i], (e / e.sum(0) * (value + d)[js]).sum(0))


def test_regrouping_keeps_the_order(spark):
    a = np.arange(24).reshape(4, 6)
    assert [r.f for r in regrouped(vectors(spark, a), 4).orderBy("i").collect()] == a.reshape(6, 4).tolist()
