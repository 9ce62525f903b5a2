"""Operators 11 to 13 against plain versions; hot anchors, long texts in pieces, spoilt hashes; null spaces and odd vectors."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import resampling, suffixes, whitening
from cloudloom.llm.suffixes import Sizes, Suffixes, without_repeats

SF = "/root/testdata/sf0.001"


def cut(rows):
    """doc_id, n_bytes, n_removed, removed ranges, kept bytes of each row, window by window."""
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 49 if i is not None else 0):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    for i, b in data:
        gone = np.zeros(len(b) + 2, np.int8)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p + 1 : p + 51] = 1
        edge = np.flatnonzero(np.diff(gone)).reshape(-1, 2)
        out.append((i, len(b), int(gone.sum()), [tuple(e) for e in edge.tolist()], bytes(x for x, g in zip(b, gone[1:]) if not g)))
    return sorted(out, key=str)


def got_cut(docs, sizes=None):
    rows = without_repeats(docs, sizes=sizes).collect()
    for r in rows:
        assert r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, [tuple(x) for x in r.removed], bytes(r.kept)) for r in rows], key=str)


@pytest.fixture(scope="module")
def odd_texts():
    g = np.random.default_rng(11)
    letters = lambda n, of="ab": "".join(g.choice(list(of), n))
    a, b, c = letters(70, "abcdefgh"), letters(400, "abcdefghéß中"), letters(120)
    rows = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 2000, a, a[1:], a[:-1], "q" + a, a + a, letters(200) + a + letters(200), b, b[30:300], b[:200] + "!" + b[200:], c, c[:60] + "z" + c[60:], c[59:] + c[:61], " " * 500, letters(3000), "é" * 40, "aé" * 40]
    rows = list(enumerate(rows)) + [(6, b), (6, b), (6, a), (None, a), (None, b), (40, b), (41, b), (41, b + a)]
    return [rows[i] for i in g.permutation(len(rows))]


@pytest.mark.parametrize("sizes", [None, Sizes(300, 3, 5, 2), Sizes(1000, 7, 2, 1), Sizes(64, 2, 2)])
def test_suffix_dedup_of_odd_texts(spark, odd_texts, sizes):
    docs = spark.createDataFrame(odd_texts, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "pack", "bucket", "told", "found", "removed")})
    assert got_cut(docs.repartition(3), sizes) == cut(odd_texts)


def test_suffix_dedup_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got_cut(docs, Sizes(20_000, 5, 4, 3)) == cut([(r.doc_id, r.text) for r in docs.collect()])


def test_suffix_order_and_extensions():
    g = np.random.default_rng(4)
    data = g.integers(0, 3, 4000).astype(np.uint8)
    start = g.integers(0, 3900, 900)
    stop = start + g.integers(0, 84, 900)
    group = g.integers(0, 5, 900)
    s = Suffixes(data, start, stop, group)
    texts = [data[a:b].tobytes() for a, b in zip(start, stop)]
    order = [(group[i], texts[i]) for i in s.order]
    assert order == sorted(order)
    for k, (i, n) in enumerate(zip(s.order, s.extension)):
        j = s.order[k - 1]
        if k and group[i] == group[j]:
            same = next((p for p, (x, y) in enumerate(zip(texts[i], texts[j])) if x != y), min(len(texts[i]), len(texts[j])))
            assert n == same
        else:
            assert n == -1


def test_a_collision_of_hashes_is_seen(monkeypatch):
    """With a first hash that can't tell two letters apart the order is made anew with the second."""
    values = suffixes._BYTE_VALUES.copy()
    values[0][1] = values[0][2]
    monkeypatch.setattr(suffixes, "_BYTE_VALUES", values)
    data = np.array([1, 1, 2, 2, 1, 2, 1, 1], np.uint8)
    start = np.arange(8)
    s = Suffixes(data, start, np.full(8, 8), np.zeros(8, np.int64))
    assert [data[i:].tolist() for i in s.order] == sorted(data[i:].tolist() for i in range(8))
    assert suffixes.equal_stretches(data, np.array([0, 2, 4]), np.array([2, 4, 6]))[1].tolist() != [0, 0, 0]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(w.encode()) % 10000 for w in words] + [zlib.crc32(f"{a} {b}".encode()) % 10000 for a, b in zip(words, words[1:])]


def drawn(docs, target):
    every = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in every for b in f), Counter(b for x in target for b in grams(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    gains = {b: gain(b) for b in s}
    out, able = [], []
    for i, words, f in every:
        weight = sum(gains[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            able.append((-out[-1][3], i is None, i or 0, len(out) - 1))
    for rank, (*_, k) in enumerate(sorted(able)[: 25 * len(able) // 100]):
        out[k][4] = rank + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_of_odd_texts(spark):
    g = np.random.default_rng(9)
    word = lambda: "".join(g.choice(list("abXé中7ß"), g.integers(1, 9)))
    texts = [None, "", " .,;", "One", "A-b C", "İ ſ ß", "z" * 100_000, "\x00a\x7fb", *(" ".join(word() for _ in range(n)) for n in (19, 20, 21, 300, 40_000, 25, 30))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(11, texts[11]), (None, texts[12]), (12, texts[9])] + [(100 + i, " ".join(word() for _ in range(25))) for i in range(30)]
    target = [None, "", "One a-b c", texts[11]]
    clash = {c: F.lit("clash") for c in ("weight", "score", "rank", "n_words", "at", "part", "stream")}
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash).repartition(4)
    b = spark.createDataFrame(list(enumerate(target)), "item_id long, text string").withColumns(clash)
    got = resampling.resampled(a, b).drop("n_words").collect()
    assert sorted(map(tuple, got), key=str) == drawn(docs, target)


def test_resampling_of_given_documents(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = resampling.op12_importance_resampling(spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == drawn([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_crc_of_runs_of_any_length():
    g = np.random.default_rng(2)
    data = g.integers(0, 256, 5000).astype(np.uint8)
    start = g.integers(0, 4000, 200)
    stop = start + np.minimum(g.geometric(0.05, 200), 1000)
    got = ~resampling.crc_on(np.full(200, 0xFFFFFFFF, np.uint32), data, start, stop)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, stop)]


def test_target_is_preferred(spark):
    """Documents with the target's words are drawn before others of the same kind."""
    g = np.random.default_rng(1)
    own, other = [f"w{i}" for i in range(50)], [f"v{i}" for i in range(50)]
    text = lambda words: " ".join(g.choice(words, 60))
    docs = spark.createDataFrame([(i, text(own if i % 4 == 0 else other)) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(i, text(own)) for i in range(20)], "item_id long, text string")
    taken = [r.doc_id for r in resampling.resampled(docs, target).filter("rank is not null").collect()]
    assert len(taken) == 100 and sum(i % 4 == 0 for i in taken) > 50  # 25 by chance


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("v", "n", "component", "task", "some")})


def test_whitening_of_odd_vectors(spark):
    g = np.random.default_rng(3)
    mix = g.normal(size=(5, 5))
    good = (g.normal(size=(400, 5)) @ mix).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(0, good[0].tolist()), (None, good[1].tolist())]
    good = np.concatenate([good, good[:2]])
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [math.nan] * 5), (903, [math.inf, 0.0, 0.0, 0.0, 0.0]), (904, [1.0, 2.0]), (905, [])]
    got = whitening.whitened(vectors(spark, rows + bad).repartition(3)).collect()
    n = len(rows)
    assert len(got) == 5 * n and {r.n for r in got} == {n}
    x = [[math.floor(64 * Fraction(float(c))) + 1_000_000 for c in v] for v in good]
    sums = [sum(c) for c in zip(*x)]
    want = Counter((i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for (i, _), v in zip(rows, x))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == want
    d = np.array([[n * a - s for a, s in zip(v, sums)] for v in x], float) / n
    e, q = np.linalg.eigh(d.T @ d / n)
    e, q = e[::-1], q[:, ::-1]
    w = {(i, j): d[k] @ q[:, j] / np.sqrt(e[j]) for k, (i, _) in enumerate(rows) for j in range(5) if i not in (0, None)}
    for j in range(5):
        own = {r.vec_id: r.whitened for r in got if r.component == j + 1}
        sign = np.sign(own[5] * w[5, j])
        assert max(abs(sign * own[i] - w[i, j]) for i in own if i not in (0, None)) < 1e-9
    for r in got:
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_whitening_without_variance(spark):
    same = whitening.whitened(vectors(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert len(same) == 8 and all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None) for r in same)
    line = whitening.whitened(vectors(spark, [(i, [float(i), 0.0, float(-i)]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and max(r.identity_error for r in line) < 1e-12
    one = whitening.whitened(vectors(spark, [(7, [3.5])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened) for r in one] == [(7, 1, 1, 0, None)]
    assert whitening.whitened(vectors(spark, [(1, None)])).count() == 0


def test_deviations_beyond_a_long():
    x = np.array([[1 << 52, 0], [0, 0]])
    assert whitening._deviations(x, 2, [1 << 52, 0]) == [None, None]
    x = np.array([[1_000_000, 5], [1_000_003, 7]])
    assert whitening._deviations(x, 2, [2_000_003, 12]) == [9 + 4, 9 + 4]


def test_outer_products_keep_both_parts():
    """Sums whose parts cancel: what doubles lose is in the low part."""
    rows = np.array([[1e8 + 1, 3.0], [1.0, 1e-8]] * 500 + [[1e8, -3e8]] * 3)
    low = np.full_like(rows, 1e-12)
    got = whitening.outer_products((rows, low))
    for i in range(2):
        for j in range(2):
            exact = sum((Fraction(float(r[i])) + Fraction(1e-12)) * (Fraction(float(r[j])) + Fraction(1e-12)) for r in rows)
            assert abs(Fraction(float(got[0][i, j])) + Fraction(float(got[1][i, j])) - exact) <= abs(exact) * Fraction(1, 10**25) + Fraction(1, 10**17)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 130])
@pytest.mark.parametrize("kind", ["full", "near multiple of one", "null space", "ones", "repeated", "graded"])
def test_eigen(n, kind):
    g = np.random.default_rng(n)
    a = g.normal(size=(n, n))
    a = {
        "full": lambda: a + a.T,
        "near multiple of one": lambda: 3 * np.eye(n) + 1e-9 * (a + a.T),
        "null space": lambda: a[:, : max(1, n // 3)] @ a[:, : max(1, n // 3)].T,
        "ones": lambda: np.ones((n, n)),
        "repeated": lambda: np.diag(np.repeat(np.arange(n // 4 + 1), 4)[:n].astype(float)),
        "graded": lambda: (a * 10.0 ** -np.arange(n)) @ (a * 10.0 ** -np.arange(n)).T,
    }[kind]()
    w, v = whitening.eigen(a)
    size = max(np.abs(a).max(), 1e-300) * n
    assert np.abs(w - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
    assert np.abs(v.T @ v - np.eye(n)).max() <= 1e-12 and np.abs(a @ v - v * w).max() <= 1e-13 * size


def test_features_of_an_empty_column():
    assert [len(x) for x in resampling.features(pa.array([], pa.string()))] == [0, 0]
    words, stream = resampling.features(pa.array([None, "", "a B"]))
    assert words.tolist() == [0, 0, 2] and stream.tolist() == grams("a b")[1]
