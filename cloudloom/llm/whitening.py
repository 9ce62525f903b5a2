"""Operator 13, whitening of embeddings by their principal components.

Entries become whole numbers x = floor(SCALE * c) + SHIFT. Sums by dimension are exact whole numbers. The covariance is
of centred vectors: each is taken from the mean (kept as a high and a low part), outer products are formed and added in
double-double by error-free transformations (two-sum, two-product), first within a task, then the high and low parts
of the tasks, in two rounds, so that no task holds those of more than FAN others. The eigenvectors of the covariance,
a matrix of the vectors' length that doesn't grow with the rows, come from Householder tridiagonalisation and divide
and conquer on the driver.

Vectors that are null, hold null, nan or infinite entries are dropped, and so are those of another length than most
vectors have (ties: the longer one). Entries are held to +-LARGEST before they are scaled. Repeated rows count as often
as they occur and have rows of their own; null vec_ids are kept. A component without variance (eigenvalue under RANK of
the greatest) has whitened null and is left out of identity_error; without any variance explained and identity_error
are null. A deviation that no long can hold is null. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, mapped, staged, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries are held to so much, so that every x is exact as a double.
LARGEST = float(1 << 46)
#: Tasks whose parts are merged by one task.
FAN = 512
#: Numbers that one step of outer products holds.
STEP = 1 << 18
RANK = 1e-13

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b rounded, and the error: exact."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> Pair:
    """a as the sum of two numbers of 26 bits each."""
    t = 134217729.0 * a  # 2^27 + 1
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray, split_a: Pair, split_b: Pair) -> Pair:
    """a * b rounded, and the error: exact. split_a, split_b: their halves."""
    p, (ah, al), (bh, bl) = a * b, split_a, split_b
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x: Pair, y: Pair) -> Pair:
    """The sum of two double-double numbers."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(x: Pair) -> Pair:
    """The sum over the first axis, by halves."""
    high, low = x
    while len(high) > 1:
        n = len(high) // 2
        h, l = add((high[:n], low[:n]), (high[n : 2 * n], low[n : 2 * n]))
        high, low = np.concatenate([h, high[2 * n :]]), np.concatenate([l, low[2 * n :]])
    return high[0], low[0]


def quotient(a: int, b: int) -> tuple[float, float]:
    """a / b as a high and a low part."""
    high = a / b
    p, q = high.as_integer_ratio()
    return high, (a * q - p * b) / (b * q)


def outer_products(rows: Pair) -> Pair:
    """The sum of the rows' outer products with themselves, added in as many lanes as a step has rows."""
    d = rows[0].shape[1]
    i, j = np.triu_indices(d)
    step = min(max(STEP // len(i), 1), len(rows[0]))
    high, low = np.zeros((step, len(i))), np.zeros((step, len(i)))
    for a in range(0, len(rows[0]), step):
        h, l = (x[a : a + step] for x in rows)
        upper, lower = halves(h)
        x, y = h[:, i], h[:, j]
        p, e = two_product(x, y, (upper[:, i], lower[:, i]), (upper[:, j], lower[:, j]))
        e += x * l[:, j] + l[:, i] * y
        s, t = two_sum(high[: len(h)], p)
        high[: len(h)] = s
        low[: len(h)] += e + t
    out = np.zeros((d, d)), np.zeros((d, d))
    for m, v in zip(out, total(two_sum(high, low))):
        m[i, j] = m[j, i] = v
    return out


_PARTS_SQL = "dim int, task long, high array<double>, low array<double>"
_PARTS = pa.schema([("dim", pa.int32()), ("task", pa.int64()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))])


def _parts(matrix: Pair, task: int) -> pa.RecordBatch:
    n = len(matrix[0])
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int64()), *(pa.array(list(m), pa.list_(pa.float64())) for m in matrix)], schema=_PARTS)


def _merge(part: pa.Table) -> pa.Table:
    part = part.sort_by("task")  # in order, so that results don't depend on the shuffle
    high, low = total(tuple(np.array(part.column(c).to_pylist()) for c in ("high", "low")))
    return pa.Table.from_arrays([pa.array([part.column("dim")[0].as_py()], pa.int32()), pa.array([part.column("task")[0].as_py()], pa.int64()), pa.array([high], pa.list_(pa.float64())), pa.array([low], pa.list_(pa.float64()))], schema=_PARTS)


def covariance(rows: DataFrame, centred: Callable[[pa.RecordBatch], Pair], n: int) -> Pair:
    """The mean outer product of the vectors that centred makes of a batch of rows; a row of it for each dimension."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                more = outer_products(centred(batch))
                out = more if out is None else add(out, more)
        if out is not None:
            yield _parts(out, TaskContext.get().partitionId())

    parts = mapped(rows, products, _PARTS_SQL)
    for _ in range(2):
        parts = grouped(parts.withColumns({"some": F.struct("dim", F.expr(f"task div {FAN}"))}), "some", lambda t: _merge(t.drop_columns(["some"])), _PARTS_SQL)
        parts = parts.withColumn("task", F.expr(f"task div {FAN}"))
    found = parts.orderBy("dim").collect()  # a row for each dimension
    high, low = (np.array([r[c] for r in found]) for c in ("high", "low"))
    return high / n, low / n


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q^T, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        most = np.abs(x).max()
        if most == 0:
            continue
        x = x / most  # so that squares of tiny entries count
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def divide_and_conquer(d: np.ndarray, e: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of the symmetric tridiagonal matrix of diagonal d and off-diagonal e.

    The matrix is torn into two halves and a correction of rank one; the halves are solved alike, and the secular
    equation joins them. What is under the rounding of the largest entry of the whole matrix (scale) counts as nothing."""
    n = len(d)
    scale = max(np.abs(d).max(), np.abs(e).max(initial=0)) if scale is None else scale
    if n == 1:
        return d.copy(), np.eye(1)
    m = n // 2
    rho, d = abs(e[m - 1]), d.copy()
    d[m - 1] -= rho
    d[m] -= rho
    w1, q1 = divide_and_conquer(d[:m], e[: m - 1], scale)
    w2, q2 = divide_and_conquer(d[m:], e[m:], scale)
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    z = np.concatenate([q1[-1], np.copysign(1.0, e[m - 1]) * q2[0]])
    return _joined(np.concatenate([w1, w2]), z, rho, q, scale)


def _joined(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of q (diag(d) + rho z z^T) q^T."""
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order].copy(), q[:, order].copy()
    tolerance = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho * (z @ z), scale)
    live: list[int] = []
    for j in range(len(d)):
        if rho * abs(z[j]) <= tolerance:
            z[j] = 0.0
            continue
        if live:
            i = live[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if abs((d[j] - d[i]) * c * s) <= tolerance:  # equal values: turned so that one has no part in z
                q[:, [i, j]] = np.stack([c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]], axis=1)
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                z[i], z[j] = 0.0, r
                live.pop()
        live.append(j)
    w = d.copy()
    if live:
        at = np.array(live)
        at = at[np.argsort(d[at], kind="stable")]
        w[at], vectors = _secular(d[at], z[at], rho)
        q[:, at] = q[:, at] @ vectors
    order = np.argsort(w, kind="stable")
    return w[order], q[:, order]


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z^T for rising d and z without zeros.

    Each root is bisected as its distance from the nearer pole, so differences from the poles keep their precision;
    the vectors come from the z for which the roots found are exact, so they are orthogonal."""
    n = len(d)
    gap = np.append(d[1:] - d[:-1], rho * (z @ z))

    def value(pole: np.ndarray, mu: np.ndarray) -> np.ndarray:
        """1 + rho sum z^2 / (d - root), for roots at d[pole] + mu."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 + rho * (z * z / ((d[None, :] - d[pole][:, None]) - mu[:, None])).sum(axis=1)

    own = np.arange(n)
    near_next = (value(own, gap / 2) < 0) & (own < n - 1)  # the root lies in the upper half of its gap
    pole = np.where(near_next, own + 1, own)
    low, high = np.where(near_next, -gap / 2, 0.0), np.where(near_next, 0.0, np.where(own < n - 1, gap / 2, gap))
    for _ in range(1100):
        mu = low + (high - low) / 2
        if not ((mu != low) & (mu != high)).any():
            break
        below = value(pole, mu) < 0  # the equation rises from -inf to inf over the gap
        low, high = np.where(below, mu, low), np.where(below, high, mu)
    mu = np.where(low == 0, high, np.where(high == 0, low, low + (high - low) / 2))
    away = (d[None, :] - d[pole][:, None]) - mu[:, None]  # [root, pole]: d - root
    # z_i^2 rho = prod_j (root_j - d_i) / prod_{j != i} (d_j - d_i), as a product of ratios near one
    between = d[None, :] - d[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = np.where(own[None, :] == own[:, None], -away.T, -away.T / between)
    fitted = np.copysign(np.sqrt(np.abs(ratio.prod(axis=1)) / rho), z)
    vectors = fitted[:, None] / away.T
    return d[pole] + mu, vectors / np.linalg.norm(vectors, axis=0)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    size = np.abs(a).max()
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / size)
    w, v = divide_and_conquer(d, e)
    return (w * size)[::-1], (q @ v)[:, ::-1]


def whole(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    """The vectors of a batch as whole numbers."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.floor(SCALE * np.clip(values, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, out = 0, None
    for batch in batches:
        if batch.num_rows:
            x = whole(batch)
            # in two parts, since no long may hold the sum of a batch
            more = [(h << 26) + l for h, l in zip((x >> 26).sum(axis=0).tolist(), (x & (1 << 26) - 1).sum(axis=0).tolist())]
            n, out = n + batch.num_rows, more if out is None else [a + b for a, b in zip(out, more)]
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(map(str, out), pa.string()), pa.array([n] * len(out))], names=["dim", "s", "n"])


def valid(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """vec_id, v (doubles) of the vectors that can be used."""
    rows = vectors.select(F.col(id_).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else 0))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - sums)^2 of each row, exact; None if no long can hold it."""
    most = (1 << 63) - 1
    reach = max(n * int(x.max()), abs(n * int(x.min())), *map(abs, sums))
    if reach <= most // 2:
        d = n * x - np.array(sums)
        if int(np.abs(d).max()) ** 2 * x.shape[1] <= most:
            return (d * d).sum(axis=1).tolist()
    out = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [v if v <= most else None for v in out]


def whitened(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: rows for each usable row of vectors and each
    of the first components."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = staged(valid(vectors, id_, vector), "vectors")
    found = mapped(rows.select("v"), _sums, "dim int, s string, n long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()  # a row for each dimension
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    mean = np.array([quotient(s, n) for s in sums]).T

    def centred(x: np.ndarray) -> Pair:
        s, e = two_sum(x.astype(np.float64), -mean[0])
        return two_sum(s, e - mean[1])

    high, low = covariance(rows.select("v"), lambda batch: centred(whole(batch)), n)
    v = high + low
    v = (v + v.T) / 2
    e, q = eigen(v)
    k = min(components, len(e))
    trace = float(np.trace(v))
    solid = np.array([j for j in range(k) if trace > 0 and e[j] > RANK * e[0]], int)
    axes = q[:, solid] / np.sqrt(e[solid])

    def projected(x: np.ndarray) -> np.ndarray:
        s, t = centred(x)
        return s @ axes + t @ axes

    error = None
    if len(solid):
        # the means of whitened values are zero up to rounding, far below what the error is asked to
        again = sum(covariance(rows.select("v"), lambda batch: (w := projected(whole(batch)), np.zeros_like(w)), n))
        error = float(np.abs(again - np.eye(len(solid))).max())
    explained = [float(x) / trace if trace > 0 else None for x in e[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = whole(batch, 1)
            w, known = np.zeros((m, k)), np.zeros((m, k), bool)
            w[:, solid], known[:, solid] = projected(x), True
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                pa.array(np.full(m * k, n)),
                pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(w.reshape(-1), mask=~known.reshape(-1)),
                pa.array(explained * m, pa.float64()),
                pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return mapped(rows, run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
