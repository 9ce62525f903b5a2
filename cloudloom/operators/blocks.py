"""Dense blocks over neighbour graphs: multi-relation encoding, downsampling and upsampling.

A graph is a table (k, i, rank, j, and what lies between i and j), searched once a level and used by all stages of it. Vectors
are arrays of doubles (k, i, f). Layers are matrix products over Arrow batches; weights come from a table (layer, row, col,
value: col -1 is the offset, and the rows of <layer>.scale and <layer>.shift follow the product), which a model's size bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.views import POINTS_SQL, cloud, features, points
from ..staging import shipped, staged
from .attention import vector_attention
from .farthest import farthest_points
from .ledgers import soft_assignment
from .neighbors import _D2, _knn_sql, knn
from .patches import fps_sql

NEIGHBOURS = 16
#: Rows whose neighbours one step of products takes at once.
STEP = 1024


class Layers:
    """A model's layers by name."""

    def __init__(self, weights: DataFrame):
        self.parts: dict[str, dict[tuple[int, int], float]] = {}
        for r in weights.select("layer", "row", "col", "value").collect():
            self.parts.setdefault(r["layer"], {})[r["row"], r["col"]] = r["value"]

    def matrix(self, name: str) -> np.ndarray:
        part = self.parts[name]
        out = np.zeros((1 + max(r for r, _ in part), 1 + max(c for _, c in part)))
        for (r, c), v in part.items():
            if c >= 0:
                out[r, c] = v
        return out

    def column(self, name: str, col: int, rows: int, other: float) -> np.ndarray:
        part = self.parts.get(name, {})
        return np.array([part.get((r, col), other) for r in range(rows)])

    def layer(self, name: str) -> Callable[[np.ndarray], np.ndarray]:
        """x to scale * (w x + b) + shift, over the last axis."""
        w = self.matrix(name)
        b, scale, shift = self.column(name, -1, len(w), 0.0), self.column(f"{name}.scale", 0, len(w), 1.0), self.column(f"{name}.shift", 0, len(w), 0.0)
        return lambda x: scale * (x @ w.T + b) + shift


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def batched(rows: DataFrame, run: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """k, i, f: f is what run makes of a batch of rows (k, i, ..), a vector for each."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("k", "i")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("i"), pa.array(list(run(part)), pa.list_(pa.float64()))], names=["k", "i", "f"])

    shipped(rows.sparkSession)
    return rows.mapInArrow(each, f"k {kind['k']}, i {kind['i']}, f array<double>")


def dense(rows: DataFrame, layer: Callable[[np.ndarray], np.ndarray], activation: Callable = relu) -> DataFrame:
    return batched(rows.select("k", "i", "f"), lambda b: activation(layer(_vectors(b.column("f")))))


def graph(cloud_: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    """k, i, rank, j, away: the n nearest points of each point of its cloud, and where they lie from it. A cloud of fewer
    points is an error."""
    near = knn(cloud_, cloud_, n)
    at = lambda name, p: cloud_.select("k", F.col("i").alias(name), *[F.col(a).alias(p + a) for a in "xyz"])
    near = near.join(at("i", "p"), ["k", "i"]).join(at("j", "q"), ["k", "j"])
    return near.select("k", "i", "rank", "j", F.array(*[F.col("q" + a) - F.col("p" + a) for a in "xyz"]).alias("away"))


def gathered(graph_: DataFrame, vectors: DataFrame, n: int = NEIGHBOURS) -> DataFrame:
    """k, i, near: the n neighbours of each point in order, with away and f."""
    rows = graph_.join(vectors.select("k", F.col("i").alias("j"), "f"), ["k", "j"]).groupBy("k", "i").agg(F.array_sort(F.collect_list(F.struct("rank", "away", "f"))).alias("near"))
    short = F.raise_error(F.concat(F.lit("a point with fewer neighbours than asked for in "), F.col("k").cast("string")))
    return rows.withColumn("near", F.when(F.size("near") == n, F.col("near")).otherwise(short.cast(rows.schema["near"].dataType)))


def relation_encoding(rows: DataFrame, layers: Layers, name: str, n: int = NEIGHBOURS) -> DataFrame:
    """k, i, f: neighbours' features and geometry (the first neighbour's place, their own, the difference and its length),
    weighted in each channel by a softmax over the neighbours, and projected."""
    first, second, scores, out = (layers.layer(f"{name}.{x}") for x in ("position1", "position2", "score", "output"))

    def run(batch: pa.RecordBatch) -> np.ndarray:
        near = batch.column("near").flatten()
        away = _vectors(near.field("away")).reshape(batch.num_rows, n, 3)
        own = _vectors(near.field("f")).reshape(batch.num_rows, n, -1)
        centre = np.broadcast_to(away[:, :1], away.shape)
        delta = centre - away
        geometry = np.concatenate([centre, away, delta, np.sqrt((delta * delta).sum(axis=2, keepdims=True))], axis=2)
        fused = np.concatenate([second(relu(first(geometry))), own], axis=2)
        s = scores(fused)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return relu(out((e / e.sum(axis=1, keepdims=True) * fused).sum(axis=1)))

    return batched(rows, run)


def beside(*vectors: DataFrame) -> DataFrame:
    """k, i, f: the vectors of a point one after the other."""
    out = vectors[0].select("k", "i", F.col("f").alias("f0"))
    for n, v in enumerate(vectors[1:], 1):
        out = out.join(v.select("k", "i", F.col("f").alias(f"f{n}")), ["k", "i"])
    return out.select("k", "i", F.concat(*[f"f{n}" for n in range(len(vectors))]).alias("f"))


def multi_relation(graph_: DataFrame, vectors: DataFrame, layers: Layers) -> DataFrame:
    """k, i, f: two stages of relation encoding over one graph, fused, plus a shortcut."""
    first = staged(relation_encoding(gathered(graph_, dense(vectors, layers.layer("input"))), layers, "first"), "first")
    second = relation_encoding(gathered(graph_, first), layers, "second")
    fuse, short, width = layers.layer("fusion"), layers.layer("shortcut"), len(layers.matrix("first.output"))

    def run(batch: pa.RecordBatch) -> np.ndarray:
        f = _vectors(batch.column("f"))
        return relu(short(f[:, 2 * width :])) + relu(fuse(f[:, : 2 * width]))

    return batched(beside(first, second, vectors), run)


def downsampled(cloud_: DataFrame, encoded: DataFrame, stride: int) -> DataFrame:
    """k, rank, i, f: stride of stride + 1 points of each cloud (rounded down) by farthest-point sampling from its first."""
    starts = cloud_.groupBy("k").agg(F.min("i").alias("s"), F.floor(F.count(F.lit(1)) * stride / (stride + 1)).alias("n")).withColumn("plan", F.lit("index0"))
    return farthest_points(starts.filter("n > 0"), cloud_).drop("plan").join(encoded, ["k", "i"]).select("k", "rank", "i", "f")


def interpolated(near: DataFrame, vectors: DataFrame) -> DataFrame:
    """k, i, f: vectors of the neighbours (near: k, i, j, d2, rank), weighted by inverse distance; of a point that is met
    exactly, its own (the first of those)."""
    pick = F.min(F.when(F.col("d2") == 0, F.struct("rank", "f")))["f"]
    rows = near.join(vectors.select("k", F.col("i").alias("j"), "f"), ["k", "j"]).withColumn("w", 1 / F.sqrt(F.greatest("d2", F.lit(1e-24))))
    rows = rows.groupBy("k", "i").agg(pick.alias("hit"), F.array_sort(F.collect_list(F.struct("rank", "w", "f"))).alias("near"))

    def run(batch: pa.RecordBatch) -> np.ndarray:
        near_ = batch.column("near").flatten()
        w = near_.field("w").to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        f = _vectors(near_.field("f")).reshape(*w.shape, -1)
        return (w[:, :, None] * f).sum(axis=1) / w.sum(axis=1, keepdims=True)

    mixed = batched(rows.filter("hit is null").select("k", "i", "near"), run)
    return mixed.unionByName(rows.filter("hit is not null").select("k", "i", F.col("hit").alias("f")))


def coded(vectors: DataFrame, codes: DataFrame) -> DataFrame:
    """k, i, f: the mean of the codes (c, f) by each vector's soft assignment. Codes are few."""
    named = vectors.select(F.struct("k", "i").alias("v"), "f")
    rows = soft_assignment(named, codes).drop("f").join(F.broadcast(codes), "c")  # a codebook: soft_assignment holds it in each row, too
    return rows.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("c", "w", "f"))).alias("mix")).select("v.k", "v.i", F.expr("aggregate(mix, transform(mix[0].f, x -> 0D), (a, m) -> zip_with(a, m.f, (x, y) -> x + m.w * y))").alias("f"))


def upsampled(near_dense: DataFrame, near_sparse: DataFrame, dense_: DataFrame, sparse: DataFrame, keys: DataFrame, values: DataFrame, codes: DataFrame, layers: Layers) -> DataFrame:
    """k, i, f: for each dense point its query (own and interpolated sparse features), attended to keys and values over its
    dense neighbours with the code prior, and projected beside the prior."""
    prior = staged(coded(dense_, codes), "prior")
    asked = dense(beside(dense_, interpolated(near_sparse, sparse)), layers.layer("query"), lambda x: x)
    seen = vector_attention(near_dense, prior, asked, keys, values, layers.matrix("attention1").tolist(), layers.matrix("attention2").tolist())
    return dense(beside(seen, prior), layers.layer("output"))


def stand_in(shapes: dict[str, tuple[int, int]], offset: bool = True) -> list[tuple[str, int, int, float]]:
    """Weights for queries, since no trained ones come with the data: eighths that differ by layer and place."""
    value = lambda n, r, c: ((7 * r + 3 * c + 5 * n + r * c) % 11 - 5) / 8
    out = [(name, r, c, value(n, r, c)) for n, (name, (rows, cols)) in enumerate(shapes.items()) for r in range(rows) for c in range(-1 if offset else 0, cols)]
    return out + [(f"{name}.{x}", r, 0, v + r / 4) for name, (rows, _) in shapes.items() for x, v in (("scale", 0.5), ("shift", 0.125)) for r in range(rows)]


_RELATION = {"position1": (4, 10), "position2": (2, 4), "score": (4, 4), "output": (2, 4)}
_SHAPES = {"input": (2, 2), **{f"{s}.{n}": x for s in ("first", "second") for n, x in _RELATION.items()}, "fusion": (4, 4), "shortcut": (4, 2)}
_UP_SHAPES = {"query": (2, 4), "attention1": (2, 2), "attention2": (2, 2), "output": (3, 4)}


def _layer_sql(weights: list[tuple], name: str, inputs: list[str], activated: bool = True) -> list[str]:
    """An expression for each output of a layer of stand-in weights."""
    part = {(n, r, c): v for n, r, c, v in weights}
    out, r = [], 0
    while (name, r, 0) in part:
        body = " + ".join([f"({part.get((name, r, -1), 0.0)!r})::DOUBLE", *(f"({part[name, r, c]!r})::DOUBLE * ({x})" for c, x in enumerate(inputs))])
        body = f"({part[f'{name}.scale', r, 0]!r})::DOUBLE * ({body}) + ({part[f'{name}.shift', r, 0]!r})::DOUBLE"
        out.append(f"greatest({body}, 0)" if activated else body)
        r += 1
    return out


def _columns(names: list[str], expressions: list[str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in zip(names, expressions))


def _relation_sql(t: str, name: str, source: str, weights: list[tuple]) -> str:
    """CTEs of a stage over nb (k, i, rank, j, dx, dy, dz) and source (k, i, a0, a1); its result is {t} (k, i, a0, a1)."""
    geometry = ["ox", "oy", "oz", "dx", "dy", "dz", "ox - dx", "oy - dy", "oz - dz", "sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy) + (oz - dz) * (oz - dz))"]
    h, p, s, u = (["h0", "h1", "h2", "h3"], ["u0", "u1"], ["s0", "s1", "s2", "s3"], ["u0", "u1", "u2", "u3"])
    return f"""
{t}g AS (SELECT nb.k AS k, nb.i AS i, dx, dy, dz, {', '.join(f'first_value(d{a}) OVER (PARTITION BY nb.k, nb.i ORDER BY rank) AS o{a}' for a in 'xyz')}, a0 AS u2, a1 AS u3 FROM nb JOIN {source} f ON nb.k = f.k AND nb.j = f.i),
{t}h AS (SELECT k, i, u2, u3, {_columns(h, _layer_sql(weights, name + '.position1', geometry))} FROM {t}g),
{t}p AS (SELECT k, i, u2, u3, {_columns(p, _layer_sql(weights, name + '.position2', h, False))} FROM {t}h),
{t}s AS (SELECT *, {_columns(s, _layer_sql(weights, name + '.score', u, False))} FROM {t}p),
{t}e AS (SELECT *, {', '.join(f'exp(s{c} - max(s{c}) OVER (PARTITION BY k, i)) AS e{c}' for c in range(4))} FROM {t}s),
{t}m AS (SELECT k, i, {', '.join(f'sum(e{c} * u{c}) / sum(e{c}) AS m{c}' for c in range(4))} FROM {t}e GROUP BY k, i),
{t} AS (SELECT k, i, {_columns(['a0', 'a1'], _layer_sql(weights, name + '.output', ['m0', 'm1', 'm2', 'm3']))} FROM {t}m)"""


def _encoding_sql() -> str:
    """CTEs that end in mr (k, i, y0, .., y3)."""
    w = stand_in(_SHAPES)
    fused = _layer_sql(w, "fusion", ["x.a0", "x.a1", "y.a0", "y.a1"])
    short = _layer_sql(w, "shortcut", ["f0", "f1"])
    return f"""{_knn_sql('c', 'c', NEIGHBOURS)},
ft AS (SELECT label AS k, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS i, {', '.join(f'CAST(embedding[{9 + j}] AS DOUBLE) AS f{j}' for j in range(4))} FROM embeddings),
nb AS (SELECT n.k AS k, n.i AS i, rank, j, {', '.join(f'r.c{a} - q.c{a} AS d{a}' for a in 'xyz')} FROM knn n JOIN pts q ON n.k = q.k AND n.i = q.i JOIN pts r ON n.k = r.k AND n.j = r.i),
pj AS (SELECT k, i, {_columns(['a0', 'a1'], _layer_sql(w, 'input', ['f0', 'f1']))} FROM ft),
{_relation_sql('ra', 'first', 'pj', w)}, {_relation_sql('rb', 'second', 'ra', w)},
mr AS (SELECT x.k AS k, x.i AS i, {', '.join(f'{a} + {b} AS y{c}' for c, (a, b) in enumerate(zip(short, fused)))} FROM ra x JOIN rb y ON x.k = y.k AND x.i = y.i JOIN ft ON ft.k = x.k AND ft.i = x.i)"""


def _encoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    layers = Layers(spark.createDataFrame(stand_in(_SHAPES), "layer string, row int, col int, value double"))
    c = cloud(points(spark, sf_dir), "c")
    f = features(spark, sf_dir, 2).select("k", "i", F.array("f0", "f1").alias("f"))
    return c, multi_relation(staged(graph(c), "graph"), f, layers)


_ROUND5 = "floor({0} * 1e5 + 0.5) / 1e5 AS {0}"


@query(f"WITH {POINTS_SQL}, {_encoding_sql()} SELECT k, i, {', '.join(_ROUND5.format(f'y{c}') for c in range(4))} FROM mr")
def multi_relation_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages over the 16 nearest neighbours of each clean point."""
    return _encoded(spark, sf_dir)[1].select("k", "i", *[(F.floor(F.get("f", c) * 1e5 + 0.5) / 1e5).alias(f"y{c}") for c in range(4)])


@query(f"""WITH RECURSIVE {POINTS_SQL}, {_encoding_sql()}, {fps_sql('c', '(SELECT max(floor(3 * c / 4)) FROM (SELECT count(*) AS c FROM pts GROUP BY k))')},
sd AS (SELECT DISTINCT fps.k AS k, rank, cur FROM fps JOIN (SELECT k, floor(3.0 * count(*) / 4) AS n FROM pts GROUP BY k) c ON fps.k = c.k WHERE rank < n)
SELECT sd.k AS k, CAST(sd.rank AS INTEGER) AS rank, CAST(cur AS INTEGER) AS i, {_ROUND5.format('y0')}, {_ROUND5.format('y3')} FROM sd JOIN mr ON sd.k = mr.k AND sd.cur = mr.i""")
def downsampled_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of four points of each cloud, with their encoding."""
    out = downsampled(*_encoded(spark, sf_dir), 3)
    return out.select("k", "rank", "i", *[(F.floor(F.get("f", c) * 1e5 + 0.5) / 1e5).alias(f"y{c}") for c in (0, 3)])


def _upsampling_sql() -> str:
    w = stand_in(_UP_SHAPES)
    plain = lambda name: [[v for n, r, c, v in w if n == name and r == row and c >= 0] for row in range(2)]
    first, second = plain("attention1"), plain("attention2")
    lin = lambda m, x: [" + ".join(f"({v!r})::DOUBLE * {y}" for v, y in zip(row, x)) for row in m]
    h = [f"greatest({e}, 0)" for e in lin(first, ["r0", "r1"])]
    return f"""WITH {POINTS_SQL}, {_knn_sql('c', 'c', NEIGHBOURS)},
ft AS (SELECT vec_id, label AS k, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS i, {', '.join(f'CAST(embedding[{9 + j}] AS DOUBLE) AS f{j}' for j in range(4))} FROM embeddings),
ns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, i ORDER BY d2, j) AS rank FROM (SELECT q.k AS k, q.i AS i, r.i AS j, {_D2.format(p='c', s='c')} AS d2 FROM pts q JOIN pts r ON q.k = r.k AND r.i % 2 = 0)) WHERE rank <= 8),
iw AS (SELECT ns.k AS k, ns.i AS i, f2, f3, d2, 1 / sqrt(greatest(d2, 1e-24)) AS w, min(CASE WHEN d2 = 0 THEN rank END) OVER (PARTITION BY ns.k, ns.i) AS hit, rank FROM ns JOIN ft ON ns.k = ft.k AND ns.j = ft.i),
ip AS (SELECT k, i, {', '.join(f'CASE WHEN any_value(hit) IS NULL THEN sum(w * f{c}) / sum(w) ELSE max(CASE WHEN rank = hit THEN f{c} END) END AS t{c}' for c in (2, 3))} FROM iw GROUP BY k, i),
co AS (SELECT v.k AS k, v.i AS i, c.vec_id AS c, c.f0 AS c0, c.f1 AS c1, (v.f0 * c.f0 + v.f1 * c.f1) / sqrt(greatest(v.f0 * v.f0 + v.f1 * v.f1, 1e-24)) / sqrt(greatest(c.f0 * c.f0 + c.f1 * c.f1, 1e-24)) AS s FROM ft v JOIN ft c ON c.vec_id < 6),
cw AS (SELECT *, exp((s - max(s) OVER (PARTITION BY k, i)) / 0.1) AS e FROM co), pr AS (SELECT k, i, sum(e * c0) / sum(e) AS p0, sum(e * c1) / sum(e) AS p1 FROM cw GROUP BY k, i),
qu AS (SELECT ft.k AS k, ft.i AS i, {_columns(['q0', 'q1'], _layer_sql(w, 'query', ['f0', 'f1', 't2', 't3'], False))} FROM ft JOIN ip ON ft.k = ip.k AND ft.i = ip.i),
sc AS (SELECT d.k AS k, d.i AS j, s.f2 AS k0, s.f3 AS k1, s.f3 AS v0, s.f2 AS v1, p0, p1 FROM ft d JOIN ft s ON d.k = s.k AND s.i = d.i - d.i % 2 JOIN pr ON pr.k = d.k AND pr.i = d.i),
re AS (SELECT n.k AS k, n.i AS i, q0 - k0 + p0 AS r0, q1 - k1 + p1 AS r1, v0 + p0 AS u0, v1 + p1 AS u1 FROM knn n JOIN qu q ON n.k = q.k AND n.i = q.i JOIN sc ON n.k = sc.k AND n.j = sc.j),
hi AS (SELECT *, {_columns(['h0', 'h1'], h)} FROM re), si AS (SELECT *, {_columns(['s0', 's1'], lin(second, ['h0', 'h1']))} FROM hi),
ex AS (SELECT *, exp(s0 - max(s0) OVER (PARTITION BY k, i)) AS e0, exp(s1 - max(s1) OVER (PARTITION BY k, i)) AS e1 FROM si),
se AS (SELECT k, i, sum(e0 * u0) / sum(e0) AS z0, sum(e1 * u1) / sum(e1) AS z1 FROM ex GROUP BY k, i),
up AS (SELECT se.k AS k, se.i AS i, {_columns(['y0', 'y1', 'y2'], _layer_sql(w, 'output', ['z0', 'z1', 'p0', 'p1']))} FROM se JOIN pr ON se.k = pr.k AND se.i = pr.i)
SELECT k, i, {', '.join(_ROUND5.format(f'y{c}') for c in range(3))} FROM up"""


@query(_upsampling_sql())
def upsampled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second point is the sparse level; keys and values of a dense point are those of the sparse one at or before it."""
    layers = Layers(spark.createDataFrame(stand_in(_UP_SHAPES), "layer string, row int, col int, value double"))
    f, c = features(spark, sf_dir, 4), cloud(points(spark, sf_dir), "c")
    own = f.select("k", "i", F.array("f0", "f1").alias("f"))
    sparse = f.filter("i % 2 = 0").select("k", "i", F.array("f2", "f3").alias("f"))
    twice = sparse.select("k", F.explode(F.array("i", F.col("i") + 1)).alias("i"), "f")
    values = twice.select("k", "i", F.reverse("f").alias("f"))
    codes = f.filter("vec_id < 6").select(F.col("vec_id").alias("c"), F.array("f0", "f1").alias("f"))
    out = upsampled(knn(c, c, NEIGHBOURS), knn(c, c.filter("i % 2 = 0"), 8), own, sparse, twice, values, codes, layers)
    return out.select("k", "i", *[(F.floor(F.get("f", j) * 1e5 + 0.5) / 1e5).alias(f"y{j}") for j in range(3)])
