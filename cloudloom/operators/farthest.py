"""Farthest-point sampling of clouds of any size: the points that the step-by-step method takes, in its order.

A cloud of up to BLOCK points is sampled by one task. A larger one is dealt into blocks of small cells, and sampled in
rounds over all such clouds at once. A cell tells its greatest least distance and the point that has it. From these the
next points are taken one after the other: each new point leaves exact the cells whose farthest point it doesn't come
nearer to, and of the others bounds what they can still hold by their box. Points are taken as long as the farthest of the
exact cells is farther than all bounds; then the blocks take in the new points, each only in the cells that these can
change, and the next round begins. No task holds more than a block, or more than the cells' summaries of a cloud."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import shipped, staged

#: Points of a cloud that one task samples at most; of a block, on average, a quarter. Rounds are for clouds
#: that are larger: they take a second or two each, and only some points.
BLOCK = 1 << 18
#: Points of a cell on average, on a surface; cells that hold more than DENSE are split without regard to place.
CELL, DENSE = 64, 4096


def farthest_points(starts: DataFrame, clouds: DataFrame, count: int | None = None, block: int = BLOCK) -> DataFrame:
    """plan, k, rank, i: the points that farthest-point sampling takes, from start point s of each plan and cloud: count, or
    as many as the column n of starts says. Ties go to the lower index. k may be of any type."""
    shipped(clouds.sparkSession)
    starts = starts if count is None else starts.withColumn("n", F.lit(count))
    kind = starts.schema["k"].dataType
    # keys are carried as JSON text
    text = F.to_json(F.struct("k")).alias("k")
    starts, clouds = starts.select("plan", text, F.col("s").cast("long").alias("s"), F.col("n").cast("long").alias("n")), clouds.select(text, F.col("i").cast("long").alias("i"), *"xyz")
    starts = staged(starts.join(clouds.groupBy("k").agg(F.count(F.lit(1)).alias("points")), "k"), "starts")  # a row a plan and cloud
    small, large = starts.filter(F.col("points") <= block), starts.filter(F.col("points") > block).drop("points")
    out = _by_cloud(small, clouds, block)
    if not large.isEmpty():
        out = out.unionByName(_in_rounds(large, clouds.join(large.select("k").distinct(), "k"), block))
    back = F.from_json("k", f"struct<k: {kind.simpleString()}>")["k"].alias("k")
    return out.select("plan", back, F.col("rank").cast("int").alias("rank"), F.col("i").cast("int").alias("i"))


def _squared(d: np.ndarray) -> np.ndarray:
    return d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]


def _sampled(xyz: np.ndarray, at: int, n: int) -> np.ndarray:
    """The positions of n points, from position at; the first position wins ties."""
    x, y, z = (np.ascontiguousarray(xyz[:, j]) for j in range(3))
    odd = not np.isfinite(xyz).all()  # what is no number would undo that a point is taken
    least, taken = np.full(len(x), np.inf), np.zeros(n, np.int64)
    d, e = np.empty_like(least), np.empty_like(least)
    for r in range(n):
        taken[r] = at
        np.subtract(x, x[at], out=d)
        np.multiply(d, d, out=d)
        for c in (y, z):
            np.subtract(c, c[at], out=e)
            np.multiply(e, e, out=e)
            np.add(d, e, out=d)
        np.minimum(least, d, out=least)
        least[taken[: r + 1] if odd else at] = -1.0
        at = int(least.argmax())
    return taken


def _coordinates(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(a).to_numpy() for a in "xyz"], axis=1)


def _by_cloud(starts: DataFrame, clouds: DataFrame, block: int) -> DataFrame:
    """starts has the points of each cloud: so many tasks that one gets about a quarter of a block's, or a cloud, and, if there are
    few, a cloud of its own."""

    def sample(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        ids = t.column("i").to_numpy()
        n = min(t.column("n")[0].as_py(), len(ids))
        taken = _sampled(_coordinates(t), int(np.searchsorted(ids, t.column("s")[0].as_py())), n)
        return pa.table({"plan": [t.column("plan")[0].as_py()] * n, "k": [t.column("k")[0].as_py()] * n, "rank": np.arange(n), "i": ids[taken]})

    samples, rows = starts.agg(F.count(F.lit(1)), F.coalesce(F.sum("points"), F.lit(0))).first()
    parts = max(1, min(samples, int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-4 * rows // block))
    each = starts.drop("points").join(clouds, "k").repartition(parts, "plan", "k")
    return each.groupBy("plan", "k").applyInArrow(sample, "plan string, k string, rank long, i long")


_STATE = "plan string, k string, block long, goal long, taken long, ids binary, xyz binary, least binary, cells binary, summary binary"
_NAMES = ("plan", "k", "block", "goal", "taken", "ids", "xyz", "least", "cells", "summary")
_PICKS = "plan string, k string, rank long, i long, x double, y double, z double, more boolean"
#: A cell's summary: greatest least distance, the point that has it, and the box.
_WIDTH = 11


def _numbers(data: bytes, width: int | None = None, kind: str = "<f8") -> np.ndarray:
    out = np.frombuffer(data, kind)
    return out if width is None else out.reshape(-1, width)


def _built(t: pa.Table) -> pa.Table:
    """A block's points in order of cell and index."""
    cell = [t.column(c).to_numpy() for c in ("cx", "cy", "cz", "sub")]
    ids = t.column("i").to_numpy()
    order = np.lexsort((ids, *cell[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cell:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    row = [t.column("plan")[0].as_py(), t.column("k")[0].as_py(), t.column("block")[0].as_py(), t.column("n")[0].as_py(), 0]
    row += [x.tobytes() for x in (ids[order].astype("<i8"), _coordinates(t)[order].astype("<f8"), np.full(len(order), np.inf), np.flatnonzero(new).astype("<i8"))] + [b""]
    return pa.table({c: [v] for c, v in zip(_NAMES, row)})


def _refreshed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the picks of the last round taken in."""
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            ids, xyz, least, first = _numbers(row["ids"], kind="<i8"), _numbers(row["xyz"], 3), _numbers(row["least"]).copy(), _numbers(row["cells"], kind="<i8")
            size = np.diff(np.append(first, len(ids)))
            low, high, top = np.minimum.reduceat(xyz, first), np.maximum.reduceat(xyz, first), np.maximum.reduceat(least, first)
            for p in sorted(row["picks"], key=lambda p: p["rank"]):
                at = np.array([p["x"], p["y"], p["z"]])
                near = _squared(np.maximum(np.maximum(low - at, at - high), 0.0)) < top
                if near.any():
                    own = np.flatnonzero(np.repeat(near, size))
                    least[own] = np.minimum(least[own], _squared(xyz[own] - at))
                    least[own[ids[own] == p["i"]]] = -1.0
                    top = np.maximum.reduceat(least, first)
            least[np.isin(ids, [p["i"] for p in row["picks"]])] = -1.0
            top = np.maximum.reduceat(least, first)
            hit = np.flatnonzero(least == np.repeat(top, size))
            best = hit[np.searchsorted(hit, first)]  # a cell's points are in order of index
            summary = np.column_stack([top, ids[best], xyz[best], low, high])
            out = [row["plan"], row["k"], row["block"], row["goal"], row["taken"] + len(row["picks"]), row["ids"], row["xyz"], least.tobytes(), row["cells"], summary.astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if j < 2 else pa.int64() if j < 5 else pa.binary()) for j, v in enumerate(out)], names=list(_NAMES))


def _picked(t: pa.Table) -> pa.Table:
    """The points of one plan and cloud that follow for certain from its cells' summaries."""
    s = np.concatenate([_numbers(x, _WIDTH) for x in t.column("summary").to_pylist()])
    top, who, where, low, high = s[:, 0].copy(), s[:, 1], s[:, 2:5], s[:, 5:8], s[:, 8:11]
    taken, goal = t.column("taken")[0].as_py(), t.column("goal")[0].as_py()
    fresh, out = np.ones(len(s), bool), []
    while taken + len(out) < goal and fresh.any():
        best = top[fresh].max()
        if best < 0 or (~fresh).any() and top[~fresh].max() >= best:
            break
        tied = np.flatnonzero(fresh & (top == best))
        j = tied[who[tied].argmin()]
        at = where[j]
        out.append((taken + len(out), int(who[j]), *map(float, at)))
        changed = fresh & (_squared(where - at) < top)
        changed[j] = True
        fresh &= ~changed
        top = np.where(fresh, top, np.minimum(top, _squared(np.maximum(np.abs(low - at), np.abs(high - at)))))
    more = taken + len(out) < goal
    columns = list(zip(*out)) or [[]] * 5
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
    head = {c: pa.array([t.column(c)[0].as_py()] * len(out), pa.string()) for c in ("plan", "k")}
    return pa.table(head | {c: pa.array(v, kind) for c, v, kind in zip(("rank", "i", *"xyz"), columns, types)} | {"more": pa.array([more] * len(out), pa.bool_())})


def _in_rounds(starts: DataFrame, clouds: DataFrame, block: int) -> DataFrame:
    box = clouds.groupBy("k").agg(F.count(F.lit(1)).alias("size"), *[f(a).alias(p + a) for a in "xyz" for p, f in (("l", F.min), ("h", F.max))])
    grid = box.selectExpr("k", "lx", "ly", "lz", "size", f"cast(ceil(size * 4 / {block}) as long) as blocks", f"pow(2, least(8, greatest(0, ceil(log2(size / {CELL}) / 2)))) as cut", "greatest(hx - lx, hy - ly, hz - lz) as extent")
    cell = [f"if(extent > 0, cast(least(cut - 1, floor(({a} - l{a}) / extent * cut)) as long), 0) as c{a}" for a in "xyz"]
    at = clouds.join(grid, "k").selectExpr("k", "i", "x", "y", "z", "blocks", "size", *cell)
    dense = at.groupBy("k", "cx", "cy", "cz").agg(F.expr(f"cast(ceil(count(1) / {DENSE}) as long)").alias("parts"))
    at = at.join(dense, ["k", "cx", "cy", "cz"]).withColumn("sub", F.expr("pmod(i, parts)")).withColumn("block", F.expr("pmod(xxhash64(cx, cy, cz, sub), blocks)"))
    at = staged(at.drop("parts", "blocks"), "cells")
    dealt = starts.join(at, "k").withColumn("n", F.least("n", "size"))
    state = staged(dealt.groupBy("plan", "k", "block").applyInArrow(_built, _STATE), "blocks")
    first = starts.join(at, (starts["k"] == at["k"]) & (starts["s"] == at["i"])).select("plan", starts["k"], F.lit(0).cast("long").alias("rank"), "i", *"xyz", (F.least("n", "size") > 1).alias("more"))
    found = [staged(first.filter("n > 0"), "picks")]
    while True:
        picks = found[-1].filter("more").groupBy("plan", "k").agg(F.collect_list(F.struct("rank", "i", *"xyz")).alias("picks"))  # the picks of one round
        state = staged(state.join(picks, ["plan", "k"]).mapInArrow(_refreshed, _STATE), "blocks")
        found.append(staged(state.groupBy("plan", "k").applyInArrow(_picked, _PICKS), "picks"))
        if found[-1].isEmpty():
            return reduce(DataFrame.unionByName, [f.select("plan", "k", "rank", "i") for f in found])
