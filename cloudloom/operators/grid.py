"""Exact nearest-neighbour search through cubes that follow density: candidates of points and of triangles, without all
pairs of a cloud.

A large cloud's box is a cube that is halved LEVELS times along each axis (level 0: the finest cubes, LEVELS: the box).
First each point looks into the smallest cube about it that holds as many reference points as it needs, which bounds the
distance to them; then it looks into the cubes that this distance meets, at the level whose side is at least as long. So
far points and dense spots only change the levels at which points search, and the result is exact. Cubes with enough
points are found from coarse to fine, and only points in such cubes go on. Where most queries of a cloud share their place
with others, one of each place is searched for. A place where many reference points coincide
counts with as many as are needed. Work is dealt by cloud, level and cube. Clouds of up to ONE_CUBE points are one cube."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import squared
from ..staging import staged

#: Clouds of up to so many points are one cube.
ONE_CUBE = 512
#: How often the box of a larger cloud is halved.
LEVELS = 20
#: Levels that are counted at once.
_STEP = 4
#: Cubes are cut further while they hold so many points.
FULL = 16
#: Levels under that of its extent at which a triangle is put into cubes, so that a large one isn't compared with all queries.
DOWN = 3
#: Queries for which one task makes pairs, about: what a task holds doesn't grow with the input.
DEALT = 20_000
_AXES = "xyz"
_KEY = ("k", "level", "cx", "cy", "cz")


def _each(form: str) -> list[str]:
    """The form for each axis, put for {a}."""
    return [form.format(a=a) for a in _AXES]


def checked(points: DataFrame) -> DataFrame:
    """points; one whose coordinates aren't numbers is an error when it is met, as it has no distance to anything."""
    fine = " and ".join(_each("abs({a}) < 1e300"))
    bad = "raise_error(concat('a point of ', cast(k as string), ' is not finite'))"
    # each coordinate carries the check: a filter that skips nulls of one may run first
    return points.withColumns({a: F.expr(f"if(coalesce({fine}, false), {a}, cast({bad} as double))") for a in _AXES})


def cubes(queries: DataFrame, reference: DataFrame) -> DataFrame:
    """k, lx, ly, lz (the grid's corner), side (of the finest cubes), depth (levels above it) of each cloud."""
    both = queries.selectExpr("k", *_AXES, "0 as n").union(reference.selectExpr("k", *_AXES, "1 as n"))
    box = both.groupBy("k").agg(*[F.expr(x) for x in (*_each("min({a}) as l{a}"), *_each("max({a}) as h{a}"), "greatest(sum(n), sum(1 - n)) as n")])
    box = box.selectExpr("k", "lx", "ly", "lz", f"if(n <= {ONE_CUBE}, 0, {LEVELS}) as depth", "greatest(hx - lx, hy - ly, hz - lz) as extent")
    return box.selectExpr("k", "lx", "ly", "lz", "depth", "if(extent > 0, extent * (1 + 1e-9D), 1.0D) / pow(2, depth) as side")


def _cube(value: str) -> str:
    """The finest cube of a coordinate on axis {a}, within the grid."""
    return f"cast(greatest(0, least(floor(({value} - l{{a}}) / side), shiftleft(1, depth) - 1)) as int)"


_RAISED = _each("shiftright(o{a}, level) as c{a}")


def _level_of(length: str) -> str:
    """The level whose side is at least so long."""
    return f"cast(least(ceil(log2(greatest({length}, side) * (1 + 1e-9D) / side)), depth) as int)"


def _spread(df: DataFrame) -> DataFrame:
    """df for each cube at its level from u to v (finest cubes) along each axis."""
    for a in _AXES:
        df = df.selectExpr("*", f"explode(sequence(shiftright(u{a}, level), shiftright(v{a}, level))) as c{a}")
    return df


def large(queries: DataFrame, reference: DataFrame) -> bool:
    """Whether any cloud has more than ONE_CUBE points on either side (a job)."""
    sizes = queries.select("k", F.lit(0).alias("side")).union(reference.select("k", F.lit(1).alias("side"))).groupBy("k", "side").count()
    return not sizes.filter(F.col("count") > ONE_CUBE).isEmpty()


def crowded(points: DataFrame, full: int) -> DataFrame:
    """k, level, cx, cy, cz: the cubes that hold `full` points or more, of clouds with levels; from coarse to fine, as long as
    there are some. Points are counted in the finest cubes of each step, and these summed for its coarser ones."""
    rest, found = points.filter("depth > 0"), []
    for top in range(LEVELS, -1, -_STEP):
        low = max(top - _STEP + 1, 0)
        cells = rest.selectExpr("k", *_each(f"shiftright(o{{a}}, {low}) as o{{a}}")).groupBy("k", "ox", "oy", "oz").count()
        cells = cells.selectExpr("k", f"explode(sequence({low}, {top})) as level", "ox", "oy", "oz", "count").selectExpr("k", "level", *_each(f"shiftright(o{{a}}, level - {low}) as c{{a}}"), "count")
        found.append(staged(cells.groupBy(*_KEY).agg(F.sum("count").alias("n")).filter(F.col("n") >= full).select(*_KEY), "crowded"))
        fine = found[-1].filter(F.col("level") == low)
        if fine.isEmpty():
            break
        rest = points.filter("depth > 0").selectExpr("*", f"{low} as level").selectExpr("*", *_RAISED).join(fine, list(_KEY), "left_semi").select("k", "ox", "oy", "oz")
    return reduce(DataFrame.union, found)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """df by cloud, level and cube, in as many partitions as give DEALT of so many rows to each."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT))
    return df.repartition(parts, *_KEY)


def at_levels(points: DataFrame, used: DataFrame, cut: str = "true") -> DataFrame:
    """points for each of the levels that used (k, level) has of their cloud, where cut holds."""
    levels = used.groupBy("k").agg(F.collect_set("level").alias("levels"))  # one set of up to LEVELS + 1 numbers a cloud
    return points.join(levels, "k").selectExpr("*", "explode(levels) as level").drop("levels").filter(cut)


def searches(queries: DataFrame, reference: DataFrame, need: int) -> tuple[DataFrame, DataFrame]:
    """(queries k, i, qx, qy, qz, bound; reference with rx, ry, rz) with level and cube cx, cy, cz, to be joined on these and k.

    bound: no point further than this (squared) is among the `need` nearest. Further columns of reference stay; of those
    at one place the `need` first in the order of these columns are enough, so the others are left out."""
    rest = [c for c in reference.columns if c not in ("k", *_AXES)]
    if not large(queries, reference):
        level = ["0 as level", *_each("0 as c{a}")]
        return queries.selectExpr("k", "i", *_each("{a} as q{a}"), "double('infinity') as bound", *level), reference.selectExpr("k", *rest, *_each("{a} as r{a}"), *level)
    if rest:
        place = F.row_number().over(Window.partitionBy("k", *_AXES).orderBy(*rest))
        reference = reference.withColumn("place", place).filter(F.col("place") <= need).drop("place")
    else:
        reference = reference.distinct()
    grid = staged(cubes(queries, reference), "grid")  # a row a cloud
    q = staged(queries.join(grid, "k").selectExpr("k", "i", *_each("{a} as q{a}"), "depth", *_each(f"{_cube('{a}')} as o{{a}}")), "queries")
    r = staged(reference.join(grid, "k").selectExpr("k", *rest, *_each("{a} as r{a}"), "depth", *_each(f"{_cube('{a}')} as o{{a}}")), "reference")
    rows = q.count()

    held = crowded(r, max(need, FULL))
    span = held.groupBy("k").agg(F.min("level").alias("lo"), F.max("level").alias("hi"))
    lowest = q.join(span, "k").selectExpr("k", "i", "qx", "qy", "qz", "lo", "hi", *_each("shiftright(o{a}, lo) as o{a}"))
    spots = lowest.select("k", "ox", "oy", "oz", "lo", "hi").distinct().selectExpr("*", "explode(sequence(lo, hi)) as level").selectExpr("*", *_each("shiftright(o{a}, level - lo) as c{a}"))
    enough = spots.join(held, list(_KEY)).groupBy("k", "ox", "oy", "oz").agg(F.min("level").alias("level"))
    own = lowest.join(enough, ["k", "ox", "oy", "oz"]).selectExpr("k", "i", "qx", "qy", "qz", "level", *_each("shiftright(o{a}, level - lo) as c{a}"))
    own = staged(own, "own")
    there = at_levels(r, own).selectExpr("k", "rx", "ry", "rz", "level", *_RAISED)
    # a query is in one cube here, so its pairs are in one task: grouped by cube first, they need no further shuffle
    at = [*_KEY, "i", "qx", "qy", "qz"]
    pairs = dealt(own, rows).join(dealt(there, rows), list(_KEY)).select(*at, squared("q", "r").alias("d2"))
    if need == 1:
        reach = pairs.groupBy(*at).agg(F.min("d2").alias("bound"))
    else:
        rank = F.row_number().over(Window.partitionBy(*_KEY, "i").orderBy("d2"))
        reach = pairs.withColumn("rank", rank).filter(F.col("rank") <= need).filter(F.col("rank") == need).withColumnRenamed("d2", "bound")
    reach = reach.selectExpr("k", "i", "qx", "qy", "qz", "bound", "level as own")
    whole = q.join(span, "k", "left_anti").selectExpr("k", "i", "qx", "qy", "qz", "cast(null as double) as bound", "cast(null as int) as own")

    # finer cubes than half the own one hold few points each, so a query would be copied to many and points to more levels
    q = reach.unionByName(whole).join(grid, "k").selectExpr("*", "sqrt(bound) * (1 + 1e-6D) + 1e-300D as far")
    low, high = (_each(f"if(bound is null, {end}, {_cube('q{a} ' + sign + ' far')}) as {to}{{a}}") for end, sign, to in (("0", "-", "u"), ("shiftleft(1, depth) - 1", "+", "v")))
    q = q.selectExpr("k", "i", "qx", "qy", "qz", "coalesce(bound, double('infinity')) as bound", *low, *high, f"if(bound is null, depth, greatest({_level_of('far')}, own - 1)) as level")
    q = staged(q, "searches")
    there = at_levels(r, q).selectExpr("k", *rest, "rx", "ry", "rz", "level", *_RAISED)
    return dealt(_spread(q).select("k", "i", "qx", "qy", "qz", "bound", *_KEY[1:]), rows), dealt(there, rows)


def corners(mesh: DataFrame) -> DataFrame:
    """k, x, y, z of the corners of all triangles (a, b, g; the y of b is by_)."""
    return mesh.selectExpr("k", "inline(array(struct(ax as x, ay as y, az as z), struct(bx as x, by_ as y, bz as z), struct(gx as x, gy as y, gz as z)))")


def triangle_searches(queries: DataFrame, mesh: DataFrame, reach: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Two pairs of (queries k, i, qx, qy, qz; mesh) with level and cube, each to be joined on these and k.

    reach: k, i, reach, a distance within which each query has some triangle. A triangle has the level whose side is at
    least its extent, a query that whose side is at least its reach. What comes within reach shares a cube at the higher of
    both levels; a large triangle goes some levels lower, into the cubes that its plane meets. So queries at their own level meet the triangles of it and of the levels below, put into its cubes; and
    triangles at their own level meet the queries of lower levels: each join makes only pairs that are compared."""
    grid = cubes(queries, corners(mesh))
    q = queries.join(reach, ["k", "i"]).join(grid, "k").selectExpr("*", "reach * (1 + 1e-6D) + 1e-12D as far")
    q = staged(q.selectExpr("k", "i", *_each("{a} as q{a}"), *_each(f"{_cube('{a} - far')} as u{{a}}"), *_each(f"{_cube('{a} + far')} as v{{a}}"), f"{_level_of('far')} as mine"), "queries")
    rows = q.count()
    corner = {"x": "ax, bx, gx", "y": "ay, by_, gy", "z": "az, bz, gz"}
    t = mesh.join(grid, "k").selectExpr("*", *[f"{f}({corner[a]}) as {n}{a}" for a in _AXES for n, f in (("p", "least"), ("q", "greatest"))])
    normal = {"x": ("by_ - ay", "gz - az", "bz - az", "gy - ay"), "y": ("bz - az", "gx - ax", "bx - ax", "gz - az"), "z": ("bx - ax", "gy - ay", "by_ - ay", "gx - ax")}
    t = t.selectExpr("*", "greatest(qx - px, qy - py, qz - pz) as extent", *[f"({e}) * ({f}) - ({g}) * ({h}) as n{a}" for a, (e, f, g, h) in normal.items()])
    t = staged(t.selectExpr(*mesh.columns, *_each(f"{_cube('p{a}')} as u{{a}}"), *_each(f"{_cube('q{a}')} as v{{a}}"), f"greatest(0, {_level_of('extent')} - {DOWN}) as mine", "lx", "ly", "lz", "side", "nx", "ny", "nz", "extent"), "triangles")
    # of the cubes that a triangle's box meets, those that its plane meets; with room for rounding, as of triangles that are nearly flat
    away = " + ".join(_each("n{a} * ((c{a} + 0.5D) * side * pow(2, level) - (a{a} - l{a}))"))
    meets = f"abs({away}) <= (abs(nx) + abs(ny) + abs(nz)) * side * pow(2, level) * (0.5D + 1e-6D) + 1e-12D * extent * extent * (extent + side * pow(2, level))"
    own = lambda df: df.withColumn("level", F.col("mine"))
    used = lambda df: df.selectExpr("k", "mine as level")
    of_q, of_t = ("k", "i", "qx", "qy", "qz", *_KEY[1:]), (*mesh.columns, *_KEY[1:])
    deal = lambda df, *columns: dealt(df.select(*columns), 4 * rows)
    return [
        (deal(_spread(own(q)), *of_q), deal(_spread(at_levels(t, used(q), "level >= mine")).filter(meets), *of_t)),
        (deal(_spread(at_levels(q, used(t), "level > mine")), *of_q), deal(_spread(own(t)).filter(meets), *of_t)),
    ]
