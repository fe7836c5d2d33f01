"""The distance join: pairs of two point sets within a radius, as an equi-join of grid cells.

Spark plans a bare distance condition as a nested loop over all pairs. Here space is ruled in cells
a little wider than the radius; each point of one side is sent to its own and the adjacent cells,
and the cells are joined by equality with the distance as a residual condition. Every pair meets in
exactly one cell, and how many rows are made follows the density of points, not their number.

Work follows pairs, not bytes, so the points of the side that is sent are dealt out first. Where
the other side fits a broadcast, by id: then neither the files of the table nor a crowded cell
decide how many tasks share the pairs. Otherwise by cell, and in crowded cells by id as well, with
a copy of the other side's points for each part.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.metric import euclidean
from ..sources.points import PointSet

#: Cells are wider than the radius by this share, so rounding at an edge loses no pair.
SLACK = 1e-5
#: Axes that are ruled; each triples the copies of the side that is sent to adjacent cells.
GRID_AXES = 3
#: A cell is crowded from so many points on, and from so large a share of all that CROWDED_CELLS at most can be; it is dealt out in SALTS parts.
CROWDED_POINTS, CROWDED_CELLS, SALTS = 10_000, 20_000, 32


def _fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark, by its own estimate and threshold, would broadcast df."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 < df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def prefixed(points: PointSet, side: str) -> DataFrame:
    return points.df.select(*[F.col(c).alias(f"{side}_{c}") for c in points.df.columns])


def axis_cell(x: Column, width: float, length: float | None) -> Column:
    if length is None:
        return F.floor(x / width)
    n = max(1, math.floor(length / width))
    return F.pmod(F.floor(x * n / length), F.lit(n))


def axis_neighbours(cell: Column, width: float, length: float | None) -> Column:
    """The cells beside and including a cell; on a short periodic axis each once."""
    if length is None:
        return F.array(cell - 1, cell, cell + 1)
    n = max(1, math.floor(length / width))
    return F.array(*[F.pmod(cell + o, F.lit(n)) for o in ((0,), (0, 1), (-1, 0, 1))[min(n, 3) - 1]])


def ruled_axes(points: PointSet, width: float) -> list[int]:
    """The axes that cells rule: the first ones, or of many axes the longest, if cells of the width part them at all."""
    if points.dim <= GRID_AXES:
        return list(range(points.dim))
    if points.periodic:
        return list(range(GRID_AXES))
    extent = points.df.agg(*[(F.max(x) - F.min(x)).alias(x) for x in points.xs]).first()
    long = sorted(((extent[x] or 0.0, -k) for k, x in enumerate(points.xs)), reverse=True)[:GRID_AXES]
    return sorted(-k for length, k in long if length > 2 * width)


def within(a: PointSet, b: PointSet, rmax: float, condition: Column | None = None, strategy: str = "grid", metric: Column | None = None, observe: Observation | None = None) -> DataFrame:
    """The columns of a (with a_) and b (with b_) and r2 for each pair with r2 <= rmax**2, and condition.

    strategy `theta` is the nested loop, for radii as large as the space itself. metric, a Column of
    a_x.. and b_x.., replaces the squared distance; it must not be below the Euclidean one. observe,
    once the result has been used, has the number of pairs as `pairs`.
    """
    a.checked_against(b)
    rmax = abs(float(rmax))
    r2 = euclidean(a.dim, a.box) if metric is None else metric
    left, right = prefixed(a, "a"), prefixed(b, "b")
    near = r2 <= rmax * rmax
    if condition is not None:
        near = near & condition
    axes = ruled_axes(b, rmax) if 0 < rmax < math.inf and strategy != "theta" else []
    if not axes and rmax > 0:
        joined = left.repartition(_tasks(left), "a_id").join(right, near)
    elif rmax == 0:
        same = [F.col(f"a_x{k}") == F.col(f"b_x{k}") for k in range(a.dim)]
        joined = left.join(right, [*same, near])
    else:
        width = rmax * (1 + SLACK)
        keys = [f"_c{k}" for k in axes]
        right = right.select("*", *[axis_cell(F.col(f"b_x{k}"), width, a.box[k]).alias(f"_c{k}") for k in axes])
        small = _fits_broadcast(right)
        if small:
            left = left.repartition(_tasks(left), "a_id")
        for k in axes:
            left = left.withColumn(f"_c{k}", F.explode(axis_neighbours(axis_cell(F.col(f"a_x{k}"), width, a.box[k]), width, a.box[k])))
        if small:
            joined = left.join(F.broadcast(right), keys).where(near).drop(*keys)
        else:
            counts = right.groupBy(*keys).agg(F.count("*").alias("n"))
            total = counts.agg(F.sum("n")).first()[0] or 0
            crowded = F.broadcast(counts.where(F.col("n") >= max(CROWDED_POINTS, total // CROWDED_CELLS)).select(*keys, F.lit(True).alias("_crowded")))  # CROWDED_CELLS rows at most
            parts = F.when(F.col("_crowded"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            part = F.when(F.col("_crowded"), F.pmod(F.xxhash64("a_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
            right = right.join(crowded, keys, "left").withColumn("_part", F.explode(parts)).drop("_crowded")
            left = left.join(crowded, keys, "left").withColumn("_part", part).drop("_crowded")
            joined = left.join(right, [*keys, "_part"]).where(near).drop("_part", *keys)
    joined = joined if observe is None else joined.observe(observe, F.count(F.lit(1)).alias("pairs"))
    return joined.withColumn("r2", r2)


def cells(points: PointSet, width: float) -> PointSet:
    """points with the cell of each of the first axes as further columns c0 .."""
    axes = range(min(points.dim, GRID_AXES))
    df = points.df.select("*", *[axis_cell(F.col(f"x{k}"), width, points.box[k]).alias(f"c{k}") for k in axes])
    return PointSet(df, points.dim, points.n_weights, points.box, (*points.extra, *[f"c{k}" for k in axes]), points.n_values)


def reach(width: float, rmax: float, dim: int) -> list[tuple[int, ...]]:
    """Offsets between cells of a given width that hold points within rmax of each other."""
    steps = math.ceil(rmax / width) + 1
    near = range(-steps, steps + 1)
    axes = min(dim, GRID_AXES)
    return [o for o in itertools.product(near, repeat=axes) if sum(max(abs(x) - 1, 0) ** 2 for x in o) * width * width <= rmax * rmax * (1 + SLACK) ** 2]
