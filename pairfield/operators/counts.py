"""Counts of pairs by distance, without listing the pairs where whole cells can be counted at once.

Bin i holds r[i-1] < d <= r[i], bin 0 everything up to r[0]; pairs beyond the last edge are dropped.
Points are summed by cell on several levels, each with cells half as wide as the one above (number,
weights, least and greatest coordinate on each axis). Two cells whose points all are in the same bin
of each other, by the bounds of their points, count at once; only those that straddle an edge are
looked at again on the next level, and on the finest level as points. The finest level is where cells
hold about LEAF points. Whether that pays is estimated from the numbers of points and of cells first;
if not, pairs are counted by points from the start. In an open box both ways give the same bins bit by bit, since the distance
bounds are rounded as the distances are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.metric import edges_below, squared
from ..plans.epsjoin import GRID_AXES, axis_cell, cells, reach, within
from ..sources.points import PointSet
from .components import stored

#: Points that a cell of the finest level holds, and levels there are at most.
LEAF, LEVELS = 16, 12
#: Pairs that a join compares in less time than the levels take to set up.
COSTLY = 1_000_000_000


def _squares(edges: Sequence[float]) -> list[float]:
    """Edges for squared distances; a negative edge is below all of them and catches nothing.

    The edge of a square is the greatest number whose rounded root is not above the edge, so a square is in the bin of its root. Above the last edge's own square there is no pair.
    """
    values = [float(e) for e in edges]
    if values != sorted(values):
        raise ValueError("edges ascend")

    def square(e: float) -> float:
        s = e * e
        while s < math.inf and math.sqrt(more := math.nextafter(s, math.inf)) <= e:
            s = more
        return s

    last = values[-1] * values[-1]
    return [min(square(e), last) if e >= 0 else -1.0 for e in values]


def collapsed(points: PointSet) -> PointSet:
    """One point for each distinct position, with n (how many there were) and their weights summed; f0 .. are the sums of what factors() multiplies.

    A pair of positions then stands for all pairs between their points, which have the same distance, so copies make no pairs of their own.
    """
    n = F.sum("n") if "n" in points.extra else F.count("*")
    factors = [F.sum(f).alias(f"f{k}") for k, f in enumerate(points.factors())] if points.n_values else []
    df = points.df.groupBy(*points.xs).agg(F.min("id").alias("id"), n.alias("n"), *[F.sum(w).alias(w) for w in points.ws], *factors)
    return PointSet(df, points.dim, points.n_weights, points.box, ("n", *[f"f{k}" for k in range(len(factors))]))


def count(a: PointSet, b: PointSet, edges: Sequence[float] | float, weighted: bool = False, by_cells: bool | None = None, metric: Column | None = None, observe: Observation | None = None) -> DataFrame:
    """bin, edge, count, and with weighted weight0 .. (sums of products, component by component) for each edge, empty bins included.

    Points of one position count as one with their number. metric, a Column of a_x.. and b_x..,
    replaces the squared distance and has pairs counted by points; so has observe, which gets their
    number as `pairs`.
    """
    a.checked_against(b)
    edges = [float(edges)] if isinstance(edges, (int, float)) else [float(e) for e in edges]
    squares = _squares(edges)
    if weighted and a.n_weights != b.n_weights:
        raise ValueError("weights of different sizes")
    names = [f"weight{k}" for k in range(a.n_weights)] if weighted else []
    if metric is None and observe is None:
        a, b = collapsed(a), collapsed(b)
    spark = a.df.sparkSession
    bins = spark.createDataFrame(list(enumerate(edges)), "bin int, edge double")
    if edges[-1] < 0:
        rows = None
    elif metric is not None or observe is not None:
        rows = _by_points(within(a, b, edges[-1], metric=metric, observe=observe), squares, names)
    elif by_cells if by_cells is not None else (not a.periodic and edges[-1] > 0 and dense(a, b, edges[-1])):
        rows = _by_cells(a, b, edges[-1], squares, names)
    else:
        rows = _by_points(within(a, b, edges[-1]), squares, names)
    if rows is None:
        return bins.select("bin", "edge", F.lit(0).cast("long").alias("count"), *[F.lit(0.0).alias(n) for n in names])
    summed = rows.groupBy("bin").agg(F.sum("count").alias("count"), *[F.sum(n).alias(n) for n in names])
    return bins.join(summed, "bin", "left").select("bin", "edge", F.coalesce("count", F.lit(0)).cast("long").alias("count"), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def _by_points(pairs: DataFrame, squares: list[float], names: list[str]) -> DataFrame:
    many = F.col("a_n") * F.col("b_n") if "a_n" in pairs.columns and "b_n" in pairs.columns else F.lit(1).cast("long")
    binned = pairs.select(edges_below(F.col("r2"), squares).alias("bin"), many.alias("count"), *[(F.col(f"a_w{k}") * F.col(f"b_w{k}")).alias(n) for k, n in enumerate(names)])
    return binned.where(F.col("bin") < len(squares))


def _occupied(points: PointSet, width: float) -> Column:
    """About how many cells of a width have points."""
    return F.approx_count_distinct(F.xxhash64(*[axis_cell(F.col(f"x{k}"), width, None) for k in range(min(points.dim, GRID_AXES))]))


def dense(a: PointSet, b: PointSet, radius: float) -> bool:
    """Whether counting by cells pays: cells of half the radius hold more than LEAF points, and a join would compare more than COSTLY pairs."""
    n = a.df.count()
    m, halves, wholes = b.df.agg(F.count("*"), _occupied(b, radius / 2), _occupied(b, radius)).first()
    return m > LEAF * halves and n * m / max(wholes, 1) * 3 ** min(a.dim, GRID_AXES) > COSTLY


def _summary(points: PointSet, axes: range, side: str) -> DataFrame:
    """The cells of points with their sums and bounds, and p0 ..: the cell of the level above."""
    grouped = points.df.groupBy(*[f"c{k}" for k in axes]).agg(
        F.sum("n").alias("n") if "n" in points.df.columns else F.count("*").alias("n"),
        *[F.sum(w).alias(w) for w in points.ws],
        *[f(x).alias(f"{x}_{name}") for x in points.xs for name, f in (("min", F.min), ("max", F.max))],
    )
    grouped = grouped.withColumns({f"p{k}": F.shiftright(f"c{k}", 1) for k in axes})
    return grouped.select(*[F.col(c).alias(f"{side}_{c}") for c in grouped.columns])


def _bounds(dim: int) -> tuple[Column, Column]:
    """Least and greatest squared distance between the points of two cells."""
    near, far = [], []
    for k in range(dim):
        amin, amax, bmin, bmax = (F.col(f"{s}_x{k}_{m}") for s in "ab" for m in ("min", "max"))
        near.append(F.when(bmin > amax, bmin - amax).when(amin > bmax, amin - bmax).otherwise(F.lit(0.0)))
        far.append(F.greatest(F.abs(bmax - amin), F.abs(amax - bmin)))
    return squared(near), squared(far)


def _by_cells(a: PointSet, b: PointSet, rmax: float, squares: list[float], names: list[str]) -> DataFrame:
    spark = a.df.sparkSession
    offsets = reach(rmax, rmax, a.dim)
    axes = range(len(offsets[0]))
    both = [f"{s}_c{k}" for s in "ab" for k in axes]
    steps = F.broadcast(spark.createDataFrame(offsets, ", ".join(f"o{k} long" for k in axes)))  # a fixed number of offsets
    near, far = _bounds(a.dim)
    width, rest, counted = rmax, None, None
    for level in range(LEVELS):
        one, two = cells(a, width), cells(b, width)
        left, right = _summary(one, axes, "a"), _summary(two, axes, "b")
        if level == 0:
            sent = left.crossJoin(steps).withColumns({f"t{k}": F.col(f"a_c{k}") + F.col(f"o{k}") for k in axes}).drop(*[f"o{k}" for k in axes])
            met = sent.join(right, [F.col(f"t{k}") == F.col(f"b_c{k}") for k in axes])
        else:
            # the cells of the level above are this level's parents
            above = rest.select(*[F.col(c).alias(c.replace("_c", "_p")) for c in both])
            met = above.join(left, [f"a_p{k}" for k in axes]).join(right, [f"b_p{k}" for k in axes])
        # bounds in a step of their own: each is compared with several edges
        met = met.withColumns({"near": near, "far": far}).withColumns({"low": edges_below(F.col("near"), squares), "high": edges_below(F.col("far"), squares)}).where(F.col("low") < len(squares))
        met = met.select(*both, "low", "high", (F.col("a_n") * F.col("b_n")).alias("count"), *[(F.col(f"a_w{k}") * F.col(f"b_w{k}")).alias(n) for k, n in enumerate(names)])
        met, _ = stored(met)
        whole = met.where("low = high").select(F.col("low").alias("bin"), "count", *names)
        counted = whole if counted is None else counted.unionByName(whole)
        rest = met.where("low < high").select(*both)
        pairs = met.where("low < high").agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("pairs")).first()
        if not pairs["n"]:
            return counted
        if pairs["pairs"] <= LEAF * LEAF * pairs["n"] or level + 1 == LEVELS:
            break
        width /= 2
    pa, pb = (p.df.select(*[F.col(c).alias(f"{s}_{c}") for c in p.df.columns]) for p, s in ((one, "a"), (two, "b")))
    points = rest.join(pa, [f"a_c{k}" for k in axes]).join(pb, [f"b_c{k}" for k in axes])
    r2 = squared([F.abs(F.col(f"a_x{k}") - F.col(f"b_x{k}")) for k in range(a.dim)])
    return counted.unionByName(_by_points(points.withColumn("r2", r2), squares, names))
