"""Counts and weight sums in half-open boxes [min, max).

One box is a filter. Many boxes go down a hierarchy of cells over the first two axes, each level's
cells BRANCH times as narrow as those above: cells wholly inside a box count at once, cells outside
leave, and only cells that a box cuts are joined, by equality, with the cells in them on the next
level, and on the finest with their points. Box sizes of a periodic set are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.points import PointSet
from .components import stored

#: Cells of a level along an axis in each cell of the level above, levels there are at most, and points that cells of the finest hold.
BRANCH, LEVELS, LEAF = 8, 6, 32


def _each(value: float | Sequence[float], dim: int) -> list[float]:
    values = [float(value)] * dim if isinstance(value, (int, float)) else [float(v) for v in value]
    if len(values) != dim:
        raise ValueError(f"a box of {len(values)} axes for points of {dim}")
    return values


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def integrate(points: PointSet, low: float | Sequence[float], high: float | Sequence[float]) -> DataFrame:
    """One row: count and weight0 .. of the points in the box."""
    low, high = _each(low, points.dim), _each(high, points.dim)
    inside = _all([(F.col(f"x{k}") >= F.lit(low[k])) & (F.col(f"x{k}") < F.lit(high[k])) for k in range(points.dim)])
    found = points.where(inside).df
    return found.agg(F.count("*").alias("count"), *[F.coalesce(F.sum(w), F.lit(0.0)).alias(f"weight{k}") for k, w in enumerate(points.ws)])


def integrate_many(points: PointSet, boxes: DataFrame, id: str, lows: Sequence[str], highs: Sequence[str]) -> DataFrame:
    """The id of each row of boxes with count and weight0 .. of the points in it; an empty box has 0."""
    if len(lows) != points.dim or len(highs) != points.dim:
        raise ValueError("a box needs a low and a high for each axis")
    boxes = boxes.select(F.col(id).alias("box"), *[F.col(c).cast("double").alias(f"l{k}") for k, c in enumerate(lows)], *[F.col(c).cast("double").alias(f"h{k}") for k, c in enumerate(highs)])
    axes = range(min(points.dim, 2))
    extent = points.df.agg(*[f(f"x{k}").alias(f"{n}{k}") for k in axes for n, f in (("from", F.min), ("to", F.max))]).first()

    def cell(k: int, n: int) -> Column:
        low, high = extent[f"from{k}"], extent[f"to{k}"]
        if low is None or not high > low:
            return F.lit(0)
        return F.least(F.floor((F.col(f"x{k}") - low) / (high - low) * n), F.lit(n - 1)).cast("int")

    keys, dims = [f"c{k}" for k in axes], range(points.dim)
    bounds = [f"{x}{k}" for x in "lh" for k in dims]
    sums = [f"weight{k}" for k in range(points.n_weights)]
    meets = _all([(F.col(f"hi{k}") >= F.col(f"l{k}")) & (F.col(f"lo{k}") < F.col(f"h{k}")) for k in dims])
    inside = _all([(F.col(f"lo{k}") >= F.col(f"l{k}")) & (F.col(f"hi{k}") < F.col(f"h{k}")) for k in dims])
    rest, found = boxes.select("*", *[F.lit(0).alias(f"q{k}") for k in axes]), []
    for level in range(1, LEVELS + 1):
        ruled = points.df.select("*", *[cell(k, BRANCH**level).alias(f"c{k}") for k in axes])
        summary = ruled.groupBy(*keys).agg(F.count("*").alias("count"), *[F.sum(w).alias(n) for w, n in zip(points.ws, sums)], *[f(f"x{k}").alias(f"{n}{k}") for k in dims for n, f in (("lo", F.min), ("hi", F.max))])
        summary = summary.withColumns({f"q{k}": F.floor(F.col(f"c{k}") / BRANCH).cast("int") for k in axes})
        # BRANCH ** 2 cells on the first level
        met = rest.join(F.broadcast(summary) if level == 1 else summary, [f"q{k}" for k in axes]).where(meets).select("box", *bounds, *keys, "count", *sums, inside.alias("whole"))
        met, _ = stored(met)
        found.append(met.where("whole").select("box", "count", *sums))
        cut = met.where("NOT whole")
        left = cut.agg(F.count("*").alias("cells"), F.coalesce(F.sum("count"), F.lit(0)).alias("points")).first()
        if not left["cells"]:
            break
        if left["points"] <= LEAF * left["cells"] or level == LEVELS:
            within = _all([(F.col(f"x{k}") >= F.col(f"l{k}")) & (F.col(f"x{k}") < F.col(f"h{k}")) for k in dims])
            found.append(cut.select("box", *bounds, *keys).join(ruled, keys).where(within).select("box", F.lit(1).cast("long").alias("count"), *[F.col(w).alias(n) for w, n in zip(points.ws, sums)]))
            break
        rest = cut.select("box", *bounds, *[F.col(f"c{k}").alias(f"q{k}") for k in axes])
    total = reduce(DataFrame.unionByName, found).groupBy("box").agg(F.sum("count").alias("count"), *[F.sum(n).alias(n) for n in sums])
    return boxes.select("box").join(total, "box", "left").select(F.col("box").alias(id), F.coalesce("count", F.lit(0)).cast("long").alias("count"), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in sums])
