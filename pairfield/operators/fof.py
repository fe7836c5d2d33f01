"""Friends of friends: the connected components of points within a linking length.

Points are put in cells so small that all points of a cell are friends; components are then found
for cells. Two cells are linked at once if the bounds of their points say that all are close, and
are no friends if none can be; only cells that the bounds leave open, and that links of the first
kind haven't put together already, are looked at as points, and give one edge each. In a clump that
is hardly any. Labels are the least id of the component.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metric import squared
from ..plans.epsjoin import GRID_AXES, axis_cell, reach, within
from ..sources.points import PointSet
from .components import connected_components, stored

#: Names that other implementations give their variants; all find the same components.
METHODS = ("splay", "allpairs", "prefernodes", "unsafe", "heuristics", "linkedlist")


def fof_labels(points: PointSet, linking_length: float, active: DataFrame | None = None, method: str = "splay", strategy: str = "auto", observe: Observation | None = None) -> DataFrame:
    """id and label of every point; r <= linking_length links. With active (ids), other points keep their own id as label.

    In an open box of up to three axes observe gets the pairs of cells that may hold friends as
    `cells`, and those of them that their bounds link as `sure`.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    everyone = points.df.select("id")
    linked = points if active is None else points.only(active)
    ll = abs(float(linking_length))
    axes = range(points.dim)
    if ll > 0:
        # the half-diagonal argument needs every axis ruled; the tiny margin covers rounding of distances
        side = ll / math.sqrt(points.dim) * (1 - 1e-9)
        keys = [axis_cell(F.col(f"x{k}"), side, points.box[k]) if points.box[k] is None else F.floor(F.col(f"x{k}") * math.ceil(points.box[k] / side) / points.box[k]) for k in axes]
    else:
        keys = [F.col(f"x{k}") for k in axes]
    cell = linked.df.select("*", *[c.alias(f"g{k}") for k, c in enumerate(keys)])
    names = [f"g{k}" for k in axes]
    heads = cell.groupBy(*names).agg(F.min("id").alias("head"))
    placed = cell.join(heads, names).drop(*names)
    if points.periodic or points.dim > GRID_AXES or not ll > 0:
        nodes = PointSet(placed, points.dim, points.n_weights, points.box, (*points.extra, "head"), points.n_values)
        edges = within(nodes, nodes, ll, F.col("a_head") < F.col("b_head")).select(F.col("a_head").alias("a"), F.col("b_head").alias("b")).distinct()
    else:
        edges = _cell_links(cell.join(heads, names), points.dim, ll, side, strategy, observe)
    roots = connected_components(edges, strategy)
    labels = placed.select("id", "head").join(roots.withColumnRenamed("node", "head"), "head", "left").select("id", F.coalesce("root", "head").alias("label"))
    return labels if active is None else everyone.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _cell_links(placed: DataFrame, dim: int, ll: float, side: float, strategy: str, observe: Observation | None) -> DataFrame:
    """Edges (a, b) between the heads of cells that hold friends; enough of them for the components. placed has x0 .., g0 .. (the cell) and head."""
    spark, axes = placed.sparkSession, range(dim)
    names = [f"g{k}" for k in axes]
    cells, _ = stored(placed.groupBy(*names, "head").agg(*[f(f"x{k}").alias(f"{n}{k}") for k in axes for n, f in (("lo", F.min), ("hi", F.max))]))
    ahead = [o for o in reach(side, ll, dim) if o > (0,) * dim]  # each two cells once
    steps = F.broadcast(spark.createDataFrame(ahead, ", ".join(f"o{k} long" for k in axes)))  # a fixed number of offsets
    left = cells.select(*[F.col(c).alias(f"a_{c}") for c in cells.columns]).crossJoin(steps)
    met = left.join(cells, [F.col(f"a_g{k}") + F.col(f"o{k}") == F.col(f"g{k}") for k in axes])
    apart = [F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"a_hi{k}"), F.col(f"a_lo{k}") - F.col(f"hi{k}")) for k in axes]
    extent = [F.greatest(F.abs(F.col(f"hi{k}") - F.col(f"a_lo{k}")), F.abs(F.col(f"a_hi{k}") - F.col(f"lo{k}"))) for k in axes]
    met = met.select(F.col("a_head").alias("a"), F.col("head").alias("b"), squared(apart).alias("near"), squared(extent).alias("far")).where(F.col("near") <= ll * ll)
    met = met.select("a", "b", (F.col("far") <= ll * ll).alias("sure"))
    met, _ = stored(met if observe is None else met.observe(observe, F.count(F.lit(1)).alias("cells"), F.count_if("sure").alias("sure")))
    sure, open_ = met.where("sure").select("a", "b"), met.where("NOT sure").select("a", "b")
    roots = connected_components(sure, strategy)
    label = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    open_ = open_.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    one, two = (placed.select(F.col("head").alias(s), *[F.col(f"x{k}").alias(f"{s}_x{k}") for k in axes]) for s in "ab")
    r2 = squared([F.abs(F.col(f"a_x{k}") - F.col(f"b_x{k}")) for k in axes])
    resolved = open_.join(one, "a").join(two, "b").where(r2 <= ll * ll).select("a", "b").distinct()
    return sure.unionByName(resolved)


def fof_runs(df: DataFrame, by: list[str], x: str, linking_length: float, id: str) -> DataFrame:
    """id and label of one-dimensional points, apart for each group of by: a gap wider than the linking length starts a new component."""
    order = W.partitionBy(*by).orderBy(x, "id")
    gap = F.col(x) - F.lag(x).over(order)
    run = df.withColumn("id", F.col(id)).select(*by, x, "id", (gap.isNull() | (gap * gap > linking_length * linking_length)).cast("int").alias("starts"))
    run = run.withColumn("run", F.sum("starts").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return run.select("id", F.min("id").over(W.partitionBy(*by, "run")).alias("label"))


@dataclass(frozen=True)
class Catalogue:
    """Groups numbered by descending length (equal lengths by least id): groups has label, root, length, offset; members has id, label."""

    points: PointSet
    groups: DataFrame
    members: DataFrame

    def find(self, label: int) -> DataFrame:
        """The ids of a group."""
        return self.members.where(F.col("label") == label).select("id")

    def indices(self) -> DataFrame:
        """position and id of all points, group after group."""
        order = W.partitionBy("label").orderBy("id")
        return self.members.join(self.groups.select("label", "offset"), "label").select((F.col("offset") + F.row_number().over(order) - 1).alias("position"), "id")

    def sum(self, weight: str = "w0") -> DataFrame:
        """label and the sum of a weight column over each group."""
        return self.members.join(self.points.df, "id").groupBy("label").agg(F.sum(weight).alias("sum"))

    def center(self, weight: str = "w0") -> DataFrame:
        """label and the weighted mean of each coordinate, taken as it is even in a periodic box."""
        means = [F.try_divide(F.sum(F.col(weight) * F.col(x)), F.sum(weight)).alias(x) for x in self.points.xs]
        return self.members.join(self.points.df, "id").groupBy("label").agg(*means)


def fof(points: PointSet, linking_length: float, strategy: str = "auto") -> Catalogue:
    """The catalogue of groups of a point set.

    Numbers come from counts of groups by length, which are few, and from row numbers within parts
    of a length, so no task sorts all groups.
    """
    found = fof_labels(points, linking_length, strategy=strategy)
    groups = found.groupBy(F.col("label").alias("root")).agg(F.count("*").alias("length"))
    part = F.shiftright("root", 16)  # in order of root
    counted = groups.groupBy("length", part.alias("part")).agg(F.count("*").alias("n"))
    by_length = W.orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    lengths = counted.groupBy("length").agg(F.sum("n").alias("n"))
    lengths = lengths.select("length", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("longer"), F.coalesce(F.sum(F.col("n") * F.col("length")).over(by_length), F.lit(0)).alias("before"))  # distinct lengths are at most the square root of twice the points
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = counted.withColumn("skip", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(lengths, "length").select("length", "part", "skip", "longer", "before")
    rank = F.col("skip") + F.row_number().over(W.partitionBy("length", "part").orderBy("root")) - 1
    ranked = groups.withColumn("part", part).join(parts, ["length", "part"]).withColumn("rank", rank)
    numbered = ranked.select((F.col("longer") + F.col("rank")).alias("label"), "root", "length", (F.col("before") + F.col("rank") * F.col("length")).alias("offset"))
    members = found.join(numbered.select(F.col("root").alias("_root"), F.col("label").alias("_label")), found["label"] == F.col("_root")).select("id", F.col("_label").alias("label"))
    return Catalogue(points, numbered, members)


def with_weights(catalogue: Catalogue, points: PointSet) -> Catalogue:
    """The same groups over another set with the same ids."""
    return replace(catalogue, points=points)
