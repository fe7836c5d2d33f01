"""Binned pair sums: the distance join, a key and factors for each pair, and one aggregation.

Spark sums by bin before the shuffle, so what moves is at most one row a bin and task. Every bin of
the scheme is in the result, empty ones with 0.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans.epsjoin import within
from ..sources.points import PointSet
from .binning import Binning
from .counts import collapsed, count


def _keys(binning: Binning) -> list[str]:
    return [f"bin{k}" for k in range(len(binning.axes))]


def all_bins(spark: SparkSession, binning: Binning, full: bool = True) -> DataFrame:
    """Each bin of a scheme once (with ell for a scheme with channels); full includes those below and above the edges."""
    ranges = [range(axis.n + 2) if full else range(1, axis.n + 1) for axis in binning.axes]
    names = _keys(binning) + ["ell"] * bool(binning.channels)
    rows = list(itertools.product(*ranges, *[binning.channels] * bool(binning.channels)))
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))


def paircount(a: PointSet, b: PointSet, binning: Binning, mean_coords: bool = False, full: bool = True, strategy: str = "grid", metric: Column | None = None, observe: Observation | None = None) -> DataFrame:
    """For each bin (bin0 .., and ell): sum1; sum2 if a field is among the two; npairs; and with mean_coords mean0 .. (null for an empty bin).

    sum1 sums the products of both sides' factors (weight, times value for a field; sum1_0 .. for a
    field of several components), sum2 those of the weights alone. metric, a Column of a_x.. and b_x..,
    replaces the squared distance; observe gets the number of pairs within reach as `pairs`.
    """
    if a.periodic and not binning.periodic_directions:
        raise ValueError(f"{type(binning).__name__} takes positions as they are and needs an open box")
    spark = a.df.sparkSession
    fields = bool(a.n_values or b.n_values)
    if binning.countable:
        if fields or mean_coords:
            raise ValueError("counting by cells needs two sets of points and no mean coordinates")
        edges = binning.axes[0].edges.tolist()
        counted = count(a, b, edges, weighted=True, metric=metric, observe=observe).select(F.col("bin").alias("bin0"), F.col("weight0").alias("sum1"), F.col("count").alias("npairs"))
        return _dense(spark, binning, counted, ["sum1", "npairs"], full)
    keys = _keys(binning)
    one, two = a.factors("a"), b.factors("b")
    many = F.lit(1).cast("long")
    if metric is None and observe is None:
        # positions for points: a pair's bins, channels and coordinates follow from the two positions
        one, two = ([F.col(f"{side}_f{k}") for k in range(p.n_values)] or [F.col(f"{side}_w0")] for p, side in ((a, "a"), (b, "b")))
        a, b = collapsed(a), collapsed(b)
        many = F.col("a_n") * F.col("b_n")
    pairs = within(a, b, binning.rmax, strategy=strategy, metric=metric, observe=observe)
    if len(one) > 1 and len(two) > 1 and len(one) != len(two):
        raise ValueError("fields of different sizes")
    width = max(len(one), len(two))
    factors = [one[k % len(one)] * two[k % len(two)] for k in range(width)]
    names = ["sum1"] if width == 1 else [f"sum1_{k}" for k in range(width)]
    coordinates = binning.coordinates(a.dim, a.box)
    computed = pairs.select(
        *[i.alias(k) for i, k in zip(binning.digitize(a.dim, a.box), keys)],
        *[f.alias(n) for f, n in zip(factors, names)],
        *[(F.col("a_w0") * F.col("b_w0")).alias("sum2")] * fields,
        many.alias("npairs"),
        *[w.alias(f"_l{ell}") for w, ell in zip(binning.weights(a.dim, a.box), binning.channels)],
        *[(binning.reported(c) if k == 0 else c).alias(f"mean{k}") for k, c in enumerate(coordinates)] * mean_coords,
    )
    more = ["sum2"] * fields
    if binning.channels:
        aggregated = computed.groupBy(*keys).agg(*[F.sum(F.col(n) * F.col(f"_l{ell}")).alias(f"{n}_l{k}") for n in names for k, ell in enumerate(binning.channels)], *[F.sum(c).alias(c) for c in more], F.sum("npairs").alias("npairs"), *_means(mean_coords, len(coordinates)))
        channels = F.explode(F.array(*[F.struct(F.lit(ell).alias("ell"), *[F.coalesce(f"{n}_l{k}", F.lit(0.0)).alias(n) for n in names]) for k, ell in enumerate(binning.channels)]))
        means = [f"mean{k}" for k in range(len(coordinates))] * mean_coords
        aggregated = aggregated.select(*keys, *more, "npairs", *means, channels.alias("c")).select(*keys, "c.ell", *[F.col(f"c.{n}") for n in names], *more, "npairs", *means)
    else:
        aggregated = computed.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in (*names, *more)], F.sum("npairs").alias("npairs"), *_means(mean_coords, len(coordinates)))
    return _dense(spark, binning, aggregated, [*names, *more, "npairs"], full)


def _means(wanted: bool, n: int) -> list:
    return [(F.sum(F.col(f"mean{k}") * F.col("npairs")) / F.sum("npairs")).alias(f"mean{k}") for k in range(n)] if wanted else []


def _dense(spark: SparkSession, binning: Binning, sums: DataFrame, zero: list[str], full: bool) -> DataFrame:
    bins = all_bins(spark, binning, full)
    joined = bins.join(sums, bins.columns, "left")  # a few rows on either side
    return joined.select(*bins.columns, *[F.coalesce(c, F.lit(0)).cast("long" if c == "npairs" else "double").alias(c) if c in zero else F.col(c) for c in sums.columns if c not in bins.columns])


def norms(a: PointSet, b: PointSet) -> DataFrame:
    """One row: weight, the product of both sums of weights."""
    return a.norm().crossJoin(b.norm().withColumnRenamed("norm", "other")).select((F.col("norm") * F.col("other")).alias("weight"))  # one row each
