"""Kernel sums: for each target the sum over sources within r_cut of mass times a kernel of distance and difference.

Exact by default. With eta > 0, a cell of sources that lies wholly within r_cut and looks small from
a target (extent squared below eta squared times the nearest distance squared) acts as one mass at
its centre of mass.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metric import signed, squared
from ..plans.epsjoin import cells, prefixed, reach, within
from ..sources.points import PointSet

#: A kernel takes r and the differences (source minus target) and gives one Column an axis.
Kernel = Callable[[Column, list[Column]], list[Column]]


def count_kernel() -> Kernel:
    """1 on each axis: the mass within r_cut."""
    return lambda r, dx: [F.lit(1.0) for _ in dx]


def plummer_kernel(a: float = 0.0) -> Kernel:
    """dx / (r^2 + a^2)^1.5, and 0 at r = 0."""

    def kernel(r: Column, dx: list[Column]) -> list[Column]:
        s = r * r + a * a
        return [F.when(r > 0, d / (F.when(r > 0, s) * F.sqrt(s))).otherwise(F.lit(0.0)) for d in dx]

    return kernel


KERNELS: dict[str, Callable[..., Kernel]] = {"count": count_kernel, "plummer": plummer_kernel}


def force(targets: PointSet, sources: PointSet, kernel: Kernel, r_cut: float, eta: float = 0.0) -> DataFrame:
    """id and f0 .. of each target, 0 where no source is within r_cut (inclusive); a source's mass is its first weight."""
    axes = range(targets.dim)
    if eta > 0 and not targets.periodic:
        terms = _by_cells(targets, sources, kernel, r_cut, eta)
    else:
        pairs = within(targets, sources, r_cut)
        dx = [signed(F.col(f"b_x{k}"), F.col(f"a_x{k}"), targets.box[k]) for k in axes]
        terms = pairs.select(F.col("a_id").alias("id"), *[(F.col("b_w0") * f).alias(f"f{k}") for k, f in enumerate(kernel(F.sqrt("r2"), dx))])
    sums = terms.groupBy("id").agg(*[F.sum(f"f{k}").alias(f"f{k}") for k in axes])
    return targets.df.select("id").join(sums, "id", "left").select("id", *[F.coalesce(f"f{k}", F.lit(0.0)).alias(f"f{k}") for k in axes])


def _by_cells(targets: PointSet, sources: PointSet, kernel: Kernel, r_cut: float, eta: float) -> DataFrame:
    targets.checked_against(sources)
    dims = range(targets.dim)
    width = r_cut / 4
    ruled = cells(sources, width)
    offsets = reach(width, r_cut, targets.dim)
    axes = range(len(offsets[0]))
    summary = ruled.df.groupBy(*[f"c{k}" for k in axes]).agg(F.sum("w0").alias("m"), *[F.try_divide(F.sum(F.col("w0") * F.col(x)), F.sum("w0")).alias(f"cm{k}") for k, x in enumerate(sources.xs)], *[f(x).alias(f"{n}{k}") for k, x in enumerate(sources.xs) for n, f in (("lo", F.min), ("hi", F.max))])
    steps = F.broadcast(targets.df.sparkSession.createDataFrame(offsets, ", ".join(f"o{k} long" for k in axes)))  # a fixed number of offsets
    sent = prefixed(cells(targets, width), "a").crossJoin(steps).withColumns({f"t{k}": F.col(f"a_c{k}") + F.col(f"o{k}") for k in axes})
    met = sent.join(summary, [F.col(f"t{k}") == F.col(f"c{k}") for k in axes])
    x = [F.col(f"a_x{k}") for k in dims]
    near = squared([F.greatest(F.lit(0.0), F.col(f"lo{k}") - x[k], x[k] - F.col(f"hi{k}")) for k in dims])
    far = squared([F.greatest(F.abs(F.col(f"lo{k}") - x[k]), F.abs(F.col(f"hi{k}") - x[k])) for k in dims])
    extent = reduce(lambda a, b: a + b, [F.col(f"hi{k}") - F.col(f"lo{k}") for k in dims])
    met = met.withColumn("one", (far <= r_cut * r_cut) & (extent * extent < eta * eta * near)).where(near <= r_cut * r_cut)
    dx = [F.col(f"cm{k}") - x[k] for k in dims]
    lumped = met.where("one").select(F.col("a_id").alias("id"), *[(F.col("m") * f).alias(f"f{k}") for k, f in enumerate(kernel(F.sqrt(squared(dx)), dx))])
    pairs = met.where("NOT one").select("a_id", *[f"a_x{k}" for k in dims], *[f"c{k}" for k in axes]).join(ruled.df, [f"c{k}" for k in axes])
    dx = [F.col(f"x{k}") - x[k] for k in dims]
    r2 = squared(dx)
    single = pairs.where(r2 <= r_cut * r_cut).select(F.col("a_id").alias("id"), *[(F.col("w0") * f).alias(f"f{k}") for k, f in enumerate(kernel(F.sqrt(r2), dx))])
    return lumped.unionByName(single)
