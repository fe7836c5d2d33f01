"""Chunks of a point set of a bounded size, close points together; and summaries by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.epsjoin import cells
from ..sources.points import PointSet


def cell_sums(points: PointSet, width: float) -> DataFrame:
    """c0 .., n, the sum of each weight and the bounds of the points of each cell that has any."""
    ruled = cells(points, width)
    keys = [c for c in ruled.df.columns if c[0] == "c" and c[1:].isdigit()]
    return ruled.df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(w).alias(w) for w in points.ws], *[f(x).alias(f"{x}_{m}") for x in points.xs for m, f in (("min", F.min), ("max", F.max))])


def make_forest(points: PointSet, chunksize: int, width: float) -> DataFrame:
    """id, c0 .. and chunk: the points of each cell in chunks of at most chunksize points, numbered from 0 within the cell."""
    if chunksize < 1:
        raise ValueError("chunksize is 1 or more")
    ruled = cells(points, width)
    keys = [c for c in ruled.df.columns if c[0] == "c" and c[1:].isdigit()]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*points.xs, "id")) - 1
    return ruled.df.select("id", *keys, F.floor(place / chunksize).alias("chunk"))
