"""Correlation estimators from binned pair sums."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(keys: list[str], **sums: DataFrame) -> DataFrame:
    out = None
    for name, df in sums.items():
        one = df.select(*keys, F.col("sum1").alias(name))
        out = one if out is None else out.join(one, keys)  # a row a bin
    return out


def natural(dd: DataFrame, rr: DataFrame, keys: Sequence[str] = ("bin0",), scale: float = 1.0) -> DataFrame:
    """DD / RR - 1, with RR multiplied by scale (the ratio of the weights); null where RR is 0."""
    return _joined(list(keys), dd=dd, rr=rr).select(*keys, (F.try_divide("dd", F.col("rr") * scale) - 1).alias("xi"))


def davis_peebles(dd: DataFrame, dr: DataFrame, keys: Sequence[str] = ("bin0",), scale: float = 1.0) -> DataFrame:
    """DD / DR - 1."""
    return _joined(list(keys), dd=dd, dr=dr).select(*keys, (F.try_divide("dd", F.col("dr") * scale) - 1).alias("xi"))


def landy_szalay(dd: DataFrame, dr: DataFrame, rr: DataFrame, ratio: float | Column = 1.0, keys: Sequence[str] = ("bin0",)) -> DataFrame:
    """(DD - 2 r DR + r^2 RR) / (r^2 RR), r the ratio of the weight of data to that of randoms."""
    r = F.lit(ratio) if isinstance(ratio, (int, float)) else ratio
    joined = _joined(list(keys), dd=dd, dr=dr, rr=rr)
    return joined.select(*keys, F.try_divide(F.col("dd") - F.lit(2.0) * r * F.col("dr") + r * r * F.col("rr"), r * r * F.col("rr")).alias("xi"))


def field_mean(sums: DataFrame, keys: Sequence[str] = ("bin0",)) -> DataFrame:
    """sum1 / sum2 of each bin; null for an empty one."""
    return sums.select(*keys, F.try_divide("sum1", "sum2").alias("xi"))


def analytic_rr(edges: DataFrame, n: float, volume: float) -> DataFrame:
    """bin and the expected pairs of n random points in a periodic volume, for the shells between low and high."""
    return edges.select("bin", ((F.col("high") * F.col("high") * F.col("high") - F.col("low") * F.col("low") * F.col("low")) * (4 * math.pi / 3) * n * (n / volume)).alias("rr"))
