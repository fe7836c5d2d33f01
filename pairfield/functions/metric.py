"""Distances as Columns, summed over the axes from the first to the last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def apart(a: Column, b: Column, length: float | None) -> Column:
    """|a - b|, on a periodic axis by the nearest image."""
    d = F.abs(a - b)
    return d if length is None else F.when(d > length / 2, F.lit(length) - d).otherwise(d)


def signed(a: Column, b: Column, length: float | None) -> Column:
    """a - b, on a periodic axis by the nearest image."""
    d = a - b
    return d if length is None else F.when(d > length / 2, d - length).when(d < -length / 2, d + length).otherwise(d)


def squared(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * p for p in parts])


def pair_columns(dim: int) -> tuple[list[Column], list[Column]]:
    return [F.col(f"a_x{k}") for k in range(dim)], [F.col(f"b_x{k}") for k in range(dim)]


def euclidean(dim: int, box: tuple[float | None, ...]) -> Column:
    """r squared of a joined pair (columns a_x.. and b_x..)."""
    a, b = pair_columns(dim)
    return squared([apart(x, y, length) for x, y, length in zip(a, b, box)])


def edges_below(x: Column, edges: list[float]) -> Column:
    """How many of the ascending edges are strictly below x: a tree of comparisons, so each row makes about log2(n)."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x > F.lit(float(edges[middle])), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(edges))


def legendre(n: int, mu: Column) -> Column:
    """P_n(mu) by the three-term recurrence."""
    previous, current = F.lit(1.0), mu
    if n == 0:
        return previous
    for k in range(1, n):
        previous, current = current, (F.lit(2.0 * k + 1) * mu * current - F.lit(float(k)) * previous) / F.lit(k + 1.0)
    return current
