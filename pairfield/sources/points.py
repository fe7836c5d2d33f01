"""Point sets: a DataFrame in the fixed form id, x0 .., w0 .. (and v0 .. for sampled fields), with a box.

Coordinates are separate DOUBLE columns, so distances stay inside generated code and column pruning
and push-down work. Rows with a null coordinate, weight or value are not in the set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Box = Sequence[float | None] | float | None


def _floating(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        raise TypeError(f"{name} is {kind.simpleString()}; coordinates and weights are float or double, cast others yourself")
    return F.col(name).cast("double")


def _names(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _box(boxsize: Box, dim: int) -> tuple[float | None, ...]:
    if boxsize is None or isinstance(boxsize, (int, float)):
        boxsize = [boxsize] * dim
    if len(boxsize) != dim:
        raise ValueError(f"boxsize has {len(boxsize)} axes, the points have {dim}")
    if any(b is not None and b <= 0 for b in boxsize):
        raise ValueError("a periodic axis needs a positive length; None means open")
    return tuple(None if b is None else float(b) for b in boxsize)


@dataclass(frozen=True)
class PointSet:
    """Discrete points: df has id, x0 .. x{dim-1}, w0 .. w{n_weights-1} and the columns of extra."""

    df: DataFrame
    dim: int
    n_weights: int = 1
    box: tuple[float | None, ...] = ()
    extra: tuple[str, ...] = ()
    n_values: int = 0

    @classmethod
    def of(cls, df: DataFrame, id: str, pos: str | Sequence[str], weight: str | Sequence[str] | None = None, boxsize: Box = None, dims: int | None = None, extra: Sequence[str] = (), value: str | Sequence[str] | None = None) -> PointSet:
        """A point set from columns of df; pos is a list of columns, or one array column with dims entries. Without weight all weights are 1."""
        if isinstance(pos, str) and isinstance(df.schema[pos].dataType, T.ArrayType):
            if dims is None:
                raise ValueError("an array of coordinates needs dims")
            if not isinstance(df.schema[pos].dataType.elementType, (T.FloatType, T.DoubleType)):
                raise TypeError(f"{pos} doesn't hold float or double")
            coordinates = [F.get(F.col(pos), k).cast("double") for k in range(dims)]
        else:
            coordinates = [_floating(df, c) for c in _names(pos)]
        if not coordinates:
            raise ValueError("points need at least one coordinate")
        weights = [_floating(df, c) for c in _names(weight)] or [F.lit(1.0)]
        values = [_floating(df, c) for c in _names(value)]
        columns = [
            F.col(id).cast("long").alias("id"),
            *[c.alias(f"x{k}") for k, c in enumerate(coordinates)],
            *[c.alias(f"w{k}") for k, c in enumerate(weights)],
            *[c.alias(f"v{k}") for k, c in enumerate(values)],
            *[F.col(c) for c in extra],
        ]
        needed = [f"x{k}" for k in range(len(coordinates))] + [f"w{k}" for k in range(len(_names(weight)))] + [f"v{k}" for k in range(len(values))]
        out = df.select(*columns).where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed]))
        return cls(out, len(coordinates), len(weights), _box(boxsize, len(coordinates)), tuple(extra), len(values))

    @property
    def xs(self) -> list[str]:
        return [f"x{k}" for k in range(self.dim)]

    @property
    def ws(self) -> list[str]:
        return [f"w{k}" for k in range(self.n_weights)]

    @property
    def periodic(self) -> bool:
        return any(b is not None for b in self.box)

    def where(self, condition: Column | str) -> PointSet:
        """The subset that meets a condition; ids, weights and box stay."""
        return replace(self, df=self.df.where(condition))

    def only(self, ids: DataFrame, id: str = "id") -> PointSet:
        """The subset whose ids are listed."""
        return replace(self, df=self.df.join(ids.select(F.col(id).cast("long").alias("id")).distinct(), "id", "left_semi"))

    def norm(self) -> DataFrame:
        """One row: norm, the sum of weights (0 for an empty set)."""
        return self.df.agg(F.coalesce(F.sum("w0"), F.lit(0.0)).alias("norm"))

    def sums(self) -> DataFrame:
        """One row: n and the sum of each weight, 0 for an empty set."""
        return self.df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in self.ws])

    def factors(self, side: str | None = None) -> list[Column]:
        """What a pair multiplies on this side (without one: of a point): the weight, or weight times value for each component of a field."""
        before = "" if side is None else f"{side}_"
        w = F.col(f"{before}w0")
        return [w * F.col(f"{before}v{k}") for k in range(self.n_values)] or [w]

    def checked_against(self, other: PointSet) -> None:
        if self.dim != other.dim:
            raise ValueError(f"{self.dim} and {other.dim} dimensions")
        if self.box != other.box:
            raise ValueError("both point sets need the same box")


class FieldSet(PointSet):
    """A sampled field: points with values v0 ..; a pair sums weight times value."""

    @classmethod
    def of(cls, df: DataFrame, id: str, pos: str | Sequence[str], value: str | Sequence[str], weight: str | Sequence[str] | None = None, **more) -> PointSet:
        return super().of(df, id, pos, weight, value=value, **more)


def _libm(f: Callable[[float], float]) -> Callable[[Column], Column]:
    """f from the C library. The JVM's own sine differs from it in the last bit of about one value in 200, which moves pairs whose angle is an edge of a bin to another bin than SQL's."""

    def each(x: pd.Series) -> pd.Series:
        return pd.Series([f(v) if math.isfinite(v) else math.nan for v in x], dtype=float)

    udf = F.pandas_udf(each, T.DoubleType())
    # NaN comes back as null
    return lambda x: F.when(x.isNotNull(), F.coalesce(udf(x), F.lit(math.nan)))


_sin, _cos = _libm(math.sin), _libm(math.cos)


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    """Degrees to the unit sphere; the first axis is sin(ra) cos(dec), the second cos(ra) cos(dec), the third sin(dec)."""
    a, d = F.radians(ra), F.radians(dec)
    return [_sin(a) * _cos(d), _cos(a) * _cos(d), _sin(d)]


class SkyPointSet(PointSet):
    """Points on the unit sphere; ra and dec stay as columns."""

    @classmethod
    def of(cls, df: DataFrame, id: str, ra: str, dec: str, weight: str | Sequence[str] | None = None, value: str | Sequence[str] | None = None, extra: Sequence[str] = ()) -> PointSet:
        placed = df.withColumns({f"_u{k}": c for k, c in enumerate(unit_vector(_floating(df, ra), _floating(df, dec)))}).withColumn("ra", F.col(ra).cast("double")).withColumn("dec", F.col(dec).cast("double"))
        return super().of(placed, id, [f"_u{k}" for k in range(3)], weight, value=value, extra=("ra", "dec", *extra))


sky_points = SkyPointSet.of


def read_points(spark: SparkSession, path: str, id: str, pos: str | Sequence[str], format: str = "parquet", **more) -> PointSet:
    """A point set from a stored table in any format Spark reads; only its columns are scanned."""
    return PointSet.of(spark.read.format(format).load(path), id, pos, **more)
