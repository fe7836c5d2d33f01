"""Binning schemes: what key a pair is counted under, as Columns.

Bins are (low, high], numbered 1 to N in each dimension; 0 holds what is at or below the first edge
and N + 1 what is above the last. Even spacing, linear or in log10, is recognised with NumPy's
allclose (or given) and uses one ceil; other edges are searched.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.metric import edges_below, legendre, pair_columns, squared
from ..functions.sky import angle


class Axis:
    """One dimension of bins."""

    def __init__(self, name: str, edges: Sequence[float], spacing: str | None = None):
        self.name, self.edges = name, np.asarray(edges, float)
        if self.edges.ndim != 1 or len(self.edges) < 2 or (np.diff(self.edges) <= 0).any():
            raise ValueError("edges are two or more ascending numbers")
        self.n = len(self.edges) - 1
        self.centers = (self.edges[1:] + self.edges[:-1]) / 2
        steps = np.diff(self.edges)
        if spacing is None:
            spacing = "linear" if np.allclose(steps, steps[0]) else "irregular"
            if spacing == "irregular" and self.edges[0] > 0 and np.allclose(np.diff(np.log10(self.edges)), np.log10(self.edges[1] / self.edges[0])):
                spacing = "log"
        if spacing not in ("linear", "log", "irregular"):
            raise ValueError(spacing)
        self.spacing = spacing

    def index(self, x: Column) -> Column:
        """The bin of x, an integer from 0 to n + 1."""
        low, high = float(self.edges[0]), float(self.edges[-1])
        if self.spacing == "linear":
            i = F.ceil((x - low) * (self.n / (high - low)))
        elif self.spacing == "log":
            positive = F.when(x == 0, F.lit(0.9 * low)).otherwise(x)
            i = F.ceil(F.log10(positive / low) * (self.n / np.log10(high / low)))
        else:
            i = edges_below(x, self.edges.tolist())
        return F.least(F.greatest(i, F.lit(0)), F.lit(self.n + 1)).cast("int")


class Binning:
    """Base of all schemes; a subclass sets axes and says the coordinates of a pair.

    A pair is a row with a_x.., b_x.. (the two positions) and r2. channels, if not empty, names the
    extra sums kept for each bin; weights() then gives each channel's factor.
    """

    axes: tuple[Axis, ...] = ()
    channels: tuple[int, ...] = ()
    #: Whether counts of whole cells at once give the same (radial bins only).
    countable = False
    #: Whether the signed directions follow a periodic box.
    periodic_directions = True

    @property
    def rmax(self) -> float:
        return float(self.axes[0].edges[-1])

    def coordinates(self, dim: int, box: tuple[float | None, ...]) -> list[Column]:
        raise NotImplementedError

    def weights(self, dim: int, box: tuple[float | None, ...]) -> list[Column]:
        return []

    def digitize(self, dim: int, box: tuple[float | None, ...]) -> list[Column]:
        return [axis.index(x) for axis, x in zip(self.axes, self.coordinates(dim, box), strict=True)]

    def reported(self, coordinate: Column) -> Column:
        """How the first coordinate's mean is reported."""
        return coordinate


def _r() -> Column:
    return F.sqrt("r2")


def _mu_axis(n: int, low: float, high: float) -> Axis:
    if not (-1 <= low < high <= 1):
        raise ValueError("mu is within -1 and 1")
    return Axis("mu", np.linspace(low, high, n + 1), "linear")


class RBinning(Binning):
    """Separation; a pair at the first edge (a point with itself, if that is 0) is below it."""

    def __init__(self, edges: Sequence[float], spacing: str | None = None):
        self.axes = (Axis("r", edges, spacing),)

    def coordinates(self, dim, box):
        return [_r()]


class FastRBinning(RBinning):
    """Separation, counted by whole cells where possible; nothing is kept above the last edge."""

    countable = True


class _Midpoint(Binning):
    """Directions to the midpoint of a pair from an observer; positions are taken as they are."""

    periodic_directions = False

    def __init__(self, observer: Sequence[float] | None = None):
        self.observer = observer

    def parts(self, dim: int) -> tuple[Column, Column, Column]:
        """d . c, |d| squared and |c|, for d the difference and c the midpoint from the observer."""
        a, b = pair_columns(dim)
        eye = [0.0] * dim if self.observer is None else [float(o) for o in self.observer]
        c = [(x + y) * 0.5 - o for x, y, o in zip(a, b, eye)]
        d = [x - y for x, y in zip(a, b)]
        dot = d[0] * c[0]
        for x, y in zip(d[1:], c[1:]):
            dot = dot + x * y
        return dot, squared(d), F.sqrt(squared(c))


def _mu(dot: Column, along: Column) -> Column:
    """The cosine, and 10 (above every edge) where it has no direction."""
    return F.when(along != 0, dot / F.when(along != 0, along)).otherwise(F.lit(10.0))


class RmuBinning(_Midpoint):
    """Separation and the cosine with the line of sight to the midpoint."""

    def __init__(self, rbins: Sequence[float], Nmu: int, observer: Sequence[float] | None = None, mu_min: float = -1, mu_max: float = 1, absmu: bool = False):
        super().__init__(observer)
        self.axes = (Axis("r", rbins), _mu_axis(Nmu, mu_min, mu_max))
        self.folded = absmu and mu_min >= 0

    def coordinates(self, dim, box):
        dot, _, length = self.parts(dim)
        mu = _mu(dot, _r() * length)
        return [_r(), F.abs(mu) if self.folded else mu]


class XYBinning(_Midpoint):
    """Separation across the line of sight and along it: Nbins - 1 by 2 Nbins - 1 bins up to Rmax, for pairs within Rmax."""

    def __init__(self, Rmax: float, Nbins: int, observer: Sequence[float] | None = None):
        super().__init__(observer)
        self.axes = (Axis("sky", np.linspace(0, Rmax, Nbins), "linear"), Axis("los", np.linspace(-Rmax, Rmax, 2 * Nbins), "linear"))

    def coordinates(self, dim, box):
        dot, d2, length = self.parts(dim)
        los = F.when(length != 0, dot / F.when(length != 0, length)).otherwise(F.lit(0.0))
        return [F.sqrt(F.abs(d2 - los * los)), los]


class MultipoleBinning(_Midpoint):
    """Separation, with a channel (2l + 1) P_l(mu) for each l; a pair at r = 0 has no direction and counts for l = 0 alone."""

    def __init__(self, rbins: Sequence[float], ells: Sequence[int]):
        super().__init__()
        self.axes, self.channels = (Axis("r", rbins),), tuple(ells)

    def mu(self, dim, box) -> Column:
        dot, _, length = self.parts(dim)
        along = _r() * length
        return F.when(along != 0, dot / F.when(along != 0, along))

    def coordinates(self, dim, box):
        return [_r()]

    def weights(self, dim, box):
        mu = self.mu(dim, box)
        return [F.lit(2.0 * n + 1) * (legendre(n, mu) if n else F.lit(1.0)) for n in self.channels]


def _parallel(los: int, box: tuple[float | None, ...]) -> Column:
    """The signed difference along one axis, by the nearest image."""
    d, length = F.col(f"a_x{los}") - F.col(f"b_x{los}"), box[los]
    return d if length is None else F.when(d > length / 2, d - length).when(d <= -length / 2, d + length).otherwise(d)


class FlatSkyMultipoleBinning(MultipoleBinning):
    """Multipoles with one axis as the line of sight."""

    periodic_directions = True

    def __init__(self, rbins: Sequence[float], ells: Sequence[int], los: int):
        super().__init__(rbins, ells)
        self.los = los

    def mu(self, dim, box):
        return F.when(_r() != 0, _parallel(self.los, box) / F.when(_r() != 0, _r()))


class FlatSkyBinning(Binning):
    """Separation and the cosine with one axis."""

    def __init__(self, rbins: Sequence[float], Nmu: int, los: int, mu_min: float = -1, mu_max: float = 1, absmu: bool = False):
        self.axes = (Axis("r", rbins), _mu_axis(Nmu, mu_min, mu_max))
        self.los, self.folded = los, absmu and mu_min >= 0

    def coordinates(self, dim, box):
        mu = _mu(_parallel(self.los, box), _r())
        return [_r(), F.abs(mu) if self.folded else mu]


class AngularBinning(RBinning):
    """Angles in degrees between points on the unit sphere, binned by their chords."""

    def __init__(self, angles: Sequence[float], spacing: str | None = None):
        super().__init__(2 * np.sin(np.radians(np.asarray(angles, float)) / 2), spacing)
        self.angular_edges = np.degrees(2 * np.arcsin(self.axes[0].edges / 2))
        self.angular_centers = np.degrees(2 * np.arcsin(self.axes[0].centers / 2))

    def reported(self, coordinate):
        return F.degrees(angle(coordinate))


class FastAngularBinning(AngularBinning):
    """Angles, counted by whole cells where possible."""

    countable = True
