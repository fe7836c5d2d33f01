"""Angles, chords and the equal-area RING pixels of the sphere (Gorski et al. 2005) as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_PI = math.pi / 2


def chord(theta: Column) -> Column:
    """The chord of an angle on the unit sphere, both from radians."""
    return F.lit(2.0) * F.sin(theta / 2)


def angle(r: Column) -> Column:
    """The angle, in radians, of a chord of the unit sphere."""
    return F.lit(2.0) * F.asin(r / 2)


def nside2npix(nside: int) -> int:
    return 12 * nside * nside


def _whole(x: Column) -> Column:
    return F.floor(x).cast("long")


def _quotient(a: Column, b: Column | int) -> Column:
    return _whole(a / b)


def ang2pix(nside: int, theta: Column, phi: Column) -> Column:
    """The pixel of a direction (colatitude and longitude in radians)."""
    n = nside
    z, s = F.cos(theta), F.sin(theta)
    quarter = F.pmod(phi / HALF_PI, F.lit(4.0))
    # belt between the caps: rings of 4n pixels, found from the two diagonal coordinates
    up, down = F.lit(float(n)) * (quarter + 0.5), z * (0.75 * n)
    a, b = _whole(up - down), _whole(up + down)
    ring = a - b + (n + 1)
    odd = F.lit(1) - F.pmod(ring, F.lit(2))
    in_ring = F.pmod(_quotient(a + b - n + odd + 1, 2), F.lit(4 * n))
    belt = F.lit(2 * n * (n - 1)) + (ring - 1) * (4 * n) + in_ring
    # caps: ring i has 4i pixels
    high = F.abs(z)
    into = quarter - F.floor(quarter)
    t = F.when(high > 0.99, F.lit(float(n)) * s / F.sqrt((high + 1) / 3)).otherwise(F.lit(float(n)) * F.sqrt((F.lit(1.0) - high) * 3))
    i = _whole(into * t) + _whole((F.lit(1.0) - into) * t) + 1
    at = F.pmod(_whole(quarter * i), i * 4)
    cap = F.when(z > 0, i * (i - 1) * 2 + at).otherwise(F.lit(12 * n * n) - i * (i + 1) * 2 + at)
    return F.when((z > -2 / 3) & (z < 2 / 3), belt).otherwise(cap).cast("long")


def pix2ang(nside: int, pix: Column) -> tuple[Column, Column]:
    """Colatitude and longitude, in radians, of a pixel's centre."""
    n, npix, ncap = nside, nside2npix(nside), 2 * nside * (nside - 1)
    pix = pix.cast("long")

    def cap(p: Column, from_south: bool) -> tuple[Column, Column]:
        q = (F.lit(npix) - p) if from_south else p
        ring = _quotient(_whole(F.sqrt(q * 2 - 1 if from_south else q * 2 + 1)) + 1, 2)
        at = ring * 4 + 1 - (q - ring * (ring - 1) * 2) if from_south else p + 1 - ring * (ring - 1) * 2
        z = (ring * ring * 4) / F.lit(float(npix))
        return (z - 1 if from_south else F.lit(1.0) - z), (at - 0.5) * HALF_PI / ring

    q = pix - ncap
    ring, at = _quotient(q, 4 * n) + n, F.pmod(q, F.lit(4 * n)) + 1
    half = (F.pmod(ring + n, F.lit(2)) + 1) * 0.5
    belt = ((F.lit(2 * n) - ring) * (8.0 * n) / npix, (at - half) * HALF_PI / n)
    north, south = cap(F.least(pix, F.lit(max(ncap - 1, 0))), False), cap(F.greatest(pix, F.lit(npix - ncap)), True)
    pick = lambda k: F.when(pix < ncap, north[k]).when(pix < npix - ncap, belt[k]).otherwise(south[k])
    return F.acos(pick(0)), pick(1)


def radec2pix(nside: int, ra: Column, dec: Column) -> Column:
    return ang2pix(nside, F.radians(F.lit(90.0) - dec), F.radians(ra))


def pix2radec(nside: int, pix: Column) -> tuple[Column, Column]:
    theta, phi = pix2ang(nside, pix)
    return F.degrees(phi), F.lit(90.0) - F.degrees(theta)
