"""Regions of the sky of about equal area, for the block bootstrap of sky data."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import nside2npix, radec2pix

SKY_SQUARE_DEGREES = 41252.96
#: Pixels up to which the table of regions goes to all tasks.
BROADCAST_PIXELS = 1_000_000


def pixelled(df: DataFrame, nside: int, ra: str = "ra", dec: str = "dec") -> DataFrame:
    return df.withColumn("pix", radec2pix(nside, F.col(ra).cast("double"), F.col(dec).cast("double")))


def merged(areas: list[tuple[int, float]], full: float) -> list[tuple[float, list[int]]]:
    """Regions (area, pixels) of pixels that are given in order with their areas, by ascending area, then by first pixel.

    A pixel joins the region that is smallest so far if both together stay below the full area;
    otherwise it starts a region.
    """
    regions: list[tuple[float, int, list[int]]] = []
    for pixel, area in areas:
        if regions and regions[0][0] + area < full:
            smallest, first, pixels = regions[0]
            heapq.heapreplace(regions, (smallest + area, first, [*pixels, pixel]))
        else:
            heapq.heappush(regions, (area, pixel, [pixel]))
    return [(area, pixels) for area, _, pixels in sorted(regions)]


def sky_regions(randoms: DataFrame, nside: int, density: float, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """pix, region and area (of the region, square degrees, from the number of randoms at a density) of each pixel that has randoms.

    Regions are numbered from 0 as merged() orders them. Only a number for each pixel (12 nside^2 at
    most) reaches the driver.
    """
    counts = pixelled(randoms, nside, ra, dec).groupBy("pix").count().collect()
    areas = sorted((int(r["pix"]), r["count"] / density) for r in counts)
    rows = [(p, i, float(area)) for i, (area, pixels) in enumerate(merged(areas, SKY_SQUARE_DEGREES / nside2npix(nside))) for p in pixels]
    return randoms.sparkSession.createDataFrame(rows, "pix long, region int, area double")


def in_regions(df: DataFrame, regions: DataFrame, nside: int, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """df with region and area; rows in pixels without randoms have none."""
    small = nside2npix(nside) <= BROADCAST_PIXELS
    return pixelled(df, nside, ra, dec).join(F.broadcast(regions) if small else regions, "pix", "left")


def region_sets(nside: int, randoms: DataFrame, density: float, *data: DataFrame, ra: str = "ra", dec: str = "dec") -> Iterator[tuple]:
    """For each region by ascending area: its area, its randoms, and its part of each data set. Data in pixels without randoms are in no region."""
    regions = sky_regions(randoms, nside, density, ra, dec)
    for r in regions.select("region", "area").distinct().orderBy("region").collect():  # 12 nside^2 rows at most
        here = regions.where(F.col("region") == r["region"])
        yield r["area"], *(in_regions(df, here, nside, ra, dec).where(F.col("region").isNotNull()).drop("pix", "region", "area") for df in (randoms, *data))
