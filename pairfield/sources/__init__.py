"""Point sets and where they come from."""

from .points import FieldSet, PointSet, SkyPointSet, read_points, sky_points

__all__ = ["FieldSet", "PointSet", "SkyPointSet", "read_points", "sky_points"]
