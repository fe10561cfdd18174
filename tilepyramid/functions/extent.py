"""Extents as ``STRUCT<minx, maxx, miny, maxy>`` columns (O-P7..O-P10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilepyramid.constants import EXTENT_SEPARATOR
from tilepyramid.functions.affine import pixel_to_map
from tilepyramid.functions.crs import to_mercator


def extent(minx: Column, maxx: Column, miny: Column, maxy: Column) -> Column:
    return F.struct(
        minx.alias("minx"), maxx.alias("maxx"), miny.alias("miny"), maxy.alias("maxy")
    )


def raster_extent(
    rows: Column, cols: Column, g: Sequence[Column], geographic: Column | None = None
) -> Column:
    """Extent of a north-up raster from its four corners, in 3857 when ``geographic`` is given.

    Only the two corners that bound each side take part, as for a north-up raster.
    """
    zero = F.lit(0)
    corners = [pixel_to_map(c, r, g) for c, r in
               ((zero, zero), (zero, rows), (cols, zero), (cols, rows))]
    if geographic is not None:
        corners = [to_mercator(x, y, geographic) for x, y in corners]
    (ltx, lty), (lbx, lby), (rtx, rty), (rbx, rby) = corners
    return extent(
        F.least(ltx, lbx), F.greatest(rtx, rbx), F.least(lby, rby), F.greatest(lty, rty)
    )


def parse_extent(s: Column) -> Column:
    """``"minX maxX minY maxY"`` to an extent; NULL unless the first four parts are numbers."""
    parts = F.split(s, EXTENT_SEPARATOR)
    v = [F.get(parts, i).try_cast("double") for i in range(4)]
    valid = v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull() & v[3].isNotNull()
    return F.when(valid, extent(*v))


def extent_wkt(e: Column, compat: bool = True, digits: int | None = None) -> Column:
    """``POLYGON((...))``.  The ``compat`` ring has four points and is left open."""
    def num(c: Column) -> Column:
        return c.cast("string") if digits is None else F.format_string(f"%.{digits}f", c)

    minx, maxx, miny, maxy = (num(e[k]) for k in ("minx", "maxx", "miny", "maxy"))
    points = [(minx, miny), (minx, maxy), (maxx, maxy), (maxx, miny)]
    if not compat:
        points.append(points[0])
    ring = F.concat_ws(",", *[F.concat_ws(" ", x, y) for x, y in points])
    return F.concat(F.lit("POLYGON(("), ring, F.lit("))"))


def intersects(a: Column, b: Column) -> Column:
    """Inclusive overlap: extents that only touch do intersect."""
    return overlaps_x(a["minx"], a["maxx"], b["minx"], b["maxx"]) & overlaps_x(
        a["miny"], a["maxy"], b["miny"], b["maxy"]
    )


def overlaps_x(amin: Column, amax: Column, bmin: Column, bmax: Column) -> Column:
    """One axis of :func:`intersects`."""
    return ~((amax < bmin) | (amin > bmax))
