"""Closed-form EPSG:4326 <-> EPSG:3857 (O-P3..O-P6).  Geographic order is always lon, lat."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilepyramid.constants import MERCATOR_RADIUS, SUPPORTED_EPSG

# The projection diverges at the poles; a global raster's corner rows are held just inside.
MAX_LATITUDE = 89.999999


def srs_pair(epsg: Column) -> Column:
    """(projected, geographic) codes of a scene's reference system, NULL if unsupported."""
    return F.when(
        epsg.isin(*SUPPORTED_EPSG),
        F.struct(F.lit(3857).alias("projected"), F.lit(4326).alias("geographic")),
    )


def lon_to_x(lon: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.radians(lon)


def lat_to_y(lat: Column) -> Column:
    held = F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE))
    return F.lit(MERCATOR_RADIUS) * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(held) / F.lit(2.0)))


def x_to_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(MERCATOR_RADIUS))


def y_to_lat(y: Column) -> Column:
    return F.degrees(
        F.lit(2.0) * F.atan(F.exp(y / F.lit(MERCATOR_RADIUS))) - F.lit(math.pi / 2)
    )


def geographic_to_projected(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon_to_x(lon), lat_to_y(lat)


def projected_to_geographic(x: Column, y: Column) -> tuple[Column, Column]:
    return x_to_lon(x), y_to_lat(y)


def is_geographic(epsg: Column) -> Column:
    """True for 4326, false for 3857; any other code fails the query instead of being guessed."""
    return (
        F.when(epsg == 4326, F.lit(True))
        .when(epsg == 3857, F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported EPSG code "), epsg.cast("string"))))
    )


def to_mercator(x: Column, y: Column, geographic: Column) -> tuple[Column, Column]:
    return (
        F.when(geographic, lon_to_x(x)).otherwise(x),
        F.when(geographic, lat_to_y(y)).otherwise(y),
    )


def x_scale(geographic: Column) -> dict[str, Column]:
    """Per-scene factors that make both directions of x branch-free in a per-cell loop."""
    return {
        "x_radius": F.when(geographic, F.lit(MERCATOR_RADIUS)).otherwise(F.lit(1.0)),
        "x_degrees": F.when(geographic, F.lit(math.degrees(1.0))).otherwise(F.lit(1.0)),
        "x_radians": F.when(geographic, F.lit(math.radians(1.0))).otherwise(F.lit(1.0)),
    }


def scaled_to_mercator_x(x: Column) -> Column:
    """``to_mercator`` of x with the factors of :func:`x_scale`."""
    return F.col("x_radius") * (x * F.col("x_radians"))


def scaled_from_mercator_x(x: Column) -> Column:
    return (x / F.col("x_radius")) * F.col("x_degrees")


def from_mercator_y(y: Column, geographic: Column) -> Column:
    return F.when(geographic, y_to_lat(y)).otherwise(y)
