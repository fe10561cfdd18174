"""Affine transforms between pixel and map coordinates, as column expressions (O-P1, O-P2).

An affine is six columns ``g0..g5``: ``X = g0 + col*g1 + row*g2``, ``Y = g3 + col*g4 + row*g5``.
Term order is kept fixed so that results are reproducible to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN = -2147483648.0
INT_MAX = 2147483647.0


def affine_columns(gt: Column | str) -> list[Column]:
    """Split an ``ARRAY<DOUBLE>`` of six coefficients into columns."""
    gt = F.col(gt) if isinstance(gt, str) else gt
    return [gt[i] for i in range(6)]


def pixel_to_map(col: Column, row: Column, g: Sequence[Column]) -> tuple[Column, Column]:
    """Map coordinates of a pixel's upper-left corner."""
    return g[0] + col * g[1] + row * g[2], g[3] + col * g[4] + row * g[5]


def map_to_pixel_exact(x: Column, y: Column, g: Sequence[Column]) -> tuple[Column, Column]:
    """Unrounded (col, row) of a map position; NULL when the affine is singular."""
    col = F.try_divide(
        x * g[5] - y * g[2] + g[2] * g[3] - g[0] * g[5], g[1] * g[5] - g[4] * g[2]
    )
    row = F.try_divide(
        x * g[4] - y * g[1] - g[0] * g[4] + g[1] * g[3], g[2] * g[4] - g[1] * g[5]
    )
    return col, row


def whole(v: Column, compat: bool = True) -> Column:
    """Double to INT, saturating.  ``compat`` truncates toward zero, otherwise floors."""
    held = F.least(F.greatest(v, F.lit(INT_MIN)), F.lit(INT_MAX))
    # least and greatest skip NULL, so an unknown position has to be kept unknown.
    return F.when(v.isNotNull(), (held if compat else F.floor(held)).cast("int"))


def map_to_pixel(
    x: Column, y: Column, g: Sequence[Column], compat: bool = True
) -> tuple[Column, Column]:
    """(col, row) holding a map position.  Truncation maps offsets in (-1, 0) to index 0."""
    col, row = map_to_pixel_exact(x, y, g)
    return whole(col, compat), whole(row, compat)
