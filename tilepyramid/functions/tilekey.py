"""Tile keys and tile paths (O-P11..O-P14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilepyramid.constants import RESOLUTIONS

ROWS_SOUTH = 64
KEY_PATTERN = r"(-?\d+)[/\\](-?\d+)[/\\](-?\d+)(?:\.[^./\\]*)?$"


def resolution(z: Column) -> Column:
    """Metres per cell of a zoom level; NULL outside 0..15."""
    return F.get(F.array(*[F.lit(r) for r in RESOLUTIONS]), z)


def tile_row(z: Column, grid_row: Column, compat: bool = True) -> Column:
    """Stored row of a top-down grid row: ``2^z - i``, or the TMS row when not ``compat``."""
    top = F.call_function("shiftleft", F.lit(1), z)
    return top - grid_row if compat else top - 1 - grid_row


def interleaved(x: Column, y: Column) -> Column:
    """Key whose bits are those of column and row in turn: tiles near each other have near keys."""
    def apart(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF),
                            (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
                            (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    # Rows beyond the southern edge are below 0; no level has that many.
    south = F.greatest(y.cast("long") + ROWS_SOUTH, F.lit(0))
    return F.shiftleft(apart(south), 1).bitwiseOR(apart(F.greatest(x.cast("long"), F.lit(0))))


def tile_path(root: Column, z: Column, x: Column, y: Column, ext: str = "png") -> Column:
    name = F.concat(y.cast("string"), F.lit(f".{ext}"))
    return F.concat_ws("/", root, z.cast("string"), x.cast("string"), name)


def tile_key(path: Column) -> Column:
    """``STRUCT<z, x, y>`` from the tail of a path with either separator; NULL if it has none.

    The last part may have an extension.
    """
    part = [F.regexp_extract(path, KEY_PATTERN, n).try_cast("int") for n in (1, 2, 3)]
    valid = part[0].isNotNull() & part[1].isNotNull() & part[2].isNotNull()
    return F.when(valid, F.struct(part[0].alias("z"), part[1].alias("x"), part[2].alias("y")))


def remove_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")
