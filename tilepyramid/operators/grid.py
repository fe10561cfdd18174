"""Tile grid generation (O-G1..O-G4).

A grid is never listed on the driver: levels are a literal array of at most 16 structs, and
tiles come from ``explode(sequence(..))`` over closed-form dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid.constants import (
    RESOLUTIONS,
    TILE,
    WORLD_MAX_X,
    WORLD_MAX_Y,
    WORLD_MIN_X,
    WORLD_MIN_Y,
)
from tilepyramid.functions.affine import map_to_pixel, pixel_to_map
from tilepyramid.functions.tilekey import resolution, tile_path, tile_row
from tilepyramid.sources.zooms import check_zooms


def grid_affine(minx: Column, maxy: Column, res: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [minx, res, zero, maxy, zero, -res]


def grid_size(
    minx: Column, maxx: Column, miny: Column, maxy: Column, res: Column,
    width: int = TILE, height: int = TILE,
) -> tuple[Column, Column, Column, Column]:
    """(total cell columns, total cell rows, tile columns, tile rows) of an extent."""
    last_col, last_row = map_to_pixel(maxx, miny, grid_affine(minx, maxy, res))
    cols, rows = last_col + 1, last_row + 1
    return (
        cols,
        rows,
        F.ceil(cols * F.lit(1.0) / F.lit(width)).cast("int"),
        F.ceil(rows * F.lit(1.0) / F.lit(height)).cast("int"),
    )


def world_dims(z: int) -> tuple[int, int]:
    """Tile columns and rows of a level of the world grid (:func:`grid_size` at plan time)."""
    res = RESOLUTIONS[z]
    cols = int((WORLD_MAX_X * -res - WORLD_MIN_X * -res) / (res * -res)) + 1
    rows = int((WORLD_MAX_Y * res - WORLD_MIN_Y * res) / (res * res)) + 1
    return math.ceil(cols / TILE), math.ceil(rows / TILE)


def zoom_levels(zooms: str | Iterable[int]) -> Column:
    """The world grid's levels as a literal ``ARRAY<STRUCT<z, res, n_cols, n_rows>>``."""
    levels = [
        "named_struct('z', {}, 'res', {!r}D, 'n_cols', {}, 'n_rows', {})".format(
            z, RESOLUTIONS[z], *world_dims(z))
        for z in check_zooms(zooms)
    ]
    return F.expr(f"array({', '.join(levels)})")


def zoom_table(spark: SparkSession, zooms: str | Iterable[int]) -> DataFrame:
    return spark.range(1).select(F.inline(zoom_levels(zooms)))


def grid_dims(extents: DataFrame, width: int = TILE, height: int = TILE) -> DataFrame:
    """Add ``res, total_cols, total_rows, n_cols, n_rows`` to rows of (z, minx, maxx, miny, maxy)."""
    df = extents.withColumn("res", resolution(F.col("z")))
    total_cols, total_rows, n_cols, n_rows = grid_size(
        *[F.col(c) for c in ("minx", "maxx", "miny", "maxy", "res")], width, height
    )
    return df.withColumns({
        "total_cols": total_cols, "total_rows": total_rows, "n_cols": n_cols, "n_rows": n_rows,
    })


def _indexes(n: Column) -> Column:
    """``0..n-1`` as an array; NULL if there are none."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1))


def subdivide(
    extents: DataFrame, width: int = TILE, height: int = TILE, compat: bool = True,
    root: str | None = None,
) -> DataFrame:
    """Cut each row's extent into tiles of ``width`` x ``height`` cells.

    Adds ``tile_column, grid_row, tile_row``, the tile affine's ``gt0, gt3`` and replaces the
    extent columns by the tile's own; edge tiles keep the full size.  With ``root`` a ``path``
    is added.  The (few) columns are shuffled before the rows are fanned out, so that one huge
    extent is not built by one task.
    """
    df = grid_dims(extents, width, height)
    df = df.withColumn("tile_column", F.explode(_indexes(F.col("n_cols"))))
    # The explicit number keeps adaptive execution from merging the still small partitions.
    parts = int(extents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(parts, "z", "tile_column")
    df = df.withColumn("grid_row", F.explode(_indexes(F.col("n_rows"))))
    j, i, res = F.col("tile_column"), F.col("grid_row"), F.col("res")
    gx, gy = pixel_to_map(j * width, i * height, grid_affine(F.col("minx"), F.col("maxy"), res))
    df = df.withColumns({"gt0": gx, "gt3": gy, "tile_row": tile_row(F.col("z"), i, compat)})
    # A north-up tile's extent: its corner plus its size.
    df = df.withColumns({
        "minx": F.col("gt0"), "maxx": F.col("gt0") + F.lit(width) * res,
        "miny": F.col("gt3") + F.lit(height) * (-res), "maxy": F.col("gt3"),
    })
    if root is not None:
        df = df.withColumn("path", tile_path(F.lit(root), F.col("z"), j, F.col("tile_row")))
    return df.drop("total_cols", "total_rows", "n_cols", "n_rows")


def world_grid(
    spark: SparkSession, zooms: str | Iterable[int], compat: bool = True, root: str | None = None
) -> DataFrame:
    """All tiles of the given levels of the world grid."""
    world = spark.range(1).select(
        F.explode(F.array(*[F.lit(z) for z in check_zooms(zooms)])).alias("z"),
        F.lit(WORLD_MIN_X).alias("minx"), F.lit(WORLD_MAX_X).alias("maxx"),
        F.lit(WORLD_MIN_Y).alias("miny"), F.lit(WORLD_MAX_Y).alias("maxy"),
    )
    return subdivide(world, compat=compat, root=root)
