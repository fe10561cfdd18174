"""Which scenes cover which tiles (O-J1, O-J2, O-A1), as arithmetic instead of a theta join.

A scene's tile span follows from its extent, so pairs come from two ``explode(sequence(..))``
and the exact inclusive test; no grid is joined and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilepyramid.constants import TILE, WORLD_MAX_Y, WORLD_MIN_X
from tilepyramid.functions.affine import affine_columns
from tilepyramid.functions.crs import is_geographic, x_scale
from tilepyramid.functions.extent import overlaps_x, raster_extent
from tilepyramid.functions.tilekey import tile_row
from tilepyramid.operators.grid import zoom_levels

# Numbers of a tile's scene order that one task ranks: as many scenes where numbers are unique.
RANK_PART = 65_536

FOOTPRINT = ["g0", "g1", "g2", "g3", "g4", "g5", "geographic", "x_radius", "x_degrees", "x_radians",
             "scene_minx", "scene_maxx", "scene_miny", "scene_maxy"]


def scene_footprints(scenes: DataFrame) -> DataFrame:
    """Split the affine and add each scene's extent in 3857."""
    g = dict(zip([f"g{i}" for i in range(6)], affine_columns("gt")))
    df = scenes.withColumns({**g, "geographic": is_geographic(F.col("epsg"))})
    box = raster_extent(
        F.col("height"), F.col("width"), [F.col(c) for c in g], F.col("geographic")
    )
    df = df.withColumns({"scene_box": box, **x_scale(F.col("geographic"))})
    return df.withColumns(
        {f"scene_{c}": F.col("scene_box")[c] for c in ("minx", "maxx", "miny", "maxy")}
    ).drop("scene_box", "gt")


def tile_west(j: Column) -> Column:
    return F.lit(WORLD_MIN_X) + (j * TILE) * F.col("res")


def tile_east(j: Column) -> Column:
    return tile_west(j) + F.lit(TILE) * F.col("res")


def tile_north(i: Column) -> Column:
    return F.lit(WORLD_MAX_Y) + (i * TILE) * (-F.col("res"))


def tile_south(i: Column) -> Column:
    return tile_north(i) + F.lit(TILE) * (-F.col("res"))


def reached_columns(west: Column, east: Column, slack: float) -> Column:
    """Array of the tile columns that [west, east] reaches and that touch the row's scene, for
    the row's zoom level (``res, n_cols``).

    Division gives the span, widened by ``slack`` tiles; the inclusive test against the scene is
    then made exactly, column by column.
    """
    side, x0 = F.col("res") * TILE, F.lit(WORLD_MIN_X)
    return F.filter(
        _span((west - x0) / side - slack, (east - x0) / side + slack, F.col("n_cols")),
        lambda j: overlaps_x(
            F.col("scene_minx"), F.col("scene_maxx"), tile_west(j), tile_east(j)))


def reached_rows(south: Column, north: Column, slack: float) -> Column:
    """Array of the top-down grid rows that [south, north] reaches and that touch the scene."""
    side, y0 = F.col("res") * TILE, F.lit(WORLD_MAX_Y)
    return F.filter(
        _span((y0 - north) / side - slack, (y0 - south) / side + slack, F.col("n_rows")),
        lambda i: overlaps_x(
            F.col("scene_miny"), F.col("scene_maxy"), tile_south(i), tile_north(i)))


def _span(first: Column, last: Column, n: Column) -> Column:
    """Integers from ``first`` to ``last`` within [0, n), as an array; NULL if there are none."""
    a = F.greatest(F.floor(first), F.lit(0)).cast("int")
    b = F.least(F.floor(last), (n - 1).cast("bigint")).cast("int")
    return F.when(b >= a, F.sequence(a, b))


def scene_tile_pairs(
    scenes: DataFrame, zooms: str | Iterable[int], compat: bool = True
) -> DataFrame:
    """One row per (tile, scene) whose extents touch: z, x, y, grid_row, scene_id, seq, bands.

    Between columns and rows the few narrow (scene, column) rows are shuffled, so that a scene
    covering the world at a high zoom is not fanned out by one task.
    """
    df = scene_footprints(scenes).select("*", F.inline(zoom_levels(zooms)))
    df = df.select(
        "scene_id", "seq", "bands", "z", "res", "n_rows", "scene_miny", "scene_maxy",
        F.explode(reached_columns(F.col("scene_minx"), F.col("scene_maxx"), 1.0)).alias("x"))
    df = spread(df, "scene_id", "z", "x").withColumn("grid_row", F.explode(
        reached_rows(F.col("scene_miny"), F.col("scene_maxy"), 1.0)))
    return df.select(
        "z", "x", tile_row(F.col("z"), F.col("grid_row"), compat).alias("y"),
        "grid_row", "scene_id", "seq", "bands",
    )


def tile_intervals(scenes: DataFrame, zooms: str | Iterable[int]) -> DataFrame:
    """The tiles of :func:`scene_tile_pairs` as runs of top-down rows, one for each scene and
    column: z, tile_column, first_row, last_row, bands."""
    df = scene_footprints(scenes).select("*", F.inline(zoom_levels(zooms)))
    df = df.select("bands", "z", "res", "n_rows", "scene_miny", "scene_maxy", F.explode(
        reached_columns(F.col("scene_minx"), F.col("scene_maxx"), 1.0)).alias("tile_column"))
    rows = reached_rows(F.col("scene_miny"), F.col("scene_maxy"), 1.0)
    return df.withColumn("rows", rows).filter(F.size("rows") > 0).select(
        "z", "tile_column", F.array_min("rows").alias("first_row"),
        F.array_max("rows").alias("last_row"), "bands")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all shuffle partitions ahead of a fan-out.

    The explicit number keeps adaptive execution from merging partitions that are small now.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scenes_per_tile(pairs: DataFrame) -> DataFrame:
    """Count, first and last scene of each tile in ``seq`` order.

    A low-zoom tile can be covered by every scene, so scenes are counted and ranked by partial
    aggregates; the full list is the rows of ``pairs`` and is never gathered into one value.
    """
    return pairs.groupBy("z", "x", "y").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("scene_id", "seq").alias("first_scene"),
        F.max_by("scene_id", "seq").alias("last_scene"),
    )


def ranked_scenes(pairs: DataFrame, seq_range: tuple[int, int]) -> DataFrame:
    """The scenes of each tile in order: z, x, y, rank (from 0), scene_id.

    ``seq_range`` bounds ``seq``. A tile may be covered by every scene, so its scenes are ranked within
    parts of ``RANK_PART`` consecutive numbers, and the counts of the parts before are added.
    """
    low, high = seq_range
    tile, order = ["z", "x", "y"], ["seq", "scene_id"]
    if high - low < RANK_PART:
        rank = F.row_number().over(Window.partitionBy(*tile).orderBy(*order)) - 1
        return pairs.select(*tile, rank.alias("rank"), "scene_id")
    parted = pairs.withColumn("part", F.floor((F.col("seq") - low) / RANK_PART))
    own = F.row_number().over(Window.partitionBy(*tile, "part").orderBy(*order)) - 1
    earlier = Window.partitionBy(*tile).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parted.groupBy(*tile, "part").agg(F.count(F.lit(1)).alias("n")).select(
        *tile, "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return parted.withColumn("own", own).join(before, [*tile, "part"]).select(
        *tile, (F.col("before") + F.col("own")).cast("int").alias("rank"), "scene_id")
