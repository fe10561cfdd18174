"""Scene values at places (O-S3, O-J3): one cell per point and scene, without tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilepyramid.functions import affine, crs
from tilepyramid.functions.cellvalue import sample
from tilepyramid.functions.extent import extent
from tilepyramid.operators.extentjoin import PART_ROWS, extent_join
from tilepyramid.operators.georeference import join_by_scene
from tilepyramid.operators.overlap import scene_footprints
from tilepyramid.operators.patches import ABOVE_MINUS_ONE

AFFINE = [f"g{i}" for i in range(6)]
# Cells by which a block's reach is widened against rounding; every point is tested exactly.
CELL_SLACK = 1e-3


def sample_points(
    points: DataFrame, scenes: DataFrame, blocks: DataFrame, band: int = 1, compat: bool = True,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``point_id, scene_id, band, px, py, value`` of every scene that holds a point.

    ``points`` are (point_id, x, y) in 3857. They meet the scenes' blocks by grid cell and take their
    value there, so that what is found, which can be far more than points and blocks, is never moved.
    ``compat`` truncates toward zero, so that a point up to one cell west or north of a scene takes its
    first cell, and wraps values to 16 signed bits. The value is NULL where the block has none.
    """
    sizes = blocks.groupBy("scene_id").agg(F.max("bw").alias("bw"), F.max("bh").alias("bh"))
    side = scene_footprints(scenes.join(sizes, "scene_id")).select(
        "scene_id", "width", "height", "bw", "bh", *AFFINE, "geographic", "x_radius", "x_degrees")
    held = blocks.filter(F.col("band") == band).select(
        "scene_id", "block_row", "block_col", "cells")
    placed = _reach(join_by_scene(held, side, ["scene_id"], scenes.count()), compat)
    # A point's latitude is the same for all scenes.
    spots = points.select(
        "point_id", "x", "y", crs.y_to_lat(F.col("y")).alias("lat"),
        extent(F.col("x"), F.col("x"), F.col("y"), F.col("y")).alias("spot"))
    met = extent_join(spots, placed, "spot", "reach", part_rows)
    x = crs.scaled_from_mercator_x(F.col("x"))
    y = F.when(F.col("geographic"), F.col("lat")).otherwise(F.col("y"))
    # map_to_pixel_exact in its term order, with the terms of a block computed once: the condition is
    # part of the join's loop, which has to stay small enough for the JIT.
    u = F.try_divide(x * F.col("g5") - y * F.col("g2") + F.col("g23") - F.col("g05"), F.col("across"))
    v = F.try_divide(x * F.col("g4") - y * F.col("g1") - F.col("g04") + F.col("g13"), F.col("down"))
    found = met.withColumns({"u": u, "v": v}).filter(
        (F.col("u") >= F.col("u0")) & (F.col("u") < F.col("px1"))
        & (F.col("v") >= F.col("v0")) & (F.col("v") < F.col("py1")))
    found = found.withColumns({"px": affine.whole(F.col("u"), compat),
                               "py": affine.whole(F.col("v"), compat)})
    at = (F.col("py") % F.col("bh")) * F.col("bw") + F.col("px") % F.col("bw")
    value = sample(F.get("cells", at), compat)
    return found.select("point_id", "scene_id", F.lit(band).alias("band"), "px", "py",
                        value.alias("value"))


def _reach(blocks: DataFrame, compat: bool) -> DataFrame:
    """Blocks with the least position ``u0, v0`` they hold, their ends ``px1, py1`` within the scene, the
    terms of their affine and the extent, in 3857, of what they can hold.

    Truncation lets those at a scene's west and north edge hold one cell more."""
    def span(axis: str, start: str, block: str, size: str, whole: str) -> dict[str, Column]:
        first = F.col(block) * F.col(size)
        low = F.greatest(first, F.lit(0)).cast("double")
        return {start: F.when(low == 0, ABOVE_MINUS_ONE).otherwise(low) if compat else low,
                f"{axis}1": F.least(first + F.col(size), F.col(whole))}

    df = blocks.filter("block_col IS NOT NULL AND block_row IS NOT NULL").withColumns({
        **span("px", "u0", "block_col", "bw", "width"),
        **span("py", "v0", "block_row", "bh", "height")})
    g = [F.col(c) for c in AFFINE]
    corners = [crs.to_mercator(*affine.pixel_to_map(u, v, g), F.col("geographic"))
               for u in (F.col("u0") - CELL_SLACK, F.col("px1") + CELL_SLACK)
               for v in (F.col("v0") - CELL_SLACK, F.col("py1") + CELL_SLACK)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    reach = extent(F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys))
    return df.select(
        "scene_id", "cells", "bw", "bh", "u0", "v0", "px1", "py1", "g1", "g2", "g4", "g5",
        (g[2] * g[3]).alias("g23"), (g[0] * g[5]).alias("g05"), (g[0] * g[4]).alias("g04"),
        (g[1] * g[3]).alias("g13"), (g[1] * g[5] - g[4] * g[2]).alias("across"),
        (g[2] * g[4] - g[1] * g[5]).alias("down"), "geographic", "x_radius", "x_degrees",
        reach.alias("reach"))
