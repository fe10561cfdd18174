"""Joining block rows with their scene's georeference without shuffling cells when avoidable."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilepyramid.functions.affine import affine_columns
from tilepyramid.operators.overlap import FOOTPRINT, scene_footprints

# A georeference row is 14 fixed-width values, under 200 bytes: 200,000 rows stay under 40 MB.
BROADCAST_ROWS = 200_000
# Beyond that, one scene's blocks are spread over this many join keys.
SALTS = 32
METRES_PER_DEGREE = 111320.0

GEOREFERENCE = ["seq", "width", "height", *FOOTPRINT]


class SceneStats(NamedTuple):
    """Proven bounds of a scene table, from one pass over its metadata columns."""

    rows: int
    min_seq: int
    max_seq: int
    max_cells: int
    coarsest: float = 0.0
    finest: float = 0.0
    unique_seq: bool = False


def scene_stats(scenes: DataFrame) -> SceneStats:
    """Row count, ``seq`` range, largest scene, coarsest and finest cell and whether no two
    scenes share a ``seq``."""
    row = scenes.agg(
        F.count(F.lit(1)), F.min("seq"), F.max("seq"),
        F.max(F.col("width").cast("long") * F.col("height")),
        F.max(cell_side()), F.min(cell_side()), F.count_distinct("seq"),
    ).first()
    return SceneStats(row[0], *[v or 0 for v in row[1:6]], row[6] == row[0])


def affine_side(g: list[Column], geographic: Column) -> Column:
    """Longer side of an affine's cell in metres, roughly."""
    side = F.greatest(F.abs(g[1]) + F.abs(g[2]), F.abs(g[4]) + F.abs(g[5]))
    return F.when(geographic, side * METRES_PER_DEGREE).otherwise(side)


def cell_side() -> Column:
    """:func:`affine_side` of a scene row."""
    return affine_side(affine_columns("gt"), F.col("epsg") == 4326)


def join_by_scene(
    blocks: DataFrame, side: DataFrame, keys: list[str], rows: int,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of blocks with one fixed-width row per scene.

    ``rows`` is a proven bound on ``side``; within ``broadcast_rows`` the side is broadcast and
    blocks stay where they were scanned.  Beyond it the join shuffles, salted by block position
    so that a scene holding a large share of all blocks is still split evenly.
    """
    if rows <= broadcast_rows:
        return blocks.join(F.broadcast(side), keys)
    salted = blocks.withColumn("salt", F.pmod(F.hash("block_row", "block_col"), F.lit(SALTS)))
    copies = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "salt"]).drop("salt")


def georeference(
    blocks: DataFrame, scenes: DataFrame, stats: SceneStats | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Blocks with their scene's order, size, affine and extent.

    Blocks that already carry these columns (a table written once from this result) keep the
    geometry they were stored with; the given scenes still say which of them take part and in
    which order.
    """
    stats = stats or scene_stats(scenes)
    if set(GEOREFERENCE) <= set(blocks.columns):
        return join_by_scene(blocks.drop("seq"), scenes.select("scene_id", "seq"), ["scene_id"],
                             stats.rows, broadcast_rows)
    side = scene_footprints(scenes).select("scene_id", *GEOREFERENCE)
    return join_by_scene(blocks, side, ["scene_id"], stats.rows, broadcast_rows)
