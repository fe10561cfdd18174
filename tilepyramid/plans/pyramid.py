"""Whole pyramid builds and their report (O-X1..O-X7, O-K2, O-K10).

All zooms are one lazy plan: each is computed from the sources, there is no overview step.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilepyramid.constants import DEFAULT_BANDS
from tilepyramid.operators.georeference import BROADCAST_ROWS
from tilepyramid.operators.mosaic import mosaic, tile_arrays, tile_id, tile_key_columns, unpack
from tilepyramid.operators.overlap import scene_tile_pairs, tile_intervals
from tilepyramid.operators.payload import blank_payload, pack_entries
from tilepyramid.operators.stretch import tile_cuts
from tilepyramid.operators.tileset import dense_tiles
from tilepyramid.schemas import STATUS, TILE_KEY
from tilepyramid.sources.zooms import check_zooms


def build_pyramid(
    scenes: DataFrame,
    blocks: DataFrame,
    zooms: str | Iterable[int],
    method: str = "inverse",
    window: str | None = None,
    bands: Sequence[int] | None = DEFAULT_BANDS,
    stretch: bool = True,
    dense: bool = False,
    payload: str | None = None,
    compat: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
    status: bool = False,
) -> DataFrame:
    """Tiles of the pyramid: zoom_level, tile_column, tile_row, tile_data.

    Every tile a scene's extent touches is emitted, even if no cell of it was filled.
    The payload is ``"png"`` (default) or ``"raw"``; with ``stretch=False`` it is the unstretched
    16-bit cells (``"u16"``).  With more than one band a ``band`` column is added and each band is
    a row.  ``dense=True`` also returns blank tiles for the uncovered part of the grid, of every
    band asked for, or with ``bands=None`` of every band that a scene has.  ``status=True`` adds
    ``n_filled``, ``vmin`` and ``vmax`` of each tile, which ``write_tiles`` sums up and leaves out.
    """
    levels = check_zooms(zooms)
    single = bands is not None and len(bands) == 1
    kind = payload or ("png" if stretch else "u16")
    if stretch == (kind == "u16"):
        raise ValueError(f"payload {kind!r} does not go with stretch={stretch}")
    touched = touched_tiles(scenes, levels, bands)
    arrays = tile_arrays(blocks, scenes, levels, method, window, bands, compat, broadcast_rows,
                         touched)
    cuts = tile_cuts(arrays, compat)
    key = [c.alias(name) for name, c in zip(TILE_KEY, tile_key_columns(compat).values())]
    if status:
        cuts = cuts.withColumns(value_range(compat))
    packed = pack_entries(cuts, kind, compat)
    tiles = packed.select(*key, *([] if single else ["band"]), "tile_data",
                          *(STATUS if status else []))
    if dense:
        runs = tile_intervals(scenes, levels)
        if not single:
            runs = runs.withColumn("band", F.explode(_bands_of(bands)))
        blanks = dense_tiles(
            tiles, levels, blank_payload(kind), compat, intervals=runs,
            bands=None if single else _band_list(scenes, bands)).filter("is_blank").drop("is_blank")
        tiles = tiles.unionByName(blanks, allowMissingColumns=True)
    return tiles


def value_range(compat: bool = True) -> dict[str, Column]:
    """Lowest and highest filled value of rows with ``entries``; NULL if there is none."""
    bias = 0 if compat else 32768
    return {"vmin": F.shiftright(F.get("entries", F.lit(0)), 16) + bias,
            "vmax": F.shiftright(F.get("entries", F.col("n_filled") - 1), 16) + bias}


def _bands_of(bands: Sequence[int] | None) -> Column:
    """The bands asked for that a scene has."""
    available = F.when(F.col("bands") > 0, F.sequence(F.lit(1), F.col("bands")))
    return available if bands is None else F.array_intersect(
        available, F.array(*[F.lit(b) for b in bands]))


def _band_list(scenes: DataFrame, bands: Sequence[int] | None) -> list[int]:
    """The bands asked for, or 1 to the most that a scene has."""
    if bands is not None:
        return list(bands)
    return list(range(1, (scenes.agg(F.max("bands")).first()[0] or 0) + 1))


def touched_tiles(
    scenes: DataFrame, zooms: str | Iterable[int], bands: Sequence[int] | None = DEFAULT_BANDS
) -> DataFrame:
    """Distinct (tile_id, band) that the extents of scenes having that band touch."""
    key = tile_id(F.col("z"), F.col("x"), F.col("grid_row")).alias("tile_id")
    pairs = scene_tile_pairs(scenes, zooms)
    return pairs.select(key, F.explode(_bands_of(bands)).alias("band")).distinct()


def tile_cells(
    scenes: DataFrame, blocks: DataFrame, zooms: str | Iterable[int], **options
) -> DataFrame:
    """The unstretched 16-bit cells as rows: z, x, y, band, dx, dy, value."""
    return unpack(mosaic(blocks, scenes, zooms, **options), options.get("compat", True))


def pyramid_report(cells: DataFrame, compat: bool = True) -> DataFrame:
    """Tiles, filled cells and value range per zoom of a packed mosaic."""
    per_tile = cells.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return per_tile.groupBy(tile_key_columns(compat)["z"].alias("z")).agg(
        F.count(F.lit(1)).alias("n_tiles"), F.sum("n").alias("n_cells"),
        F.min("lo").alias("vmin"), F.max("hi").alias("vmax"))


def array_report(arrays: DataFrame, compat: bool = True) -> DataFrame:
    """:func:`pyramid_report` of :func:`~tilepyramid.operators.mosaic.tile_arrays`."""
    filled = arrays.filter("n_filled > 0").withColumns(value_range(compat))
    return filled.groupBy(tile_key_columns(compat)["z"].alias("z")).agg(
        F.count_distinct("tile_id").alias("n_tiles"), F.sum("n_filled").alias("n_cells"),
        F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))
