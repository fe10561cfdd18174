"""Mosaic and nearest-neighbour resampling of scene blocks into tile cells (O-A2..O-A5, O-J3).

A block's share of a tile goes one of two ways, by how its cells compare with the tile's. Where they
are not much finer, the block is resampled to array patches, which are shuffled once, by tile, and laid
over each other (``patches``). Where they are (``FINE`` or less of a tile cell, so that many blocks meet
in few cells) each block is fanned out, where it was scanned, to tiles and then to cells in one
whole-stage-codegen span of nested generators, and the cells meet in a hash aggregation keyed by one
packed BIGINT, with map-side combine, that keeps the last write: a hot tile is spread over its 65,536
cells, and a hot cell shrinks to one row per map task before the shuffle. Both hold a cell's order and
value in one BIGINT, so that they merge. Where the order does not fit one, all go the second way.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilepyramid.constants import DEFAULT_BANDS, RESOLUTIONS, TILE
from tilepyramid.functions import affine, crs
from tilepyramid.functions.cellvalue import sample
from tilepyramid.functions.tilekey import tile_row
from tilepyramid.operators.georeference import (
    BROADCAST_ROWS,
    SceneStats,
    affine_side,
    cell_side,
    georeference,
    scene_stats,
)
from tilepyramid.operators.grid import zoom_levels
from tilepyramid.operators.overlap import (
    reached_columns,
    reached_rows,
    scene_tile_pairs,
    spread,
    tile_east,
    tile_north,
    tile_south,
    tile_west,
)
from tilepyramid.operators.patches import (
    VALUE_BIAS,
    VALUE_BITS,
    forward_cells,
    inverse_patches,
    overlaid,
)
from tilepyramid.sources.zooms import check_zooms

# Slack, in tiles or cells, that keeps a computed window a superset of the exact answer: far
# above double rounding, far below one cell.  Every cell is tested exactly afterwards.
TILE_SLACK = 1e-6
CELL_SLACK = 1e-3

# Tile cells per source cell and axis above which one block makes too much work for one task.
OVERSAMPLED = 16
# Tile cells per source cell and axis up to which cells, not patches, are combined.
FINE = 1 / 8
# Scenes over one tile above which its patches are first merged in parts: about 1 GB of patches.
LAYERS = 4_096

AFFINE = [f"g{i}" for i in range(6)]


def mosaic(
    blocks: DataFrame,
    scenes: DataFrame,
    zooms: str | Iterable[int],
    method: str = "inverse",
    window: str | None = None,
    bands: Sequence[int] | None = DEFAULT_BANDS,
    compat: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Filled tile cells as packed rows ``tile_id, band, cell, value`` (see :func:`unpack`).

    ``method="inverse"`` looks up a source cell for every tile cell and lets the last scene
    overwrite; ``"forward"`` drops every positive source cell onto its tile cell, last write
    winning in (seq, row, column) order, and leaves unhit cells empty.  ``window`` restricts
    the forward scan to the source window under each tile (``"clip"``, or ``"abs"`` for the
    variant that takes the absolute end index).  ``bands=None`` means every band.
    """
    build = _Build(blocks, scenes, zooms, method, window, bands, compat, broadcast_rows)
    if not build.patch_zooms:
        return build.decoded(build.last_writes(build.cell_zooms))
    entries = build.laid().select("tile_id", "band", F.explode("entries").alias("entry"))
    return entries.select(
        # Never NULL; saying so keeps the null filters of later joins away from the arrays.
        F.coalesce("tile_id", F.lit(-1)).alias("tile_id"), "band",
        F.col("entry").bitwiseAND(0xFFFF).alias("cell"),
        (F.shiftright("entry", 16) + (0 if compat else 32768)).alias("value"))


def tile_arrays(
    blocks: DataFrame,
    scenes: DataFrame,
    zooms: str | Iterable[int],
    method: str = "inverse",
    window: str | None = None,
    bands: Sequence[int] | None = DEFAULT_BANDS,
    compat: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
    touched: DataFrame | None = None,
) -> DataFrame:
    """The mosaic as one row per (tile, band): ``tile_id, band, entries, n_negative, n_filled``.

    ``entries`` are the filled cells, sorted, each ``value << 16 | cell`` (the value less 32768 if not
    ``compat``). ``touched`` (tile_id, band) adds tiles that were reached but got no cell.
    """
    build = _Build(blocks, scenes, zooms, method, window, bands, compat, broadcast_rows)
    if build.patch_zooms:
        return build.laid(touched)
    return gather(build.decoded(build.last_writes(build.cell_zooms)), compat, touched)


def gather(cells: DataFrame, compat: bool = True, touched: DataFrame | None = None) -> DataFrame:
    """Rows of cells, at most one for each cell of a tile, as the arrays of :func:`tile_arrays`."""
    bias = 0 if compat else 32768
    entry = F.shiftleft(F.col("value") - bias, 16).bitwiseOR(F.col("cell"))
    rows = cells.select("tile_id", "band", entry.alias("entry"))
    if touched is not None:
        rows = rows.unionByName(touched.select("tile_id", "band"), allowMissingColumns=True)
    # The pre-shuffle leaves collect_list nothing to do map-side.
    return rows.repartition("tile_id", "band").groupBy("tile_id", "band").agg(
        F.sort_array(F.collect_list("entry")).alias("entries"),
        # Only biased entries are negative without a negative value.
        F.count_if(F.lit(compat) & (F.col("entry") < 0)).cast("int").alias("n_negative"),
        F.count("entry").cast("int").alias("n_filled"))


class _Build:
    """One mosaic: which zooms go which way, and the two ways."""

    def __init__(self, blocks, scenes, zooms, method, window, bands, compat, broadcast_rows):
        if method not in ("inverse", "forward"):
            raise ValueError(f"unknown method {method!r}")
        if window not in (None, "clip", "abs") or (window and method == "inverse"):
            raise ValueError(f"unknown window {window!r} for method {method!r}")
        self.scenes, self.window, self.bands, self.compat = scenes, window, bands, compat
        self.forward, self.broadcast_rows = method == "forward", broadcast_rows
        zooms = check_zooms(zooms)
        self.stats = stats = scene_stats(scenes)
        if bands is not None:
            blocks = blocks.filter(F.col("band").isin(*bands))
        # compat wraps every sample to 16 bits
        self.blocks = blocks if compat else sixteen_bit(blocks)
        self.place_bits = stats.max_cells.bit_length() if self.forward else 0
        if fits_one_long(stats, self.place_bits):
            self.patch_zooms = [z for z in zooms if stats.coarsest > FINE * RESOLUTIONS[z]]
            self.cell_zooms = [z for z in zooms if stats.finest <= FINE * RESOLUTIONS[z]]
        else:
            self.patch_zooms, self.cell_zooms = [], list(zooms)
        # Only a zoom that goes both ways has to be told apart block by block.
        self.both = set(self.patch_zooms) & set(self.cell_zooms)

    def last_writes(self, zooms: Sequence[int]) -> DataFrame:
        """(cell_id, [band,] last) of the cells way."""
        written = None
        for part, oversampled in _by_coarseness(self.scenes, self.stats, zooms):
            placed = georeference(self.blocks, part, self.stats, self.broadcast_rows)
            leveled = self._of_kind(_block_zooms(placed, zooms, self.forward), fine=True)
            tiles = _block_tiles(leveled, self.forward, oversampled)
            cells = (_forward_cells(tiles, self.window, self.compat) if self.forward
                     else _inverse_cells(tiles, self.compat))
            cells = _writes(cells, self.stats, self.forward, self.bands)
            written = cells if written is None else written.union(cells)
        return _last_write(written, self.stats, self.forward)

    def _of_kind(self, leveled: DataFrame, fine: bool) -> DataFrame:
        if not self.both:
            return leveled
        g = [F.col(c) for c in AFFINE]
        small = affine_side(g, F.col("geographic")) <= FINE * F.col("res")
        return leveled.filter(small if fine else ~small)

    def decoded(self, kept: DataFrame) -> DataFrame:
        return _decoded(kept, self.stats, self.forward, self.bands)

    def patches(self) -> DataFrame:
        if self.forward:
            placed = georeference(self.blocks, self.scenes, self.stats, self.broadcast_rows)
            leveled = self._of_kind(_block_zooms(placed, self.patch_zooms, True), fine=False)
            return forward_cells(leveled, self.compat, self.window, self.place_bits)
        found = None
        for part, oversampled in _by_coarseness(self.scenes, self.stats, self.patch_zooms):
            placed = georeference(self.blocks, part, self.stats, self.broadcast_rows)
            leveled = self._of_kind(_block_zooms(placed, self.patch_zooms, False), fine=False)
            tiles = _inverse_spans(_block_tiles(leveled, False, oversampled))
            tiles = tiles.filter("dxs IS NOT NULL AND dys IS NOT NULL").withColumns({
                "tile_id": tile_id(F.col("z"), F.col("tile_column"), F.col("grid_row")),
                "dx0": F.col("dxs.first"), "dx1": F.col("dxs.last"),
                "dy0": F.col("dys.first"), "dy1": F.col("dys.last")})
            patches = inverse_patches(tiles, self.compat)
            found = patches if found is None else found.union(patches)
        return found

    def laid(self, touched: DataFrame | None = None) -> DataFrame:
        """The arrays of all tiles."""
        rows = self.patches()
        if self.cell_zooms:
            band = (F.col("band") if self.bands is None or len(self.bands) > 1
                    else F.lit(self.bands[0])).cast("int")
            cell = F.struct(F.col("cell_id").bitwiseAND(0xFFFF).cast("int").alias("cell"), "last")
            merged = self.last_writes(self.cell_zooms).groupBy(
                F.shiftright("cell_id", 16).alias("tile_id"), band.alias("band")).agg(
                F.collect_list(cell).alias("t"))
            rows = rows.unionByName(merged.select(
                "tile_id", "band", F.col("t.cell").alias("cells"), F.col("t.last").alias("packed")),
                allowMissingColumns=True)
        if touched is not None:
            rows = rows.unionByName(touched.select("tile_id", "band"), allowMissingColumns=True)
        return overlaid(rows, self.compat, self._salts())

    def _salts(self) -> int:
        """Parts of about ``LAYERS`` scenes in which a tile's patches are merged first; the tiles of other
        levels are parts of those of the lowest. A merged part is up to a whole tile, so that more
        parts than needed would move more than the patches."""
        if self.stats.rows <= LAYERS:
            return 1
        pairs = scene_tile_pairs(self.scenes, [min(self.patch_zooms)])
        most = pairs.groupBy("x", "grid_row").count().agg(F.max("count")).first()[0] or 0
        return max(1, math.ceil(most / LAYERS))


def _by_coarseness(
    scenes: DataFrame, stats: SceneStats, zooms: Sequence[int]
) -> list[tuple[DataFrame, bool]]:
    """(scenes, whether their blocks must be spread): fine blocks are not moved for coarse ones."""
    limit = OVERSAMPLED * RESOLUTIONS[max(zooms)]
    if stats.coarsest <= limit:
        return [(scenes, False)]
    if stats.finest > limit:
        return [(scenes, True)]
    coarse = cell_side() > limit
    return [(scenes.filter(~coarse), False), (scenes.filter(coarse), True)]


def sixteen_bit(blocks: DataFrame) -> DataFrame:
    """``blocks``, failing the query at a cell (padding included) that 16 bits cannot hold: a
    mosaic packs values of that width."""
    bad = (F.array_max("cells") > 0xFFFF) | (F.array_min("cells") < -0x8000)
    told = F.raise_error(F.concat(F.lit("a sample of scene "), F.col("scene_id").cast("string"),
                                  F.lit(" does not fit 16 bits")))
    return blocks.withColumn("cells", F.when(bad, told.cast(blocks.schema["cells"].dataType))
                             .otherwise(F.col("cells")))


def _block_zooms(blocks: DataFrame, zooms: Sequence[int], forward: bool) -> DataFrame:
    """Blocks with their footprint, once for every level."""
    df = blocks.withColumns({
        "px0": F.col("block_col") * F.col("bw"), "py0": F.col("block_row") * F.col("bh"),
    })
    df = df.withColumns({
        "px1": F.least(F.col("px0") + F.col("bw"), F.col("width")),
        "py1": F.least(F.col("py0") + F.col("bh"), F.col("height")),
    })
    # Truncation lets the inverse direction accept source offsets down to -1.
    back = 0 if forward else 1
    g = [F.col(c) for c in AFFINE]
    corners = [
        affine.pixel_to_map(u, v, g)
        for u in (F.col("px0") - back, F.col("px1"))
        for v in (F.col("py0") - back, F.col("py1"))
    ]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    geographic = F.col("geographic")
    west, south = crs.to_mercator(F.least(*xs), F.least(*ys), geographic)
    east, north = crs.to_mercator(F.greatest(*xs), F.greatest(*ys), geographic)
    df = df.withColumns({"west": west, "east": east, "south": south, "north": north})
    return df.select("*", F.inline(zoom_levels(zooms)))


def _block_tiles(df: DataFrame, forward: bool, oversampled: bool) -> DataFrame:
    """Fan (block, zoom) rows out to the tiles their footprint can reach.

    When cells are far coarser than the finest zoom, one block covers many tiles and its fan-out
    would be one task's work; its (block, tile column) copies are then spread first, which moves
    about a hundredth of what they grow into.
    """
    # Truncation lets the forward direction reach the tile east and south of a cell's own.
    reach = F.col("res") if forward else F.lit(0.0)
    # A higher-order expression is not code-generated, which ends the block-level stage here on
    # purpose: block code and the cell loops become separate methods, small enough for the JIT.
    df = df.withColumn("tile_column", F.explode(
        reached_columns(F.col("west"), F.col("east") + reach, TILE_SLACK)))
    if oversampled:
        df = spread(df, "scene_id", "band", "block_row", "block_col", "z", "tile_column")
    df = df.withColumn("grid_row", F.explode(
        reached_rows(F.col("south") - reach, F.col("north"), TILE_SLACK)))
    return df.withColumns({"tile_minx": tile_west(F.col("tile_column")),
                           "tile_maxy": tile_north(F.col("grid_row"))})


def _inverse_spans(tiles: DataFrame) -> DataFrame:
    """The tile cells ``dxs, dys`` that the block's footprint can reach."""
    res = F.col("res")
    return tiles.withColumns({
        "dys": _cell_span((F.col("tile_maxy") - F.col("north")) / res,
                          (F.col("tile_maxy") - F.col("south")) / res, F.lit(0), F.lit(TILE - 1)),
        "dxs": _cell_span((F.col("west") - F.col("tile_minx")) / res,
                          (F.col("east") - F.col("tile_minx")) / res, F.lit(0), F.lit(TILE - 1)),
    })


def _inverse_cells(tiles: DataFrame, compat: bool) -> DataFrame:
    res, geographic = F.col("res"), F.col("geographic")
    df = _inverse_spans(tiles).withColumn("dy", _each("dys"))
    # The source y depends on the tile row alone, so its trigonometry runs once per row.
    df = df.withColumn("sy", crs.from_mercator_y(
        F.col("tile_maxy") + F.col("dy") * (-res), geographic))
    df = df.withColumn("dx", _each("dxs"))
    df = df.withColumn("sx", crs.scaled_from_mercator_x(F.col("tile_minx") + F.col("dx") * res))
    u, v = affine.map_to_pixel_exact(F.col("sx"), F.col("sy"), [F.col(c) for c in AFFINE])
    df = df.withColumns({"u": u, "v": v}).filter(
        _inside(F.col("u"), F.col("px0"), F.col("px1"), compat)
        & _inside(F.col("v"), F.col("py0"), F.col("py1"), compat))
    df = df.withColumns({"px": _index(F.col("u"), compat), "py": _index(F.col("v"), compat)})
    return _with_value(df, compat).filter(F.col("value").isNotNull())


def _forward_cells(tiles: DataFrame, window: str | None, compat: bool) -> DataFrame:
    res, geographic = F.col("res"), F.col("geographic")
    g = [F.col(c) for c in AFFINE]
    tiles = tiles.withColumns({"tile_maxx": tile_east(F.col("tile_column")),
                               "tile_miny": tile_south(F.col("grid_row"))})
    df = _source_window(tiles, window, compat) if window else _reachable_source(tiles)
    df = df.withColumn("py", _each("pys"))
    # North-up scenes: the row's y is shared by all its cells, so project it once.
    row_y = g[3] + F.col("py") * g[5]
    df = df.withColumn("row_y", F.when(
        g[4] == 0.0, F.when(geographic, crs.lat_to_y(row_y)).otherwise(row_y)))
    df = df.withColumn("px", _each("pxs"))
    df = _with_value(df, compat)
    sx, sy = affine.pixel_to_map(F.col("px"), F.col("py"), g)
    mx = crs.scaled_to_mercator_x(sx)
    my = F.coalesce(F.col("row_y"), F.when(geographic, crs.lat_to_y(sy)).otherwise(sy))
    # The tile's affine has no shear, so the general inverse reduces to these exact terms.
    u = (mx * (-res) - F.col("tile_minx") * (-res)) / (res * (-res))
    v = (my * res - res * F.col("tile_maxy")) / (res * (-res))
    df = df.withColumns({"u": u, "v": v}).filter(
        (F.col("value") > 0)
        & _inside(F.col("u"), F.lit(0), F.lit(TILE), compat)
        & _inside(F.col("v"), F.lit(0), F.lit(TILE), compat))
    return df.withColumns({"dx": _index(F.col("u"), compat), "dy": _index(F.col("v"), compat)})


def _reachable_source(tiles: DataFrame) -> DataFrame:
    """Spans ``pxs, pys`` of the block that can reach the tile: a superset, only to prune.

    The tile's box, one cell wider to the west and north, is taken back to the source; its
    bounding box in pixels also holds for sheared scenes.
    """
    res, geographic, g = F.col("res"), F.col("geographic"), [F.col(c) for c in AFFINE]
    df = tiles.withColumns({
        "src_west": crs.scaled_from_mercator_x(F.col("tile_minx") - res),
        "src_east": crs.scaled_from_mercator_x(F.col("tile_maxx")),
        "src_south": crs.from_mercator_y(F.col("tile_miny"), geographic),
        "src_north": crs.from_mercator_y(F.col("tile_maxy") + res, geographic),
    })
    corners = [
        affine.map_to_pixel_exact(F.col(x), F.col(y), g)
        for x in ("src_west", "src_east") for y in ("src_south", "src_north")
    ]
    us, vs = [c[0] for c in corners], [c[1] for c in corners]
    return df.withColumns({
        "pxs": _cell_span(F.least(*us), F.greatest(*us), F.col("px0"), F.col("px1") - 1),
        "pys": _cell_span(F.least(*vs), F.greatest(*vs), F.col("py0"), F.col("py1") - 1),
    })


def _source_window(tiles: DataFrame, window: str, compat: bool) -> DataFrame:
    """Spans ``pxs, pys`` of the block between the tile's upper-left and lower-right corners."""
    geographic, g = F.col("geographic"), [F.col(c) for c in AFFINE]
    first_x, first_y = affine.map_to_pixel(
        crs.scaled_from_mercator_x(F.col("tile_minx")),
        crs.from_mercator_y(F.col("tile_maxy"), geographic), g, compat)
    last_x, last_y = affine.map_to_pixel(
        crs.scaled_from_mercator_x(F.col("tile_maxx")),
        crs.from_mercator_y(F.col("tile_miny"), geographic), g, compat)
    if window == "abs":
        last_x, last_y = F.abs(last_x), F.abs(last_y)
    df = tiles.withColumns({
        "first_x": F.greatest(F.col("px0"), first_x), "last_x": F.least(F.col("px1") - 1, last_x),
        "first_y": F.greatest(F.col("py0"), first_y), "last_y": F.least(F.col("py1") - 1, last_y),
    })
    return df.withColumns({
        "pxs": _span(F.col("first_x"), F.col("last_x")),
        "pys": _span(F.col("first_y"), F.col("last_y")),
    })


def _cell_span(first: Column, last: Column, low: Column, high: Column) -> Column:
    """First and last integer of [first, last], with slack, clipped to [low, high]; or NULL."""
    a = F.greatest(F.ceil(first - CELL_SLACK), low.cast("bigint")).cast("int")
    b = F.least(F.floor(last + CELL_SLACK), high.cast("bigint")).cast("int")
    return _span(a, b)


def _span(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.struct(first.alias("first"), last.alias("last")))


def _each(span: str) -> Column:
    """One row per integer of a span; none for NULL."""
    return F.explode(F.sequence(F.col(f"{span}.first"), F.col(f"{span}.last")))


def _inside(at: Column, low: Column, high: Column, compat: bool) -> Column:
    """Whether the index of an unrounded position is in [low, high)."""
    if compat:
        # Truncation takes (-1, 0) to 0: the bound is the first double above -1.
        low = F.when(low == 0, F.lit(-0.9999999999999999)).otherwise(low.cast("double"))
    return (at >= low) & (at < high)


def _index(at: Column, compat: bool) -> Column:
    """Index of a position already known to be in range."""
    return (at if compat else F.floor(at)).cast("int")


def _with_value(df: DataFrame, compat: bool) -> DataFrame:
    at = (F.col("py") - F.col("py0")) * F.col("bw") + (F.col("px") - F.col("px0"))
    return df.withColumn("raw", F.get(F.col("cells"), at)).withColumn(
        "value", sample(F.col("raw"), compat))


def _writes(
    cells: DataFrame, stats: SceneStats, forward: bool, bands: Sequence[int] | None
) -> DataFrame:
    """Packed key, and order with value, of every write to a tile cell."""
    cell = F.col("dy") * TILE + F.col("dx")
    keys = {
        "cell_id": F.shiftleft(tile_id(F.col("z"), F.col("tile_column"), F.col("grid_row")), 16)
        .bitwiseOR(cell.cast("long"))
    }
    if bands is None or len(bands) > 1:
        keys["band"] = F.col("band")
    last, _ = _last_value(stats, _place(forward))
    return cells.select(*[c.alias(k) for k, c in keys.items()], *last[0])


def _place(forward: bool) -> Column | None:
    return F.col("py").cast("long") * F.col("width") + F.col("px") if forward else None


def _last_write(written: DataFrame, stats: SceneStats, forward: bool) -> DataFrame:
    """Keep the last write to each tile cell."""
    last, _ = _last_value(stats, _place(forward))
    keys = [k for k in ("cell_id", "band") if k in written.columns]
    return written.groupBy(*keys).agg(last[1].alias("last"))


def _decoded(
    kept: DataFrame, stats: SceneStats, forward: bool, bands: Sequence[int] | None
) -> DataFrame:
    """``tile_id, band, cell, value`` of the last writes."""
    _, value = _last_value(stats, _place(forward))
    band = F.col("band") if "band" in kept.columns else F.lit(bands[0])
    return kept.select(
        # Never NULL; saying so keeps the null filters of later joins out of the cell loops.
        F.coalesce(F.shiftright("cell_id", 16), F.lit(-1)).alias("tile_id"),
        band.cast("int").alias("band"),
        F.col("cell_id").bitwiseAND(0xFFFF).cast("int").alias("cell"),
        value.cast("int").alias("value"),
    )


def fits_one_long(stats: SceneStats, place_bits: int) -> bool:
    """Whether the order of a write, without ties, and its value fit one BIGINT."""
    order_bits = place_bits + stats.max_seq.bit_length()
    return stats.unique_seq and stats.min_seq >= 0 and order_bits <= 63 - VALUE_BITS


def _last_value(
    stats: SceneStats, place: Column | None
) -> tuple[tuple[list[Column], Column], Column]:
    """(inputs, aggregate) and the decoded value of "last by (seq, scene_id, place)".

    While no two scenes share a ``seq``, it stands for the scene too.  With the proven bounds of
    ``stats`` the order and the 16-bit value then usually fit one BIGINT, and a plain ``max`` over
    it stays in hash aggregation with a fixed-width buffer.  If only the order fits, ``max_by``
    does the same; otherwise the exact struct order is used.  All three are the same total order.
    """
    seq, value = F.col("seq").cast("long"), F.col("value")
    place_bits = stats.max_cells.bit_length() if place is not None else 0
    order_bits = place_bits + stats.max_seq.bit_length()
    if stats.unique_seq and stats.min_seq >= 0 and order_bits <= 63:
        order = seq if place is None else F.shiftleft(seq, place_bits).bitwiseOR(place)
        if fits_one_long(stats, place_bits):
            packed = F.shiftleft(order, VALUE_BITS).bitwiseOR((value + VALUE_BIAS).cast("long"))
            decoded = F.col("last").bitwiseAND((1 << VALUE_BITS) - 1) - VALUE_BIAS
            return ([packed.alias("packed")], F.max("packed")), decoded
        return ([order.alias("order"), value], F.max_by("value", "order")), F.col("last")
    parts = [seq.alias("seq"), F.col("scene_id"),
             *([] if place is None else [place.alias("place")]), value]
    return ([F.struct(*parts).alias("write")], F.max("write")), F.col("last.value")


def tile_id(z: Column, tile_column: Column, grid_row: Column) -> Column:
    """Tile key packed into one BIGINT: 16 bits each for zoom, column and top-down row."""
    return F.shiftleft(z.cast("long"), 32).bitwiseOR(
        F.shiftleft(tile_column.cast("long"), 16)).bitwiseOR(grid_row.cast("long"))


def tile_key_columns(compat: bool = True) -> dict[str, Column]:
    """``z, x, y`` of a packed ``tile_id``."""
    z = F.shiftright("tile_id", 32).cast("int")
    x = F.shiftright("tile_id", 16).bitwiseAND(0xFFFF).cast("int")
    return {"z": z, "x": x,
            "y": tile_row(z, F.col("tile_id").bitwiseAND(0xFFFF).cast("int"), compat)}


def unpack(cells: DataFrame, compat: bool = True) -> DataFrame:
    """Packed cells as ``z, x, y, band, dx, dy`` and whatever else they carry."""
    rest = [c for c in cells.columns if c not in ("tile_id", "band", "cell")]
    return cells.select(
        *[c.alias(k) for k, c in tile_key_columns(compat).items()], "band",
        (F.col("cell") % TILE).alias("dx"), F.floor(F.col("cell") / TILE).cast("int").alias("dy"),
        *rest,
    )
