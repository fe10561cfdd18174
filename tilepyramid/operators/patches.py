"""Tile arrays from array patches (O-A2..O-A5): what a block gives to a tile is one row.

A block is resampled to patches where it was scanned, all its cells at once: inverse, a rectangle of
values per tile; forward, the cells that fall into each tile, found by arithmetic from the cell's
position. Patches are shuffled once, by tile, and laid over each other there. A cell's order and its
value are one BIGINT, (order << 17) + value + 32768, so that laying over is ``max`` and patches may
come in any order and may be merged in parts. Forward cells are laid over each other in the task that
projects them first: what it moves of a tile is a tile, however many blocks meet there.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilepyramid.constants import MERCATOR_RADIUS, TILE, TILE_CELLS, WORLD_MAX_Y, WORLD_MIN_X
from tilepyramid.functions.crs import MAX_LATITUDE

VALUE_BITS = 17
VALUE_BIAS = 32768
#: Marks a cell of a rectangle that gets no value; no 16-bit sample has it.
HOLE = -(1 << 20)
#: Slack in tiles of a computed tile index; every cell is tested exactly afterwards.
TILE_SLACK = 1e-6
#: The first double above -1: truncation takes what lies between it and 0 to 0.
ABOVE_MINUS_ONE = -0.9999999999999999
#: Values handed to Spark at a time.
BATCH_VALUES = 1 << 20
#: Tiles that a task holds whole while it projects blocks, half a MB each.
HELD_TILES = 128

PATCHES = ("tile_id long, band int, seq long, dx0 int, dy0 int, w int, patch array<int>, "
           "cells array<int>, packed array<long>")
ARRAYS = "tile_id long, band int, entries array<int>, n_negative int, n_filled int"

AFFINE = [f"g{i}" for i in range(6)]
BLOCK = [*AFFINE, "geographic", "seq", "band", "px0", "px1", "py0", "py1", "bw", "res", "cells"]
INVERSE = [*BLOCK, "tile_id", "tile_minx", "tile_maxy", "x_radius", "x_degrees",
           "dx0", "dx1", "dy0", "dy1"]
FORWARD = [*BLOCK, "z", "n_cols", "n_rows", "width", "x_radius", "x_degrees", "x_radians",
           "scene_minx", "scene_maxx", "scene_miny", "scene_maxy"]


def lists(column: pa.ListArray, missing: int = HOLE) -> Iterator[np.ndarray]:
    """The values of each list, without copying; ``missing`` stands for a missing one."""
    flat, offsets = column.values, column.offsets.to_numpy()
    if flat.null_count:
        flat = flat.fill_null(missing)
    flat = flat.to_numpy()
    return (flat[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def list_array(parts: list[np.ndarray | None], dtype) -> pa.ListArray:
    sizes = [0 if p is None else len(p) for p in parts]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    held = [p for p in parts if p is not None and len(p)]
    flat = np.concatenate(held).astype(dtype) if held else np.zeros(0, dtype=dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


class Rows:
    """Patch rows on their way to Spark."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, tile_id, band, seq=0, dx0=0, dy0=0, w=0, patch=None, cells=None, packed=None):
        patch, cells = (None if a is None else a.astype(np.int32) for a in (patch, cells))
        self.rows.append((tile_id, band, seq, dx0, dy0, w, patch, cells, packed))
        self.size += len(patch if patch is not None else cells)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 9
        self.rows, self.size = [], 0
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, type=k) for c, k in zip(columns, kinds)],
             list_array(columns[6], np.int32), list_array(columns[7], np.int32),
             list_array(columns[8], np.int64)],
            names=[f.split()[0] for f in PATCHES.split(", ")])


class HeldTiles:
    """Tiles on which a task lays its cells before they leave it; that laid on least lately makes room."""

    def __init__(self, rows: Rows, most: int):
        self.rows, self.most, self.held = rows, most, {}

    def lay(self, tile_id: int, band: int, cells: np.ndarray, packed: np.ndarray) -> None:
        canvas = self.held.pop((tile_id, band), None)
        if canvas is None:
            canvas = (self.leave() if len(self.held) >= self.most
                      else np.full(TILE_CELLS, -1, dtype=np.int64))
        np.maximum.at(canvas, cells, packed)
        self.held[tile_id, band] = canvas

    def leave(self) -> np.ndarray:
        """Hand the tile laid on least lately to the rows; its canvas is empty then."""
        key = next(iter(self.held))
        canvas = self.held.pop(key)
        cells = np.flatnonzero(canvas >= 0)
        self.rows.add(*key, cells=cells, packed=canvas[cells])
        canvas[cells] = -1
        return canvas


def block_rows(batch: pa.RecordBatch, missing: int = HOLE) -> Iterator[dict]:
    names = [n for n in batch.schema.names if n != "cells"]
    told = zip(*[batch.column(n).to_pylist() for n in names])
    for row, cells in zip(told, lists(batch.column("cells"), missing)):
        yield dict(zip(names, row), cells=cells)


def samples(b: dict, compat: bool) -> np.ndarray:
    """The block's own cells (without padding) as compared and stored."""
    rows = b["py1"] - b["py0"]
    raw = b["cells"][:rows * b["bw"]]
    if len(raw) < rows * b["bw"]:
        raw = np.concatenate([raw, np.full(rows * b["bw"] - len(raw), HOLE, dtype=raw.dtype)])
    raw = raw.reshape(rows, b["bw"])[:, :b["px1"] - b["px0"]]
    if not compat:
        return raw
    return np.where(raw == HOLE, HOLE, ((raw + VALUE_BIAS) & 0xFFFF) - VALUE_BIAS)


def to_latitude(y):
    return np.degrees(2.0 * np.arctan(np.exp(y / MERCATOR_RADIUS)) - pi / 2)


def from_latitude(lat):
    held = np.minimum(np.maximum(lat, -MAX_LATITUDE), MAX_LATITUDE)
    return MERCATOR_RADIUS * np.log(np.tan(pi / 4 + np.radians(held) / 2.0))


def to_pixel(x, y, g: list[float]):
    """Unrounded (column, row), or None for a singular affine. Terms in their fixed order."""
    across, down = g[1] * g[5] - g[4] * g[2], g[2] * g[4] - g[1] * g[5]
    if across == 0 or down == 0:
        return None
    return ((x * g[5] - y * g[2] + g[2] * g[3] - g[0] * g[5]) / across,
            (x * g[4] - y * g[1] - g[0] * g[4] + g[1] * g[3]) / down)


def inside(at, low: int, high: int, compat: bool):
    return (at >= (ABOVE_MINUS_ONE if compat and low == 0 else low)) & (at < high)


def whole(at, compat: bool):
    return np.trunc(at).astype(np.int64) if compat else np.floor(at).astype(np.int64)


def inverse_patch(b: dict, compat: bool, rows: Rows) -> None:
    """The rectangle of a tile that a block fills, looked up cell by cell in the block."""
    g = [b[c] for c in AFFINE]
    dy, dx = np.arange(b["dy0"], b["dy1"] + 1), np.arange(b["dx0"], b["dx1"] + 1)
    y = b["tile_maxy"] + dy * (-b["res"])
    sy = to_latitude(y) if b["geographic"] else y
    sx = ((b["tile_minx"] + dx * b["res"]) / b["x_radius"]) * b["x_degrees"]
    straight = g[2] == 0 and g[4] == 0
    if not straight:
        sx, sy = sx[None, :], sy[:, None]
    place = to_pixel(sx, sy, g) if not straight else _straight(sx, sy, g)
    if place is None:
        return
    u, v = place
    in_u, in_v = inside(u, b["px0"], b["px1"], compat), inside(v, b["py0"], b["py1"], compat)
    own = samples(b, compat)
    if straight:  # a column's u and a row's v say it all
        xs, ys = np.flatnonzero(in_u), np.flatnonzero(in_v)
        if not len(xs) or not len(ys):
            return
        xs, ys = np.arange(xs[0], xs[-1] + 1), np.arange(ys[0], ys[-1] + 1)
        patch = own[np.ix_(whole(v[ys], compat) - b["py0"], whole(u[xs], compat) - b["px0"])]
        first = int(dx[xs[0]]), int(dy[ys[0]])
    else:
        filled = in_u & in_v
        if not filled.any():
            return
        patch = np.full(filled.shape, HOLE, dtype=np.int64)
        patch[filled] = own[whole(v[filled], compat) - b["py0"], whole(u[filled], compat) - b["px0"]]
        first = b["dx0"], b["dy0"]
    rows.add(b["tile_id"], b["band"], b["seq"], *first, patch.shape[1], patch.ravel())


def _straight(sx: np.ndarray, sy: np.ndarray, g: list[float]):
    """:func:`to_pixel` without shear: the terms with g2 and g4 are zeros."""
    if g[1] * g[5] == 0:
        return None
    return (sx * g[5] - g[0] * g[5]) / (g[1] * g[5]), (g[1] * g[3] - sy * g[1]) / -(g[1] * g[5])


def forward_patches(b: dict, compat: bool, window: str | None, place_bits: int,
                    tiles: HeldTiles) -> None:
    """The block's positive cells, each in the tile its position is in and, by truncation, in the
    tiles east and south of it if it is less than one tile cell before them."""
    g, res = [b[c] for c in AFFINE], b["res"]
    own = samples(b, compat)
    at = np.flatnonzero(own.ravel() > 0)
    if not len(at):
        return
    value = own.ravel()[at].astype(np.int64)
    py, px = b["py0"] + at // own.shape[1], b["px0"] + at % own.shape[1]
    sx, sy = g[0] + px * g[1] + py * g[2], g[3] + px * g[4] + py * g[5]
    mx = b["x_radius"] * (sx * b["x_radians"])
    my = from_latitude(sy) if b["geographic"] else sy
    side, bleed = TILE * res, (1 / TILE if compat else 0) + TILE_SLACK
    t, s = (mx - WORLD_MIN_X) / side, (WORLD_MAX_Y - my) / side
    columns = [np.floor(t - TILE_SLACK).astype(np.int64), np.floor(t + bleed).astype(np.int64)]
    lines = [np.floor(s - TILE_SLACK).astype(np.int64), np.floor(s + bleed).astype(np.int64)]
    found = []
    for j, again_x in ((columns[0], None), (columns[1], columns[0])):
        west = WORLD_MIN_X + (j * TILE) * res
        u = (mx * (-res) - west * (-res)) / (res * (-res))
        ok_x = inside(u, 0, TILE, compat) & (j >= 0) & (j < b["n_cols"]) & (
            b["scene_maxx"] >= west) & (b["scene_minx"] <= west + TILE * res)
        if again_x is not None:
            ok_x &= j != again_x
        if not ok_x.any():
            continue
        for i, again_y in ((lines[0], None), (lines[1], lines[0])):
            north = WORLD_MAX_Y + (i * TILE) * (-res)
            v = (my * res - res * north) / (res * (-res))
            ok = ok_x & inside(v, 0, TILE, compat) & (i >= 0) & (i < b["n_rows"]) & (
                b["scene_maxy"] >= north + TILE * (-res)) & (b["scene_miny"] <= north)
            if again_y is not None:
                ok &= i != again_y
            if ok.any():
                k = np.flatnonzero(ok)
                found.append((k, j[k], i[k],
                              whole(v[k], compat) * TILE + whole(u[k], compat)))
    if not found:
        return
    k, j, i, cell = (np.concatenate(c) for c in zip(*found))
    tile = j * 65536 + i
    if window:
        keep = _in_window(b, g, window, compat, tile, px[k], py[k])
        k, tile, cell = k[keep], tile[keep], cell[keep]
    order = (b["seq"] << place_bits) + py[k] * b["width"] + px[k]
    packed = (order << VALUE_BITS) + value[k] + VALUE_BIAS
    by = np.argsort(tile, kind="stable")
    tile, cell, packed = tile[by], cell[by], packed[by]
    cuts = np.flatnonzero(tile[1:] != tile[:-1]) + 1
    for a, z in zip([0, *cuts], [*cuts, len(tile)]):
        if z > a:
            tiles.lay((b["z"] << 32) + int(tile[a]), b["band"], cell[a:z], packed[a:z])


def _in_window(b: dict, g: list[float], window: str, compat: bool, tile: np.ndarray,
               px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Whether a source cell is between its tile's upper-left and lower-right corners."""
    tiles, which = np.unique(tile, return_inverse=True)
    j, i, res = tiles >> 16, tiles & 0xFFFF, b["res"]
    west, north = WORLD_MIN_X + (j * TILE) * res, WORLD_MAX_Y + (i * TILE) * (-res)
    ends = []
    for x, y in ((west, north), (west + TILE * res, north + TILE * (-res))):
        sy = to_latitude(y) if b["geographic"] else y
        place = to_pixel((x / b["x_radius"]) * b["x_degrees"], sy, g)
        if place is None:
            return np.ones(len(px), dtype=bool)
        ends.append([whole(np.clip(p, -2147483648.0, 2147483647.0), compat) for p in place])
    (x0, y0), (x1, y1) = ends
    if window == "abs":
        x1, y1 = np.abs(x1), np.abs(y1)
    return ((px >= x0[which]) & (px <= x1[which]) & (py >= y0[which]) & (py <= y1[which]))


def inverse_patches(tiles: DataFrame, compat: bool) -> DataFrame:
    """Patches of (block, tile) rows with the :data:`INVERSE` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        for batch in batches:
            for b in block_rows(batch):
                inverse_patch(b, compat, rows)
                if rows.size > BATCH_VALUES:
                    yield rows.batch()
        yield rows.batch()

    return tiles.select(*INVERSE).mapInArrow(run, PATCHES)


def forward_cells(blocks: DataFrame, compat: bool, window: str | None, place_bits: int) -> DataFrame:
    """Patches of (block, zoom) rows with the :data:`FORWARD` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows()
        tiles = HeldTiles(rows, most)
        for batch in batches:
            for b in block_rows(batch):
                forward_patches(b, compat, window, place_bits, tiles)
                if rows.size > BATCH_VALUES:
                    yield rows.batch()
        while tiles.held:
            tiles.leave()
            if rows.size > BATCH_VALUES:
                yield rows.batch()
        yield rows.batch()

    most = HELD_TILES
    return blocks.select(*FORWARD).mapInArrow(run, PATCHES)


def overlaid(patches: DataFrame, compat: bool, salts: int = 1) -> DataFrame:
    """One row per (tile, band) that has a patch: its filled cells as sorted ``entries``
    (value << 16 | cell, the value less 32768 if not ``compat``) and their numbers.

    With ``salts`` a tile's patches, salted by their order, are first merged in parts.
    """
    if salts > 1:
        salt = F.pmod(F.hash("seq", F.get("packed", F.lit(0))), F.lit(salts))
        patches = _lay(patches.withColumn("salt", salt), ["tile_id", "band", "salt"], None)
    return _lay(patches, ["tile_id", "band"], compat)


def _lay(patches: DataFrame, keys: list[str], compat: bool | None) -> DataFrame:
    """Patches merged by ``keys``: to entries, or with ``compat`` None to patches again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canvas = np.full(TILE_CELLS, -1, dtype=np.int64)
        now, done, rows = None, [], Rows()

        def finish() -> None:
            cells = np.flatnonzero(canvas >= 0)
            packed = canvas[cells]
            canvas[cells] = -1
            if compat is None:
                rows.add(*now[:2], cells=cells, packed=packed)
                return
            value = (packed & ((1 << VALUE_BITS) - 1)) - VALUE_BIAS
            entries = np.sort(((value - (0 if compat else VALUE_BIAS)) << 16) | cells)
            n_negative = int(np.count_nonzero(value < 0)) if compat else 0
            done.append((*now[:2], entries.astype(np.int32), n_negative, len(cells)))

        def batch_of() -> pa.RecordBatch:
            if compat is None:
                return rows.batch()
            columns = list(zip(*done)) or [()] * 5
            out = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                 list_array(columns[2], np.int32), pa.array(columns[3], pa.int32()),
                 pa.array(columns[4], pa.int32())],
                names=["tile_id", "band", "entries", "n_negative", "n_filled"])
            done.clear()
            return out

        for batch in batches:
            told = zip(*[batch.column(k).to_pylist() for k in keys])
            shape = zip(*[batch.column(k).to_pylist() for k in ("seq", "dx0", "dy0", "w")])
            arrays = zip(*[lists(batch.column(k)) for k in ("patch", "cells", "packed")])
            for key, (seq, dx0, dy0, w), (patch, cells, packed) in zip(told, shape, arrays):
                if key != now:
                    if now is not None:
                        finish()
                        if len(done) * TILE_CELLS >= BATCH_VALUES or rows.size >= BATCH_VALUES:
                            yield batch_of()
                    now = key
                if len(patch):
                    h = len(patch) // w
                    patch = patch.reshape(h, w).astype(np.int64)
                    over = np.where(patch == HOLE, -1, (seq << VALUE_BITS) + patch + VALUE_BIAS)
                    under = canvas.reshape(TILE, TILE)[dy0:dy0 + h, dx0:dx0 + w]
                    np.maximum(under, over, out=under)
                elif len(cells):
                    canvas[cells] = np.maximum(canvas[cells], packed)
        if now is not None:
            finish()
        yield batch_of()

    columns = [*keys, "seq", "dx0", "dy0", "w", "patch", "cells", "packed"]
    return (patches.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(run, PATCHES if compat is None else ARRAYS))
