"""Percent-clip stretch to 8 bits (O-H1..O-H5)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilepyramid.constants import CLIP_HIGH, CLIP_LOW, TILE_CELLS
from tilepyramid.operators.georeference import BROADCAST_ROWS, join_by_scene
from tilepyramid.operators.mosaic import gather
from tilepyramid.operators.patches import block_rows, list_array, lists

#: Marks a missing sample of a whole scene, where values are not bound to 16 bits.
MISSING = -(1 << 31)
#: Distinct values that a counting task holds before it hands them on.
COUNTED = 1 << 22
PLACED = ["scene_id", "band", "width", "height", "block_row", "block_col", "bw", "bh", "cells"]


def half_up(v: Column) -> Column:
    """Round half toward positive infinity (Spark's ``round`` goes away from zero)."""
    return F.floor(v + 0.5).cast("int")


def percentile_at(at, n: int, p: float) -> Column:
    """Linear percentile of ``n`` sorted values, ``at(i)`` being the i-th, rounded half up."""
    x = (n - 1) * p
    i = math.floor(x)
    g = x - i
    if g == 0:
        return at(i).cast("int")
    return half_up(F.lit(1 - g) * at(i) + F.lit(g) * at(i + 1))


def array_percentile(values: Column, n: int, p: float) -> Column:
    """Percentile of an array column of known length."""
    ordered = F.sort_array(values)
    return percentile_at(lambda i: F.get(ordered, F.lit(i)), n, p)


def stretch(v: Column, lo: Column, hi: Column, compat: bool = True) -> Column:
    """Byte 0..255 of a value between its cuts.

    ``compat`` writes 0 above the high cut, otherwise 255.  Equal cuts give 0.
    """
    scaled = F.try_divide((v - lo).cast("double"), (hi - lo) / F.lit(255.0)).cast("int")
    return (
        F.when(v < lo, F.lit(0))
        .when(v > hi, F.lit(0 if compat else 255))
        .otherwise(F.coalesce(scaled, F.lit(0)))
        .cast("smallint")
    )


def tile_entries(
    cells: DataFrame, compat: bool = True, touched: DataFrame | None = None
) -> DataFrame:
    """:func:`tile_cuts` of a mosaic given as rows of cells."""
    return tile_cuts(gather(cells, compat, touched), compat)


def tile_cuts(arrays: DataFrame, compat: bool = True) -> DataFrame:
    """One row per (tile, band): ``entries``, the zero-inclusive cuts ``lo``, ``hi`` and ``blank``.

    ``blank`` is the stretched 0, which every cell outside ``entries`` takes. Sorting entries sorts
    values, so the cuts of the zero-filled canvas are read by position without ever filling it.
    """
    bias = 0 if compat else 32768
    pad = F.lit(TILE_CELLS) - F.col("n_filled")

    def at(i: int) -> Column:
        i = F.lit(i)
        entry_value = lambda k: F.shiftright(F.get("entries", k), 16) + bias
        return (
            F.when(i < F.col("n_negative"), entry_value(i))
            .when(i < F.col("n_negative") + pad, F.lit(0))
            .otherwise(entry_value(i - pad))
        )

    return arrays.withColumns({
        "lo": percentile_at(at, TILE_CELLS, CLIP_LOW),
        "hi": percentile_at(at, TILE_CELLS, CLIP_HIGH),
    }).select("tile_id", "band", "n_filled", "lo", "hi",
              stretch(F.lit(0), F.col("lo"), F.col("hi"), compat).alias("blank"), "entries")


def stretch_tiles(entries: DataFrame, compat: bool = True) -> DataFrame:
    """Packed filled cells with their stretched byte ``b``, from :func:`tile_entries`.

    The cells of a tile that are not among them hold its ``blank``.
    """
    bias = 0 if compat else 32768
    cells = entries.select("tile_id", "band", "lo", "hi", F.explode("entries").alias("entry"))
    value = F.shiftright("entry", 16) + bias
    return cells.select(
        "tile_id", "band", F.col("entry").bitwiseAND(0xFFFF).alias("cell"),
        stretch(value, F.col("lo"), F.col("hi"), compat).alias("b"),
    )


def scene_cuts(placed: DataFrame) -> DataFrame:
    """Exact ``lo``, ``hi`` per (scene_id, band) of blocks with their scene's size, no zero fill.

    Values are counted within each task, so that what moves is one pair of arrays (values, counts)
    for each task and band of a scene, however many blocks it has.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            for b in block_rows(batch, MISSING):
                values = _own(b)
                values = values[values != MISSING]
                held.setdefault((b["scene_id"], b["band"]), []).append(np.unique(
                    values, return_counts=True))
                size += len(held[b["scene_id"], b["band"]][-1][0])
                if size > COUNTED:
                    yield _counts(held)
                    held, size = {}, 0
        yield _counts(held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, done = None, [], []

        def finish() -> None:
            values, counts = _merged(parts)
            if len(values):
                ends = np.cumsum(counts)
                done.append((*now, *[_cut(values, ends, p) for p in (CLIP_LOW, CLIP_HIGH)]))

        for batch in batches:
            keys = zip(batch.column("scene_id").to_pylist(), batch.column("band").to_pylist())
            arrays = zip(lists(batch.column("values")), lists(batch.column("counts")))
            for key, part in zip(keys, arrays):
                if key != now and now is not None:
                    finish()
                    parts = []
                elif len(parts) > 64:
                    parts = [_merged(parts)]
                now = key
                parts.append(part)
        if now is not None:
            finish()
        columns = list(zip(*done)) or [()] * 4
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["scene_id", "band", "lo", "hi"])

    keys = ["scene_id", "band"]
    counts = placed.select(*PLACED).mapInArrow(
        count, "scene_id long, band int, values array<int>, counts array<long>")
    return counts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        cut, "scene_id long, band int, lo int, hi int")


def _own(b: dict) -> np.ndarray:
    """The samples of a block row that belong to its scene, by row."""
    cells = b["cells"]
    whole = np.full(b["bw"] * b["bh"], MISSING, dtype=np.int32)
    whole[:len(cells)] = cells[:len(whole)]
    return whole.reshape(b["bh"], b["bw"])[
        :max(0, b["height"] - b["block_row"] * b["bh"]), :max(0, b["width"] - b["block_col"] * b["bw"])]


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """One sorted (values, counts) pair of several."""
    values, where = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    counts = np.zeros(len(values), dtype=np.int64)
    np.add.at(counts, where, np.concatenate([c for _, c in parts]))
    return values, counts


def _counts(held: dict[tuple, list]) -> pa.RecordBatch:
    merged = [_merged(parts) for parts in held.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int32()),
         list_array([v for v, _ in merged], np.int32), list_array([c for _, c in merged], np.int64)],
        names=["scene_id", "band", "values", "counts"])


def _cut(values: np.ndarray, ends: np.ndarray, p: float) -> int:
    """The linear percentile of counted values, rounded half up."""
    x = (int(ends[-1]) - 1) * p
    i = math.floor(x)
    a, b = (int(values[np.searchsorted(ends, k, side="right")])
            for k in (i, min(i + 1, int(ends[-1]) - 1)))
    return a if x == i else math.floor((1 - (x - i)) * a + (x - i) * b + 0.5)


def stretch_scene_blocks(
    blocks: DataFrame, scenes: DataFrame, compat: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Blocks of every band of every scene stretched by its own cuts: scene_id, band, px0, py0, w and
    ``cells``, the bytes of the block's part of the scene, by row.

    Samples stay unsigned here; a missing one becomes 0.
    """
    size = scenes.select("scene_id", "width", "height")
    placed = join_by_scene(blocks, size, ["scene_id"], scenes.count(), broadcast_rows)
    cuts = scene_cuts(placed)
    # Blocks may hold bands that no scene row declares: the bound is counted from them.
    band_rows = blocks.select("scene_id", "band").distinct().limit(broadcast_rows + 1).count()
    cut = join_by_scene(placed, cuts, ["scene_id", "band"], band_rows, broadcast_rows)
    high = 0 if compat else 255

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            for b in block_rows(batch, MISSING):
                own, lo, hi = _own(b), b["lo"], b["hi"]
                out = np.where(own > hi, high, 0).astype(np.int16)
                if hi != lo:
                    scaled = ((own.astype(np.int64) - lo) / ((hi - lo) / 255.0)).astype(np.int16)
                    out = np.where((own >= lo) & (own <= hi), scaled, out)
                out[own == MISSING] = 0
                rows.append((b["scene_id"], b["band"], b["block_col"] * b["bw"],
                             b["block_row"] * b["bh"], own.shape[1]))
                cells.append(out.ravel())
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, k) for c, k in zip(columns, kinds)], list_array(cells, np.int16)],
                names=["scene_id", "band", "px0", "py0", "w", "cells"])

    return cut.select(*PLACED, "lo", "hi").mapInArrow(
        run, "scene_id long, band int, px0 int, py0 int, w int, cells array<smallint>")


def stretch_scenes(
    blocks: DataFrame, scenes: DataFrame, compat: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """:func:`stretch_scene_blocks` as rows of cells: scene_id, band, px, py, b."""
    stretched = stretch_scene_blocks(blocks, scenes, compat, broadcast_rows)
    cells = stretched.select("scene_id", "band", "px0", "py0", "w",
                             F.posexplode("cells").alias("at", "b"))
    return cells.select(
        "scene_id", "band", (F.col("px0") + F.col("at") % F.col("w")).alias("px"),
        (F.col("py0") + F.floor(F.col("at") / F.col("w")).cast("int")).alias("py"), "b")
