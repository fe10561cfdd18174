"""Tile lookup and dense grids over tile tables (O-S6, O-S7, O-K1)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilepyramid.constants import RESOLUTIONS
from tilepyramid.functions.tilekey import interleaved, tile_row
from tilepyramid.operators.grid import world_dims, zoom_table
from tilepyramid.schemas import TILE_KEY
from tilepyramid.sources.zooms import check_zooms

# A request key is four short values; one million of them is tens of megabytes.
BROADCAST_KEYS = 1_000_000
# Boxes that requests are cut into, and the bits of the interleaved key that tell boxes apart.
BOXES = 32
PREFIX_BITS = 10


def lookup(
    requests: DataFrame, tiles: DataFrame, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """Payload for each request row (z, x, y and, for named tilesets, ``tileset``).

    Where tiles of several bands are stored, requests name a ``band`` too. ``tile_data`` is NULL when the tile is missing; if a key is stored more than once the
    smallest payload is taken, so the answer does not depend on row order.  The tile table is
    first cut to the levels and to at most ``BOXES`` boxes of columns and rows that hold all keys, as
    literal filters, so that partitions, files and row groups are skipped; then to the keys, by
    broadcast if they are counted small.
    """
    if ("band" in requests.columns) != ("band" in tiles.columns):
        raise ValueError("either both requests and tiles have a band, or neither")
    named = [c for c in ("tileset", "band") if c in requests.columns]
    rename = {"zoom_level": "z", "tile_column": "x", "tile_row": "y"}
    stored = tiles.select(*named, *[F.col(c).alias(rename[c]) for c in TILE_KEY], "tile_data")
    on = [*named, "z", "x", "y"]
    keys = requests.select(*on).distinct()
    n, levels, boxes = _boxes(keys)
    if boxes:
        stored = stored.filter(F.col("z").isin(*levels) & reduce(lambda a, b: a | b, [
            F.col("x").between(x0, x1) & F.col("y").between(y0, y1) for x0, x1, y0, y1 in boxes]))
    else:
        stored = stored.limit(0)
    if n <= broadcast_keys:
        keys = F.broadcast(keys)
    hits = stored.join(keys, on, "left_semi").groupBy(*on).agg(
        F.min("tile_data").alias("tile_data"))
    return requests.join(hits, on, "left")


def _boxes(keys: DataFrame) -> tuple[int, list[int], list[tuple[int, int, int, int]]]:
    """The number of keys, their levels, and boxes (first and last column and row) that hold them.

    Keys are boxed by the leading ``PREFIX_BITS`` of their interleaved key; of these boxes, few
    thousand whatever the number of keys, neighbours are put together, but for the widest gaps.
    """
    spare = F.greatest(2 * (F.col("z") + 1) - PREFIX_BITS, F.lit(0))
    prefix = F.call_function("shiftright", interleaved(F.col("x"), F.col("y")), spare)
    ends = [f(c) for c in "xy" for f in (F.min, F.max)]
    found = keys.groupBy("z", prefix.alias("prefix")).agg(F.count(F.lit(1)), *ends).collect()
    found = sorted((r for r in found if r[0] is not None), key=lambda r: (r[0], r[1]))
    # another level is a gap as well; within one, the distance of the prefixes
    gaps = [float("inf") if a[0] != b[0] else b[1] - a[1] for a, b in zip(found, found[1:])]
    cuts = sorted(sorted(range(len(gaps)), key=lambda k: -gaps[k])[:BOXES - 1])
    boxes = []
    for a, b in zip([0, *[k + 1 for k in cuts]], [*[k + 1 for k in cuts], len(found)]):
        part = found[a:b]
        if part:
            boxes.append((min(r[3] for r in part), max(r[4] for r in part),
                          min(r[5] for r in part), max(r[6] for r in part)))
    return sum(r[2] for r in found), sorted({r[0] for r in found}), boxes


def dense_tiles(
    tiles: DataFrame, zooms: str | Iterable[int], blank: bytes, compat: bool = True,
    covered: DataFrame | None = None, bands: Sequence[int] | None = None,
    intervals: DataFrame | None = None,
) -> DataFrame:
    """``tiles`` plus a blank payload for every uncovered tile of the levels; adds ``is_blank``.

    With ``bands`` the tiles have a ``band`` column and each band of the grid is filled. The grid
    is generated by the tasks, so its size is bounded by the output alone.

    ``covered`` gives the keys of ``tiles`` when they can be had without computing or reading the
    tiles a second time; ``intervals`` gives them as runs of rows (see :func:`gaps`).
    """
    zooms, key = check_zooms(zooms), [*TILE_KEY, *([] if bands is None else ["band"])]
    if intervals is None:
        row = tile_row(F.col("zoom_level"), F.col("tile_row"), compat)  # its own inverse
        intervals = (tiles if covered is None else covered).select(
            F.col("zoom_level").alias("z"), "tile_column", *key[3:], row.alias("first_row"),
            row.alias("last_row"))
    blanks = gaps(intervals, zooms, bands).select(
        F.col("z").alias("zoom_level"), "tile_column",
        tile_row(F.col("z"), F.col("grid_row"), compat).alias("tile_row"), *key[3:],
        F.lit(blank).alias("tile_data"), F.lit(True).alias("is_blank"))
    return tiles.select(*key, "tile_data", F.lit(False).alias("is_blank")).unionByName(blanks)


def gaps(
    intervals: DataFrame, zooms: str | Iterable[int], bands: Sequence[int] | None = None
) -> DataFrame:
    """The tiles (z, tile_column, grid_row[, band]) of the levels that no interval covers.

    ``intervals`` are (z, tile_column, first_row, last_row[, band]) in top-down rows, both ends
    covered. Only intervals are shuffled, at most one for each first row of a column; a column's
    gaps lie between those of its intervals, and are exploded last.
    """
    keys = ["z", "tile_column", *([] if bands is None else ["band"])]
    columns = zoom_table(intervals.sparkSession, zooms).select(
        "z", "n_rows", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("tile_column"))
    if bands is not None:
        columns = columns.withColumn("band", F.explode(F.array(*[F.lit(int(b)) for b in bands])))
    # one interval just before and one just after each column's rows
    ends = columns.select(*keys, F.explode(F.array(F.lit(-1), F.col("n_rows"))).alias("first_row"))
    heights = F.array(*[F.lit(world_dims(z)[1]) for z in range(len(RESOLUTIONS))])
    within = intervals.filter(F.col("first_row") < F.get(heights, F.col("z")))
    longest = within.groupBy(*keys, "first_row").agg(F.max("last_row").alias("last_row"))
    runs = longest.unionByName(ends.withColumn("last_row", F.col("first_row")))
    before = Window.partitionBy(*keys).orderBy("first_row").rowsBetween(
        Window.unboundedPreceding, -1)
    free = runs.withColumn("after", F.max("last_row").over(before) + 1).filter(
        F.col("after") < F.col("first_row"))
    rows = F.explode(F.sequence(F.col("after"), F.col("first_row") - 1))
    return free.select(*keys, rows.alias("grid_row")).filter("grid_row >= 0")


def union_tilesets(parts: Mapping[str, DataFrame]) -> DataFrame | None:
    """Tile tables under their names in a ``tileset`` column; None if there is none."""
    named = [tiles.withColumn("tileset", F.lit(name)) for name, tiles in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named) if named else None
