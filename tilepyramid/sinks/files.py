"""Tile file export (O-K4) with a status row per tile (O-K10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = "path string, n_bytes bigint, status string"


def export_tile_files(tiles: DataFrame, root: str, ext: str = "png") -> DataFrame:
    """Write ``root/z/x/y.ext`` from the executors; returns one status row per tile.

    Tiles with a ``band`` column go to ``root/b<band>/z/x/y.ext``.

    ``root`` is a folder or URI every executor can reach.  A file appears under its final name
    only when complete, so a retried task simply replaces it.  The files are written when the
    returned rows are consumed.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(root)
        known = set()
        for batch in batches:
            rows = []
            for top, z, x, y, data in zip(batch.top, batch.zoom_level, batch.tile_column,
                                          batch.tile_row, batch.tile_data):
                folder = f"{base}/{top}{z}/{x}"
                if folder not in known:
                    target.create_dir(folder, recursive=True)
                    known.add(folder)
                name = f"{folder}/{y}.{ext}"
                part = f"{folder}/.{y}.{uuid.uuid4().hex}"
                try:
                    with target.open_output_stream(part) as out:
                        out.write(data)
                    target.move(part, name)
                except BaseException:
                    if target.get_file_info(part).type != fs.FileType.NotFound:
                        target.delete_file(part)
                    raise
                rows.append((name, len(data), "finished"))
            yield pd.DataFrame(rows, columns=["path", "n_bytes", "status"])

    top = F.concat(F.lit("b"), F.col("band").cast("string"), F.lit("/")) \
        if "band" in tiles.columns else F.lit("")
    return tiles.select(top.alias("top"), "zoom_level", "tile_column", "tile_row",
                        "tile_data").mapInPandas(write, STATUS)
