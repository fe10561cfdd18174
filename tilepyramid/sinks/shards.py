"""Sharded single-file tilesets (O-K8): one SQLite file per block of neighbouring tiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid import schemas

# Tiles per shard side as a power of two: a shard holds at most 256 x 256 tiles.
SHARD_BITS = 8
SHARDS = "shard string, n_tiles bigint"


def write_shards(tiles: DataFrame, root: str, bits: int = SHARD_BITS) -> DataFrame:
    """Pack tiles into ``root/z_px_py.mbtiles`` files; returns (shard, n_tiles) when consumed.

    Rows are shuffled and sorted by shard, then streamed, so a task holds one Arrow batch and
    one open file.  A shard is built under a private name in ``root`` (a shared folder) and
    renamed when complete: a lost executor leaves no half shard, and a retry replaces it whole.
    The format has no place for bands and needs a mounted folder; other input is refused.
    """
    if "band" in tiles.columns:
        raise ValueError("a shard cannot hold bands; write one set of shards for each")
    if "://" in root:
        raise ValueError(f"shards need a mounted folder that all executors share, not {root}")
    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import sqlite3
        import uuid

        os.makedirs(root, exist_ok=True)
        current, part, db, count, done = None, None, None, 0, []

        def finish() -> None:
            if current is None:
                return
            db.commit()
            db.close()
            os.replace(part, os.path.join(root, current))
            done.append((os.path.join(root, current), count))

        for batch in batches:
            for name, rows in batch.groupby("shard", sort=False):
                if name != current:
                    finish()
                    current, count = name, 0
                    part = os.path.join(root, f".{name}.{uuid.uuid4().hex}")
                    db = sqlite3.connect(part)
                    db.execute("CREATE TABLE tiles (zoom_level integer, tile_column integer, "
                               "tile_row integer, tile_data blob)")
                    db.execute("CREATE UNIQUE INDEX tile_index ON tiles "
                               "(zoom_level, tile_column, tile_row)")
                db.executemany(
                    "INSERT OR REPLACE INTO tiles VALUES (?, ?, ?, ?)",
                    ((int(z), int(x), int(y), bytes(d)) for z, x, y, d in zip(
                        rows.zoom_level, rows.tile_column, rows.tile_row, rows.tile_data)))
                count += len(rows)
        finish()
        yield pd.DataFrame(done, columns=["shard", "n_tiles"])

    parent = [F.shiftright(c, bits).cast("string") for c in ("tile_column", "tile_row")]
    name = F.concat(F.concat_ws("_", F.col("zoom_level").cast("string"), *parent),
                    F.lit(".mbtiles"))
    return (
        tiles.select(*schemas.TILE_KEY, "tile_data", name.alias("shard"))
        .repartition("shard").sortWithinPartitions("shard", *schemas.TILE_KEY)
        .mapInPandas(store, SHARDS)
    )


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """The ``tiles`` rows of all shards under ``root``, one shard per task at a time."""
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3
        from urllib.parse import unquote, urlparse

        for batch in batches:
            for path in batch["path"]:
                db = sqlite3.connect(unquote(urlparse(path).path))
                rows = db.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles")
                while part := rows.fetchmany(256):
                    yield pd.DataFrame(part, columns=list(columns))
                db.close()

    columns = schemas.TILES.fieldNames()
    shards = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*.mbtiles").select("path")
    return shards.mapInPandas(load, schemas.TILES)
