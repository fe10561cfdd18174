"""Tile table sources (O-S5, O-S7)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid import schemas
from tilepyramid.operators.tileset import union_tilesets


def read_tiles(spark: SparkSession, path: str | None = None, format: str = "parquet",
               **options) -> DataFrame:
    """A ``tiles`` table from Parquet or any DataFrame source, with ``band`` if it has one.

    For ``format="jdbc"`` pass ``partitionColumn="tile_column"`` with its bounds to read in
    parallel.
    """
    reader = spark.read.format(format).options(**options)
    df = reader.load(path) if path else reader.load()
    return schemas.conform(df, schemas.tiles_schema("band" in df.columns))


def parse_tilesets(conf: Mapping[str, str]) -> dict[str, str]:
    """Named tilesets from ``tile-dbs`` and ``<name>.path`` settings; blank paths are skipped."""
    names = (conf.get("tile-dbs") or "").split(",")
    paths = {name: conf.get(f"{name}.path") for name in names if name}
    return {name: path for name, path in paths.items() if path}


def read_tilesets(spark: SparkSession, paths: Mapping[str, str], **options) -> DataFrame:
    """Union of named tile tables with a ``tileset`` column; blank paths are skipped."""
    parts = {name: read_tiles(spark, path, **options) for name, path in paths.items() if path}
    empty = spark.createDataFrame([], schemas.TILES).withColumn(
        "tileset", F.lit(None).cast("string"))
    return union_tilesets(parts) if parts else empty
