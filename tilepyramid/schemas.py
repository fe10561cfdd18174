"""Explicit schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCENES = T.StructType([
    T.StructField("scene_id", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("epsg", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("bands", T.IntegerType()),
    T.StructField("gt", T.ArrayType(T.DoubleType())),
])

BLOCKS = T.StructType([
    T.StructField("scene_id", T.LongType()),
    T.StructField("band", T.IntegerType()),
    T.StructField("block_row", T.IntegerType()),
    T.StructField("block_col", T.IntegerType()),
    T.StructField("bw", T.IntegerType()),
    T.StructField("bh", T.IntegerType()),
    T.StructField("cells", T.ArrayType(T.IntegerType())),
])

TILES = T.StructType([
    T.StructField("zoom_level", T.IntegerType()),
    T.StructField("tile_column", T.IntegerType()),
    T.StructField("tile_row", T.IntegerType()),
    T.StructField("tile_data", T.BinaryType()),
])


def tiles_schema(band: bool) -> T.StructType:
    """``TILES``, with a ``band`` column if tiles of several bands are held."""
    return T.StructType([*TILES.fields, *([T.StructField("band", T.IntegerType())] if band else [])])


#: What a build can tell of a tile besides its payload.
STATUS = ("n_filled", "vmin", "vmax")
TILE_KEY = ("zoom_level", "tile_column", "tile_row")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``; a missing column is an error, extra columns are pruned."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
