"""Table sinks (O-K6, O-K7, O-K9) with their status (O-K10) and the georeferenced block table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilepyramid import schemas
from tilepyramid.constants import RESOLUTIONS
from tilepyramid.functions.tilekey import interleaved
from tilepyramid.operators.georeference import georeference


def write_tiles(tiles: DataFrame, path: str | None = None, format: str = "parquet",
                mode: str | None = None, **options) -> list[dict[str, int | None]]:
    """Write tiles to Parquet by zoom, or to any sink (``jdbc``, a document store connector).

    The Parquet form overwrites just the zooms it holds, so a repeated run does not duplicate
    rows; neighbouring tiles are stored together, so a lookup can skip row groups.  A ``band``
    column is kept.  Other sinks append in batches, unless ``mode`` says otherwise: they repeat
    rows if a run is repeated.  The order is that of interleaved column and row bits, so that a
    file or row group covers a small box of tiles.

    Returns the status of each zoom written, counted while writing: ``z``, ``n_tiles`` (rows),
    ``n_bytes`` and, of tiles built with ``status=True``, ``n_cells``, ``vmin`` and ``vmax``.
    """
    told = [c for c in schemas.STATUS if c in tiles.columns]
    schema = schemas.tiles_schema("band" in tiles.columns)
    if format == "parquet":
        rows = schemas.conform(tiles, T.StructType(
            [*schema.fields, *[T.StructField(c, T.IntegerType()) for c in told]]))
        place = ["zoom_level", interleaved(F.col("tile_column"), F.col("tile_row")),
                 *schemas.TILE_KEY[1:]]
        rows = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    else:
        rows = tiles
    # Observed after the range shuffle, whose sampling reads the rows before it once more.
    seen = Observation()
    rows = rows.observe(seen, *_status(told)).drop(*told)
    if format == "parquet":
        (
            rows.write.mode(mode or "overwrite")
            .option("partitionOverwriteMode", "dynamic").options(**options)
            .partitionBy("zoom_level").parquet(path)
        )
    else:
        writer = rows.write.format(format).mode(mode or "append").options(**options)
        if path:
            writer.save(path)
        else:
            writer.save()
    found = seen.get
    names = ["n_tiles", "n_bytes", *(["n_cells", "vmin", "vmax"] if told else [])]
    return [{"z": z, **{n: found[f"{n}_{z}"] for n in names}} for z in range(len(RESOLUTIONS))
            if found[f"n_tiles_{z}"]]


def _status(told: list[str]) -> list[Column]:
    """The status of every zoom as aggregates of one pass."""
    out = []
    for z in range(len(RESOLUTIONS)):
        def of(c: str | Column, z: int = z) -> Column:
            return F.when(F.col("zoom_level") == z, c if isinstance(c, Column) else F.col(c))

        values = {"n_tiles": F.count(of("tile_column")),
                  "n_bytes": F.sum(of(F.octet_length("tile_data").cast("long")))}
        if told:
            values |= {"n_cells": F.sum(of(F.col("n_filled").cast("long"))),
                       "vmin": F.min(of("vmin")), "vmax": F.max(of("vmax"))}
        out += [v.alias(f"{n}_{z}") for n, v in values.items()]
    return out


def create_tiles_table(spark: SparkSession, name: str, path: str, band: bool = False) -> None:
    """Register the ``tiles`` table over a Parquet folder."""
    columns = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in schemas.tiles_schema(band))
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"PARTITIONED BY (zoom_level) LOCATION '{path}'"
    )


def write_blocks(blocks: DataFrame, scenes: DataFrame, path: str) -> None:
    """Store blocks together with their georeference, so that later builds need no join."""
    georeference(blocks, scenes).write.mode("overwrite").parquet(path)
