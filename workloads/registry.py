"""Registered queries: each reads the given tables through ``rasters`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid import scene_tile_pairs, unpack
from tilepyramid.constants import RESOLUTIONS
from tilepyramid.functions import affine, cellvalue, crs, extent, tilekey
from tilepyramid.operators.extentjoin import extent_join
from tilepyramid.operators.grid import grid_dims, subdivide
from tilepyramid.operators.mosaic import tile_arrays
from tilepyramid.operators.overlap import ranked_scenes, scene_footprints, scenes_per_tile
from tilepyramid.operators.payload import PNG_SIGNATURE, blank_payload, payload_sum
from tilepyramid.operators.sampling import sample_points
from tilepyramid.operators.stretch import stretch_scenes, stretch_tiles, tile_cuts
from tilepyramid.operators.tileset import dense_tiles, lookup, union_tilesets
from tilepyramid.plans.pyramid import array_report, build_pyramid, tile_cells
from tilepyramid.schemas import TILE_KEY
from tilepyramid.sinks.tables import write_tiles
from tilepyramid.sources.rasters import block_cells, read_scenes, with_path_seq
from tilepyramid.sources.tiles import read_tiles
from workloads import rasters

ZOOMS = "2-3"
Query = Callable[[SparkSession, str], DataFrame]


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scenes = rasters.scenes(spark, sf_dir)
    return scenes, rasters.blocks(scenes)


def _round(name: str, digits: int = 3):
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = rasters.scenes(spark, sf_dir)
    parts = spark.sparkContext.defaultParallelism
    df = scenes.select("scene_id", "width", "height", "gt").repartition(parts, "scene_id")
    df = df.withColumn("py", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return df.withColumn("px", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))


def affine_pixel_to_map(spark, sf_dir):
    x, y = affine.pixel_to_map(F.col("px"), F.col("py"), affine.affine_columns("gt"))
    return _positions(spark, sf_dir).select("scene_id", "px", "py", x.alias("x"), y.alias("y"))


def affine_map_to_pixel(spark, sf_dir):
    g = affine.affine_columns("gt")
    x, y = affine.pixel_to_map(F.col("px"), F.col("py"), g)
    col, row = affine.map_to_pixel(x - F.lit(0.37) * g[1], y - F.lit(0.37) * g[5], g)
    return _positions(spark, sf_dir).select(
        "scene_id", "px", "py", col.alias("col"), row.alias("row"))


def crs_forward(spark, sf_dir):
    x, y = crs.geographic_to_projected(F.col("lon"), F.col("lat"))
    df = rasters.points(spark, sf_dir).select("id", x.alias("x"), y.alias("y"))
    return df.select("id", _round("x"), _round("y"))


def crs_inverse(spark, sf_dir):
    x, y = crs.geographic_to_projected(F.col("lon"), F.col("lat"))
    lon, lat = crs.projected_to_geographic(x, y)
    df = rasters.points(spark, sf_dir).select("id", lon.alias("lon"), lat.alias("lat"))
    return df.select("id", _round("lon", 7), _round("lat", 7))


def scene_extent(spark, sf_dir):
    df = scene_footprints(rasters.scenes(spark, sf_dir)).withColumn(
        "srs", crs.srs_pair(F.col("epsg")))
    df = df.select("scene_id", "srs.projected", "srs.geographic", *[
        F.col(f"scene_{c}").alias(c) for c in ("minx", "maxx", "miny", "maxy")])
    return df.select("scene_id", "projected", "geographic",
                     *[_round(c) for c in ("minx", "maxx", "miny", "maxy")])


def _extent_texts(spark, sf_dir):
    """Extent strings, valid and malformed in turn."""
    k = F.col("s_suppkey")
    a, b = (k * 37) % 300 - 170, (k * 23) % 110 - 60
    parts = [(a + F.lit(0.5)).cast("string"), (a + F.lit(7.25)).cast("string"),
             b.cast("string"), (b + 9).cast("string")]
    kind = k % 5
    text = (
        F.when(kind == 1, F.concat_ws(" ", *parts[:3]))
        .when(kind == 2, F.concat_ws(" ", *parts[:3], F.lit("north")))
        .when(kind == 3, F.concat(parts[0], F.lit("  "), F.concat_ws(" ", *parts[1:])))
        .when(kind == 4, F.concat_ws(" ", *parts, F.lit("m")))
        .otherwise(F.concat_ws(" ", *parts))
    )
    return rasters.table(spark, sf_dir, "supplier").select(
        k.alias("id"), text.alias("text"),
        extent.extent(a + F.lit(0.5), a + F.lit(7.25), b.cast("double"), b + F.lit(9.0))
        .alias("box"))


def extent_parse(spark, sf_dir):
    df = _extent_texts(spark, sf_dir).withColumn("e", extent.parse_extent(F.col("text")))
    return df.select("id", "e.minx", "e.maxx", "e.miny", "e.maxy")


def extent_wkt(spark, sf_dir):
    box = F.col("box")
    return _extent_texts(spark, sf_dir).select(
        "id", extent.extent_wkt(box, digits=3).alias("wkt"),
        extent.extent_wkt(box, compat=False, digits=3).alias("wkt_closed"))


def extent_intersects(spark, sf_dir):
    """All pairs of extents that meet, snapped to ten units so that many only touch."""
    k = F.col("s_suppkey")

    def snap(v):
        return F.floor(v / F.lit(10.0)) * 10.0

    west, south = snap((k * 37) % 300 - 170), snap((k * 23) % 110)
    boxes = rasters.table(spark, sf_dir, "supplier").select(
        k.alias("id"), extent.extent(west, west + 60, south, south + 30).alias("box"))
    others = boxes.select(F.col("id").alias("other"), F.col("box").alias("other_box"))
    return extent_join(boxes, others).filter("id < other").select("id", "other")


def region_overlap(spark, sf_dir):
    """Scenes over an irregular grid of the user's."""
    boxes = scene_footprints(rasters.scenes(spark, sf_dir)).select(
        "scene_id", extent.extent(*[F.col(f"scene_{c}") for c in ("minx", "maxx", "miny", "maxy")])
        .alias("box"))
    met = extent_join(boxes, rasters.regions(spark, sf_dir), right_box="region")
    return met.select("scene_id", "region_id")


def point_samples(spark, sf_dir):
    scenes, blocks = _sources(spark, sf_dir)
    x, y = crs.geographic_to_projected(F.col("lon"), F.col("lat"))
    points = rasters.points(spark, sf_dir).select(
        F.col("id").alias("point_id"), x.alias("x"), y.alias("y"))
    return sample_points(points, scenes, blocks).drop("band")


def _scene_boxes(spark, sf_dir, z):
    df = scene_footprints(rasters.scenes(spark, sf_dir))
    return df.select("scene_id", z.cast("int").alias("z"), *[
        F.col(f"scene_{c}").alias(c) for c in ("minx", "maxx", "miny", "maxy")])


def scene_grid_dims(spark, sf_dir):
    df = grid_dims(_scene_boxes(spark, sf_dir, F.col("scene_id") % len(RESOLUTIONS)))
    return df.select("scene_id", "z", "res", "total_cols", "total_rows", "n_cols", "n_rows")


def grid_tiles(spark, sf_dir):
    df = subdivide(_scene_boxes(spark, sf_dir, 3 + F.col("scene_id") % 5))
    return df.select("scene_id", "z", "tile_column", "grid_row", "tile_row",
                     *[_round(c) for c in ("minx", "maxx", "miny", "maxy")])


def _pairs(spark, sf_dir, zooms="2-4"):
    return scene_tile_pairs(rasters.scenes(spark, sf_dir), zooms)


def tile_path(spark, sf_dir):
    path = tilekey.tile_path(F.lit("out"), F.col("z"), F.col("x"), F.col("y"))
    return _pairs(spark, sf_dir).select(path.alias("path")).distinct()


def tile_key_parse(spark, sf_dir):
    path = tilekey.tile_path(F.lit("o.ut"), F.col("z"), F.col("x"), F.col("y"))
    df = _pairs(spark, sf_dir).select("scene_id", path.alias("path"))
    mixed = F.when(F.col("scene_id") % 2 == 0, F.translate("path", "/", "\\")).otherwise(
        F.col("path"))
    return df.withColumn("key", tilekey.tile_key(mixed)).select(
        "scene_id", "key.z", "key.x", "key.y", tilekey.remove_extension(F.col("path")).alias("stem"))


def byte_sign_roundtrip(spark, sf_dir):
    cells = rasters.embedding_blocks(spark, sf_dir).withColumn(
        "cells", cellvalue.signed_bytes(F.transform("cells", lambda v: v % 256)))
    return block_cells(cells).select(
        "scene_id", "px", "py", F.col("value").alias("s"),
        cellvalue.unsigned_byte(F.col("value")).alias("u"))


def scene_tile_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("z", "x", "y", "scene_id")


def tile_scene_ranks(spark, sf_dir):
    return scenes_per_tile(_pairs(spark, sf_dir))


def tile_scene_list(spark, sf_dir):
    scenes = rasters.scenes(spark, sf_dir)
    low, high = scenes.agg(F.min("seq"), F.max("seq")).first()
    return ranked_scenes(scene_tile_pairs(scenes, "0-4"), (low or 0, high or 0))


def path_rank(spark, sf_dir):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(rasters.scratch(spark, "checkpoints"))
    return with_path_seq(rasters.scenes(spark, sf_dir).select("path"))


def scene_table(spark, sf_dir):
    path = rasters.scratch(spark, "scenes")
    rasters.scenes(spark, sf_dir).write.parquet(path)
    return read_scenes(spark, path).select("scene_id", "seq", "epsg", "width", "height", "bands",
                                           F.col("gt")[0].alias("gt0"), F.col("gt")[5].alias("gt5"))


def embedded_block_cells(spark, sf_dir):
    return block_cells(rasters.embedding_blocks(spark, sf_dir)).select(
        "scene_id", "px", "py", "value")


def _mosaic(band: bool = False, **options) -> Query:
    def run(spark, sf_dir):
        scenes, blocks = _sources(spark, sf_dir)
        cells = tile_cells(scenes, blocks, ZOOMS, **options)
        return cells if band else cells.drop("band")
    return run


def tile_percentile_cuts(spark, sf_dir):
    scenes, blocks = _sources(spark, sf_dir)
    entries = tile_cuts(tile_arrays(blocks, scenes, ZOOMS))
    return unpack(entries.withColumn("cell", F.lit(0)).drop("entries", "n_filled", "blank")).drop(
        "band", "dx", "dy")


def _stretch(compat: bool) -> Query:
    def run(spark, sf_dir):
        scenes, blocks = _sources(spark, sf_dir)
        arrays = tile_arrays(blocks, scenes, ZOOMS, method="forward", compat=compat)
        return unpack(stretch_tiles(tile_cuts(arrays, compat), compat), compat).drop("band")
    return run


def scene_stretch(spark, sf_dir):
    return stretch_scenes(rasters.embedding_blocks(spark, sf_dir),
                          rasters.embedding_scenes(spark, sf_dir))


def scene_stretch_bands(spark, sf_dir):
    scenes, blocks = _sources(spark, sf_dir)
    return stretch_scenes(blocks, scenes)


def _pyramid(columns, **options) -> Query:
    def run(spark, sf_dir):
        scenes, blocks = _sources(spark, sf_dir)
        tiles = build_pyramid(scenes, blocks, ZOOMS, **options)
        return tiles.select(
            F.col("zoom_level").alias("z"), F.col("tile_column").alias("x"),
            F.col("tile_row").alias("y"), *columns())
    return run


def _sum(name: str = "sum_bytes"):
    return lambda: [payload_sum(F.col("tile_data")).alias(name)]


def _sum_and_size():
    return [F.octet_length("tile_data").alias("n_bytes"), *_sum()()]


def _png_check():
    size = len(PNG_SIGNATURE)
    head = F.substring("tile_data", 1, size) == F.lit(PNG_SIGNATURE)
    return [head.alias("sig_ok"), *_sum("decoded_sum")()]


def tiles_dense(spark, sf_dir):
    scenes, blocks = _sources(spark, sf_dir)
    tiles = build_pyramid(scenes, blocks, ZOOMS, method="forward", payload="raw")
    covered = scene_tile_pairs(scenes, ZOOMS).select(
        *[F.col(a).alias(b) for a, b in zip("zxy", TILE_KEY)])
    return dense_tiles(tiles, ZOOMS, blank_payload("raw"), covered=covered).select(
        F.col("zoom_level").alias("z"), F.col("tile_column").alias("x"),
        F.col("tile_row").alias("y"), "is_blank")


def _requests(spark, sf_dir):
    k = F.col("o_orderkey")

    def div(v, n):
        return F.floor(v / F.lit(float(n)))

    return rasters.table(spark, sf_dir, "orders").select(
        k.alias("req_id"), (2 + k % 2).cast("int").alias("z"),
        (div(k, 2) % 9).cast("int").alias("x"), (div(k, 18) % 10 - 1).cast("int").alias("y"))


def tile_lookup(spark, sf_dir):
    scenes, blocks = _sources(spark, sf_dir)
    tiles = build_pyramid(scenes, blocks, ZOOMS, method="forward", payload="raw")
    wanted = _requests(spark, sf_dir).groupBy("z", "x", "y").agg(
        F.count(F.lit(1)).alias("n_requests"))
    found = lookup(wanted, tiles)
    data = F.coalesce("tile_data", F.lit(b""))
    return found.select("z", "x", "y", "n_requests", F.when(
        F.col("tile_data").isNotNull(), payload_sum(data)).alias("sum_bytes"))


def band_lookup(spark, sf_dir):
    """Tiles of several bands, asked for by band; no scene has a fourth."""
    scenes, blocks = _sources(spark, sf_dir)
    tiles = build_pyramid(scenes, blocks, ZOOMS, method="forward", bands=None, stretch=False)
    wanted = _requests(spark, sf_dir).withColumn("band", (1 + F.col("req_id") % 4).cast("int"))
    wanted = wanted.groupBy("z", "x", "y", "band").agg(F.count(F.lit(1)).alias("n_requests"))
    data = F.coalesce("tile_data", F.lit(b""))
    return lookup(wanted, tiles).select("z", "x", "y", "band", "n_requests", F.when(
        F.col("tile_data").isNotNull(), payload_sum(data)).alias("sum_bytes"))


def tileset_lookup(spark, sf_dir):
    scenes, blocks = _sources(spark, sf_dir)
    parts = {
        name: build_pyramid(scenes.filter(F.col("epsg") == epsg), blocks, ZOOMS)
        for name, epsg in (("geographic", 4326), ("projected", 3857))
    }
    requests = _requests(spark, sf_dir).withColumn(
        "tileset", F.get(F.array(*[F.lit(n) for n in ("geographic", "projected", "unknown")]),
                         (F.col("req_id") % 3).cast("int")))
    found = lookup(requests, union_tilesets(parts))
    return found.select("req_id", "tileset", "z", "x", "y",
                        F.col("tile_data").isNotNull().alias("found"))


def bands_dense(spark, sf_dir):
    """Every band of every scene, with blank tiles for the rest of the grid."""
    scenes, blocks = _sources(spark, sf_dir)
    tiles = build_pyramid(scenes, blocks, ZOOMS, method="forward", bands=None, stretch=False,
                          dense=True)
    return tiles.select(
        F.col("zoom_level").alias("z"), F.col("tile_column").alias("x"),
        F.col("tile_row").alias("y"), "band", *_sum()())


def overlap_south_edge(spark, sf_dir):
    """All scenes moved to the southern edge of the grid, where rows turn negative."""
    scenes, k = rasters.scenes(spark, sf_dir), F.col("scene_id") % 7
    south = F.when(F.col("epsg") == 3857, F.lit(-19500000.0) - k * F.lit(90000.0)).otherwise(
        F.lit(-84.3) - k * F.lit(0.07))
    moved = scenes.withColumn("gt", F.transform(
        "gt", lambda g, i: F.when(i == 3, south).otherwise(g)))
    return scene_tile_pairs(moved, "11-11").select("scene_id", "x", "y")


def zoom_report(spark, sf_dir):
    scenes, blocks = _sources(spark, sf_dir)
    return array_report(tile_arrays(blocks, scenes, "2-4"))


def _written(spark, sf_dir):
    scenes, blocks = _sources(spark, sf_dir)
    path = rasters.scratch(spark, "tiles")
    return path, write_tiles(build_pyramid(scenes, blocks, ZOOMS, payload="raw", status=True), path)


def tiles_written(spark, sf_dir):
    """The pyramid written to a tile table and read again."""
    path, _ = _written(spark, sf_dir)
    return read_tiles(spark, path).select(
        F.col("zoom_level").alias("z"), F.col("tile_column").alias("x"),
        F.col("tile_row").alias("y"), *_sum()())


def write_status(spark, sf_dir):
    """What the write itself counted, a row per zoom."""
    _, status = _written(spark, sf_dir)
    return spark.createDataFrame(
        [tuple(s[c] for c in ("z", "n_tiles", "n_bytes", "n_cells", "vmin", "vmax"))
         for s in status], "z int, n_tiles long, n_bytes long, n_cells long, vmin int, vmax int")


def queries() -> dict[str, Query]:
    return {
        "affine_pixel_to_map": affine_pixel_to_map,
        "affine_map_to_pixel": affine_map_to_pixel,
        "crs_forward": crs_forward,
        "crs_inverse": crs_inverse,
        "scene_extent": scene_extent,
        "extent_parse": extent_parse,
        "extent_wkt": extent_wkt,
        "extent_intersects": extent_intersects,
        "grid_dims": scene_grid_dims,
        "grid_tiles": grid_tiles,
        "tile_path": tile_path,
        "tile_key_parse": tile_key_parse,
        "byte_sign_roundtrip": byte_sign_roundtrip,
        "scene_tile_overlap": scene_tile_overlap,
        "scenes_per_tile": tile_scene_ranks,
        "block_cells": embedded_block_cells,
        "mosaic_forward": _mosaic(method="forward"),
        "mosaic_forward_strict": _mosaic(method="forward", compat=False),
        "mosaic_forward_windowed": _mosaic(method="forward", window="clip"),
        "mosaic_inverse": _mosaic(),
        "mosaic_inverse_strict": _mosaic(compat=False),
        "mosaic_multiband": _mosaic(band=True, method="forward", bands=None),
        "tile_percentile_cuts": tile_percentile_cuts,
        "stretch_8bit": _stretch(True),
        "stretch_8bit_strict": _stretch(False),
        "scene_stretch": scene_stretch,
        "scene_stretch_bands": scene_stretch_bands,
        "tile_cells_u16": _mosaic(band=True, method="forward", bands=(1, 2, 3)),
        "tile_payload_raw": _pyramid(_sum_and_size, method="forward", payload="raw"),
        "tile_payload_png": _pyramid(_png_check),
        "tile_payload_u16": _pyramid(_sum_and_size, method="forward", stretch=False),
        "tiles_dense": tiles_dense,
        "pyramid_forward_u16_dense": _pyramid(_sum(), method="forward", stretch=False, dense=True),
        "pyramid_forward_png_dense": _pyramid(_sum(), method="forward", dense=True),
        "pyramid_windowed_png_dense": _pyramid(
            _sum(), method="forward", window="clip", dense=True),
        "pyramid_windowed_raw": _pyramid(
            _sum(), method="forward", window="clip", payload="raw"),
        "pyramid_abs_window_png_dense": _pyramid(
            _sum(), method="forward", window="abs", dense=True),
        "mosaic_forward_abs_window": _mosaic(method="forward", window="abs"),
        "pyramid_inverse_raw": _pyramid(_sum_and_size, payload="raw"),
        "pyramid_bands_u16_dense": bands_dense,
        "overlap_south_edge": overlap_south_edge,
        "pyramid_inverse_png": _pyramid(_sum()),
        "pyramid_inverse_png_strict": _pyramid(_sum(), compat=False),
        "tile_lookup": tile_lookup,
        "tileset_lookup": tileset_lookup,
        "tile_lookup_bands": band_lookup,
        "region_overlap": region_overlap,
        "point_samples": point_samples,
        "tile_scene_list": tile_scene_list,
        "path_rank": path_rank,
        "scene_table": scene_table,
        "tiles_written": tiles_written,
        "write_status": write_status,
        "pyramid_report": zoom_report,
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse PNG pyramid itself."""
    scenes, blocks = _sources(spark, sf_dir)
    return build_pyramid(scenes, blocks, ZOOMS)
