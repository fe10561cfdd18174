"""The physical plans that the engine relies on at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tests.scenes import sample_scenes, tables
from tilepyramid import build_pyramid, mosaic, scene_tile_pairs, scenes_per_tile
from tilepyramid.operators.tileset import lookup, union_tilesets
from tilepyramid.sinks.tables import write_tiles
from tilepyramid.sources.rasters import read_blocks, read_scenes
from tilepyramid.sources.tiles import read_tiles

JIT_LIMIT = 8000


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plans"))
    scenes, blocks = tables(spark, sample_scenes())
    scenes.write.parquet(f"{root}/scenes")
    blocks.write.parquet(f"{root}/blocks")
    return read_scenes(spark, f"{root}/scenes"), read_blocks(spark, f"{root}/blocks")


def explain(df, mode="formatted"):
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = df.select("*")
        return spark._jvm.PythonSQLUtils.explainString(fresh._jdf.queryExecution(), mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def operators(df):
    """Operator names of the plan tree."""
    tree = explain(df).split("\n\n")[0]
    return re.findall(r"([A-Z][A-Za-z]+)(?: [A-Za-z]+)* \(\d+\)", tree)


@pytest.mark.parametrize("options", [
    {}, {"compat": False}, {"method": "forward"}, {"method": "forward", "window": "clip"},
    {"method": "forward", "window": "abs", "compat": False}, {"method": "forward", "bands": None}])
def test_mosaic_is_one_shuffle_with_compiled_loops(source, options):
    df = mosaic(source[1], source[0], "0-3", **options)
    names = operators(df)
    assert names.count("Exchange") == 1
    assert "SortMergeJoin" not in names and "SortAggregate" not in names
    assert not any("NestedLoop" in n or "Cartesian" in n for n in names)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", explain(df, "codegen"))]
    assert sizes and max(sizes) < JIT_LIMIT


def test_native_levels_shuffle_patches(source):
    plan = explain(build_pyramid(*source, "2-3"))
    shuffled = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    # the patches, by tile, and before them the rows of tiles that scenes touch
    assert sum("patch#" in s for s in shuffled) == 1 and not any("cell_id#" in s for s in shuffled)
    assert "HashAggregate(keys=[cell_id" not in plan


def test_lookups_over_a_built_pyramid_stay_compiled(spark, source):
    requests = spark.createDataFrame([(2, 1, 1), (3, 1, 2)], "z int, x int, y int")
    for options in ({"method": "forward"}, {}):
        tiles = build_pyramid(*source, "2-3", payload="raw", **options)
        named = union_tilesets({"a": tiles, "b": tiles})
        for found in (lookup(requests, tiles),
                      lookup(requests.withColumn("tileset", F.lit("a")), named)):
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)",
                                                explain(found, "codegen"))]
            assert sizes and max(sizes) < JIT_LIMIT


def test_block_scan_is_pruned(source):
    plan = explain(mosaic(source[1], source[0], [2]))
    assert "EqualTo(band,1)" in plan
    scan = re.search(r"ReadSchema: (struct<scene_id:bigint,band:.*)", plan).group(1)
    assert "cells:array<int>" in scan
    paths = re.findall(r"ReadSchema: .*", plan)
    assert not any("path:string" in p for p in paths)


def test_pairs_do_not_join(source):
    pairs = scene_tile_pairs(source[0], "0-15")
    assert not any("Join" in n for n in operators(pairs))
    # One shuffle of narrow (scene, column) rows, one for the counts.
    assert operators(pairs).count("Exchange") == 1
    assert operators(scenes_per_tile(pairs)).count("Exchange") == 2


def test_coarse_scenes_are_spread_before_the_fan_out(source):
    # The coarsest sample cell is about 190 km; zoom 3 has 20 km cells, zoom 9 about 300 m.
    assert operators(mosaic(source[1], source[0], [3])).count("Exchange") == 1
    assert operators(mosaic(source[1], source[0], [9])).count("Exchange") == 2


def test_fine_blocks_are_not_moved_for_coarse_ones(source):
    # at zoom 5 the 20 km cells of one scene are fine and the 190 km cells of others coarse
    found = operators(mosaic(source[1], source[0], [5]))
    assert found.count("Union") == 1 and found.count("Exchange") == 2


def test_salted_join_beyond_the_broadcast_bound(source):
    plan = explain(mosaic(source[1], source[0], [2], broadcast_rows=0))
    assert "salt" in plan


def test_lookup_prunes_zoom_partitions(spark, source, tmp_path):
    write_tiles(build_pyramid(*source, "1-2"), str(tmp_path / "t"))
    requests = spark.createDataFrame([(1, 2, 1, 1)], "req_id bigint, z int, x int, y int")
    tiles = read_tiles(spark, str(tmp_path / "t"))
    plan = explain(lookup(requests, tiles))
    assert "BroadcastHashJoin" in plan
    assert re.search(r"PartitionFilters: \[.*zoom_level.*= 2", plan)
