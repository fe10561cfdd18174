import os
import random

import pytest
from pyspark.sql import functions as F

from tests import model
from tests.scenes import sample_scenes, tables
from tilepyramid import build_pyramid, mosaic, pyramid_report, schemas
from tilepyramid.operators.tileset import dense_tiles, gaps, lookup
from tilepyramid.sinks.files import export_tile_files
from tilepyramid.sinks.shards import read_shards, write_shards
from tilepyramid.sinks.tables import create_tiles_table, write_tiles
from tilepyramid.sources.rasters import (
    block_cells,
    list_scenes,
    listed_scenes,
    read_blocks,
    read_scenes,
    with_path_seq,
)
from tilepyramid.sources.tiles import parse_tilesets, read_tiles, read_tilesets


@pytest.fixture(scope="module")
def tiles(spark):
    scenes, blocks = tables(spark, sample_scenes())
    return build_pyramid(scenes, blocks, "1-2").cache()


def keyed(df):
    return sorted((r.zoom_level, r.tile_column, r.tile_row, bytes(r.tile_data))
                  for r in df.collect())


def tile_rows(spark, *rows):
    return spark.createDataFrame([(*k, bytearray(d)) for *k, d in rows], schemas.TILES)


def test_listing(spark, tmp_path):
    for name in ("a/x.tif", "a/y.TIF", "top.tif", "a/b/deep.tif", "b/w.tif", "a/a.tif"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(b"x")
    got = list_scenes(spark, str(tmp_path / "r")).orderBy("seq").collect()
    assert [(r.path.rsplit("/r/", 1)[1], r.seq) for r in got] == [
        ("a/a.tif", 0), ("a/x.tif", 1), ("b/w.tif", 2)]


def test_path_rank_is_dense_over_many_partitions(spark):
    files = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("path"))
    rows = with_path_seq(files).orderBy("path").collect()
    assert [r.seq for r in rows] == list(range(5000))


def test_scene_and_block_tables(spark, tmp_path):
    scenes, blocks = tables(spark, sample_scenes())
    scenes.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "s"))
    blocks.write.parquet(str(tmp_path / "b"))
    assert read_scenes(spark, str(tmp_path / "s")).schema.names == schemas.SCENES.names
    with pytest.raises(ValueError, match="missing columns"):
        read_scenes(spark, str(tmp_path / "b"))
    cells = block_cells(read_blocks(spark, str(tmp_path / "b")))
    by_key = {(r.scene_id, r.band, r.px, r.py): r.value for r in cells.collect()}
    for s in sample_scenes():
        for band, px in s["pixels"].items():
            for y, row in enumerate(px):
                for x, v in enumerate(row):
                    assert by_key[s["scene_id"], band, x, y] == v


def test_parquet_round_trip_is_idempotent(spark, tiles, tmp_path):
    path = str(tmp_path / "tiles")
    write_tiles(tiles, path)
    write_tiles(tiles, path)
    assert keyed(read_tiles(spark, path)) == keyed(tiles)
    # Rewriting one zoom leaves the other alone.
    write_tiles(tiles.filter("zoom_level = 1").limit(1), path)
    assert read_tiles(spark, path).filter("zoom_level = 2").count() == tiles.filter(
        "zoom_level = 2").count()
    assert read_tiles(spark, path).filter("zoom_level = 1").count() == 1


def test_other_sinks_get_the_four_columns(spark, tiles, tmp_path):
    path = str(tmp_path / "orc")
    write_tiles(tiles, path, format="orc")
    assert keyed(read_tiles(spark, path, format="orc")) == keyed(tiles)
    write_tiles(tiles, format="noop")


def test_tiles_table(spark, tiles, tmp_path):
    path = str(tmp_path / "table")
    write_tiles(tiles, path)
    create_tiles_table(spark, "tiles_ddl", path)
    spark.sql("MSCK REPAIR TABLE tiles_ddl")
    assert keyed(spark.table("tiles_ddl")) == keyed(tiles)
    spark.sql("DROP TABLE tiles_ddl")


def test_shards_round_trip(spark, tiles, tmp_path):
    for attempt in range(2):
        report = write_shards(tiles, str(tmp_path / "shards"), bits=1).collect()
        assert sum(r.n_tiles for r in report) == tiles.count()
    names = sorted(os.listdir(tmp_path / "shards"))
    assert names == sorted(os.path.basename(r.shard) for r in report) and len(names) > 2
    assert keyed(read_shards(spark, str(tmp_path / "shards"))) == keyed(tiles)


def banded(df):
    return sorted((r.zoom_level, r.tile_column, r.tile_row, r.band, bytes(r.tile_data))
                  for r in df.collect())


def test_bands_reach_every_sink_that_can_hold_them(spark, tmp_path):
    scenes, blocks = tables(spark, sample_scenes())
    tiles = build_pyramid(scenes, blocks, [2], bands=None).cache()
    assert tiles.count() > tiles.select(*schemas.TILE_KEY).distinct().count()
    write_tiles(tiles, str(tmp_path / "t"))
    assert banded(read_tiles(spark, str(tmp_path / "t"))) == banded(tiles)
    report = export_tile_files(tiles, str(tmp_path / "f")).collect()
    assert len({r.path for r in report}) == tiles.count()
    for z, x, y, band, data in banded(tiles):
        assert (tmp_path / "f" / f"b{band}" / str(z) / str(x) / f"{y}.png").read_bytes() == data
    with pytest.raises(ValueError, match="bands"):
        write_shards(tiles, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="mounted folder"):
        write_shards(tiles.drop("band"), "s3a://bucket/shards")


def test_listing_orders_scenes(spark):
    scenes = tables(spark, sample_scenes())[0].withColumn(
        "path", F.concat(F.lit("r/"), F.col("path")))
    files = with_path_seq(spark.createDataFrame(
        [("file:/x/r/s/3.tif",), ("file:/x/r/s/1.tif",), ("file:/x/r/s/8.tif",)], "path string"))
    got = listed_scenes(scenes, files)
    assert got.columns == scenes.columns
    assert {(r.scene_id, r.seq) for r in got.collect()} == {(1, 0), (3, 1)}


def test_lookup_reads_the_levels_and_range_asked_for(spark, tiles, tmp_path):
    write_tiles(tiles, str(tmp_path / "t"))
    requests = spark.createDataFrame([(1, 2, 1, 1), (2, 2, 2, 1)], "req_id bigint, z int, x int, y int")
    plan = lookup(requests, read_tiles(spark, str(tmp_path / "t")))._jdf.queryExecution().toString()
    assert "zoom_level#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "= 2)" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(tile_row,1)" in pushed and "Or(And(" in pushed
    empty = lookup(requests.limit(0), read_tiles(spark, str(tmp_path / "t")))
    assert empty.collect() == []


def rows_read(spark, df):
    """Rows that the scan of a tile table gave out, and files it opened."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = df.select("*")
        fresh.collect()
        leaves = fresh._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(k).metrics() for k in range(leaves.size())]
        scans = [m for m in scans if m.contains("numFiles")]
        return tuple(sum(m.apply(n).value() for m in scans) for n in ("numOutputRows", "numFiles"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_scattered_requests_skip_row_groups(spark, tmp_path):
    n = 64
    side = spark.range(n).select(F.col("id").cast("int").alias("v"))
    grid = side.select(F.lit(6).alias("zoom_level"), F.col("v").alias("tile_column")).crossJoin(
        side.select(F.col("v").alias("tile_row"))).withColumn("tile_data", F.lit(b"x"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_tiles(grid, str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    tiles = read_tiles(spark, str(tmp_path / "t"))
    corners = [(6, 1, 1), (6, 62, 2), (6, 2, 61), (6, 62, 62), (6, 63, 63)]
    requests = spark.createDataFrame(corners, "z int, x int, y int")
    found = lookup(requests, tiles)
    assert found.filter("tile_data IS NOT NULL").count() == 5
    assert rows_read(spark, tiles)[0] == n * n
    # a box of all four corners would hold every row
    assert rows_read(spark, found)[0] <= n * n // 2
    middle = spark.createDataFrame([(6, 9, 9), (6, 10, 10)], "z int, x int, y int")
    assert rows_read(spark, lookup(middle, tiles))[0] <= n * n // 8


def test_tile_files(spark, tiles, tmp_path):
    report = export_tile_files(tiles, str(tmp_path / "out")).collect()
    assert {r.status for r in report} == {"finished"}
    for z, x, y, data in keyed(tiles):
        assert (tmp_path / "out" / str(z) / str(x) / f"{y}.png").read_bytes() == data
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "out")) == tiles.count()


@pytest.mark.parametrize("broadcast_keys", [10, 0])
def test_lookup(spark, broadcast_keys):
    stored = tile_rows(spark, (2, 1, 1, b"b"), (2, 1, 1, b"a"), (11, 4, -1, b"c"), (3, 3, 3, b"d"))
    requests = spark.createDataFrame(
        [(1, 2, 1, 1), (2, 2, 1, 1), (3, 11, 4, -1), (4, 2, 0, 1), (5, 3, 3, 2)],
        "req_id bigint, z int, x int, y int")
    got = {r.req_id: r.tile_data and bytes(r.tile_data)
           for r in lookup(requests, stored, broadcast_keys).collect()}
    assert got == {1: b"a", 2: b"a", 3: b"c", 4: None, 5: None}


def test_tilesets(spark, tmp_path):
    conf = {"tile-dbs": "one,two,three,four", "one.path": str(tmp_path / "1"), "two.path": "",
            "three.path": str(tmp_path / "3"), "five.path": "x"}
    paths = parse_tilesets(conf)
    assert list(paths) == ["one", "three"]
    assert parse_tilesets({}) == {}
    write_tiles(tile_rows(spark, (2, 1, 1, b"one")), paths["one"])
    write_tiles(tile_rows(spark, (2, 1, 1, b"three")), paths["three"])
    named = read_tilesets(spark, {**paths, "two": ""})
    requests = spark.createDataFrame(
        [("one", 2, 1, 1), ("three", 2, 1, 1), ("two", 2, 1, 1)],
        "tileset string, z int, x int, y int")
    got = {r.tileset: r.tile_data and bytes(r.tile_data)
           for r in lookup(requests, named).collect()}
    assert got == {"one": b"one", "three": b"three", "two": None}
    assert read_tilesets(spark, {}).columns == [*schemas.TILES.names, "tileset"]


def test_dense_tiles(spark):
    some = tile_rows(spark, (1, 0, 2, b"x"), (1, 1, 0, b"y"))
    rows = dense_tiles(some, [1], b"blank").collect()
    assert len(rows) == 6
    assert {bytes(r.tile_data) for r in rows if r.is_blank} == {b"blank"}
    assert sum(not r.is_blank for r in rows) == 2


@pytest.mark.parametrize("bands", [None, (1, 3)])
def test_gaps_are_what_no_interval_covers(spark, bands):
    rng = random.Random(3)
    runs = [(z, rng.randrange(0, 2 ** z), a, a + rng.randrange(0, 3), rng.choice([1, 3]))
            for z in (2, 3) for a in [rng.randrange(0, 2 ** z) for _ in range(9)]]
    table = spark.createDataFrame(runs + [(3, 99, 0, 1, 1), (2, 0, 40, 41, 1)],
                                  "z int, tile_column int, first_row int, last_row int, band int")
    got = gaps(table if bands else table.drop("band"), "2-4", bands).collect()
    want = set()
    for z in (2, 3, 4):
        n_cols, n_rows = model.dims(z)
        for band in bands or [None]:
            want |= {(z, j, i, band) for j in range(n_cols) for i in range(n_rows) if not any(
                r[:2] == (z, j) and r[2] <= i <= r[3] and band in (None, r[4]) for r in runs)}
    assert len(got) == len(want)
    assert {(r.z, r.tile_column, r.grid_row, r.band if bands else None) for r in got} == want


def test_lookup_by_band(spark, tmp_path):
    scenes, blocks = tables(spark, sample_scenes())
    tiles = build_pyramid(scenes, blocks, [2], bands=(1, 2), stretch=False).cache()
    held = {(r.tile_column, r.tile_row, r.band): bytes(r.tile_data) for r in tiles.collect()}
    requests = tiles.select(F.lit(2).alias("z"), F.col("tile_column").alias("x"),
                            F.col("tile_row").alias("y")).distinct()
    asked = requests.withColumn("band", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))))
    got = {(r.x, r.y, r.band): r.tile_data and bytes(r.tile_data)
           for r in lookup(asked, tiles).collect()}
    assert {k: v for k, v in got.items() if v is not None} == held
    assert len(got) == 3 * requests.count()
    for sides in ((requests, tiles), (asked, tiles.drop("band"))):
        with pytest.raises(ValueError, match="band"):
            lookup(*sides)


def test_writing_tells_what_was_written(spark, tmp_path):
    scenes, blocks = tables(spark, sample_scenes())
    tiles = build_pyramid(scenes, blocks, "1-3", payload="raw", status=True)
    status = write_tiles(tiles, str(tmp_path / "t"))
    stored = read_tiles(spark, str(tmp_path / "t"))
    assert stored.columns == schemas.TILES.names
    want = {r.z: tuple(r)[1:] for r in pyramid_report(mosaic(blocks, scenes, "1-3")).collect()}
    assert [s["z"] for s in status] == [1, 2, 3]
    for s in status:
        n = stored.filter(f"zoom_level = {s['z']}").count()
        assert (s["n_tiles"], s["n_bytes"]) == (n, 65536 * n) and n >= want[s["z"]][0]
        assert (s["n_cells"], s["vmin"], s["vmax"]) == want[s["z"]][1:]
    again = write_tiles(stored, format="noop")
    assert [(s["z"], s["n_tiles"]) for s in again] == [(s["z"], s["n_tiles"]) for s in status]
    assert write_tiles(stored.limit(0), str(tmp_path / "none")) == []
