import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tests import model
from tests.scenes import cells_of, sample_scenes, scene, tables
from tilepyramid import build_pyramid, mosaic, pyramid_report, tile_cells, unpack
from tilepyramid.constants import RESOLUTIONS, WORLD_MAX_Y, WORLD_MIN_X
from tilepyramid.operators.payload import blank_payload, payload_sum
from tilepyramid.operators.stretch import stretch_scenes, stretch_tiles, tile_entries


def dense_scene():
    """A scene that fills all cells of one z = 2 tile (column 2, grid row 2)."""
    st = RESOLUTIONS[2]
    gt = [WORLD_MIN_X + 512 * st - 10.37 * st, st, 0, WORLD_MAX_Y - 512 * st + 8.41 * st, 0, -st]
    s = scene(900001, 0, 3857, 280, 280, gt, values=lambda: 0)
    s["pixels"][1] = [[500 + (x * 17 + y * 29 + x * y) % 3000 for x in range(280)]
                      for y in range(280)]
    return s


def canvases(cells):
    tiles = {}
    for (z, x, y, band, dx, dy), v in cells.items():
        tiles.setdefault((z, x, y, band), [0] * 65536)[dy * 256 + dx] = v
    return tiles


def decode_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, idat, header = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        body = data[at + 8:at + 8 + size]
        assert zlib.crc32(kind + body) == struct.unpack(">I", data[at + 8 + size:at + 12 + size])[0]
        header = body if kind == b"IHDR" else header
        idat += body if kind == b"IDAT" else b""
        at += 12 + size
    assert struct.unpack(">IIBBBBB", header) == (256, 256, 8, 0, 0, 0, 0)
    raw = zlib.decompress(idat)
    return b"".join(raw[k * 257 + 1:k * 257 + 257] for k in range(256))


def test_dense_tile_has_a_low_cut(spark):
    scenes, blocks = tables(spark, [dense_scene()], block=32)
    entries = tile_entries(mosaic(blocks, scenes, [2], method="forward"))
    full = entries.filter("n_filled = 65536").collect()
    assert [(r.lo, r.hi) for r in full] == [(559, 3439)]


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize("method", ["forward", "inverse"])
def test_cuts_stretch_and_payloads_equal_the_model(spark, compat, method):
    scenes, blocks = tables(spark, [*sample_scenes(), dense_scene()], block=32)
    options = {"method": method, "compat": compat}
    tiles = canvases(cells_of(tile_cells(scenes, blocks, [2], **options)))
    want = {k: model.clip(v, compat) for k, v in tiles.items()}
    cells = mosaic(blocks, scenes, [2], **options)
    entries = tile_entries(cells, compat)
    for r in unpack(entries.withColumn("cell", F.lit(0)), compat).collect():
        canvas = tiles[r.z, r.x, r.y, r.band]
        assert (r.lo, r.hi) == (model.percentile(canvas, .02), model.percentile(canvas, .98))
    stretched = unpack(stretch_tiles(entries, compat), compat).collect()
    assert len(stretched) == cells.count()
    for r in stretched:
        assert r.b == want[r.z, r.x, r.y, r.band][r.dy * 256 + r.dx]
    for payload, decode in (("raw", bytes), ("png", decode_png)):
        built = build_pyramid(scenes, blocks, [2], payload=payload, **options).collect()
        got = {(r.zoom_level, r.tile_column, r.tile_row, 1): list(decode(r.tile_data))
               for r in built}
        zero = {k: v for k, v in got.items() if k not in want}
        assert {k: v for k, v in got.items() if k in want} == want
        assert all(not any(v) for v in zero.values())
    raw16 = build_pyramid(scenes, blocks, [2], stretch=False, **options).collect()
    for r in raw16:
        canvas = tiles.get((r.zoom_level, r.tile_column, r.tile_row, 1), [0] * 65536)
        assert list(struct.unpack("<65536H", r.tile_data)) == [v % 65536 for v in canvas]


def test_every_touched_tile_is_emitted(spark):
    # The scene's east edge lies on a tile border, so the eastern neighbour is only touched.
    res = RESOLUTIONS[3]
    borders = [WORLD_MIN_X + j * 256 * res for j in range(1, 8)]
    border = next(b for b in borders if b - 4 * res + 4 * res == b)
    s = scene(1, 0, 3857, 2, 2, [border - 4 * res, 2 * res, 0, 1000.3, 0, -res], values=lambda: 50)
    scenes, blocks = tables(spark, [s])
    touched = {(3, j, 8 - i) for j, i, _, _ in model.pairs([s], 3)}
    filled = {k[:3] for k in cells_of(tile_cells(scenes, blocks, [3], method="forward"))}
    got = {(r.zoom_level, r.tile_column, r.tile_row): r.tile_data for r in build_pyramid(
        scenes, blocks, [3], method="forward", payload="raw").collect()}
    assert set(got) == touched and touched - filled
    assert all(got[k] == bytes(65536) for k in touched - filled)


def test_dense_pyramid(spark):
    scenes, blocks = tables(spark, sample_scenes())
    sparse = build_pyramid(scenes, blocks, "1-2").collect()
    dense = build_pyramid(scenes, blocks, "1-2", dense=True).collect()
    keys = {(r.zoom_level, r.tile_column, r.tile_row) for r in dense}
    assert len(dense) == len(keys) == 6 + 20
    blank = blank_payload("png")
    assert sum(r.tile_data != blank for r in dense) <= len(sparse)
    assert {bytes(r.tile_data) for r in sparse} <= {bytes(r.tile_data) for r in dense}
    # of any size: the grid is made by the tasks, and planning does not run it
    plan = build_pyramid(scenes, blocks, [12], dense=True)._jdf.queryExecution().toString()
    assert "Window" in plan and "LeftAnti" not in plan


def test_dense_pyramid_of_several_bands(spark):
    scenes, blocks = tables(spark, sample_scenes())
    options = {"method": "forward", "stretch": False}
    for bands, held in ((None, [1, 2, 3]), ((2, 3), [2, 3])):
        sparse = build_pyramid(scenes, blocks, "1-2", bands=bands, **options).collect()
        dense = build_pyramid(scenes, blocks, "1-2", bands=bands, dense=True, **options).collect()
        keyed = {(r.zoom_level, r.tile_column, r.tile_row, r.band): bytes(r.tile_data) for r in dense}
        assert len(keyed) == len(dense) == (6 + 20) * len(held)
        for r in sparse:
            assert keyed.pop((r.zoom_level, r.tile_column, r.tile_row, r.band)) == bytes(r.tile_data)
        assert set(keyed.values()) == {blank_payload("u16")}


def test_payload_must_go_with_stretch(spark):
    scenes, blocks = tables(spark, sample_scenes())
    for options in ({"stretch": False, "payload": "png"}, {"payload": "u16"}):
        with pytest.raises(ValueError, match="does not go with"):
            build_pyramid(scenes, blocks, [2], **options)


@pytest.mark.parametrize("compat", [True, False])
def test_unfilled_cells_take_the_stretched_zero(spark, compat):
    # 3 % of the canvas is negative (compat), so the low cut is, and 0 lies between the cuts
    res, side = RESOLUTIONS[2], 120
    west, north = WORLD_MIN_X + 256 * res, WORLD_MAX_Y - 256 * res
    values = iter(range(side * side))
    s = scene(1, 0, 3857, side, side, [west + 20 * res, res, 0, north - 20 * res, 0, -res],
              values=lambda: 50000 if next(values) % 7 == 0 else 900)
    scenes, blocks = tables(spark, [s], block=40)
    tiles = canvases(cells_of(tile_cells(scenes, blocks, [2], compat=compat)))
    built = build_pyramid(scenes, blocks, [2], payload="raw", compat=compat).collect()
    got = {(r.zoom_level, r.tile_column, r.tile_row, 1): list(r.tile_data) for r in built}
    want = {k: model.clip(v, compat) for k, v in tiles.items()}
    assert {k: v for k, v in got.items() if k in want} == want
    if compat:
        assert any(model.percentile(v, .02) < 0 and 0 < want[k][0] for k, v in tiles.items())


def test_multiband_pyramid(spark):
    scenes, blocks = tables(spark, sample_scenes())
    rows = build_pyramid(scenes, blocks, [2], method="forward", stretch=False, bands=None)
    sums = {(r.zoom_level, r.tile_column, r.tile_row, r.band): sum(struct.unpack(
        "<65536H", r.tile_data)) for r in rows.collect()}
    want = {}
    for k, v in cells_of(tile_cells(scenes, blocks, [2], method="forward", bands=None)).items():
        want[k[:4]] = want.get(k[:4], 0) + v
    assert {k: v for k, v in sums.items() if v} == want


def test_scene_stretch_of_non_square_scenes(spark):
    rng = random.Random(5)
    scenes = [scene(k, k, 3857, 3 + 2 * k, 7 - k, [0, 1, 0, 0, 0, -1], bands=1 + k % 2,
                    values=lambda: rng.randrange(65536)) for k in range(5)]
    scenes.append(scene(9, 9, 3857, 4, 3, [0, 1, 0, 0, 0, -1], values=lambda: 8))
    table, blocks = tables(spark, scenes)
    for broadcast_rows in (1000, 0):
        got = {(r.scene_id, r.band, r.px, r.py): r.b for r in stretch_scenes(
            blocks, table, broadcast_rows=broadcast_rows).collect()}
        want = {}
        for s in scenes:
            for band, px in s["pixels"].items():
                flat = model.clip([v for row in px for v in row])
                want |= {(s["scene_id"], band, n % s["width"], n // s["width"]): v
                         for n, v in enumerate(flat)}
        assert got == want


def test_payload_sum_and_blanks(spark):
    df = spark.createDataFrame(
        [(blank_payload("png"),), (blank_payload("raw"),), (bytes([3, 255]) * 32768,)],
        "tile_data binary")
    assert [r[0] for r in df.select(payload_sum(F.col("tile_data"))).collect()] == [
        0, 0, 258 * 32768]
    assert len(blank_payload("u16")) == 131072


def test_report(spark):
    scenes, blocks = tables(spark, sample_scenes())
    cells = cells_of(tile_cells(scenes, blocks, "1-2"))
    got = {r.z: tuple(r)[1:] for r in pyramid_report(mosaic(blocks, scenes, "1-2")).collect()}
    for z in (1, 2):
        values = [v for k, v in cells.items() if k[0] == z]
        tiles = {k[:3] for k in cells if k[0] == z}
        assert got[z] == (len(tiles), len(values), min(values), max(values))
