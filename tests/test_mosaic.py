import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import model
from tests.scenes import cells_of, expected, sample_scenes, scene, tables
from tilepyramid import mosaic, tile_cells, unpack
from tilepyramid.constants import RESOLUTIONS, WORLD_MAX_Y, WORLD_MIN_X
from tilepyramid.operators import mosaic as mosaic_module
from tilepyramid.operators import patches
from tilepyramid.operators.georeference import (
    BROADCAST_ROWS,
    GEOREFERENCE,
    SceneStats,
    georeference,
)
from tilepyramid.operators.patches import Rows
from tilepyramid.sinks.tables import write_blocks
from tilepyramid.sources.rasters import read_blocks

SCENES = sample_scenes()


@pytest.fixture(scope="module")
def source(spark):
    scenes, blocks = tables(spark, SCENES)
    return scenes.cache(), blocks.cache()


@pytest.fixture(scope="module")
def inverse_model():
    return {compat: model.inverse(SCENES, 2, compat) for compat in (True, False)}


@pytest.mark.parametrize("compat", [True, False])
def test_inverse(source, inverse_model, compat):
    got = cells_of(tile_cells(*source, "2-2", compat=compat))
    assert got == expected(inverse_model[compat], 2, compat=compat)
    assert min(got.values()) < 0 if compat else max(got.values()) > 32767


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize("window", [None, "clip", "abs"])
@pytest.mark.parametrize("z", [2, 5])
def test_forward(source, compat, window, z):
    # The corner-to-corner window is defined for north-up scenes; keep the sheared one out.
    use = SCENES if window is None else [s for s in SCENES if s["scene_id"] != 4]
    scenes = source[0].filter(F.col("scene_id").isin(*[s["scene_id"] for s in use]))
    got = cells_of(tile_cells(scenes, source[1], [z], method="forward", window=window,
                              compat=compat))
    assert got == expected(model.forward(use, z, compat, window), z, compat=compat)
    assert got


def test_truncation_bleeds_into_the_next_tile(spark):
    """A cell less than one tile cell west or north of a tile also lands in that tile."""
    res = RESOLUTIONS[2]
    gt = [WORLD_MIN_X + 256 * res - 0.7 * res, 2 * res, 0, WORLD_MAX_Y - 512 * res + 0.7 * res, 0,
          -2 * res]
    scenes = [scene(1, 0, 3857, 6, 6, gt, values=iter(range(1, 37)).__next__)]
    source = tables(spark, scenes)
    bleed = expected(model.forward(scenes, 2), 2)
    floor = expected(model.forward(scenes, 2, compat=False), 2)
    assert len(bleed) > len(floor)
    assert cells_of(tile_cells(*source, [2], method="forward")) == bleed


def test_bands(source):
    got = cells_of(tile_cells(*source, [2], method="forward", bands=None))
    want = {}
    for band in (1, 2, 3):
        having = [s for s in SCENES if s["bands"] >= band]
        want |= expected(model.forward(having, 2, band=band), 2, band)
    assert got == want
    second = cells_of(tile_cells(*source, [2], method="forward", bands=[2]))
    assert second == {k: v for k, v in want.items() if k[3] == 2}


def test_zooms_are_independent(source):
    both = cells_of(tile_cells(*source, "1-2"))
    assert {k: v for k, v in both.items() if k[0] == 2} == cells_of(tile_cells(*source, [2]))
    assert {k: v for k, v in both.items() if k[0] == 1} == expected(model.inverse(SCENES, 1), 1)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_block_size_does_not_matter(spark, inverse_model, block):
    got = cells_of(tile_cells(*tables(spark, SCENES, block), [2]))
    assert got == expected(inverse_model[True], 2)


def test_row_order_does_not_matter(source, inverse_model):
    shuffled = source[1].repartition(7).orderBy(F.rand(3))
    assert cells_of(tile_cells(source[0].orderBy(F.rand(1)), shuffled, [2])) == expected(
        inverse_model[True], 2)


def test_salted_join_and_stored_georeference(spark, source, inverse_model, tmp_path):
    want = expected(inverse_model[True], 2)
    salted = mosaic(source[1], source[0], [2], broadcast_rows=0)
    assert cells_of(unpack(salted)) == want
    write_blocks(source[1], source[0], str(tmp_path / "blocks"))
    stored = read_blocks(spark, str(tmp_path / "blocks"))
    assert cells_of(tile_cells(source[0], stored, [2])) == want
    # the given scenes say which blocks take part and in which order
    few = source[0].filter("epsg = 4326").withColumn("seq", -F.col("seq"))
    assert cells_of(tile_cells(few, stored, [2])) == cells_of(tile_cells(few, source[1], [2]))
    assert set(GEOREFERENCE) <= set(georeference(stored, few).columns)


@pytest.mark.parametrize("shift", [2 ** 40, 2 ** 59, -100])
@pytest.mark.parametrize("method", ["forward", "inverse"])
def test_order_tiers_agree(source, shift, method):
    """One packed BIGINT, max_by over a BIGINT, and the struct order give the same mosaic."""
    moved = source[0].withColumn("seq", F.col("seq") + F.lit(shift))
    assert cells_of(tile_cells(moved, source[1], [2], method=method)) == cells_of(
        tile_cells(*source, [2], method=method))


@pytest.mark.parametrize("method", ["forward", "inverse"])
def test_ties_of_seq_go_to_the_larger_scene_id_in_every_tier(source, method):
    got = [cells_of(tile_cells(source[0].withColumn("seq", F.lit(seq)), source[1], [2], method=method))
           for seq in (7, 2 ** 50, -3)]
    by_id = source[0].withColumn("seq", F.col("scene_id"))
    assert got == [cells_of(tile_cells(by_id, source[1], [2], method=method))] * 3


def test_values_beyond_16_bits_fail_and_do_not_wrap(spark):
    s = scene(1, 0, 3857, 2, 2, [1.5, 9783.939621 * 40, 0, -1.5, 0, -9783.939621 * 40],
              values=lambda: 200000)
    with pytest.raises(Exception, match="does not fit 16 bits"):
        tile_cells(*tables(spark, [s], block=2), [4], compat=False).collect()


@pytest.mark.parametrize("oversampled", [1, 3, 5])
@pytest.mark.parametrize("method", ["forward", "inverse"])
def test_mixed_coarseness_changes_nothing(source, monkeypatch, method, oversampled):
    want = cells_of(tile_cells(*source, [2], method=method))
    monkeypatch.setattr(mosaic_module, "OVERSAMPLED", oversampled)
    assert cells_of(tile_cells(*source, [2], method=method)) == want


@pytest.mark.parametrize("fine", [0.0, 2.0, 3.0, 5.0, 1e9])
@pytest.mark.parametrize("options", [
    {}, {"compat": False}, {"method": "forward", "bands": None},
    {"method": "forward", "window": "abs", "compat": False}])
def test_patches_and_cells_agree(source, monkeypatch, options, fine):
    """All by patches, all by cells, and levels where scenes go both ways."""
    scenes = source[0].filter("scene_id <> 4") if options.get("window") else source[0]
    build = tile_cells(scenes, source[1], "1-3", **options)
    want = cells_of(build)
    monkeypatch.setattr(mosaic_module, "FINE", fine)
    assert cells_of(tile_cells(scenes, source[1], "1-3", **options)) == want


@pytest.mark.parametrize("method", ["forward", "inverse"])
def test_crowded_tiles_are_merged_in_parts(source, monkeypatch, method):
    want = cells_of(tile_cells(*source, "1-2", method=method))
    monkeypatch.setattr(mosaic_module, "LAYERS", 1)
    assert cells_of(tile_cells(*source, "1-2", method=method)) == want


def test_missing_samples_leave_the_cell_to_others(spark):
    gt = [100.3, 50000.1, 0, -100.3, 0, -50000.1]
    scenes, blocks = tables(spark, [scene(1, 0, 3857, 4, 4, gt, values=lambda: 9),
                                    scene(2, 1, 3857, 4, 4, gt, values=lambda: 5)])
    holed = blocks.withColumn("cells", F.transform("cells", lambda v, i: F.when(
        (F.col("scene_id") == 1) | (i % 2 == 0), v)))
    for method in ("inverse", "forward"):
        got = cells_of(tile_cells(scenes, holed, [3], method=method))
        assert set(got.values()) == {5, 9}


def test_spreading_coarse_blocks_changes_nothing(source, inverse_model, monkeypatch):
    monkeypatch.setattr(mosaic_module, "OVERSAMPLED", 0)
    assert cells_of(tile_cells(*source, [2])) == expected(inverse_model[True], 2)


def test_order_tiers_are_chosen_by_bounds():
    def kind(max_seq, max_cells, min_seq=0, place=True, unique=True):
        stats = SceneStats(1, min_seq, max_seq, max_cells, unique_seq=unique)
        place = F.col("place") if place else None
        return str(mosaic_module._last_value(stats, place)[0][1])

    assert "max(packed)" in kind(1000, 4096)
    assert "max_by" in kind(2 ** 24, 2 ** 30)
    assert "max(write)" in kind(2 ** 40, 2 ** 30)
    assert "max(write)" in kind(10, 10, min_seq=-1)
    assert "max(packed)" in kind(2 ** 45, 2 ** 60, place=False)
    assert "max(write)" in kind(1000, 4096, unique=False)


def test_wrap_of_large_samples(spark):
    values = iter([32767, 32768, 65535, 1])
    s = scene(1, 0, 3857, 2, 2, [1.5, 9783.939621 * 40, 0, -1.5, 0, -9783.939621 * 40],
              values=lambda: next(values))
    source = tables(spark, [s], block=2)
    inverse = set(cells_of(tile_cells(*source, [4])).values())
    assert inverse == {32767, -32768, -1, 1}
    forward = set(cells_of(tile_cells(*source, [4], method="forward")).values())
    assert forward == {32767, 1}
    strict = set(cells_of(tile_cells(*source, [4], method="forward", compat=False)).values())
    assert strict == {32767, 32768, 65535, 1}


def test_later_zero_erases_only_in_inverse(spark):
    gt = [100.3, 50000.1, 0, -100.3, 0, -50000.1]
    source = tables(spark, [scene(1, 0, 3857, 3, 3, gt, values=lambda: 9),
                            scene(2, 1, 3857, 3, 3, gt, values=lambda: 0)])
    assert set(cells_of(tile_cells(*source, [3])).values()) == {0}
    assert set(cells_of(tile_cells(*source, [3], method="forward")).values()) == {9}


def test_global_geographic_raster(spark):
    s = scene(1, 0, 4326, 18, 9, [-180.0, 20.0, 0, 90.0, 0, -20.0], values=lambda: 5)
    got = cells_of(tile_cells(*tables(spark, [s]), [0]))
    assert got == expected(model.inverse([s], 0), 0)
    # The whole 1 x 2 grid lies inside the scene but for its east edge, half a cell beyond 180.
    assert len({k[:3] for k in got}) == 2


def test_nothing_covered(spark):
    far = [scene(1, 0, 3857, 2, 2, [3e7, 10, 0, 0, 0, -10])]
    assert mosaic(*reversed(tables(spark, far)), "0-3").count() == 0


def test_bad_options(source):
    for bad in ({"method": "cubic"}, {"window": "clip"}, {"method": "forward", "window": "x"}):
        with pytest.raises(ValueError):
            mosaic(source[1], source[0], [2], **bad)


def test_hot_tiles_are_merged_in_no_more_parts_than_layers_ask_for(spark, monkeypatch):
    monkeypatch.setattr(mosaic_module, "LAYERS", 8)
    pile = [scene(k, k, 3857, 4, 4, [100000.5, 30000.7, 0, 900000.3, 0, -30000.7])
            for k in range(1, 17)]
    scenes, blocks = tables(spark, pile)
    build = mosaic_module._Build(blocks, scenes, [2], "inverse", None, (1,), True, 100)
    assert build._salts() == 2
    whole = cells_of(tile_cells(scenes, blocks, [2]))
    monkeypatch.setattr(mosaic_module, "LAYERS", 100)
    assert whole and cells_of(tile_cells(scenes, blocks, [2])) == whole


def test_patches_wait_as_four_byte_cells():
    rows = Rows()
    rows.add(1, 1, patch=np.arange(9, dtype=np.int64))
    rows.add(1, 1, cells=np.arange(4), packed=np.arange(4))
    assert rows.rows[0][6].dtype == rows.rows[1][7].dtype == np.int32


@pytest.mark.parametrize("held, rows", [(128, 2), (1, 60)])
def test_forward_cells_of_many_blocks_leave_a_task_as_one_tile(spark, monkeypatch, held, rows):
    """Blocks of 20 scenes meet in one tile at z = 2 and one at z = 3: a row for each tile, not for
    each block, unless a task holds fewer tiles than its blocks go to in turn."""
    monkeypatch.setattr(patches, "HELD_TILES", held)
    res = RESOLUTIONS[2]
    gt = [WORLD_MIN_X + 300 * res, res, 0, WORLD_MAX_Y - 300 * res, 0, -res]
    scenes = [scene(k, (k * 7) % 20, 3857, 8, 4, gt) for k in range(20)]
    source = tables(spark, scenes)
    build = mosaic_module._Build(source[1].coalesce(1), source[0], "2-3", "forward", None, (1,), True,
                                 BROADCAST_ROWS)
    made = build.patches().filter("cells IS NOT NULL AND size(cells) > 0")
    n = made.count()
    assert n == rows if held > 1 else n >= rows
    want = {**expected(model.forward(scenes, 2), 2), **expected(model.forward(scenes, 3), 3)}
    assert cells_of(tile_cells(*source, "2-3", method="forward")) == want
