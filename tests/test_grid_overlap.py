import random

import pytest
from pyspark.sql import functions as F

from tests import model
from tests.scenes import sample_scenes, scene, tables
from tilepyramid.operators import overlap
from tilepyramid import scene_tile_pairs, scenes_per_tile
from tilepyramid.constants import WORLD_MAX_X, WORLD_MAX_Y, WORLD_MIN_X, WORLD_MIN_Y
from tilepyramid.operators.grid import grid_dims, subdivide, world_dims, world_grid, zoom_table

# Zoom, total columns, total rows, tile columns, tile rows of the world grid.
DIMS = [(0, 256, 257, 1, 2), (1, 512, 513, 2, 3), (2, 1024, 1025, 4, 5), (3, 2047, 2050, 8, 9),
        (10, 261999, 262294, 1024, 1025), (11, 523997, 524588, 2047, 2050),
        (15, 8383949, 8393406, 32750, 32787)]


def test_world_dims(spark):
    got = {r.z: (r.n_cols, r.n_rows) for r in zoom_table(spark, range(16)).collect()}
    assert got == {z: model.dims(z) for z in range(16)} == {z: world_dims(z) for z in range(16)}
    world = spark.createDataFrame(
        [(z, WORLD_MIN_X, WORLD_MAX_X, WORLD_MIN_Y, WORLD_MAX_Y) for z, *_ in DIMS],
        "z int, minx double, maxx double, miny double, maxy double")
    rows = grid_dims(world).select("z", "total_cols", "total_rows", "n_cols", "n_rows").collect()
    assert sorted(tuple(r) for r in rows) == DIMS


def test_world_grid_tiles(spark):
    rows = world_grid(spark, "0-3", root="out").collect()
    assert len(rows) == 2 + 6 + 20 + 72
    want = {(z, j, 2 ** z - i): box for z in range(4) for j, i, box in model.grid(z)}
    for r in rows:
        key = (r.z, r.tile_column, r.tile_row)
        assert (r.minx, r.maxx, r.miny, r.maxy) == want.pop(key)
        assert r.path == "out/{}/{}/{}.png".format(*key)
    assert not want


def test_negative_rows_from_zoom_11(spark):
    last = world_grid(spark, [11]).filter("tile_column = 0").agg(
        F.min("tile_row"), F.max("tile_row")).first()
    assert tuple(last) == (-1, 2048)


def test_subdivide_other_tile_size(spark):
    box = spark.createDataFrame([(4, 0.0, 5e6, 0.0, 3e6)],
                                "z int, minx double, maxx double, miny double, maxy double")
    rows = subdivide(box, 128, 64).collect()
    res = 9783.939621
    n_cols, n_rows = -(-(int(5e6 / res) + 1) // 128), -(-(int(3e6 / res) + 1) // 64)
    assert len(rows) == n_cols * n_rows
    assert all(abs(r.maxx - r.minx - 128 * res) < 1e-6 for r in rows)
    assert all(abs(r.maxy - r.miny - 64 * res) < 1e-6 for r in rows)


def random_scenes(n):
    rng = random.Random(7)
    out = []
    for k in range(n):
        if k % 2:
            gt = [rng.uniform(-2.2e7, 2.1e7), rng.uniform(1e3, 2e5), 0,
                  rng.uniform(-2.1e7, 2.2e7), 0, -rng.uniform(1e3, 2e5)]
        else:
            gt = [rng.uniform(-185, 175), rng.uniform(0.01, 2), 0,
                  rng.uniform(-80, 89), 0, -rng.uniform(0.01, 2)]
        out.append(scene(k, k, 3857 if k % 2 else 4326, rng.randrange(1, 20),
                         rng.randrange(1, 20), gt, values=lambda: 1))
    # Exactly on tile borders, so that the inclusive test decides.
    for k, (j, i, box) in enumerate(list(model.grid(2))[:8]):
        out.append(scene(n + k, n + k, 3857, 2, 2,
                         [box[0], (box[1] - box[0]) / 2, 0, box[3], 0, -(box[3] - box[2]) / 2],
                         values=lambda: 1))
    return out


def test_pairs_equal_brute_force(spark):
    scenes = random_scenes(60)
    got = {(r.z, r.x, r.y, r.scene_id)
           for r in scene_tile_pairs(tables(spark, scenes)[0], "0-4").collect()}
    want = {(z, j, 2 ** z - i, s["scene_id"])
            for z in range(5) for j, i, _, s in model.pairs(scenes, z)}
    assert got == want


def test_scenes_per_tile(spark):
    scenes = sample_scenes()
    rows = scenes_per_tile(scene_tile_pairs(tables(spark, scenes)[0], "2-2")).collect()
    want = {}
    for j, i, _, s in model.pairs(scenes, 2):
        want.setdefault((2, j, 4 - i), []).append(s["scene_id"])
    got = {(r.z, r.x, r.y): (r.n, r.first_scene, r.last_scene) for r in rows}
    assert got == {k: (len(v), v[0], v[-1]) for k, v in want.items()}


def test_scene_outside_the_world_has_no_pairs(spark):
    far = [scene(1, 0, 3857, 2, 2, [3e7, 10, 0, 0, 0, -10])]
    assert scene_tile_pairs(tables(spark, far)[0], "0-3").count() == 0


def test_unknown_epsg_fails(spark):
    bad = [scene(1, 0, 32633, 2, 2, [0, 10, 0, 0, 0, -10])]
    with pytest.raises(Exception, match="unsupported EPSG"):
        scene_tile_pairs(tables(spark, bad)[0], "0-0").collect()


@pytest.mark.parametrize("part", [65_536, 2])
def test_ranked_scenes_of_a_crowded_tile(spark, monkeypatch, part):
    monkeypatch.setattr(overlap, "RANK_PART", part)
    scenes = random_scenes(40)
    table = tables(spark, scenes)[0]
    rows = overlap.ranked_scenes(scene_tile_pairs(table, "0-2"), (0, len(scenes))).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault((r.z, r.x, r.y), []).append((r.rank, r.scene_id))
    want = {}
    for z in range(3):
        for j, i, _, s in model.pairs(scenes, z):
            want.setdefault((z, j, 2 ** z - i), []).append(s["scene_id"])
    assert got == {k: list(enumerate(v)) for k, v in want.items()}


def test_intervals_are_the_pairs(spark):
    table = tables(spark, random_scenes(40))[0]
    runs = overlap.tile_intervals(table, "0-4").collect()
    pairs = scene_tile_pairs(table, "0-4").select("z", "x", "grid_row").collect()
    assert sorted((r.z, r.tile_column, i) for r in runs
                  for i in range(r.first_row, r.last_row + 1)) == sorted(map(tuple, pairs))
