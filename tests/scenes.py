"""Small scenes for the tests, as model dicts and as the engine's tables."""

import random

from tilepyramid import schemas


def scene(scene_id, seq, epsg, width, height, gt, bands=1, values=None, seed=0):
    rng = random.Random(seed * 1000 + scene_id)
    pick = values or (lambda: rng.choice([0, rng.randrange(1, 4096), rng.randrange(32000, 65536)]))
    pixels = {b: [[pick() for _ in range(width)] for _ in range(height)]
              for b in range(1, bands + 1)}
    return {"scene_id": scene_id, "seq": seq, "epsg": epsg, "width": width, "height": height,
            "gt": [float(v) for v in gt], "bands": bands, "pixels": pixels}


def sample_scenes():
    """Geographic, projected, sheared, overlapping and border-crossing scenes for z = 2."""
    return [
        scene(1, 5, 4326, 9, 7, [-60.37, 1.3, 0, 41.21, 0, -1.3], bands=2),
        scene(2, 3, 4326, 8, 11, [-55.11, 1.7, 0, 44.73, 0, -1.7]),
        scene(3, 9, 3857, 10, 6, [-6500000.37, 150123.7, 0, 5000000.41, 0, -150123.7]),
        scene(4, 1, 3857, 7, 7, [-6000000.3, 140000.3, 21000.7, 4600000.2, 17000.9, -139000.1],
              bands=3),
        scene(5, 7, 3857, 6, 5, [9900000.7, 20000.9, 0, 9998300.3, 0, -30000.1]),
    ]


def tables(spark, scenes, block=4, pad=True):
    """``scenes`` and ``blocks`` DataFrames with ragged edge blocks padded by junk."""
    rows = [(s["scene_id"], f"s/{s['scene_id']}.tif", s["seq"], s["epsg"], s["width"], s["height"],
             s["bands"], s["gt"]) for s in scenes]
    blocks = []
    for s in scenes:
        for band, px in s["pixels"].items():
            for br in range(-(-s["height"] // block)):
                for bc in range(-(-s["width"] // block)):
                    cells = []
                    for y in range(br * block, br * block + block):
                        for x in range(bc * block, bc * block + block):
                            inside = x < s["width"] and y < s["height"]
                            cells.append(px[y][x] if inside else 777)
                    blocks.append((s["scene_id"], band, br, bc, block, block, cells))
    return (spark.createDataFrame(rows, schemas.SCENES),
            spark.createDataFrame(blocks, schemas.BLOCKS))


def cells_of(df):
    """Unpacked cells as {(z, x, y, band, dx, dy): value}, failing on duplicates."""
    rows = df.collect()
    out = {(r.z, r.x, r.y, r.band, r.dx, r.dy): r.value for r in rows}
    assert len(out) == len(rows)
    return out


def expected(model_cells, z, band=1, compat=True):
    top = 2 ** z if compat else 2 ** z - 1
    return {(z, j, top - i, band, dx, dy): v for (j, i, dx, dy), v in model_cells.items()}
