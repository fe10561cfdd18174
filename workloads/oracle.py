"""SQL over the given tables that checks each registered query by brute force.

Scenes are crossed with the whole grid and every source or tile cell is visited; nothing of the
engine's pruning, packing or sparse representation is repeated here.
"""

from __future__ import annotations

from tilepyramid.constants import (
    CLIP_HIGH,
    CLIP_LOW,
    RESOLUTIONS,
    WORLD_MAX_X,
    WORLD_MAX_Y,
    WORLD_MIN_X,
    WORLD_MIN_Y,
)

R = "6378137.0e0"
HELD = 89.999999
RES = "[" + ", ".join(f"{r!r}e0" for r in RESOLUTIONS) + "]"

SCENES = """scenes AS (
  SELECT k AS scene_id, (k * 31) % 1009 + (k // 1009) * 1009 AS seq,
    k % 2 = 0 AS geo,
    48 + (k % 3) * 8 AS width, 40 + (k % 4) * 8 AS height,
    CASE WHEN k % 5 = 0 THEN 3 ELSE 1 END AS bands,
    CASE WHEN k % 2 = 0 THEN -170 + (k * 37) % 300 + 0.1237e0
         ELSE -19000000 + (k * 1234567) % 34000000 + 0.37e0 END AS g0,
    CASE WHEN k % 2 = 0 THEN 0.25e0 ELSE 27829.873e0 END AS g1, 0e0 AS g2,
    CASE WHEN k % 2 = 0 THEN 70 - (k * 23) % 110 + 0.0731e0
         ELSE 15000000 - (k * 7654321) % 28000000 + 0.41e0 END AS g3, 0e0 AS g4,
    CASE WHEN k % 2 = 0 THEN -0.25e0 ELSE -27829.873e0 END AS g5
  FROM (SELECT s_suppkey AS k FROM supplier))"""


def to_x(x: str) -> str:
    return f"{R} * radians({x})"


def to_y(y: str) -> str:
    return f"{R} * ln(tan(pi() / 4 + radians(least(greatest({y}, -{HELD}e0), {HELD}e0)) / 2e0))"


def to_lon(x: str) -> str:
    return f"degrees({x} / {R})"


def to_lat(y: str) -> str:
    return f"degrees(2e0 * atan(exp({y} / {R})) - pi() / 2)"


def col_of(x: str, y: str, g: str = "") -> str:
    a = [f"{g}g{i}" for i in range(6)]
    return (f"({x} * {a[5]} - {y} * {a[2]} + {a[2]} * {a[3]} - {a[0]} * {a[5]})"
            f" / ({a[1]} * {a[5]} - {a[4]} * {a[2]})")


def row_of(x: str, y: str, g: str = "") -> str:
    a = [f"{g}g{i}" for i in range(6)]
    return (f"({x} * {a[4]} - {y} * {a[1]} - {a[0]} * {a[4]} + {a[1]} * {a[3]})"
            f" / ({a[2]} * {a[4]} - {a[1]} * {a[5]})")


# Scene extents in 3857; scenes here are north-up, so the four corners give two x and two y.
EXTENTS = f"""extents AS (
  SELECT *,
    CASE WHEN geo THEN {to_x('g0')} ELSE g0 END AS sminx,
    CASE WHEN geo THEN {to_x('(g0 + width * g1)')} ELSE g0 + width * g1 END AS smaxx,
    CASE WHEN geo THEN {to_y('(g3 + height * g5)')} ELSE g3 + height * g5 END AS sminy,
    CASE WHEN geo THEN {to_y('g3')} ELSE g3 END AS smaxy
  FROM scenes)"""


def grid(low: int, high: int) -> str:
    x0, x1 = f"({WORLD_MIN_X!r}e0)", f"({WORLD_MAX_X!r}e0)"
    y0, y1 = f"({WORLD_MIN_Y!r}e0)", f"({WORLD_MAX_Y!r}e0)"
    return f"""zooms AS (
  SELECT z::INT AS z, {RES}[z + 1] AS res FROM generate_series({low}, {high}) t(z)),
sizes AS (
  SELECT *,
    ceil((trunc((-res * {x1} - {x0} * -res) / (res * -res)) + 1) / 256)::INT AS n_cols,
    ceil((trunc((-res * {y0} + res * {y1}) / (res * res)) + 1) / 256)::INT AS n_rows
  FROM zooms),
grid AS (
  SELECT z, res, j::INT AS j, i::INT AS i,
    {x0} + (j * 256) * res AS minx, {x0} + (j * 256) * res + 256 * res AS maxx,
    {y1} + (i * 256) * -res + 256 * -res AS miny, {y1} + (i * 256) * -res AS maxy
  FROM sizes, generate_series(0, n_cols - 1) a(j), generate_series(0, n_rows - 1) b(i))"""


PAIRS = """pairs AS (
  SELECT g.*, s.* FROM grid g, extents s
  WHERE NOT (s.smaxx < g.minx OR s.smaxy < g.miny OR s.sminx > g.maxx OR s.sminy > g.maxy))"""


def cell_value(k: str, band: str, px: str, py: str, signed: bool) -> str:
    u = f"(({k} * 131 + {band} * 977 + {px} * 17 + {py} * 29 + {px} * {py}) % 4096)"
    v = f"(CASE WHEN {u} % 11 = 0 THEN 0 WHEN {k} % 13 = 0 THEN {u} * 16 ELSE {u} END)"
    return f"(CASE WHEN {v} > 32767 THEN {v} - 65536 ELSE {v} END)" if signed else v


def row_name(strict: bool = False) -> str:
    return "(2 ** z)::INT - 1 - i" if strict else "(2 ** z)::INT - i"


def common(low: int, high: int) -> str:
    return f"WITH {SCENES},\n{EXTENTS},\n{grid(low, high)},\n{PAIRS}"


def index(at: str, strict: bool) -> str:
    return f"floor({at})" if strict else f"trunc({at})"


def inverse(low: int, high: int, strict: bool = False) -> str:
    """CTEs ending in ``cells(z, i, j, dx, dy, band, value)``."""
    return f"""{common(low, high)},
ys AS (
  SELECT z, j, i, scene_id, dy, CASE WHEN geo THEN {to_lat('(maxy + dy * -res)')}
    ELSE maxy + dy * -res END AS sy
  FROM pairs, generate_series(0, 255) b(dy)),
xs AS (
  SELECT z, j, i, scene_id, dx, CASE WHEN geo THEN {to_lon('(minx + dx * res)')}
    ELSE minx + dx * res END AS sx
  FROM pairs, generate_series(0, 255) a(dx)),
looked AS (
  SELECT p.z, p.i, p.j, xs.dx, ys.dy, p.scene_id, p.seq, p.width, p.height,
    {index(col_of('sx', 'sy', 'p.'), strict)} AS px, {index(row_of('sx', 'sy', 'p.'), strict)} AS py
  FROM pairs p JOIN ys USING (z, i, j, scene_id) JOIN xs USING (z, i, j, scene_id)),
found AS (
  SELECT *, px::BIGINT AS ix, py::BIGINT AS iy FROM looked
  WHERE px >= 0 AND px < width AND py >= 0 AND py < height),
cells AS (
  SELECT z, i, j, dx, dy, 1 AS band,
    arg_max({cell_value('scene_id', '1', 'ix', 'iy', not strict)}, seq) AS value
  FROM found GROUP BY ALL)"""


def forward(low: int, high: int, strict: bool = False, window: bool = False,
            bands: str = "1", ends: str = "") -> str:
    """CTEs ending in ``cells``: every pixel of every paired scene is projected.

    ``ends="abs"`` takes the absolute value of the window's end indexes.
    """
    span = ""
    if window:
        lon_w = f"CASE WHEN p.geo THEN {to_lon('p.minx')} ELSE p.minx END"
        lon_e = f"CASE WHEN p.geo THEN {to_lon('p.maxx')} ELSE p.maxx END"
        lat_n = f"CASE WHEN p.geo THEN {to_lat('p.maxy')} ELSE p.maxy END"
        lat_s = f"CASE WHEN p.geo THEN {to_lat('p.miny')} ELSE p.miny END"
        span = f"""
  WHERE px >= trunc({col_of(f'({lon_w})', f'({lat_n})', 'p.')})
    AND px < {ends}(trunc({col_of(f'({lon_e})', f'({lat_s})', 'p.')})) + 1
    AND py >= trunc({row_of(f'({lon_w})', f'({lat_n})', 'p.')})
    AND py < {ends}(trunc({row_of(f'({lon_e})', f'({lat_s})', 'p.')})) + 1"""
    return f"""{common(low, high)},
pixels AS (
  SELECT scene_id, band, px, py, {cell_value('scene_id', 'band', 'px', 'py', not strict)} AS value,
    CASE WHEN geo THEN {to_x('(g0 + px * g1 + py * g2)')} ELSE g0 + px * g1 + py * g2 END AS mx,
    CASE WHEN geo THEN {to_y('(g3 + px * g4 + py * g5)')} ELSE g3 + px * g4 + py * g5 END AS my
  FROM scenes, generate_series(1, {bands}) c(band),
    generate_series(0, width - 1) a(px), generate_series(0, height - 1) b(py)),
dropped AS (
  SELECT z, i, j, p.scene_id, p.seq, band, px, py, value,
    {index('(mx * -res - minx * -res) / (res * -res)', strict)} AS dx,
    {index('(res * maxy - my * res) / (res * res)', strict)} AS dy
  FROM pairs p JOIN (SELECT * FROM pixels WHERE value > 0) USING (scene_id){span}),
cells AS (
  SELECT z, i, j, dx::INT AS dx, dy::INT AS dy, band, arg_max(value, (seq, py, px)) AS value
  FROM dropped WHERE dx >= 0 AND dx < 256 AND dy >= 0 AND dy < 256 GROUP BY ALL)"""


CELL_COLUMNS = ["z", "x", "y", "dx", "dy", "value"]


def select_cells(ctes: str, strict: bool = False, band: bool = False) -> str:
    extra = "band::INT AS band, " if band else ""
    return f"""{ctes}
SELECT z, j AS x, {row_name(strict)} AS y, {extra}dx::INT AS dx, dy::INT AS dy,
  value::INT AS value FROM cells"""


def rounded_percentile(ordered: str, n: int, p: float) -> str:
    """The linear percentile of a sorted list, spelled out from its definition."""
    x = (n - 1) * p
    i = int(x)
    g = x - i
    return f"floor({1 - g!r}e0 * {ordered}[{i + 1}] + {g!r}e0 * {ordered}[{i + 2}] + 0.5e0)::INT"


def cuts(ctes: str) -> str:
    """Zero-fill every covered canvas to 65,536 values and take the percentiles from it."""
    return f"""{ctes},
tiles AS (SELECT DISTINCT z, i, j FROM cells),
canvas AS (
  SELECT t.z, t.i, t.j, coalesce(c.value, 0) AS value
  FROM (SELECT *, n % 256 AS dx, n // 256 AS dy FROM tiles, generate_series(0, 65535) s(n)) t
  LEFT JOIN cells c ON c.z = t.z AND c.i = t.i AND c.j = t.j AND c.dx = t.dx AND c.dy = t.dy),
ordered AS (SELECT z, i, j, list(value ORDER BY value) AS v FROM canvas GROUP BY ALL),
cuts AS (
  SELECT z, i, j, {rounded_percentile('v', 65536, CLIP_LOW)} AS lo,
    {rounded_percentile('v', 65536, CLIP_HIGH)} AS hi FROM ordered)"""


def stretched(v: str, strict: bool = False) -> str:
    return (f"CASE WHEN {v} < lo THEN 0 WHEN {v} > hi THEN {255 if strict else 0} WHEN hi = lo THEN 0"
            f" ELSE trunc(({v} - lo)::DOUBLE / ((hi - lo) / 255e0)) END")


def bytes_of(ctes: str, strict: bool = False) -> str:
    return f"""{cuts(ctes)},
bytes AS (
  SELECT z, i, j, dx, dy, {stretched('value', strict)} AS b FROM cells JOIN cuts USING (z, i, j))"""


def canvas_bytes(ctes: str, strict: bool = False) -> str:
    """The stretched bytes of all 65,536 cells of every tile that has a filled one."""
    return f"""{cuts(ctes)},
bytes AS (
  SELECT z, i, j, {stretched('value', strict)} AS b FROM canvas JOIN cuts USING (z, i, j))"""


def payload(ctes: str, columns: str, strict: bool = False) -> str:
    """One row per tile that any scene touches, whether or not a cell was filled."""
    return f"""{canvas_bytes(ctes, strict)},
touched AS (SELECT DISTINCT z, i, j FROM pairs)
SELECT z, j AS x, {row_name(strict)} AS y, {columns}
FROM touched LEFT JOIN bytes USING (z, i, j) GROUP BY ALL"""


def dense(ctes: str, columns: str, source: str = "bytes") -> str:
    return f"""{ctes}
SELECT g.z, g.j AS x, (2 ** g.z)::INT - g.i AS y, {columns}
FROM grid g LEFT JOIN {source} b ON b.z = g.z AND b.i = g.i AND b.j = g.j
GROUP BY g.z, g.j, g.i"""


EMBEDDED = """cells AS (
  SELECT vec_id AS scene_id, (n % 8)::INT AS px, (n // 8)::INT AS py,
    floor((embedding[n + 1]::DOUBLE + 1) * 2000)::INT AS value
  FROM embeddings, generate_series(0, 63) s(n))"""

POINTS = """points AS (
  SELECT c_custkey AS id, -180 + (c_custkey * 7919 % 36000) / 100e0 AS lon,
    -85 + (c_custkey * 104729 % 17000) / 100e0 AS lat FROM customer)"""

PIXELS = f"""WITH {SCENES}, positions AS (
  SELECT scene_id, px::INT AS px, py::INT AS py, g0, g1, g2, g3, g4, g5,
    g0 + px * g1 + py * g2 AS x, g3 + px * g4 + py * g5 AS y
  FROM scenes, generate_series(0, width - 1) a(px), generate_series(0, height - 1) b(py))"""

TEXTS = """texts AS (
  SELECT k AS id, k % 5 AS kind, (k * 37) % 300 - 170 AS a, (k * 23) % 110 - 60 AS b
  FROM (SELECT s_suppkey AS k FROM supplier))"""

SNAPPED = """snapped AS (
  SELECT k, floor(((k * 37) % 300 - 170) / 10e0) * 10 AS minx,
    floor(((k * 37) % 300 - 170) / 10e0) * 10 + 60 AS maxx,
    ((k * 23) % 110) // 10 * 10 AS miny, ((k * 23) % 110) // 10 * 10 + 30 AS maxy
  FROM (SELECT s_suppkey AS k FROM supplier))"""


def sql() -> dict[str, str]:
    cell = {m: f() for m, f in {
        "inverse": lambda: inverse(2, 3), "forward": lambda: forward(2, 3)}.items()}
    overlap = common(2, 4)
    box = "round({0}, 3) + 0e0 AS {0}"
    requests = """requests AS (
  SELECT o_orderkey AS req_id, (2 + o_orderkey % 2)::INT AS z, (o_orderkey // 2 % 9)::INT AS x,
    (o_orderkey // 18 % 10 - 1)::INT AS y FROM orders)"""
    total = "coalesce(sum(b), 0)::BIGINT AS sum_bytes"
    geo_x, geo_y = (f"(CASE WHEN geo THEN {f(v)} ELSE {v} END)"
                    for f, v in ((to_lon, "x"), (to_lat, "y")))
    return {
        "affine_pixel_to_map": f"{PIXELS} SELECT scene_id, px, py, x, y FROM positions",
        "affine_map_to_pixel": f"""{PIXELS}, moved AS (
  SELECT *, x - 0.37e0 * g1 AS mx, y - 0.37e0 * g5 AS my FROM positions)
SELECT scene_id, px, py, trunc({col_of('mx', 'my')})::INT AS col,
  trunc({row_of('mx', 'my')})::INT AS row FROM moved""",
        "crs_forward": f"""WITH {POINTS}
SELECT id, round({to_x('lon')}, 3) + 0e0 AS x, round({to_y('lat')}, 3) + 0e0 AS y FROM points""",
        "crs_inverse": f"""WITH {POINTS}, projected AS (
  SELECT id, {to_x('lon')} AS x, {to_y('lat')} AS y FROM points)
SELECT id, round({to_lon('x')}, 7) + 0e0 AS lon, round({to_lat('y')}, 7) + 0e0 AS lat
FROM projected""",
        "scene_extent": f"""WITH {SCENES}, {EXTENTS}
SELECT scene_id, 3857 AS projected, 4326 AS geographic, round(sminx, 3) + 0e0 AS minx,
  round(smaxx, 3) + 0e0 AS maxx, round(sminy, 3) + 0e0 AS miny, round(smaxy, 3) + 0e0 AS maxy
FROM extents""",
        "extent_parse": f"""WITH {TEXTS}
SELECT id, CASE WHEN kind IN (0, 4) THEN a + 0.5e0 END AS minx,
  CASE WHEN kind IN (0, 4) THEN a + 7.25e0 END AS maxx,
  CASE WHEN kind IN (0, 4) THEN b::DOUBLE END AS miny,
  CASE WHEN kind IN (0, 4) THEN b + 9e0 END AS maxy FROM texts""",
        "extent_wkt": f"""WITH {TEXTS}, corners AS (
  SELECT id, printf('%.3f', a + 0.5e0) AS w, printf('%.3f', a + 7.25e0) AS e,
    printf('%.3f', b::DOUBLE) AS s, printf('%.3f', b + 9e0) AS n FROM texts)
SELECT id, 'POLYGON((' || w || ' ' || s || ',' || w || ' ' || n || ',' || e || ' ' || n || ','
    || e || ' ' || s || '))' AS wkt,
  'POLYGON((' || w || ' ' || s || ',' || w || ' ' || n || ',' || e || ' ' || n || ','
    || e || ' ' || s || ',' || w || ' ' || s || '))' AS wkt_closed
FROM corners""",
        "extent_intersects": f"""WITH {SNAPPED}
SELECT a.k AS id, b.k AS other FROM snapped a JOIN snapped b ON a.k < b.k
  AND a.maxx >= b.minx AND b.maxx >= a.minx AND a.maxy >= b.miny AND b.maxy >= a.miny""",
        "region_overlap": f"""WITH {SCENES}, {EXTENTS}, sides AS (
  SELECT c_custkey AS k, -19000000 + (c_custkey * 7919 % 38000) * 1000 AS w,
    -19000000 + (c_custkey * 104729 % 38000) * 1000 AS s FROM customer)
SELECT scene_id, k AS region_id FROM extents, sides
WHERE smaxx >= w AND sminx <= w + 20000 * (1 + k % 40)
  AND smaxy >= s AND sminy <= s + 30000 * (1 + k % 23)""",
        "point_samples": f"""WITH {SCENES}, {POINTS}, placed AS (
  SELECT id, {to_x('lon')} AS x, {to_y('lat')} AS y FROM points), looked AS (
  SELECT id AS point_id, scene_id, width, height,
    trunc({col_of(geo_x, geo_y)}) AS px, trunc({row_of(geo_x, geo_y)}) AS py FROM placed, scenes)
SELECT point_id, scene_id, px::INT AS px, py::INT AS py,
  {cell_value('scene_id', '1', 'px::BIGINT', 'py::BIGINT', True)}::INT AS value
FROM looked WHERE px >= 0 AND px < width AND py >= 0 AND py < height""",
        "tile_scene_list": f"""{common(0, 4)}
SELECT z, j AS x, {row_name()} AS y, scene_id,
  (row_number() OVER (PARTITION BY z, i, j ORDER BY seq) - 1)::INT AS rank FROM pairs""",
        "path_rank": """SELECT path, row_number() OVER (ORDER BY path) - 1 AS seq FROM (
  SELECT 'scenes/s' || s_suppkey % 7 || '/scene_' || lpad(s_suppkey::VARCHAR, 6, '0') || '.tif' AS path
  FROM supplier)""",
        "scene_table": f"""WITH {SCENES}
SELECT scene_id, seq, (CASE WHEN geo THEN 4326 ELSE 3857 END)::INT AS epsg, width::INT AS width,
  height::INT AS height, bands::INT AS bands, g0 AS gt0, g5 AS gt5 FROM scenes""",
        "tiles_written": payload(cell["inverse"], total),
        "write_status": f"""{cell['inverse']}, touched AS (
  SELECT z, count(DISTINCT (i, j)) AS n_tiles FROM pairs GROUP BY z), filled AS (
  SELECT z, count(*) AS n_cells, min(value)::INT AS vmin, max(value)::INT AS vmax
  FROM cells GROUP BY z)
SELECT z, n_tiles, n_tiles * 65536 AS n_bytes, n_cells, vmin, vmax
FROM touched JOIN filled USING (z)""",
        "tile_lookup_bands": f"""{forward(2, 3, bands="bands")}, {requests}, stored AS (
  SELECT p.z, p.j AS x, (2 ** p.z)::INT - p.i AS y, p.band::INT AS band,
    coalesce(sum(value % 256 + value // 256), 0)::BIGINT AS sum_bytes
  FROM (SELECT DISTINCT z, i, j, unnest(range(1, bands + 1)) AS band FROM pairs) p
  LEFT JOIN cells c ON c.z = p.z AND c.i = p.i AND c.j = p.j AND c.band = p.band GROUP BY ALL)
SELECT z, x, y, band, count(*) AS n_requests, sum_bytes
FROM (SELECT *, (1 + req_id % 4)::INT AS band FROM requests) LEFT JOIN stored USING (z, x, y, band)
GROUP BY ALL""",
        "grid_dims": f"""WITH {SCENES}, {EXTENTS}, leveled AS (
  SELECT *, (scene_id % 16)::INT AS z, {RES}[scene_id % 16 + 1] AS res FROM extents), sized AS (
  SELECT *, trunc((-res * smaxx - sminx * -res) / (res * -res))::INT + 1 AS total_cols,
    trunc((-res * sminy + res * smaxy) / (res * res))::INT + 1 AS total_rows FROM leveled)
SELECT scene_id, z, res, total_cols, total_rows, ceil(total_cols / 256)::INT AS n_cols,
  ceil(total_rows / 256)::INT AS n_rows FROM sized""",
        "grid_tiles": f"""WITH {SCENES}, {EXTENTS}, leveled AS (
  SELECT *, (3 + scene_id % 5)::INT AS z, {RES}[3 + scene_id % 5 + 1] AS res FROM extents), sized AS (
  SELECT *, ceil((trunc((-res * smaxx - sminx * -res) / (res * -res)) + 1) / 256)::INT AS n_cols,
    ceil((trunc((-res * sminy + res * smaxy) / (res * res)) + 1) / 256)::INT AS n_rows FROM leveled)
SELECT scene_id, z, j::INT AS tile_column, i::INT AS grid_row, {row_name()}::INT AS tile_row,
  round(sminx + j * 256 * res, 3) + 0e0 AS minx,
  round(sminx + j * 256 * res + 256 * res, 3) + 0e0 AS maxx,
  round(smaxy + i * 256 * -res + 256 * -res, 3) + 0e0 AS miny,
  round(smaxy + i * 256 * -res, 3) + 0e0 AS maxy
FROM sized, generate_series(0, n_cols - 1) a(j), generate_series(0, n_rows - 1) b(i)""",
        "tile_path": f"""{overlap}
SELECT DISTINCT 'out/' || z || '/' || j || '/' || ({row_name()}) || '.png' AS path FROM pairs""",
        "tile_key_parse": f"""{overlap}
SELECT scene_id, z, j AS x, {row_name()} AS y,
  'o.ut/' || z || '/' || j || '/' || ({row_name()}) AS stem FROM pairs""",
        "byte_sign_roundtrip": f"""WITH {EMBEDDED}
SELECT scene_id, px, py, (CASE WHEN value % 256 > 127 THEN value % 256 - 256
  ELSE value % 256 END)::INT AS s, (value % 256)::INT AS u FROM cells""",
        "scene_tile_overlap": f"{overlap} SELECT z, j AS x, {row_name()} AS y, scene_id FROM pairs",
        "scenes_per_tile": f"""{overlap}
SELECT z, j AS x, {row_name()} AS y, count(*) AS n, arg_min(scene_id, seq) AS first_scene,
  arg_max(scene_id, seq) AS last_scene FROM pairs GROUP BY ALL""",
        "block_cells": f"WITH {EMBEDDED} SELECT scene_id, px, py, value FROM cells",
        "mosaic_forward": select_cells(cell["forward"]),
        "mosaic_forward_strict": select_cells(forward(2, 3, strict=True), strict=True),
        "mosaic_forward_windowed": select_cells(forward(2, 3, window=True)),
        "mosaic_inverse": select_cells(cell["inverse"]),
        "mosaic_inverse_strict": select_cells(inverse(2, 3, strict=True), strict=True),
        "mosaic_multiband": select_cells(forward(2, 3, bands="bands"), band=True),
        "tile_percentile_cuts": f"""{cuts(cell['inverse'])}
SELECT z, j AS x, {row_name()} AS y, lo, hi FROM cuts""",
        "stretch_8bit": f"""{bytes_of(cell['forward'])}
SELECT z, j AS x, {row_name()} AS y, dx, dy, b::SMALLINT AS b FROM bytes""",
        "stretch_8bit_strict": f"""{bytes_of(forward(2, 3, strict=True), strict=True)}
SELECT z, j AS x, {row_name(True)} AS y, dx, dy, b::SMALLINT AS b FROM bytes""",
        "scene_stretch": f"""WITH {EMBEDDED}, ordered AS (
  SELECT scene_id, list(value ORDER BY value) AS v FROM cells GROUP BY ALL), cuts AS (
  SELECT scene_id, {rounded_percentile('v', 64, CLIP_LOW)} AS lo,
    {rounded_percentile('v', 64, CLIP_HIGH)} AS hi FROM ordered)
SELECT scene_id, 1 AS band, px, py, ({stretched('value')})::SMALLINT AS b
FROM cells JOIN cuts USING (scene_id)""",
        "scene_stretch_bands": f"""WITH {SCENES}, cells AS (
  SELECT scene_id, band, px, py, {cell_value('scene_id', 'band', 'px', 'py', False)} AS value
  FROM scenes, generate_series(1, bands) c(band), generate_series(0, width - 1) a(px),
    generate_series(0, height - 1) b(py)), cuts AS (
  SELECT scene_id, band, floor(quantile_cont(value, {CLIP_LOW}) + 0.5e0)::INT AS lo,
    floor(quantile_cont(value, {CLIP_HIGH}) + 0.5e0)::INT AS hi FROM cells GROUP BY ALL)
SELECT scene_id, band::INT AS band, px::INT AS px, py::INT AS py,
  ({stretched('value')})::SMALLINT AS b FROM cells JOIN cuts USING (scene_id, band)""",
        "tile_cells_u16": select_cells(forward(2, 3, bands="bands"), band=True),
        "tile_payload_raw": payload(
            cell["forward"], "65536 AS n_bytes, " + total),
        "tile_payload_png": payload(
            cell["inverse"], "true AS sig_ok, coalesce(sum(b), 0)::BIGINT AS decoded_sum"),
        "tile_payload_u16": f"""{cell['forward']},
touched AS (SELECT DISTINCT z, i, j FROM pairs)
SELECT z, j AS x, {row_name()} AS y, 131072 AS n_bytes,
  coalesce(sum(value % 256 + value // 256), 0)::BIGINT AS sum_bytes
FROM touched LEFT JOIN cells USING (z, i, j) GROUP BY ALL""",
        "tiles_dense": dense(cell["forward"], "count(b.z) = 0 AS is_blank", "pairs"),
        "pyramid_forward_u16_dense": dense(
            cell["forward"],
            "coalesce(sum(value % 256 + value // 256), 0)::BIGINT AS sum_bytes", "cells"),
        "pyramid_forward_png_dense": dense(canvas_bytes(cell["forward"]), total),
        "pyramid_windowed_png_dense": dense(canvas_bytes(forward(2, 3, window=True)), total),
        "pyramid_abs_window_png_dense": dense(
            canvas_bytes(forward(2, 3, window=True, ends="abs")), total),
        "mosaic_forward_abs_window": select_cells(forward(2, 3, window=True, ends="abs")),
        "pyramid_inverse_raw": payload(cell["inverse"], "65536 AS n_bytes, " + total),
        "pyramid_bands_u16_dense": f"""{forward(2, 3, bands="bands")},
banded AS (SELECT * FROM grid, (SELECT unnest(range(1, max(bands)::INT + 1)) AS band FROM scenes))
SELECT g.z, g.j AS x, (2 ** g.z)::INT - g.i AS y, g.band::INT AS band,
  coalesce(sum(value % 256 + value // 256), 0)::BIGINT AS sum_bytes
FROM banded g LEFT JOIN cells b ON b.z = g.z AND b.i = g.i AND b.j = g.j AND b.band = g.band
GROUP BY g.z, g.j, g.i, g.band""",
        "overlap_south_edge": f"""WITH {SCENES.replace("SELECT k AS scene_id", "SELECT k AS scene_id, k AS kk", 1)
    .replace("scenes AS", "placed AS", 1)},
scenes AS (SELECT * REPLACE (CASE WHEN geo THEN -84.3e0 - (kk % 7) * 0.07e0
  ELSE -19500000e0 - (kk % 7) * 90000e0 END AS g3) FROM placed),
{EXTENTS}, {grid(11, 11)}
SELECT scene_id, j AS x, {row_name()} AS y FROM grid g, extents s
WHERE NOT (s.smaxx < g.minx OR s.smaxy < g.miny OR s.sminx > g.maxx OR s.sminy > g.maxy)""",
        "pyramid_windowed_raw": payload(forward(2, 3, window=True), total),
        "pyramid_inverse_png": payload(cell["inverse"], total),
        "pyramid_inverse_png_strict": payload(inverse(2, 3, strict=True), total, strict=True),
        "tile_lookup": f"""{canvas_bytes(cell['forward'])}, {requests},
touched AS (SELECT DISTINCT z, i, j FROM pairs), stored AS (
  SELECT z, j AS x, {row_name()} AS y, {total}
  FROM touched LEFT JOIN bytes USING (z, i, j) GROUP BY ALL)
SELECT z, x, y, count(*) AS n_requests, sum_bytes FROM requests LEFT JOIN stored USING (z, x, y)
GROUP BY ALL""",
        "tileset_lookup": f"""{common(2, 3)}, {requests}, named AS (
  SELECT *, CASE WHEN req_id % 3 = 0 THEN 'geographic' WHEN req_id % 3 = 1 THEN 'projected'
    ELSE 'unknown' END AS tileset FROM requests), stored AS (
  SELECT DISTINCT CASE WHEN geo THEN 'geographic' ELSE 'projected' END AS tileset, z, j AS x,
    {row_name()} AS y FROM pairs)
SELECT req_id, tileset, z, x, y, s.tileset IS NOT NULL AS found
FROM named r LEFT JOIN stored s USING (tileset, z, x, y)""",
        "pyramid_report": f"""{inverse(2, 4)}
SELECT z, count(DISTINCT (i, j)) AS n_tiles, count(*) AS n_cells, min(value)::INT AS vmin,
  max(value)::INT AS vmax FROM cells GROUP BY z""",
    }
