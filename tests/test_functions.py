import math

import pytest
from pyspark.sql import functions as F

from tilepyramid.functions import affine, cellvalue, crs, extent, tilekey
from tilepyramid.operators.stretch import array_percentile, half_up, stretch
from tilepyramid.sources.zooms import check_zooms, parse_zoom_range
from tests import model


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_affine_round_trip_and_truncation(spark):
    g = [10.5, 2.0, 0.3, 50.25, 0.1, -2.5]
    lit = [F.lit(v) for v in g]
    rows = spark.range(200).select(
        (F.col("id") % 20).alias("c"), (F.col("id") / 20).cast("int").alias("r"))
    x, y = affine.pixel_to_map(F.col("c") + 0.5, F.col("r") + 0.5, lit)
    c, r = affine.map_to_pixel(x, y, lit)
    assert rows.filter((c != F.col("c")) | (r != F.col("r"))).count() == 0

    north_up = [F.lit(v) for v in (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)]
    c, r = affine.map_to_pixel(F.lit(-0.7), F.lit(0.7), north_up)
    cf, rf = affine.map_to_pixel(F.lit(-0.7), F.lit(0.7), north_up, compat=False)
    assert tuple(one(spark, c, r, cf, rf)) == (0, 0, -1, -1)


def test_affine_saturates_and_rejects_singular(spark):
    unit = [F.lit(v) for v in (0.0, 1e-6, 0.0, 0.0, 0.0, -1e-6)]
    c, r = affine.map_to_pixel(F.lit(1e9), F.lit(1e9), unit)
    assert tuple(one(spark, c, r)) == (2147483647, -2147483648)
    flat = [F.lit(v) for v in (0.0, 1.0, 1.0, 0.0, 1.0, 1.0)]
    assert tuple(one(spark, *affine.map_to_pixel(F.lit(1.0), F.lit(1.0), flat))) == (None, None)


@pytest.mark.parametrize("lon,lat", [(0, 0), (179.99, 85.05), (-179.99, -85.05), (12.3, 45.6)])
def test_crs_round_trip(spark, lon, lat):
    x, y = crs.geographic_to_projected(F.lit(float(lon)), F.lit(float(lat)))
    back = crs.projected_to_geographic(x, y)
    got = one(spark, x, y, *back)
    assert got[:2] == pytest.approx(model.project(lon, lat, 4326), abs=1e-6)
    assert got[2:] == pytest.approx((lon, lat), abs=1e-9)


def test_crs_poles_are_finite_and_unknown_codes_fail(spark):
    _, y = crs.geographic_to_projected(F.lit(0.0), F.lit(-90.0))
    assert math.isfinite(one(spark, y)[0])
    with pytest.raises(Exception, match="unsupported EPSG"):
        one(spark, crs.is_geographic(F.lit(2154)))
    assert one(spark, crs.srs_pair(F.lit(2154)).alias("p")).p is None


def test_raster_extent_projects_corners(spark):
    g = [F.lit(v) for v in (-10.0, 0.5, 0.0, 40.0, 0.0, -0.25)]
    box = one(spark, extent.raster_extent(F.lit(8), F.lit(4), g, F.lit(True)).alias("e")).e
    want = model.extent({"gt": [-10, 0.5, 0, 40, 0, -0.25], "width": 4, "height": 8, "epsg": 4326})
    assert (box.minx, box.maxx, box.miny, box.maxy) == pytest.approx(want)


@pytest.mark.parametrize("text,want", [
    ("1 2 3 4", (1, 2, 3, 4)), ("-1.5 2e3 -3 4", (-1.5, 2000, -3, 4)), ("1 2 3", None),
    ("1 2 x 4", None), ("1  2 3 4", None), ("1 2 3 4 5", (1, 2, 3, 4)), ("", None)])
def test_extent_parse(spark, text, want):
    e = one(spark, extent.parse_extent(F.lit(text)).alias("e")).e
    assert (None if e is None else tuple(e)) == want


def test_extent_wkt(spark):
    e = extent.extent(*[F.lit(v) for v in (1.0, 2.0, 3.0, 4.5)])
    got = one(spark, extent.extent_wkt(e), extent.extent_wkt(e, compat=False, digits=1))
    assert got[0] == "POLYGON((1.0 3.0,1.0 4.5,2.0 4.5,2.0 3.0))"
    assert got[1] == "POLYGON((1.0 3.0,1.0 4.5,2.0 4.5,2.0 3.0,1.0 3.0))"


@pytest.mark.parametrize("other,hit", [
    ((5, 6, 5, 6), False), ((0.5, 2, 0.5, 2), True), ((1, 2, 0, 1), True), ((1, 2, 1, 2), True),
    ((0.2, 0.4, 0.2, 0.4), True), ((0, 1, 0, 1), True), ((1.0001, 2, 0, 1), False)])
def test_extent_intersects(spark, other, hit):
    a = extent.extent(*[F.lit(float(v)) for v in (0, 1, 0, 1)])
    b = extent.extent(*[F.lit(float(v)) for v in other])
    assert tuple(one(spark, extent.intersects(a, b), extent.intersects(b, a))) == (hit, hit)


@pytest.mark.parametrize("path,key", [
    ("/o/4/3/16.png", (4, 3, 16)), ("o\\4\\3\\16.png", (4, 3, 16)),
    ("/a/b/c/d/11/7/-1.png", (11, 7, -1)), ("/o/4/3/16", (4, 3, 16)), ("3/16.png", None), ("/o/4/3/16.", (4, 3, 16)), ("/o/4/3/x", None),
    ("/o/99999999999/3/1.png", None)])
def test_tile_key(spark, path, key):
    got = one(spark, tilekey.tile_key(F.lit(path)).alias("k")).k
    assert (None if got is None else tuple(got)) == key


def test_tile_path_row_and_extension(spark):
    z, i = F.lit(11), F.lit(2049)
    got = one(
        spark, tilekey.tile_row(z, i), tilekey.tile_row(z, i, compat=False),
        tilekey.tile_path(F.lit("out"), z, F.lit(7), F.lit(-1)),
        tilekey.remove_extension(F.lit("a.b/c.tar.gz")), tilekey.remove_extension(F.lit("plain")),
        tilekey.resolution(F.lit(15)), tilekey.resolution(F.lit(16)))
    assert tuple(got) == (-1, -2, "out/11/7/-1.png", "a.b/c.tar", "plain", 4.777314, None)


def test_bytes(spark):
    values = [0, 1, 127, 128, 254, 255]
    arr = F.array(*[F.lit(v) for v in values])
    got = one(spark, cellvalue.signed_bytes(arr).alias("s"),
              cellvalue.unsigned_bytes(cellvalue.signed_bytes(arr)).alias("u"))
    assert got.s == [0, 1, 127, -128, -2, -1] and got.u == values
    wrap = [cellvalue.sample(F.lit(v)) for v in (0, 32767, 32768, 65535)]
    assert tuple(one(spark, *wrap)) == (0, 32767, -32768, -1)
    assert one(spark, cellvalue.sample(F.lit(65535), compat=False))[0] == 65535


@pytest.mark.parametrize("values,p", [
    ([7], 0.5), ([5, 5, 5], 0.02), ([1, 2], 0.5), ([3, 1, 2], 0.5), ([-2, -3], 0.5),
    ([-5, 0, 9, 100], 0.98), (list(range(100, 0, -1)), 0.02)])
def test_percentile_vectors(spark, values, p):
    got = array_percentile(F.array(*[F.lit(v) for v in values]), len(values), p)
    assert one(spark, got)[0] == model.percentile(values, p)


def test_half_up_is_toward_positive(spark):
    assert tuple(one(spark, half_up(F.lit(-2.5)), half_up(F.lit(2.5)))) == (-2, 3)


def test_stretch_edges(spark):
    def b(v, lo, hi, compat=True):
        return stretch(F.lit(v), F.lit(lo), F.lit(hi), compat)
    got = one(spark, b(5, 10, 20), b(21, 10, 20), b(21, 10, 20, False), b(20, 10, 20),
              b(15, 10, 20), b(10, 10, 10), b(9, 10, 10), b(11, 10, 10))
    assert tuple(got) == (0, 0, 255, 255, 127, 0, 0, 0)


def test_zoom_ranges():
    assert parse_zoom_range("2-4") == [4, 3, 2]
    assert parse_zoom_range("3-3") == [3]
    for bad in ("4-2", "5", "a-b", "2-16", "1-2-3", "-1-3"):
        with pytest.raises(ValueError):
            parse_zoom_range(bad)
    assert check_zooms([3, 1, 3]) == [3, 1]
    with pytest.raises(ValueError):
        check_zooms([])
