"""Extent joins and point samples against loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tests import model
from tests.scenes import sample_scenes, tables
from tests.test_plans import JIT_LIMIT, explain
from tilepyramid.functions.extent import extent
from tilepyramid.operators import extentjoin
from tilepyramid.operators.extentjoin import extent_join, split_join
from tilepyramid.operators.sampling import sample_points


def boxes(spark, rows, name, box):
    df = spark.createDataFrame(rows, f"{name} int, a double, b double, c double, d double")
    made = extent(*[F.col(c) for c in "abcd"])
    return df.select(name, F.when(F.col("a").isNotNull(), made).alias(box))


def meets(a, b):
    return not (a[1] < b[0] or b[1] < a[0] or a[3] < b[2] or b[3] < a[2])


def rows(seed, n):
    rng, out = random.Random(seed), []
    for k in range(n):
        w, h = (rng.choice([0, 1, 8, 0.3, 200]) * rng.choice([1, 1, 7]) for _ in "wh")
        x, y = (rng.choice([rng.randrange(-64, 64), rng.uniform(-90, 90)]) for _ in "xy")
        out.append((k, float(x), float(x + w), float(y), float(y + h)))
    return [*out, (n, None, None, None, None)]


@pytest.mark.parametrize("part_rows", [50_000, 3])
@pytest.mark.parametrize("sizes", [(150, 90), (1, 40), (0, 5)])
def test_all_pairs_that_meet_once(spark, sizes, part_rows):
    a, b = rows(1, sizes[0]), rows(2, sizes[1])
    got = extent_join(boxes(spark, a, "i", "box"), boxes(spark, b, "j", "other_box"),
                      part_rows=part_rows).select("i", "j").collect()
    want = {(p[0], q[0]) for p in a[:-1] for q in b[:-1] if meets(p[1:], q[1:])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_one_place_for_all(spark):
    same = [(k, 5.0, 5.0, 5.0, 5.0) for k in range(40)]
    joined = extent_join(boxes(spark, same, "i", "box"), boxes(spark, same, "j", "other_box"),
                         part_rows=10)
    assert joined.count() == 1600
    with pytest.raises(ValueError, match="both sides"):
        extent_join(boxes(spark, same, "i", "box"), boxes(spark, same, "i", "other_box"))


def test_pairs_of_one_cell_are_spread_over_tasks(spark):
    same = [(k, 5.0, 5.5, 5.0, 5.5) for k in range(60)]
    joined = extent_join(boxes(spark, same, "i", "box"), boxes(spark, same, "j", "other_box"),
                         part_rows=10)
    tasks = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 3600
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 2400


def test_tasks_grow_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(extentjoin, "TASK_PAIRS", 100)
    same = [(k, 5.0, 5.5, 5.0, 5.5) for k in range(60)]
    joined = extent_join(boxes(spark, same, "i", "box"), boxes(spark, same, "j", "other_box"),
                         part_rows=5)
    tasks = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 3600
    assert len(tasks) > 15 and max(r["count"] for r in tasks) < 900


def test_narrow_rows_of_one_file_are_dealt_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(extentjoin, "SPREAD_ROWS", 10)
    seen = []
    real = extentjoin._dealt
    monkeypatch.setattr(extentjoin, "_dealt", lambda df, *rest: seen.append(
        df.rdd.getNumPartitions()) or real(df, *rest))
    a = boxes(spark, rows(1, 60), "i", "box").coalesce(1)
    b = boxes(spark, rows(2, 30), "j", "other_box").coalesce(1)
    extent_join(a, b)
    extent_join(a, b.withColumn("cells", F.array(F.lit(1))))  # wide rows stay where they are
    assert seen == [9, 9, 9, 1]


def test_both_sides_of_a_hot_key_are_cut(spark):
    left = spark.createDataFrame([(1, k) for k in range(40)] + [(2, 40)], "k int, v int")
    right = spark.createDataFrame([(1, k) for k in range(70)] + [(3, 0)], "k int, w int")
    found = [tuple(r) for r in split_join(left, right, ["k"], 10).select("v", "w").collect()]
    assert sorted(found) == [(v, w) for v in range(40) for w in range(70)]


def test_hot_keys_are_cut(spark):
    left = spark.createDataFrame([(1 if k < 90 else k, k) for k in range(100)], "k int, v int")
    right = spark.createDataFrame([(k, -k) for k in range(100)], "k int, w int")
    parts = split_join(left, right, ["k"], 10)
    assert sorted(r.v for r in parts.collect()) == list(range(100))


@pytest.mark.parametrize("compat", [True, False])
def test_points_take_the_cell_that_holds_them(spark, compat):
    scenes = sample_scenes()
    rng, points = random.Random(4), []
    for s in scenes:
        west, east, south, north = model.extent(s)
        reach = (east - west) / s["width"]
        points += [(rng.uniform(west - 2 * reach, east + reach),
                    rng.uniform(south - reach, north + 2 * reach)) for _ in range(60)]
    want = {}
    for k, (x, y) in enumerate(points):
        for s in scenes:
            c, r = (model.whole(v, compat)
                    for v in model.to_pixel(*model.unproject(x, y, s["epsg"]), s["gt"]))
            if 0 <= c < s["width"] and 0 <= r < s["height"]:
                want[k, s["scene_id"]] = (c, r, model.stored(s["pixels"][1][r][c], compat))
    table = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)],
                                  "point_id int, x double, y double")
    for part_rows in (50_000, 5):
        got = sample_points(table, *tables(spark, scenes), compat=compat, part_rows=part_rows)
        assert {(r.point_id, r.scene_id): (r.px, r.py, r.value) for r in got.collect()} == want
    assert len(want) > 100 and not math.isnan(points[0][0])


def test_samples_are_not_moved(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "point_id int, x double, y double")
    plan = explain(sample_points(points, *tables(spark, sample_scenes())), "formatted")
    # what is found is not shuffled by block again: the join by grid cells is the last of the plan
    joins = re.findall(r"SortMergeJoin.*\nLeft keys \[\d+\]: (.*)", plan)
    assert any("_level" in keys for keys in joins)
    assert not any("block_row" in keys for keys in joins)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", explain(
        sample_points(points, *tables(spark, sample_scenes())), "codegen"))]
    assert sizes and max(sizes) < JIT_LIMIT
