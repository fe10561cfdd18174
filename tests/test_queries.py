"""Every registered query against its brute-force SQL on the smallest tables."""

import math

import duckdb
import pytest

from workloads import oracle, rasters, registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), oracle.sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("supplier", "customer", "orders", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def rows(records):
    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(v) for v in r) for r in records),
                  key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*columns).collect())
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    want = rows(cursor.fetchall())
    assert len(got) == len(want) and got
    assert got == want


def test_blocks_of_scenes_with_large_keys(spark):
    """Keys whose product with 131 is beyond an INT give the cells that the formula gives."""
    keys = [13, 16_393_040, 36_000_016, 7 * 10 ** 11]
    scenes = spark.createDataFrame(
        [(k, 40, 33, 1) for k in keys], "scene_id long, width int, height int, bands int")
    got = {(r.scene_id, r.block_row, r.block_col): r.cells for r in rasters.blocks(scenes).collect()}
    assert len(got) == 4 * len(keys)
    for (k, i, j), cells in got.items():
        want = [(k * 131 + 977 + px * 17 + py * 29 + px * py) % 4096
                for py in range(32 * i, 32 * i + 32) for px in range(32 * j, 32 * j + 32)]
        assert cells == [0 if u % 11 == 0 else u * (16 if k % 13 == 0 else 1) for u in want]
