import math

import numpy as np
from helpers import Roots

from tilepyramid.llm import embedding_dedup
from tilepyramid.llm.blocks import forest

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame(
        [(ids[k] if ids else k, None if v is None else [None if x is None else float(x) for x in v],
          k % 3, "x") for k, v in enumerate(vectors)], SCHEMA)


def sample(n=400, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    near = base[rng.integers(0, len(base), n - len(base))]
    return np.vstack([base, near + rng.normal(size=near.shape) * 0.12 * rng.random((len(near), 1))])


def test_links_equal_brute_force_to_the_target_recall(spark):
    x = sample().astype(np.float32)
    x[390:] = x[0]
    x[380:390] = x[0] * 3
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table(spark, x.tolist())).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= near.sum(1)).all()
    assert found.sum() >= 0.99 * near.sum()
    if found.sum() == near.sum():
        roots = Roots()
        for a, b in zip(*np.nonzero(near), strict=True):
            roots.join(int(a), int(b))
        assert all(got[k].component_id == roots.root(k) for k in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_unsound_vectors_link_with_nothing(spark):
    a = [1.0, 2.0, 3.0, 4.0]
    rows = [a, a, None, [0.0] * 4, [1.0, None, 3.0, 4.0], [math.nan, 2, 3, 4], [math.inf, 2, 3, 4],
            [1.0, 2.0], [], [2e38, 4e37, 1e-40, 0], a]
    ids = [4, 2, 3, 5, 6, 7, 8, 9, 10, 11, None]
    got = embedding_dedup.near_duplicates(table(spark, rows, ids)).collect()
    told = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert len(got) == len(rows)
    assert told[4] == (1, 2, False) and told[2] == (1, 2, True)
    assert all(told[k] == (0, k, True) for k in (3, 5, 6, 7, 8, 9, 10, 11))  # 9: of another length
    assert told[None] == (0, None, True)


def test_lengths_do_not_mix_but_each_is_searched(spark):
    rng = np.random.default_rng(8)
    long, short = rng.normal(size=(30, 8)), rng.normal(size=(5, 3))
    rows = [*long.tolist(), *(long + rng.normal(size=long.shape) * 0.01).tolist(),
            *short.tolist(), *(short * 1.5 + 0.001).tolist(), [2.0], [3.0], [-1.0]]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table(spark, rows)).collect()}
    assert all(got[30 + k].component_id == got[k].component_id != 30 + k for k in range(30))
    assert all(got[65 + k].n_links >= 1 for k in range(5))
    assert [(got[k].n_links, got[k].component_id) for k in (70, 71, 72)] == [(1, 70), (1, 70), (0, 72)]


def test_few_cells_are_visited_and_links_at_the_threshold_found(spark):
    rng = np.random.default_rng(21)
    n, dim = 6000, 64
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    partner = turned(rng, x[:400], rng.uniform(0.9002, 0.91, 400))
    all_rows = np.vstack([x, partner]).astype(np.float32)
    vectors = table(spark, all_rows.tolist())
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors).collect()}
    want = links_by_brute_force(all_rows)
    found = np.array([got[k].n_links for k in range(len(all_rows))])
    assert want.sum() == 800 and (found <= want).all() and found.sum() >= 0.99 * want.sum()
    unit = vectors.selectExpr("vec_id", "1L AS copies", "CAST(embedding AS array<double>) AS unit")
    grid = embedding_dedup.fit(unit, len(all_rows))
    mean = embedding_dedup.cells(unit, grid).agg({"n_cells": "avg"}).first()[0]
    assert mean / (len(grid.first) * len(grid.second)) < 0.1


def test_empty_and_all_unsound(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).collect() == []
    got = embedding_dedup.near_duplicates(table(spark, [None, [0.0, 0.0]])).collect()
    assert sorted(r.vec_id for r in got) == [0, 1] and all(r.n_links == 0 for r in got)


def test_chunks_of_a_hot_cell_change_nothing(spark, monkeypatch):
    x = sample(200, seed=5).tolist()
    whole = sorted(map(tuple, embedding_dedup.near_duplicates(table(spark, x)).collect()))
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(table(spark, x)).collect())) == whole


def turned(rng, x, cosine):
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    return cosine[:, None] * x + np.sqrt(1 - cosine[:, None] ** 2) * side


def links_by_brute_force(x):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    return near.sum(1)


def test_a_large_group_does_not_set_the_reach_of_others(spark):
    rng = np.random.default_rng(11)
    single = rng.normal(size=(4000, 16))
    single /= np.linalg.norm(single, axis=1)[:, None]
    partner = turned(rng, single[:200], rng.uniform(0.9005, 0.905, 200))
    hot = single[-1] + rng.normal(size=(2000, 16)) * 0.004
    x = np.vstack([single, partner, hot]).astype(np.float32)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(
        table(spark, x.tolist())).collect()}
    want = links_by_brute_force(x)
    found = np.array([got[k] for k in range(len(x))])
    assert (found <= want).all() and (found[4200:] == want[4200:]).all()
    pairs = [*range(200), *range(4000, 4200)]
    assert found[pairs].sum() >= 0.99 * want[pairs].sum()


def test_rounds_of_residents_change_nothing_and_move_no_vector(spark, monkeypatch):
    x = sample(300, seed=6).tolist()
    vectors = table(spark, x)
    whole = sorted(map(tuple, embedding_dedup.near_duplicates(vectors).collect()))
    monkeypatch.setattr(embedding_dedup, "HELD_BYTES", 40 * 8 * 16)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 16)
    monkeypatch.setattr(embedding_dedup, "GATHERED", 8)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(vectors).collect())) == whole
    assert any(r[1] for r in whole)
    unit = vectors.selectExpr("vec_id", "1L AS copies", "CAST(embedding AS array<double>) AS unit")
    grid = embedding_dedup.fit(unit, len(x))
    placed = embedding_dedup.cells(unit, grid).cache()
    sent = []
    keep = embedding_dedup.stored
    monkeypatch.setattr(embedding_dedup, "stored", lambda df, *a: sent.append(df) or keep(df, *a))
    embedding_dedup.near_links(placed, grid, 0.9).collect()
    assert len(sent) > 5
    for df in sent:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString().split("InMemory")[0]


def test_rounds_cut_large_buckets():
    assert embedding_dedup.rounds({3: 4, 0: 2, 1: 3, 2: 25, 5: 1}, 10) == [
        (0, 1, 0, 1), (2, 2, 0, 3), (2, 2, 1, 3), (2, 2, 2, 3), (3, 5, 0, 1)]


def test_forest_has_a_row_for_each_node_but_the_least_of_its_component():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 500, (2, 400))
    roots = Roots()
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        roots.join(u, v)
    want = [(k, roots.root(k)) for k in range(500) if roots.root(k) != k]
    assert list(map(tuple, forest(a, b, 500).tolist())) == want
