"""Embedding near-duplicates by an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own codebook of K codes; the product
grid has K*K cells, about as many as there are rows. A vector visits cells in the order of the
multi-sequence traversal, i.e. by the sum of its squared distances to the cell's two codes, as far as
a reach beyond its own cell; only with the vectors of visited cells is it compared. A pair is met if
either visits the other's cell. Every pair met is verified by its cosine in double precision.

The reach is the larger of two, plus the margin ``SLACK``; neither is weighted by pairs, so a large
group does not speak for the others. One is measured: sampled rows, taken in turn from all cells so
that a crowded cell gives no more than others, are compared with all rows by brute force, and the
farthest partner of any of them counts. Rounds of probes are drawn until ``ENOUGH`` have partners
without being in a large group, or ``ROUNDS`` are through. The other needs no partners in the table:
sampled rows are given partners at the threshold itself, turned toward other rows or in free
directions, and ``TARGET_RECALL`` of such pairs of either kind are within the reach.

The codebooks are fitted on at most ``MAX_FIT`` vectors, and the reach is set on those; this is a
parameter of the method and bounds what the driver holds. All rows are indexed and all rows search.

Exact copies are one vector with a multiplicity. The codes of each half are put into groups of near
codes; a pair of groups is a bucket of about ``CHUNK`` vectors. A vector visits a fair share of the
buckets, so no vector is sent to those it visits: that would store it once for each. Buckets are taken
in rounds of ``HELD_BYTES`` of resident vectors, which every task of the round holds while it reads the
stored vectors where they lie and compares each with the residents of the cells it visits. Nothing is
shuffled; a task adds up links and sends one row per vector, never one per pair, and for components a
spanning forest of all links it has seen. Rounds grow with the rows, the memory of a task does not.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing
and are their own component; vectors of different lengths do not link, each length has an index of its
own; a null id is kept, as a vector without links; rows that repeat id and vector count as copies of
each other; an empty table gives no row; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilepyramid.llm.blocks import forest
from tilepyramid.llm.common import drop_folder, read, stored, stored_path
from tilepyramid.llm.components import components

THRESHOLD = 0.9
TARGET_RECALL = 0.995
SLACK = 0.02
MAX_FIT = 8_000
#: Probes of the rounds: each is compared with all rows.
MAX_PROBES = 256
ROUNDS = (MAX_PROBES, 3 * MAX_PROBES, 12 * MAX_PROBES)
ENOUGH = 64
#: Partners drawn for a sampled row, of each kind.
DRAWS = 4
CHUNK = 2_048
#: Bytes of the resident vectors of a round.
HELD_BYTES = 32 << 20
#: Links of a forest that a task gathers before it makes one forest of them.
GATHERED = 1 << 20
#: Pairs of vectors whose cosines are told at a time.
PAIRS = 1 << 16
#: More than what distances told by matrix products are off; whether a cell is visited is then told
#: by sums of its own.
ROUNDING = 1e-9
COUNT, TIE = 0, 1


@dataclass(frozen=True)
class Grid:
    """Two codebooks of K codes each, the group of each code, and the reach of the traversal."""

    first: np.ndarray
    second: np.ndarray
    reach: float = math.inf
    groups: tuple[np.ndarray, np.ndarray] | None = None

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return _squared(x[:, :half], self.first), _squared(x[:, half:], self.second)

    def beyond(self, x: np.ndarray, nearest: np.ndarray, own1: np.ndarray,
               own2: np.ndarray) -> np.ndarray:
        """How far beyond its own cell each row of ``x`` has the cell (own1, own2) of the same row.

        Summed row by row, so that it is the same number in whatever company a row is told.
        """
        half = x.shape[1] // 2
        return (((x[:, :half] - self.first[own1]) ** 2).sum(1)
                + ((x[:, half:] - self.second[own2]) ** 2).sum(1) - nearest)


def _squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means; a code that loses all its points takes the point worst served."""
    rng = np.random.default_rng(3)
    codes = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        d = _squared(x, codes)
        own = d.argmin(1)
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=len(codes))
        codes = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], codes)
        for lost in np.flatnonzero(counts == 0):
            worst = d.min(1).argmax()
            codes[lost] = x[worst]
            d[worst] = 0
    return codes


def codes_for(rows: int) -> int:
    """K so that there are about as many cells as rows, between 4 and 1024."""
    return int(min(1024, max(4, 2 ** round(math.log2(math.sqrt(max(rows, 1)))))))


def groups_for(rows: int) -> int:
    """Groups of the codes of a half, so that a bucket holds about ``CHUNK`` vectors; at most 64."""
    return int(min(64, max(1, round(math.sqrt(rows / CHUNK)))))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _sample(unit: DataFrame, rows: int, most: int, seed: str) -> np.ndarray:
    draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    got = unit.filter(draw < most / max(rows, 1)).select("unit").limit(2 * most).collect()
    return np.array([r[0] for r in got], dtype=np.float64)


def _away(grid: Grid, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The reach with which the same rows of ``x`` and ``y`` meet, either way."""
    d1, d2 = grid.distances(x)
    e1, e2 = grid.distances(y)
    row = np.arange(len(x))
    there = d1[row, e1.argmin(1)] + d2[row, e2.argmin(1)] - d1.min(1) - d2.min(1)
    back = e1[row, d1.argmin(1)] + e2[row, d2.argmin(1)] - e1.min(1) - e2.min(1)
    return np.minimum(there, back)


def imagined_reach(grid: Grid, sample: np.ndarray, threshold: float) -> float:
    """The reach that pairs of sampled rows and partners at the threshold itself need."""
    rng = np.random.default_rng(5)
    needed: list[list[np.ndarray]] = [[], []]
    for _ in range(DRAWS):
        kinds = (sample[rng.permutation(len(sample))], rng.normal(size=sample.shape))
        for kind, toward in enumerate(kinds):
            side = toward - (toward * sample).sum(1)[:, None] * sample
            length = np.linalg.norm(side, axis=1)
            turned = np.flatnonzero(length > 1e-9)
            for at in range(0, len(turned), 512):
                row = turned[at:at + 512]
                partner = threshold * sample[row] + math.sqrt(max(0, 1 - threshold ** 2)) * (
                    side[row] / length[row, None])
                needed[kind].append(_away(grid, sample[row], partner))
    return max((float(np.quantile(np.concatenate(n), TARGET_RECALL, method="higher"))
                for n in needed if n), default=0.0)


def probes_in_turn(grid: Grid, sample: np.ndarray) -> np.ndarray:
    """The sample in an order that takes one row of every cell before a second of any."""
    d = [np.concatenate(c) for c in zip(*(
        [e.argmin(1) for e in grid.distances(sample[at:at + 512])]
        for at in range(0, len(sample), 512)), strict=True)]
    cell = pd.Series(d[0].astype(np.int64) * len(grid.second) + d[1])
    return sample[np.argsort(cell.groupby(cell).cumcount().to_numpy(), kind="stable")]


def probed(unit: DataFrame, grid: Grid, probes: np.ndarray, threshold: float) -> np.ndarray:
    """(partners, farthest) of each probe that has partners, among all rows."""
    shipped = unit.sparkSession.sparkContext.broadcast((grid, probes))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid, probes = shipped.value
        to_first, to_second = grid.distances(probes)
        nearest = to_first.min(1) + to_second.min(1)
        mine1, mine2 = to_first.argmin(1), to_second.argmin(1)
        partners, farthest = np.zeros(len(probes), dtype=np.int64), np.zeros(len(probes))
        for batch in batches:
            for at in range(0, len(batch), 512):
                x = _matrix(batch["unit"].iloc[at:at + 512])
                d1, d2 = grid.distances(x)
                own1, own2 = d1.argmin(1), d2.argmin(1)
                cosine = x @ probes.T
                # copies are gone, so a cosine of one is the probe itself
                row, probe = np.nonzero((cosine >= threshold) & (cosine < 1 - 1e-12))
                there = to_first[probe, own1[row]] + to_second[probe, own2[row]] - nearest[probe]
                back = (d1[row, mine1[probe]] + d2[row, mine2[probe]]
                        - d1[row, own1[row]] - d2[row, own2[row]])
                away = np.minimum(there, back)
                partners += np.bincount(probe, minlength=len(probes))
                np.maximum.at(farthest, probe, away)
        at = np.flatnonzero(partners)
        yield pd.DataFrame({"probe": at, "n": partners[at], "away": farthest[at]})

    told = (unit.select("unit").mapInPandas(run, "probe long, n long, away double")
            .groupBy("probe").agg(F.sum("n"), F.max("away")).collect())  # a row for each probe
    return np.array([(r[1], r[2]) for r in told], dtype=np.float64).reshape(-1, 2)


def fit(unit: DataFrame, rows: int, threshold: float = THRESHOLD) -> Grid:
    """Codebooks from a sample, then the reach from sampled rows against all rows."""
    sample = _sample(unit, rows, MAX_FIT, "fit")
    if not len(sample):
        sample = np.array([r[0] for r in unit.select("unit").limit(MAX_FIT).collect()])
    half = sample.shape[1] // 2
    k = min(codes_for(rows), len(sample))
    grid = Grid(codebook(sample[:, :half], k), codebook(sample[:, half:], k))
    reach = imagined_reach(grid, sample, threshold)
    probes, at, useful = probes_in_turn(grid, sample), 0, 0
    for size in ROUNDS:
        if useful >= ENOUGH or at >= len(probes):
            break
        told = probed(unit, grid, probes[at:at + size], threshold)
        at += size
        reach = max(reach, told[:, 1].max(initial=0.0))
        # a probe with a hundredth of all rows as partners is in a large group
        useful += int((told[:, 0] <= max(8, rows / 100)).sum())
    n = groups_for(rows)
    groups = tuple(_squared(codes, codebook(codes, min(n, len(codes)))).argmin(1)
                   for codes in (grid.first, grid.second))
    return Grid(grid.first, grid.second, reach + SLACK, groups)


def _group_least(excess: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """The least of each row over the codes of each group; infinite for a group without codes."""
    out = np.full((len(excess), n), np.inf)
    for g in np.unique(groups):
        out[:, g] = excess[:, groups == g].min(1)
    return out


def _near(grid: Grid, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Whether each row visits a cell of each bucket, from its distances to the codes."""
    g1, g2 = grid.groups
    e1, e2 = d1 - d1.min(1)[:, None], d2 - d2.min(1)[:, None]
    near = (_group_least(e1, g1, int(g1.max()) + 1)[:, :, None]
            + _group_least(e2, g2, int(g2.max()) + 1)[:, None, :] <= grid.reach + ROUNDING)
    return near.reshape(len(d1), -1)


def cells(unit: DataFrame, grid: Grid, counted: bool = True) -> DataFrame:
    """``unit`` with own1, own2, nearest, bucket and, if ``counted``, n_cells: the own cell and how near
    it is, its bucket, and the number of cells visited."""
    shipped = unit.sparkSession.sparkContext.broadcast(grid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = shipped.value
        g1, g2 = grid.groups
        n2 = int(g2.max()) + 1
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at:at + 512]
                x = _matrix(part["unit"])
                d1, d2 = grid.distances(x)
                own1, own2 = d1.argmin(1), d2.argmin(1)
                told = {"own1": own1, "own2": own2, "bucket": g1[own1] * n2 + g2[own2],
                        "nearest": grid.beyond(x, np.zeros(len(x)), own1, own2)}
                if counted:
                    # the traversal: for each first code, nearest first, a prefix of the second codes
                    e1 = np.sort(d1 - d1.min(1)[:, None], axis=1)
                    ordered = np.sort(d2 - d2.min(1)[:, None], axis=1)
                    told["n_cells"] = [
                        int(np.searchsorted(o, grid.reach - a[a <= grid.reach], "right").sum())
                        for a, o in zip(e1, ordered)]
                yield part.assign(**told)

    made = [("own1", T.IntegerType()), ("own2", T.IntegerType()), ("bucket", T.IntegerType()),
            ("nearest", T.DoubleType()), *([("n_cells", T.IntegerType())] if counted else [])]
    schema = T.StructType([*unit.schema.fields, *(T.StructField(*f) for f in made)])
    return unit.mapInPandas(run, schema)


@dataclass(frozen=True)
class Residents:
    """The vectors of a round's buckets, by bucket; ``first`` and ``last`` are the ends of each."""

    ids: np.ndarray
    copies: np.ndarray
    unit: np.ndarray
    own1: np.ndarray
    own2: np.ndarray
    nearest: np.ndarray
    buckets: np.ndarray
    first: np.ndarray
    last: np.ndarray


PLACED = ["vec_id", "copies", "unit", "own1", "own2", "nearest"]


def _columns(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    """The :data:`PLACED` columns, ``unit`` as a matrix."""
    out = []
    for name in PLACED:
        column = batch.column(name)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if name == "unit":
            out.append(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))
        else:
            out.append(column.to_numpy(zero_copy_only=False))
    return out


def rounds(sizes: dict[int, int], most: int) -> list[tuple[int, int, int, int]]:
    """(first bucket, last bucket, part, parts) of rounds with about ``most`` vectors at most; a larger
    bucket is cut into parts, each a round."""
    out, held = [], 0
    for bucket in sorted(sizes):
        n = sizes[bucket]
        if n > most:
            parts = math.ceil(n / most)
            out += [(bucket, bucket, p, parts) for p in range(parts)]
            held = most
        elif out and held + n <= most:
            out[-1] = (out[-1][0], bucket, 0, 1)
            held += n
        else:
            out.append((bucket, bucket, 0, 1))
            held = n
    return out


def _residents(placed: DataFrame, first: int, last: int, part: int, parts: int) -> Residents:
    own = placed.filter(F.col("bucket").between(first, last))
    if parts > 1:
        own = own.filter(F.expr(f"pmod(xxhash64(vec_id, 'chunk'), {parts}) = {part}"))
    table = own.select("bucket", *PLACED).toArrow()
    bucket = table.column("bucket").to_numpy()
    by = np.argsort(bucket, kind="stable")
    buckets, at = np.unique(bucket[by], return_index=True)
    return Residents(*[c[by] for c in _columns(table)], buckets, at, np.append(at[1:], len(by)))


def near_links(placed: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """(kind, a, b): kind COUNT tells b links more of vector a, kind TIE a link of the forest.

    A pair is met where one visits the other's cell. If each visits the other's, each counts its own
    side; if only one does, it counts both. ``placed`` is read twice in each round: store it.
    """
    context = placed.sparkSession.sparkContext
    sizes = {r[0]: r[1] for r in placed.groupBy("bucket").count().collect()}  # 64 * 64 at most
    dim = grid.first.shape[1] + grid.second.shape[1]
    shipped, found = context.broadcast(grid), []
    for which in rounds(sizes, max(1, HELD_BYTES // (8 * dim))):
        held = context.broadcast(_residents(placed, *which))
        found.append(stored(placed.select(*PLACED).mapInArrow(
            _comparing(shipped, held, threshold), "kind int, a long, b long"), "vector-links"))
        held.destroy()
    return reduce(DataFrame.union, found)


def _comparing(shipped, held, threshold: float):
    """What a task of a round does with the vectors it reads."""
    def told(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)),
             pa.array(b.astype(np.int64))], names=["kind", "a", "b"])

    def met(grid: Grid, res: Residents, x: np.ndarray, x_nearest: np.ndarray, rows: np.ndarray,
            d1: np.ndarray, d2: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Rows and residents of ``part`` that are linked, if the row visits the resident's cell."""
        # the residents of visited cells, and only those, are compared
        row, col = np.nonzero(d1[rows][:, res.own1[part]] + d2[rows][:, res.own2[part]]
                              <= (x_nearest[rows] + grid.reach + ROUNDING)[:, None])
        row, col = rows[row], col + part.start
        linked = np.concatenate([np.zeros(0, dtype=bool), *(
            np.einsum("ij,ij->i", x[row[k:k + PAIRS]], res.unit[col[k:k + PAIRS]]) >= threshold
            for k in range(0, len(row), PAIRS))])
        row, col = row[linked], col[linked]
        there = grid.beyond(x[row], x_nearest[row], res.own1[col], res.own2[col]) <= grid.reach
        return row[there], col[there]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, res = shipped.value, held.value
        more = np.zeros(len(res.ids), dtype=np.int64)
        ties: list[np.ndarray] = []
        gathered = 0
        for batch in batches:
            if not len(batch):
                continue
            columns = _columns(batch)
            for at in range(0, len(batch), 512):
                x_id, copies, x, own1, own2, nearest = (c[at:at + 512] for c in columns)
                d1, d2 = grid.distances(x)
                visits = _near(grid, d1, d2)[:, res.buckets]
                n = np.zeros(len(x), dtype=np.int64)
                for k in np.flatnonzero(visits.any(0)):
                    rows = np.flatnonzero(visits[:, k])
                    for start in range(res.first[k], res.last[k], CHUNK):
                        part = slice(start, min(start + CHUNK, res.last[k]))
                        row, col = met(grid, res, x, nearest, rows, d1, d2, part)
                        other = x_id[row] != res.ids[col]
                        row, col = row[other], col[other]
                        if not len(row):
                            continue
                        back = grid.beyond(res.unit[col], res.nearest[col], own1[row],
                                           own2[row]) <= grid.reach
                        n += np.bincount(row, res.copies[col], minlength=len(x)).astype(np.int64)
                        more[part] += np.bincount(
                            col[~back] - start, copies[row[~back]],
                            minlength=part.stop - start).astype(np.int64)
                        ids = np.concatenate([x_id, res.ids[part]])
                        ties.append(ids[forest(row, len(x) + col - start, len(ids))])
                        gathered += len(ties[-1])
                if gathered > GATHERED:
                    ties = [_one_forest(ties)]
                    gathered = len(ties[0])
                    if gathered > GATHERED // 2:
                        yield told(TIE, ties[0][:, 0], ties[0][:, 1])
                        ties, gathered = [], 0
                if n.any():
                    yield told(COUNT, x_id[n > 0], n[n > 0])
        if ties:
            tied = _one_forest(ties)
            yield told(TIE, tied[:, 0], tied[:, 1])
        yield told(COUNT, res.ids[more > 0], more[more > 0])

    return run


def _one_forest(ties: list[np.ndarray]) -> np.ndarray:
    """The links (a, b) of several forests as one forest."""
    ids, at = np.unique(np.concatenate(ties), return_inverse=True)
    at = at.reshape(-1, 2)
    return ids[forest(at[:, 0], at[:, 1], len(ids))]


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``."""
    # single precision stays as it is where vectors are stored and moved
    single = vectors.schema[embedding].dataType == T.ArrayType(T.FloatType())
    kind = "array<float>" if single else "array<double>"
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"),
                       F.col(embedding).cast(kind).alias("v"))
    # scaled by the largest component first, so that no square overflows
    v = v.withColumn("top", _top()).withColumn("size", F.size("v"))
    v = v.withColumn("ok", F.coalesce(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
        & (F.col("top") > 0) & (F.col("top") < math.inf), F.lit(False)))
    found = v.filter(~F.col("ok")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"))
    sound = v.filter("ok").select("vec_id", "v", "size")
    # an index for each length; vectors of one table have one length, or a few
    for size in sorted(r[0] for r in sound.select("size").distinct().collect()):
        found = found.union(_of_one_length(sound.filter(F.col("size") == size), threshold))
    return found


def _top() -> Column:
    return F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))


def _with_unit(df: DataFrame) -> DataFrame:
    """``df`` with the unit vector of its sound ``v``; lambdas bind the largest component and the norm,
    which would else be told anew for each component."""
    return df.withColumn("unit", F.expr("""
        transform(array(array_max(transform(v, x -> abs(CAST(x AS DOUBLE))))), t ->
          transform(array(transform(v, x -> CAST(x AS DOUBLE) / t)), s ->
            transform(array(sqrt(aggregate(s, 0D, (a, x) -> a + x * x))), n ->
              transform(s, x -> x / n))[0])[0])[0]"""))


def _of_one_length(sound: DataFrame, threshold: float) -> DataFrame:
    # copies: one vector with its multiplicity, named by its smallest id
    spark = sound.sparkSession
    path = stored_path(spark, "vectors")
    copies = stored(sound.groupBy("v").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "vectors", path)
    unit = _with_unit(copies)
    grid = fit(unit, copies.count(), threshold)
    placed = stored(cells(unit, grid, counted=False).drop("unit"), "cells")
    drop_folder(spark, path)  # the cells have the vectors too
    links = near_links(_with_unit(placed), grid, threshold)
    counts = links.filter(F.col("kind") == COUNT).groupBy("a").agg(F.sum("b").alias("found"))
    comps = components(links.filter(F.col("kind") == TIE))
    first_id = F.col("first_id")
    told = (placed.select("v", F.col("vec_id").alias("first_id"), "copies")
            .join(counts, first_id == F.col("a"), "left")
            .join(comps, first_id == F.col("id"), "left")
            .select("v", (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n_links"),
                    F.coalesce("component", "first_id").alias("component_id")))
    return sound.select("vec_id", "v").join(told, "v").select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: Every pair of sound vectors, whatever their cells; right for the engine while its recall is 1.
OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
       least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       vec_id <= coalesce(low.b, vec_id) AS kept
FROM v LEFT JOIN low ON v.vec_id = low.a LEFT JOIN n ON v.vec_id = n.a
"""
