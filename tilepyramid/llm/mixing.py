"""Mixing sources to target weights by Pfair scheduling.

Every source is a stream of blocks of ``block_rows`` documents, in a fixed mixed order. One slot
holds one block. While the streams with weights w_1..w_k (integers, sum Q) all have blocks, block
i of stream s may not start before slot ``i*Q div w_s`` (its release) and must be placed before
slot ``ceil((i+1)*Q / w_s)`` (its deadline). In each slot the released block with the earliest
deadline is placed, ties by the order of the streams. On one slot line this keeps every deadline,
so each prefix holds each stream's target share to within less than one block. The pattern repeats
after Q slots, hence it is computed once per phase and not once per block.

When a stream has no block left, a new phase begins with the others' weights: no document is
dropped or repeated, and the bound holds within each phase.

Sources that ``weights`` does not name form one stream, so the number of streams is bounded by the
parameter and not by the data, and so is the timetable, the only table that is broadcast: at most
(streams)^2 rows. DataFrame and SQL functions only.

Defined results: a null source belongs to the unnamed stream; a null doc_id sorts first; rows equal
in id, source and ``ties`` get neighbouring places in any order; texts are not looked at; an empty
table gives an empty result; other columns pass through (those named as an added one are
replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid.llm.common import free_names, id_key, ranked, read, small_table

OTHER = "(other)"
BLOCK_ROWS = 8
ADDED = ("stream", "phase", "block", "slot", "release", "deadline", "position")

#: Target weights of the query and of the pipeline.
WEIGHTS = {f"src{k}": w for k, w in enumerate(
    [8, 3, 3, 2, 2, 2, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1])}

# The streams are numbered from 1. A state holds the blocks left and used of each, the first slot
# and number of the next phase, and the timetable so far.
_PICK = """
array_min(filter(transform(sequence(1, size(w)), s ->
  if(act[s - 1] > 0 AND k[s - 1] < act[s - 1] AND (k[s - 1] * q) div act[s - 1] <= t,
     struct(((k[s - 1] + 1) * q + act[s - 1] - 1) div act[s - 1] AS d, s AS s), NULL)),
  x -> x IS NOT NULL)).s"""

_PATTERN = f"""
aggregate(sequence(0L, q - 1),
  struct(array_repeat(0L, size(w)) AS k, CAST(array() AS ARRAY<INT>) AS made),
  (e, t) -> aggregate(array({_PICK.replace('k[', 'e.k[')}), e, (e2, p) -> struct(
    transform(e2.k, (v, i) -> if(i + 1 = p, v + 1, v)) AS k, array_append(e2.made, p) AS made)),
  e -> e.made)"""

_LENGTH = """
array_min(filter(transform(sequence(1, size(w)), s -> if(act[s - 1] > 0,
  1 + ((st.left[s - 1] - 1) div act[s - 1]) * q
    + places[s - 1][CAST((st.left[s - 1] - 1) % act[s - 1] AS INT)], NULL)), x -> x IS NOT NULL))"""


def _let(name: str, value: str, body: str) -> str:
    """SQL has no LET: fold over an array of one."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_STEP = _let("act", "zip_with(w, st.left, (a, l) -> if(l > 0, a, 0L))", _let(
    "q", "aggregate(act, 0L, (x, y) -> x + y)",
    "if(q = 0, st, " + _let("made", _PATTERN, _let(
        "places", "transform(sequence(1, size(w)), s -> transform(filter(transform(made, (p, i) -> "
                  "struct(p AS p, CAST(i AS BIGINT) AS i)), x -> x.p = s), x -> x.i))", _let(
            "len", _LENGTH, _let(
                "took", "transform(act, (a, i) -> (len div q) * a + CAST(size(filter(places[i], "
                        "x -> x < len % q)) AS BIGINT))", """
struct(zip_with(st.left, took, (l, u) -> l - u) AS left,
       zip_with(st.used, took, (a, u) -> a + u) AS used,
       st.first + len AS first, st.phase + 1 AS phase,
       concat(st.told, filter(transform(sequence(1, size(w)), s -> struct(
         s AS s, st.phase AS phase, st.first AS start, q AS period, act[s - 1] AS weight,
         st.used[s - 1] AS first_block, st.used[s - 1] + took[s - 1] AS end_block,
         places[s - 1] AS places)), x -> x.end_block > x.first_block)) AS told)""")))) + ")"))

_TABLE = f"""
aggregate(sequence(1, size(w)), struct(
    n AS left, transform(n, x -> 0L) AS used, 0L AS first, 0 AS phase,
    CAST(array() AS ARRAY<STRUCT<s: INT, phase: INT, start: BIGINT, period: BIGINT,
      weight: BIGINT, first_block: BIGINT, end_block: BIGINT, places: ARRAY<BIGINT>>>) AS told),
  (st, i) -> {_STEP}, st -> st.told)"""


def timetable(rows_per_stream: DataFrame, weights: dict[str, int], other_weight: int = 1,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(stream, phase, start, period, weight, first_block, end_block, places, short).

    ``rows_per_stream`` has (stream, rows). Block b of a stream is in the phase with first_block <=
    b < end_block; with i = b - first_block its slot is ``start + (i div weight)*period +
    places[i % weight]``. ``short`` tells, for each stream whose last block is not full, that
    block's slot and the rows it lacks.
    """
    spark = rows_per_stream.sparkSession
    given = [(name, number, int(w)) for number, (name, w) in enumerate(
        [*weights.items(), (OTHER, other_weight)])]
    if any(w < 1 for _, _, w in given):
        raise ValueError("weights must be positive integers")
    order = small_table(spark, given, "stream string, number int, weight long")
    one = rows_per_stream.join(F.broadcast(order), "stream").agg(F.array_sort(F.collect_list(
        F.struct("number", "stream", "weight", "rows"))).alias("all"))
    one = one.filter(F.size("all") > 0).selectExpr(
        "all", "transform(all, x -> x.weight) AS w",
        f"transform(all, x -> (x.rows + {block_rows - 1}) div {block_rows}) AS n")
    told = one.selectExpr("all", f"{_TABLE} AS told")
    slot = "x.start + ((x.end_block - 1 - x.first_block) div x.weight) * x.period + " \
           "x.places[CAST((x.end_block - 1 - x.first_block) % x.weight AS INT)]"
    last = f"filter(told, x -> x.end_block * {block_rows} > all[x.s - 1].rows)"
    told = told.selectExpr(
        "all", "told", f"transform({last}, x -> struct({slot} AS slot, "
        f"x.end_block * {block_rows} - all[x.s - 1].rows AS lacks)) AS short")
    return (told.select("all", "short", F.explode("told").alias("x"))
            .selectExpr("all[x.s - 1].stream AS stream", "x.phase", "x.start", "x.period",
                        "x.weight", "x.first_block", "x.end_block", "x.places", "short"))


def mix(docs: DataFrame, weights: dict[str, int], other_weight: int = 1,
        block_rows: int = BLOCK_ROWS, source: str = "source", doc_id: str = "doc_id",
        ties: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with its place in the mix: stream, phase, block, slot, release, deadline and the
    gapless 0-based ``position`` of the row."""
    docs = docs.drop(*[c for c in ADDED if c != source])
    named = F.col(source).isin(*weights) if weights else F.lit(False)
    stream = F.coalesce(F.when(named, F.col(source)), F.lit(OTHER))
    sizes = docs.groupBy(stream.alias("stream")).agg(F.count(F.lit(1)).alias("rows")).collect()
    spark = docs.sparkSession
    rows = small_table(spark, [(r[0], r[1]) for r in sizes], "stream string, rows long")
    table = timetable(rows, weights, other_weight, block_rows)
    placed = ranked(docs.withColumn("stream", stream).withColumn("_key", id_key(F.col(doc_id))),
                    ["stream"], "_key", [F.col(c) for c in (doc_id, source, *ties)], "_rank",
                    sum(r[1] for r in sizes))
    placed = placed.withColumn("block", F.expr(f"_rank div {block_rows}"))
    table = F.broadcast(table.withColumnRenamed("stream", "_stream"))
    placed = placed.join(table, (F.col("stream") == F.col("_stream"))
                         & (F.col("block") >= F.col("first_block"))
                         & (F.col("block") < F.col("end_block")))
    placed = placed.withColumn("_i", F.col("block") - F.col("first_block")).withColumn(
        "slot", F.expr("start + (_i div weight) * period + places[CAST(_i % weight AS INT)]"))
    out = placed.withColumns({
        "release": F.expr("start + (_i * period) div weight"),
        "deadline": F.expr("start + ((_i + 1) * period + weight - 1) div weight"),
        "position": F.expr(
            f"slot * {block_rows} + _rank % {block_rows} - aggregate(short, 0L, (a, x) -> "
            "a + if(x.slot < slot, x.lacks, 0L))"),
    })
    return out.select(*docs.columns, *[F.col(c) for c in ADDED if c not in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, WEIGHTS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: all documents in the order of the mix; file by file and row by row the output is the
    mix, so a reader that goes through it in order sees the target shares."""
    row, = free_names(docs, "row")
    whole = docs.select("source", "doc_id", F.struct(*docs.columns).alias(row))
    placed = mix(whole, WEIGHTS)  # whose own columns do not meet those of the documents
    return (placed.repartitionByRange("position").sortWithinPartitions("position")
            .select(f"{row}.*"))


_STREAMS = ", ".join(f"('{s}', {i}, {w})" for i, (s, w) in enumerate([*WEIGHTS.items(), (OTHER, 1)]))

#: Goes slot by slot, unlike the engine, which repeats one period.
OP1_SQL = f"""
WITH RECURSIVE weight(stream, number, w) AS (VALUES {_STREAMS}),
doc AS (
  SELECT doc_id, source, coalesce(weight.stream, '{OTHER}') AS stream
  FROM documents LEFT JOIN weight ON source = weight.stream AND source <> '{OTHER}'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY stream
           ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id) - 1 AS rnk FROM doc),
sizes AS (
  SELECT stream, number, w, count(*) AS n, (count(*) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS blocks
  FROM placed JOIN weight USING (stream) GROUP BY ALL),
given AS (
  SELECT list(w ORDER BY number) AS ws, list(blocks ORDER BY number) AS bs,
         list(stream ORDER BY number) AS names FROM sizes),
walk AS (
  SELECT 0::BIGINT AS t, 0::BIGINT AS t0, 0 AS phase, bs AS remain,
         list_transform(bs, lambda x: 0::BIGINT) AS used,
         list_transform(bs, lambda x: 0::BIGINT) AS base,
         0::BIGINT AS pick, 0::BIGINT AS block, 0::BIGINT AS release, 0::BIGINT AS deadline
  FROM given WHERE len(bs) > 0
  UNION ALL
  SELECT t + 1, if(done, t + 1, t0), if(done, phase + 1, phase), rest, u2,
         if(done, u2, base), p, used[p], t0 + (used[p] - base[p]) * q // a[p],
         t0 + ((used[p] - base[p] + 1) * q + a[p] - 1) // a[p]
  FROM (
    SELECT *, list_transform(remain, lambda x, i: if(i = p, x - 1, x)) AS rest,
           list_transform(used, lambda x, i: if(i = p, x + 1, x)) AS u2, remain[p] = 1 AS done
    FROM (
      SELECT *, list_min(list_filter(list_transform(a, lambda x, i:
          if(x > 0 AND (used[i] - base[i]) * q // greatest(x, 1) <= t - t0,
             [((used[i] - base[i] + 1) * q + x - 1) // x, i], NULL)),
          lambda y: y IS NOT NULL))[2] AS p
      FROM (
        SELECT *, list_sum(a)::BIGINT AS q FROM (
          SELECT walk.*, list_transform(remain, lambda x, i: if(x > 0, ws[i], 0)::BIGINT) AS a
          FROM walk, given)
        WHERE q > 0)))),
slot AS (
  SELECT names[pick] AS stream, block, t - 1 AS slot, release, deadline, ph AS phase
  FROM (SELECT walk.*, names,
               lag(walk.phase) OVER (ORDER BY t) AS ph FROM walk, given) WHERE t > 0)
SELECT doc_id, source, stream, phase, block, slot, release, deadline,
       row_number() OVER (ORDER BY slot, rnk) - 1 AS position
FROM placed JOIN slot USING (stream)
WHERE block = rnk // {BLOCK_ROWS}
"""
