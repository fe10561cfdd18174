"""Conversation structure repair by a square-root checkpointed dynamic program.

The turns of a conversation, in order, are kept, reroled, deleted or joined by inserted empty turns,
at least cost, so that the initials of their roles read ``(s?(ua)+)?``. A state says what came last
(nothing, system, user, assistant); the least cost from a place to the end is a vector of four numbers.
Going backward these vectors are kept only at every ``sqrt(n)``-th turn; going forward those between
two checkpoints are computed again, block by block, and the edit of least ASCII initial among the
tight ones is emitted. Memory is ``sqrt(n)`` vectors.

A conversation of over ``LONG_ROWS`` turns or ``LONG_BYTES`` bytes is not the work of one task: its
turns are numbered by range, cut into blocks of ``sqrt(n)`` turns, and each block gives its matrix of
least costs from state to state. The matrices (``sqrt(n)`` small rows) give the vectors at the
checkpoints; with them every block walks forward from each of the four states, and chaining the end
states tells which walk is the one. Only the digest of such a conversation, being one SHA-256, reads
its blocks one after the other.

Defined results: null roles and texts count as one space; a null turn sorts first; a null conv_id is
a conversation. Turns that are equal in number are ordered by role and text, so repeated rows are
adjacent. Blank: no character but ASCII white space; duplicate: role and text seen earlier in the
conversation; truncated: the last such character is not one of ``.!?``; a turn counts for its first
fault only. An empty table gives no row. Texts are read whole. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tilepyramid.llm.common import importable, numbered, read, stored
from tilepyramid.llm.sqlcrc import CRC_TABLE, crc32 as sql_crc32

LONG_ROWS = 4_096
LONG_BYTES = 32 << 20
SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing, system, user or assistant came last. What an inserted or reroled turn leads to:
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: What keeping a turn with the initial s, u, a (else: 3) leads to.
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
#: Inserts still needed at the end, by state.
MISSING = (0, 2, 1, 0)
AT_END = [INSERT * n for n in MISSING]
NEVER = 1 << 60

TURNS = "turn long, role string, text string"


def code(initial: str, faulty: bool, truncated: bool) -> int:
    """What the program needs to know of a turn; ``faulty`` turns must be deleted."""
    kind = "sua".find(initial) if initial else -1
    return (kind if kind >= 0 else 3) * 4 + 2 * faulty + truncated


def earlier(turn: int, after: list[int]) -> list[int]:
    """The cost vector before a turn, given the one after it."""
    best = [DELETE + c for c in after]
    if not turn & 2:
        late, keep = TRUNCATED * (turn & 1), KEEP[turn >> 2]
        for state in range(4):
            cost = REROLE + late + after[NEXT[state]]
            if state in keep:
                cost = min(cost, late + after[keep[state]])
            best[state] = min(best[state], cost)
    after_user, after_assistant = best[2], best[3]
    best[2] = min(after_user, INSERT + after_assistant)
    best[3] = min(after_assistant, INSERT + after_user)
    best[0] = min(best[0], INSERT + best[2])
    best[1] = min(best[1], INSERT + best[2])
    return best


def before(codes: list[int], end: list[int]) -> list[int]:
    """The cost vector before all the turns."""
    for turn in reversed(codes):
        end = earlier(turn, end)
    return end


def walk(codes: list[int], end: list[int], state: int) -> tuple[str, int]:
    """(edits, last state) of the cheapest way through the turns, given the vector after them."""
    side = isqrt(len(codes)) + 1
    starts = range(0, len(codes), side)
    marks, vector = {}, end  # the vectors at the ends of blocks
    for at in reversed(starts):
        marks[at] = vector
        vector = before(codes[at:at + side], vector)
    edits = []
    for at in starts:
        block = codes[at:at + side]
        vectors = [marks[at]]
        for turn in reversed(block):
            vectors.append(earlier(turn, vectors[-1]))
        vectors.reverse()
        for turn, here, after in zip(block, vectors, vectors[1:]):
            late, keep = TRUNCATED * (turn & 1), KEEP[turn >> 2]
            while True:
                if DELETE + after[state] == here[state]:
                    edits.append("D")
                elif INSERT + here[NEXT[state]] == here[state]:
                    edits.append("I")
                    state = NEXT[state]
                    continue
                elif state in keep and late + after[keep[state]] == here[state]:
                    edits.append("K")
                    state = keep[state]
                else:
                    edits.append("R")
                    state = NEXT[state]
                break
    return "".join(edits), state


def rebuilt(edits: str, state: int, turns: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    roles, texts, source = [], [], iter(turns)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        if edit == "K":
            state = KEEP["sua".find(role[0])][state]
        else:
            state = NEXT[state]
            role = ROLE[state]
        roles.append(role)
        texts.append(text)
    return roles, texts


def illegal_pairs(codes: list[int]) -> int:
    """Neighbours whose initials are not su, ua or au."""
    kinds = [c >> 2 for c in codes]
    return sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(kinds, kinds[1:]))


def repaired(turns: list[tuple]) -> tuple:
    """One conversation, from its (turn, role, text) in order."""
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    seen, codes, faults = set(), [], [0, 0, 0]
    for _, role, text in turns:
        plain = text.rstrip(SPACE)
        fault = (0 if not plain else 1 if (role, text) in seen
                 else 2 if not plain.endswith(ENDS) else None)
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        codes.append(code(role[:1], fault in (0, 1), fault == 2))
    edits, state = walk(codes, AT_END, 0)
    edits += "I" * MISSING[state]
    return (gaps, *faults, illegal_pairs(codes), before(codes, AT_END)[0], edits,
            *rebuilt(edits, 0, [(r, t) for _, r, t in turns]))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = [("block", pa.int64()), ("blocks", pa.int64()), *[(c, pa.int64()) for c in COUNTS],
          ("audit", pa.string()), ("roles", pa.list_(pa.string())),
          ("texts", pa.list_(pa.string()))]
RESULT_SQL = ("block long, blocks long, " + ", ".join(f"{c} long" for c in COUNTS)
              + ", audit string, roles array<string>, texts array<string>")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _short(turns: DataFrame) -> DataFrame:
    """Conversations of bounded size: each is whole within one task."""
    kind = to_arrow_type(turns.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = zip(*done)
            types = [kind, *[t for _, t in RESULT]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)],
                names=["conv_id", *[n for n, _ in RESULT]])

        held, now, done, size = [], None, [], 0
        for batch in batches:
            for conv, *turn in zip(*[c.to_pylist() for c in batch.columns]):
                if held and conv != now:
                    done.append((now, 0, 1, *repaired(held)))
                    held = []
                    if size > 1 << 20:
                        yield batch_of(done)
                        done, size = [], 0
                now = conv
                held.append(tuple(turn))
                size += len(turn[2])
        if held:
            done.append((now, 0, 1, *repaired(held)))
        if done:
            yield batch_of(done)

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        run, f"conv_id {_kind(turns, 'conv_id')}, {RESULT_SQL}")


def _long(turns: DataFrame) -> DataFrame:
    """Conversations of any size, block by block."""
    conv = _kind(turns, "conv_id")
    key = F.struct("conv_id")  # as a struct, a null id joins and groups like any other
    digest = F.sha2(F.col("text"), 256)
    rows = numbered(turns, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"),
                            F.asc("role"), F.asc("text")], "place").withColumn("conv", key)
    firsts = rows.groupBy("conv", "role", digest.alias("digest")).agg(
        F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    rows = rows.join(firsts, "place", "left")
    numbers = rows.groupBy("conv", "turn").count().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    plain = F.rtrim(F.translate("text", SPACE, " " * len(SPACE)))
    blank, repeated = plain == "", F.col("first").isNull()
    truncated = ~blank & ~repeated & ~F.substring(plain, -1, 1).isin(*ENDS)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    rows = rows.withColumns({
        "blank": blank.cast("long"), "duplicate": (~blank & repeated).cast("long"),
        "truncated": truncated.cast("long"),
        "code": (kind * 4 + (blank | repeated).cast("int") * 2 + truncated.cast("int"))})
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("at"),
                                     *[F.sum(c).alias(c) for c in COUNTS[1:4]])
    sizes = stored(sizes.join(numbers, "conv"), "conversation-sizes")
    side = F.ceil(F.sqrt("n")).cast("long")
    blocks = rows.drop(*COUNTS).join(sizes, "conv").withColumns({
        "block": F.expr("(place - at) div CAST(ceil(sqrt(n)) AS BIGINT)"),
        "blocks": F.ceil(F.col("n") / side)})
    blocks = stored(
        blocks.groupBy("conv", "block").agg(
            *[F.first(c).alias(c) for c in ("blocks", *COUNTS[:4])],
            F.array_sort(F.collect_list(F.struct("place", "code", "role", "text"))).alias("t"))
        .select("conv", "block", *["blocks", *COUNTS[:4]],
                *[F.col(f"t.{c}").alias(f"{c}s") for c in ("code", "role", "text")]),
        "conversation-blocks")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            units = [[0 if s == e else NEVER for s in range(4)] for e in range(4)]
            f["costs"] = [[c for unit in units for c in before(codes.tolist(), unit)]
                          for codes in f["codes"]]
            f["inner"] = [illegal_pairs(c) for c in f["codes"]]
            f["head"] = [c[0] for c in f["codes"]]
            f["tail"] = [c[-1] for c in f["codes"]]
            yield f.drop(columns=["codes"])

    told = "conv struct<conv_id:{}>, block long, ".format(conv)
    costs = blocks.select("conv", "block", "codes").mapInPandas(
        matrices, told + "costs array<long>, inner long, head int, tail int")

    def checkpoints(f: pd.DataFrame) -> pd.DataFrame:
        """The vectors at the ends of a conversation's blocks, its cost and illegal pairs."""
        f = f.sort_values("block", ignore_index=True)
        vector, vectors = list(AT_END), []
        for c in reversed([c.tolist() for c in f["costs"]]):
            vectors.append(vector)
            vector = [min(c[4 * e + s] + vector[e] for e in range(4)) for s in range(4)]
        f["vector"] = vectors[::-1]
        f["cost"] = vector[0]
        joints = [illegal_pairs(list(p)) for p in zip(f["tail"].tolist(), f["head"].tolist()[1:])]
        f["illegal"] = int(f["inner"].sum()) + sum(joints)
        return f[["conv", "block", "vector", "cost", "illegal"]]

    marks = costs.groupBy("conv").applyInPandas(
        checkpoints, told + "vector array<long>, cost long, illegal long")

    def walks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [[walk(codes.tolist(), vector.tolist(), s) for s in range(4)]
                     for codes, vector in zip(f["codes"], f["vector"])]
            f["audits"] = [[edits for edits, _ in four] for four in found]
            f["ends"] = [[state for _, state in four] for four in found]
            yield f.drop(columns=["codes", "vector"])

    walked = stored(blocks.select("conv", "block", "codes").join(marks, ["conv", "block"])
                    .mapInPandas(walks, told + "cost long, illegal long, audits array<string>, "
                                               "ends array<int>"), "conversation-walks")

    def chain(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("block", ignore_index=True)
        state, states = 0, []
        for ends in f["ends"]:
            states.append(state)
            state = int(ends[state])
        f["state"] = states
        f["more"] = [0] * (len(f) - 1) + [MISSING[state]]
        return f[["conv", "block", "state", "more"]]

    chosen = walked.select("conv", "block", "ends").groupBy("conv").applyInPandas(
        chain, told + "state int, more int")

    def rebuild(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [rebuilt(a, s, list(zip(r, t))) for a, s, r, t in zip(
                f["audit"], f["state"], f["roles"], f["texts"])]
            f["roles"] = [roles for roles, _ in made]
            f["texts"] = [texts for _, texts in made]
            f["conv_id"] = [c["conv_id"] for c in f["conv"]]
            yield f.drop(columns=["conv", "state"])

    audit = F.concat(F.get("audits", F.col("state")), F.repeat(F.lit("I"), F.col("more")))
    whole = (blocks.drop("codes").join(walked.drop("ends"), ["conv", "block"])
             .join(chosen, ["conv", "block"]).withColumn("audit", audit)
             .drop("audits", "more"))
    return whole.mapInPandas(rebuild, f"{RESULT_SQL}, conv_id {conv}").select(
        "conv_id", *[n for n, _ in RESULT])


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text", long_rows: int = LONG_ROWS,
           long_bytes: int = LONG_BYTES) -> DataFrame:
    """Repaired conversations: conv_id, block, blocks, gaps, blank, duplicate, truncated, illegal,
    cost, audit, roles, texts.

    A conversation is one row (block 0 of 1); a long one is a row per block, whose audits, roles and
    texts follow on each other and which all carry the conversation's counts.
    """
    importable(conversations.sparkSession)
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n)
          for c, n in ((role, "role"), (text, "text"))])
    sizes = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    large = stored(sizes.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes))
                   .select(F.col("conv_id").alias("_large")), "conversations-long")
    if large.isEmpty():
        return _short(turns)
    on = F.col("conv_id").eqNullSafe(F.col("_large"))
    return _short(turns.join(large, on, "left_anti")).unionByName(
        _long(turns.join(large, on, "left_semi")))


def digests(repaired_blocks: DataFrame) -> DataFrame:
    """One row per conversation: its counts, whole audit and the SHA-256 of its ``role:text`` lines."""
    counts = COUNTS
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    told = repaired_blocks.withColumn("lines", F.array_join(lines, "\n"))
    one = told.filter(F.col("blocks") == 1).select(
        "conv_id", *counts, "audit", F.sha2("lines", 256).alias("repaired_sha256"))
    kind = _kind(repaired_blocks, "conv_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = audits = None
        for f in frames:
            for row in f.itertuples(index=False):
                if row.block == 0:
                    held, audits, empty = sha256(), [], True
                if row.n_lines:
                    held.update(("" if empty else "\n").encode() + row.lines.encode())
                    empty = False
                audits.append(row.audit)
                if row.block == row.blocks - 1:
                    yield pd.DataFrame([[row.conv_id, *[getattr(row, c) for c in counts],
                                         "".join(audits), held.hexdigest()]],
                                       columns=["conv_id", *counts, "audit", "repaired_sha256"])

    many = told.filter(F.col("blocks") > 1).select(
        "conv_id", "block", "blocks", *counts, "audit", F.size("roles").alias("n_lines"), "lines")
    many = many.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(
        run, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in counts)
        + ", audit string, repaired_sha256 string")
    return one.unionByName(many)


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage of the query: rows dropped, emptied, stripped of ends, repeated or reroled."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    told = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    df = conversations.select("conv_id", "turn", spaced("role").alias("role"),
                              spaced("text").alias("text"),
                              (F.crc32(told.cast("binary")) % 20).alias("_kind"))
    kind = F.col("_kind")
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return df.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations")
    found = digests(repair(damaged(given)))
    ids = given.select(F.col("conv_id").alias("_id")).distinct()
    joined = ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _way(cost: str, edit: str, rest: str, line: str | None) -> str:
    """A SQL struct (cost, edits, repaired lines): a step put before the way ``rest``."""
    lines = f"{line} || chr(10) || {rest}.o" if line else f"{rest}.o"
    return f"{{'c': {cost} + {rest}.c, 'a': '{edit}' || {rest}.a, 'o': {lines}}}"


def _best(state: int) -> str:
    """The best way from a state over one turn (f0..f3: the ways after it), inserts left out."""
    ways = [_way(str(DELETE), "D", f"f{state}", None)]
    late = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
    after = NEXT[state]
    allowed = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"
    rerole = _way(f"{REROLE} + {late}", "R", f"f{after}", f"'{ROLE[after]}:' || text")
    ways.append(f"CASE WHEN {allowed} THEN {rerole} END")
    for initial, keep in zip("sua", KEEP):
        if state in keep:
            kept = _way(late, "K", f"f{keep[state]}", "role || ':' || text")
            ways.append(f"CASE WHEN {allowed} AND substr(role, 1, 1) = '{initial}' THEN {kept} END")
    return f"list_min([{', '.join(ways)}])"


def _inserted(own: str, other: str, role: str) -> str:
    return f"list_min([{own}, {_way(str(INSERT), 'I', other, chr(39) + role + ':' + chr(39))}])"


_END = "{{'c': {}::BIGINT, 'a': '{}', 'o': {}}}"
_EMPTY = "sha256('')"
_PLAIN = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc_table),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM given, generate_series(1, 2) copies(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    substr(role, 1, 1) AS initial FROM hurt),
faulty AS (
  SELECT *, CASE WHEN {_PLAIN} = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
    WHEN right({_PLAIN}, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair
  FROM placed),
told AS (
  SELECT conv_id, max(k) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
ways AS (
  SELECT conv_id, n + 1 AS k, {_END.format(0, '', "''")} AS f0,
    {_END.format(2 * INSERT, 'II', "'user:' || chr(10) || 'assistant:' || chr(10)")} AS f1,
    {_END.format(INSERT, 'I', "'assistant:' || chr(10)")} AS f2, {_END.format(0, '', "''")} AS f3
  FROM told
  UNION ALL
  SELECT conv_id, k, {_inserted("b0", "g2", "user")}, {_inserted("b1", "g2", "user")}, g2, g3
  FROM (
    SELECT *, {_inserted("b2", "b3", "assistant")} AS g2, {_inserted("b3", "b2", "user")} AS g3
    FROM (
      SELECT t.conv_id, t.k, {", ".join(f"{_best(s)} AS b{s}" for s in range(4))}
      FROM ways w JOIN faulty t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.k = w.k - 1)))
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(f0.c, 0)::BIGINT AS cost, coalesce(f0.a, '') AS audit,
  coalesce(sha256(left(f0.o, greatest(length(f0.o) - 1, 0))), {_EMPTY}) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM i.conv_id AND w.k = 1
"""
