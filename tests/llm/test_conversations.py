"""Conversation repair against exhaustive search and SQL."""

import random
import re
from hashlib import sha256

import duckdb
import pytest

from tilepyramid.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, block long, cost string, conv string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", "y") for r in rows], SCHEMA)


def cheapest(turns):
    """(cost, edits, lines) by trying every edit, inserts up to two in a row; ties ASCII-least."""
    seen, marked = set(), []
    for _, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        bare = text.strip(c.SPACE)
        fault = "must" if not bare or (role, text) in seen else "late" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    best = None

    def go(at, inserts, cost, edits, lines):
        nonlocal best
        if at == len(marked):
            initials = "".join(line[:1] for line in lines)
            if re.fullmatch("(s?(ua)+)?", initials):
                best = min(filter(None, (best, (cost, edits, lines))))
        else:
            role, text, fault = marked[at]
            go(at + 1, 0, cost + 4, edits + "D", lines)
            if fault != "must":
                late = 3 * (fault == "late")
                go(at + 1, 0, cost + late, edits + "K", [*lines, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    go(at + 1, 0, cost + late + 3, edits + "R", [*lines, f"{other}:{text}"])
        if inserts < 2:
            for other in ("user", "assistant"):
                go(at, inserts + 1, cost + 3, edits + "I", [*lines, f"{other}:"])

    go(0, 0, 0, "", [])
    cost, edits, lines = best
    return cost, edits, sha256("\n".join(lines).encode()).hexdigest()


def conversations(seed, n, longest):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        turns = []
        for turn in range(rng.randrange(1, longest + 1)):
            turns.append((rng.choice([turn, turn, turn, None, turn + 3]),
                          rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "",
                                      None]),
                          rng.choice(["Yes.", "No!", "Who? \n", "cut off", " \t", "", None,
                                      f"Turn {turn}.", "é."])))
        rows += [(None if conv == 3 else conv, *t) for t in turns]
    return rows


def ordered(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, " " if role is None else role,
                                         " " if text is None else text))
    return {k: sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
            for k, v in out.items()}


def digests(df):
    rows = c.digests(df).collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_exhaustive_search_agrees(spark):
    rows = conversations(1, 60, 3)
    got = digests(c.repair(frame(spark, rows)))
    for conv, turns in ordered(rows).items():
        assert got[conv][5:] == cheapest(turns), turns


@pytest.mark.parametrize("long_rows", [0, 3])
def test_long_conversations_go_by_blocks(spark, long_rows):
    rows = conversations(2, 12, 40) + [(99, 1, "user", "Same.")] * 30
    whole = digests(c.repair(frame(spark, rows)))
    blocks = c.repair(frame(spark, rows), long_rows=long_rows)
    assert blocks.filter("blocks > 1").count() > 12
    assert digests(blocks) == whole


def test_long_texts_make_a_conversation_long(spark):
    rows = [(1, 0, "user", "word " * 1000 + "."), (1, 1, "assistant", "Ok."), (2, 0, "user", "Hm.")]
    found = c.repair(frame(spark, rows), long_bytes=1000)
    assert {r.conv_id: r.blocks for r in found.collect()} == {1: 1, 2: 1}
    assert digests(found) == digests(c.repair(frame(spark, rows)))


def test_walk_needs_square_root_memory(monkeypatch):
    rng, calls = random.Random(5), []
    codes = [rng.choice([1, 4, 6, 8, 9, 12]) for _ in range(400)]
    end = list(c.AT_END)
    real = c.earlier
    monkeypatch.setattr(c, "earlier", lambda t, a: calls.append(1) or real(t, a))
    edits, state = c.walk(codes, end, 0)
    assert len(calls) == 2 * len(codes)  # once backward, once more going forward
    assert edits.translate({ord("I"): None}).__len__() == 400 and state in (0, 2, 3)


def test_general_columns_and_empty(spark):
    df = frame(spark, [(7, 2, "user", "A."), (7, 5, "assistant", "B.")])
    row = c.repair(df).collect()[0]
    assert (row.gaps, row.audit, row.roles, row.texts) == (2, "KK", ["user", "assistant"], ["A.", "B."])
    assert c.repair(df.limit(0)).count() == 0
    assert c.digests(c.repair(df.limit(0))).count() == 0


def test_query_and_sql_with_nulls(spark, tmp_path):
    rows = conversations(4, 60, 12)
    frame(spark, rows).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = c.op13_conversations(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM "
                f"'{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({c.OP13_SQL})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
