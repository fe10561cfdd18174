import math
from collections import Counter

import pytest
from helpers import documents

from tilepyramid.llm import mixing


def schedule(sizes, weights, block_rows):
    """Slot by slot: earliest deadline first among released blocks."""
    left = {s: math.ceil(n / block_rows) for s, n in sizes.items()}
    used, base, t, t0, phase, out = Counter(), Counter(), 0, 0, 0, []
    while any(left.values()):
        active = [s for s in weights if left.get(s)]
        q = sum(weights[s] for s in active)
        ready = [s for s in active if (used[s] - base[s]) * q // weights[s] <= t - t0]
        pick = min(ready, key=lambda s: (-(-(used[s] - base[s] + 1) * q // weights[s]),
                                         list(weights).index(s)))
        out.append((pick, used[pick], phase, t))
        left[pick] -= 1
        used[pick] += 1
        t += 1
        if not left[pick]:
            base, t0, phase = Counter(used), t, phase + 1
    return out


@pytest.mark.parametrize("block_rows", [1, 3])
def test_mix_equals_slot_by_slot(spark, block_rows):
    sources = ["a"] * 41 + ["b"] * 17 + [None, "zz", "zz", "c"]
    docs = documents(spark, ["t"] * len(sources), sources=sources)
    weights = {"a": 5, "b": 2, "c": 1}
    rows = mixing.mix(docs, weights, other_weight=3, block_rows=block_rows).collect()
    sizes = Counter(s if s in weights else mixing.OTHER for s in sources)
    want = schedule(sizes, weights | {mixing.OTHER: 3}, block_rows)
    assert sorted({(r.stream, r.block, r.phase, r.slot) for r in rows}) == sorted(want)
    assert sorted(r.position for r in rows) == list(range(len(sources)))
    assert sorted(r.doc_id for r in rows) == list(range(len(sources)))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    by_place = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in by_place] == sorted(r.slot for r in rows)


def test_every_prefix_is_within_one_block(spark):
    weights = {"a": 7, "b": 3, "c": 2}
    docs = documents(spark, ["t"] * 1200, sources=["a"] * 700 + ["b"] * 300 + ["c"] * 200)
    rows = mixing.mix(docs, weights, block_rows=1).orderBy("slot").collect()
    placed = Counter()
    for t, row in enumerate(rows, 1):
        placed[row.stream] += 1
        if row.phase == 0:
            assert all(abs(placed[s] - w * t / 12) < 1 for s, w in weights.items())


def test_empty_repeated_and_null_ids(spark):
    assert mixing.mix(documents(spark, []), {"a": 1}).collect() == []
    docs = documents(spark, ["t"] * 6, sources=["a"] * 6, ids=[None, 1, 1, 1, None, 2])
    rows = mixing.mix(docs, {"a": 2}, block_rows=2).collect()
    assert sorted(r.position for r in rows) == list(range(6))


def test_plan_has_no_python(spark):
    plan = mixing.mix(documents(spark, ["t"]), {"a": 1})._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "ArrowEval", "MapIn"))
