import math
import re

from helpers import LONG, documents, edited, prose

from tilepyramid.llm import decontamination


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(texts, items):
    out = set()
    for i, item in enumerate(items):
        w = words(item)
        span = min(len(w), 5)
        if not w:
            continue
        mine = {tuple(w[k:k + span]) for k in range(len(w) - span + 1)}
        for d, text in enumerate(texts):
            v = words(text)
            held = len(mine & {tuple(v[k:k + span]) for k in range(len(v) - span + 1)})
            if held >= math.ceil(round(0.8 * len(mine), 9)):
                out.add((d, i, held, len(mine), held / len(mine)))
    return out


def items_of(spark, items):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(items)],
                                 "item_id long, text string, doc_id string, size long")


def test_leaks_equal_brute_force(spark):
    items = [prose(k, 1 + 3 * k, 5000) for k in range(20)] + ["", None, "one", "Two Words!", prose(3, 10, 5000)]
    texts = [None, "", "one", "two, words", LONG, prose(500, 4000)]
    for k, item in enumerate(items[:20]):
        for edits in (0, 1, 2):
            text = edited(item, k, edits)
            texts.append(f"{prose(k + 50, 100)}\n{text.upper()} - {prose(k + 90, 200)}")
    texts += [f"{LONG} {items[15]} {LONG}", items[6] + " " + items[6]]
    got = {tuple(r) for r in decontamination.leaks(documents(spark, texts), items_of(spark, items)).collect()}
    assert got == brute(texts, items)
    assert any(g[4] < 1 for g in got)


def test_no_bounded_side_gives_the_same(spark, monkeypatch):
    items, texts = [prose(k, 30) for k in range(4)], [prose(k % 5, 30) for k in range(9)]
    args = documents(spark, texts), items_of(spark, items)
    want = sorted(map(tuple, decontamination.leaks(*args).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_HASHES", -1)
    assert sorted(map(tuple, decontamination.leaks(*args).collect())) == want != []


def test_empty_tables_and_null_ids(spark):
    docs, items = documents(spark, [prose(1, 30)], ids=[None]), items_of(spark, [prose(1, 30)])
    assert [tuple(r)[:2] for r in decontamination.leaks(docs, items).collect()] == [(None, 0)]
    assert decontamination.leaks(docs, items_of(spark, ["", None])).collect() == []
    assert decontamination.leaks(docs.limit(0), items).collect() == []
    assert decontamination.leaks(docs, items.limit(0)).collect() == []


def test_stage_drops_leaking_documents_only(spark, tmp_path):
    items_of(spark, [prose(1, 30)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [prose(1, 30), prose(2, 30), None, f"a {prose(1, 30)} b"])
    kept = decontamination.clean(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_plan_has_no_python(spark):
    docs, items = documents(spark, [prose(1, 30)]), items_of(spark, [prose(1, 30)])
    plan = decontamination.leaks(docs, items)._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "ArrowEval", "MapIn"))


def test_stage_keeps_clean_texts_that_share_an_id(spark, tmp_path):
    items_of(spark, [prose(1, 30)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [prose(1, 30), prose(2, 30), None, f"a {prose(1, 30)} b", prose(3, 30), prose(4, 30)]
    docs = documents(spark, texts, ids=[None, None, None, 7, 7, 8])
    kept = decontamination.clean(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r.n for r in kept.collect())) == [1, 2, 4, 5]
