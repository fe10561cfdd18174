import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import LONG, Roots, documents, edited, prose
from pyspark.sql import functions as F

from tilepyramid.llm import ngram_join
from tilepyramid.llm.common import BATCH_BYTES, small_batches
from tilepyramid.llm.components import components
from tilepyramid.llm.textbytes import slices


def shingles(text, width):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    roots = Roots()
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                roots.join(a, b)
    return {(k, len(s), roots.root(k)) for k, s in enumerate(sets)}


def corpus():
    texts = [None, "", " \n\t ", "One", "one", "ONE two", "one two", "éa É", "a b c d", "A b c d"]
    for k in range(12):
        base = prose(k, 20 + 17 * k)
        texts += [base, base, base.upper(), *[edited(base, s, 1 + s % 5) for s in range(9)]]
    # a passage that many documents share
    passage = prose(99, 60)
    texts += [f"{passage} {prose(200 + k, 30 + k)}" for k in range(30)]
    # a chain: neighbours link, ends do not
    words = prose(77, 300).split()
    texts += [" ".join([*(f"c{j}" for j in range(6 * k)), *words[6 * k:]]) for k in range(12)]
    return texts + [LONG, LONG + "end", prose(5, 3000), edited(prose(5, 3000), 1, 30)]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, width, percent):
    texts = corpus()
    got = ngram_join.joined(documents(spark, texts), width, percent).collect()
    assert {tuple(r) for r in got} == brute(texts, width, percent)
    assert len(got) == len(texts)


def test_allocation_exceeds_the_difference_and_follows_cost():
    for most in range(200):
        m, twos, spare = ngram_join.allocation(most, max(1, most * 5))
        assert twos <= m and m + twos == most + 1 + spare and not (spare and twos)
    assert ngram_join.allocation(1, 8)[1] == 1  # two small segments cost more than one large
    assert ngram_join.allocation(90, 500)[1] == 0 < ngram_join.allocation(90, 500)[2]


def test_groups_meet_for_all_sizes_that_can_link():
    for a in range(1, 400):
        for b in range(a, 100 * a // 80 + 1):
            mine = {g: most for g, _, most in ngram_join.groups_of(a, 80)}
            other = {g for g, _, _ in ngram_join.groups_of(b, 80)}
            assert any(mine[g] >= (a + b) * 20 // 180 for g in mine.keys() & other), (a, b)


def test_linked_sets_share_more_keys_than_are_spare():
    rng = np.random.default_rng(4)
    for n in (3, 8, 20, 60, 300, 2000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n * 15 // 200:], rng.integers(
            0, 2**64, n * 15 // 200, dtype=np.uint64)]))
        assert 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        shared = {}
        a, b = np.stack([a, a], axis=1), np.stack([b, b], axis=1)
        for k, p in set(zip(*map(tuple, ngram_join.signatures(a, 85)), strict=True)) & set(
                zip(*map(tuple, ngram_join.signatures(b, 85)), strict=True)):
            shared[int(p)] = shared.get(int(p), 0) + 1
        assert any(n > p % ngram_join.PART for p, n in shared.items())


def test_null_and_repeated_ids(spark):
    docs = documents(spark, ["a b c d e", "x", "x", "a b c d e", ""], ids=[None, 3, 3, 5, None])
    got = sorted(ngram_join.joined(docs).collect(), key=str)
    assert [tuple(r) for r in got] == sorted(
        [(None, 2, None), (None, 0, None), (3, 1, 3), (3, 1, 3), (5, 2, 5)], key=str)


def test_empty_table(spark):
    assert ngram_join.joined(documents(spark, [])).collect() == []


def test_stage_keeps_one_of_each_group(spark):
    base = prose(1, 80)
    docs = documents(spark, [base, base, edited(base, 1, 1), prose(2, 80), None, ""])
    kept = ngram_join.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    twice = ngram_join.one_of_each(spark, docs.union(docs), "")
    assert sorted(r.doc_id for r in twice.collect()) == [0, 3, 4, 5]


def test_components(spark):
    links = spark.createDataFrame([(5, 3), (3, 9), (9, 9), (20, 21), (7, None), (21, 22), (22, 4)],
                                  "a long, b long")
    got = {tuple(r) for r in components(links).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (4, 4), (20, 4), (21, 4), (22, 4)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}
    assert components(links.limit(0)).collect() == []


def test_blocks_of_dense_keys_change_nothing(spark, monkeypatch):
    texts = corpus()
    want = brute(texts, 4, 85)
    monkeypatch.setattr(ngram_join, "DENSE", 1)
    monkeypatch.setattr(ngram_join, "CHUNK", 5)
    got = ngram_join.joined(documents(spark, texts)).collect()
    assert {tuple(r) for r in got} == want


def test_shared_counts_over_slices(monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE", 7)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 30, 60, 90, 9)]
    got = ngram_join.shared_counts([np.stack([t, t % 7], axis=1) for t in sets], slice(0, 3),
                                   slice(3, 6))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:3]]


def test_ids_with_several_texts(spark):
    a, b, c = prose(31, 80), prose(32, 80), prose(33, 90)
    texts, ids = [a, a, b, edited(b, 1, 1), c, "", ""], [3, 5, 5, 9, 9, 5, 7]
    docs = documents(spark, texts, ids=ids)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect()}
    assert got == {3: (77, 3), 5: (77, 3), 9: (87, 3), 7: (0, 7)}
    only = documents(spark, [a, a, b, b], ids=[3, 5, 5, 9])
    rows = sorted(tuple(r) for r in ngram_join.joined(only).collect())
    assert rows == [(3, 77, 3), (5, 77, 3), (5, 77, 3), (9, 77, 3)]
    kept = ngram_join.one_of_each(spark, docs.union(docs), "")
    assert kept.columns == docs.columns
    assert sorted(r.n for r in kept.collect()) == [0, 2, 4, 5, 6]


def test_words_that_any_polynomial_confuses_are_told_apart(spark):
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.joined(
        documents(spark, [thue, other, f"{thue} {other} x y z", thue])).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (2, 2), 3: (1, 0)}


def test_shingles_that_agree_in_half_their_bits_are_told_apart():
    rows = np.array([[5, 1], [5, 2], [5, 2], [5, 1], [7, 1], [3, 9]], dtype=np.uint64)
    a = ngram_join.distinct(rows)
    assert a.tolist() == [[3, 9], [5, 1], [5, 2], [7, 1]]
    b = ngram_join.distinct(np.array([[5, 2], [5, 3], [7, 2], [3, 9]], dtype=np.uint64))
    assert ngram_join.shared(a, b) == ngram_join.shared(b, a) == 2
    counts = ngram_join.shared_counts([a, a[:0], b], slice(0, 2), slice(2, 3))
    assert counts.tolist() == [[2], [0]]


def test_a_passage_that_many_share_sends_each_text_a_few_times(spark, monkeypatch):
    """Texts that share most of their words, but do not link, are not sent once per chunk."""
    monkeypatch.setattr(ngram_join, "CHUNK", 16)
    monkeypatch.setattr(ngram_join, "DENSE", 8)
    sent = []
    real = ngram_join.with_texts
    monkeypatch.setattr(ngram_join, "with_texts", lambda rows, docs: sent.append(rows.count()) or real(
        rows, docs))
    passage = prose(1, 60, 10_000)
    rows = []
    for n in (150, 300):
        sent.clear()
        texts = [f"{passage} {prose(100 + k, 12, 10_000)}" for k in range(n)]
        # some that do link
        texts[5] = edited(texts[4], 3, 1)
        texts[n - 1] = edited(texts[7], 4, 1)
        got = ngram_join.joined(documents(spark, texts)).collect()
        assert {tuple(r) for r in got} == brute(texts, 4, 85)
        rows.append(sum(sent))
    assert rows[1] < 3 * rows[0]


@pytest.mark.parametrize("flush", [1 << 20, 300])
def test_keys_with_one_holder_are_dropped_on_the_way(spark, monkeypatch, flush):
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    monkeypatch.setattr(ngram_join, "PER_BUCKET", 1)
    texts = corpus()
    docs = documents(spark, texts).selectExpr("doc_id AS doc", "text")
    rows = []
    for doc, tokens in enumerate(ngram_join.shingle_sets([(t or "").encode() for t in texts], 4)):
        rows.append((doc, doc, -1 - len(tokens)))
        if len(tokens):
            keys, parts = ngram_join.signatures(tokens, 85)
            rows += zip(keys.view(np.int64).tolist(), [doc] * len(keys), parts.tolist(), strict=True)
    held = Counter(key for key, _, part in rows if part >= 0)
    want = Counter(r for r in rows if r[2] < 0 or held[r[0]] > 1)
    got = Counter(tuple(r) for r in ngram_join.signed(docs, 4, 85).collect())
    assert got == want and sum(want.values()) < len(rows)


def test_a_key_of_many_holders_sends_two_to_its_bucket():
    held = [ngram_join._rows(doc, np.arange(8, dtype=np.uint64).reshape(4, 2), 85)
            for doc in range(50)]
    batch = ngram_join.packed(held, 16)
    sent = {b: len(k) // 8 for b, k in zip(*(batch[c].to_pylist() for c in ("bucket", "key")),
                                           strict=True)}
    keys = len(held[0][0]) - 1
    assert sum(n for b, n in sent.items() if b >= 0) == 2 * keys
    assert sum(n for b, n in sent.items() if b < 0) == 50 * (keys + 1) - 2 * keys
    kept = [ngram_join.let_through(b, [tuple(batch[c][k].as_py() for c in ("key", "doc", "part"))])
            for k, b in enumerate(sent)]
    assert sum(k.num_rows for k in kept) == 50 * (keys + 1)


def test_python_tasks_get_small_batches(spark, monkeypatch):
    key, seen, store = "spark.sql.execution.arrow.maxBytesPerBatch", {}, ngram_join.stored

    def noted(df, name):
        seen.setdefault(name, set()).add(spark.conf.get(key))
        return store(df, name)

    texts = [f"{prose(1, 60)} {prose(k, 40)}" for k in range(40)] + [prose(1, 60)] * 2
    monkeypatch.setattr(ngram_join, "stored", noted)
    monkeypatch.setattr(ngram_join, "DENSE", 4)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    before = spark.conf.get(key)
    got = ngram_join.joined(documents(spark, texts)).collect()
    assert {tuple(r) for r in got} == brute(texts, 4, 85)
    small = {str(BATCH_BYTES)}
    assert seen["ngram-signed"] == seen["ngram-links"] == seen["ngram-shingles"] == small
    assert spark.conf.get(key) == before and spark.conf.get(key, None) is None


def test_small_batches_bound_what_a_task_gets(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])],
                                             names=["n", "size"])

    def batches():
        rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
        return rows.mapInArrow(run, "n long, size long").collect()

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with small_batches(spark):
        got = batches()
    assert sum(r.n for r in got) == 3000 and max(r["size"] for r in got) < 1.1 * BATCH_BYTES
    assert [r.n for r in batches()] == [3000]
    spark.conf.set(key, "32m")  # the session's own
    try:
        with small_batches(spark):
            assert spark.conf.get(key) == "32m"
        assert spark.conf.get(key) == "32m"
    finally:
        spark.conf.unset(key)


def test_batches_of_texts_are_worked_on_in_slices():
    texts = [None, "", "x" * 500, *["word " * k for k in range(60)]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(slices(batch, 1000))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == texts
    assert max(p.num_rows for p in parts) < 10
    assert [p.num_rows for p in slices(batch, 1)] == [1] * len(texts)
    assert list(slices(batch.slice(0, 0))) == []
