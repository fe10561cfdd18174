"""Language ID and quality classifier: held-out accuracy and the awkward cases."""

import zlib

import numpy as np
import pytest
from helpers import LONG, documents

from tilepyramid.llm import cotraining, language_id

DATA = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = [r for r in language_id.op7_language_id(spark, DATA).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows) and len(rows) > 200
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    docs = documents(spark, ["der die und das nicht", "the and of that with", "", None, "123 !?",
                             "der die ist und", "the of is and that", LONG, "und die", "é"],
                     langs=["de", "en", "en", "de", "en", "de", "en", None, None, None],
                     ids=[0, 1, 3, 4, 6, 7, 8, 9, 10, None])
    model = language_id.train(docs)
    assert model.languages == ("de", "en")
    rows = language_id.identify(docs, model).collect()
    told = {r.doc_id: r.lang_pred for r in rows}
    assert len(rows) == 10 and rows[0].slot == "x"
    assert [told[k] for k in (3, 4, 6)] == ["und"] * 3
    assert told[0] == "de" and told[1] == "en" and told[10] == "de"
    kept = language_id.known_language(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == 7


def test_no_language_and_one_language(spark):
    docs = documents(spark, ["a b", None], langs=[None, None])
    assert [r.lang_pred for r in language_id.identify(docs, language_id.train(docs)).collect()] == [
        "und", "und"]
    docs = documents(spark, ["a b", ""], langs=["en", "en"])
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("en", 1.0), ("und", 0.0)]
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.train(empty)).collect() == []


@pytest.mark.parametrize("n", [2, 4, 5, 6, 30])
def test_codewords_are_apart_and_no_bit_is_constant(n):
    code = language_id.codewords(n)
    assert len({tuple(c) for c in code}) == n
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_one_wrong_bit_is_corrected():
    code = language_id.codewords(5)
    model = language_id.Model(tuple("abcde"), code, np.eye(code.shape[1]), np.ones(code.shape[1]))
    for k in range(5):
        for bit in range(code.shape[1]):
            margin = 3 * code[k].copy()
            margin[bit] *= -1
            assert language_id.decode(model, margin[None, :])[0][0] == k


def test_quality_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = cotraining.train(docs, labels.filter("doc_id % 2 = 0"))
    truth = {r.doc_id: r.quality for r in labels.filter("doc_id % 2 = 1").collect()}
    rows = [r for r in cotraining.score(docs, model).collect() if r.doc_id in truth]
    right = np.mean([r.quality == truth[r.doc_id] for r in rows])
    assert len(rows) > 100 and right > 0.93
    good = [r.score for r in rows if truth[r.doc_id]]
    bad = [r.score for r in rows if not truth[r.doc_id]]
    assert np.mean(good) > np.mean(bad) + 0.5


def test_features_do_not_depend_on_the_texts_around():
    raws = [b"the cat", b"", b"a", "h\u00e9 \u0e01".encode(), b"zz zz", b"\n\n"]
    for features in (cotraining.text_view, language_id.features):
        together = features(raws)
        for k, raw in enumerate(raws):
            assert np.array_equal(together[k], features([raw])[0])


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = (rng.random(900) < 0.5).astype(float)
    views = [np.hstack([rng.normal(size=(900, 3)) + (2 * y[:, None] - 1), np.ones((900, 1))]).astype(
        np.float32) for _ in range(2)]
    lab = np.arange(900) < 30
    fitted = cotraining.cotrain(tuple(v[lab] for v in views), y[lab], np.arange(30) % 3 == 0,
                                tuple(v[(~lab) & (np.arange(900) < 600)] for v in views))
    rest = np.arange(900) >= 600
    odds = sum(f.log_odds(v[rest]) for f, v in zip(fitted, views, strict=True))
    assert np.mean((odds > 0) == (y[rest] > 0.5)) > 0.95


def _mixed_docs(spark, n=400):
    rng = np.random.default_rng(5)
    words = [["river", "stone", "quiet", "evening", "garden"], ["buy", "CLICK", "$$$", "now!!", "win"]]
    bad = rng.random(n) < 0.4
    texts = [" ".join(rng.choice(words[int(b)], rng.integers(5, 60))) for b in bad]
    sources = [("shop" if b else "book") if rng.random() < 0.9 else "mail" for b in bad]
    return documents(spark, texts, langs=["en"] * n, sources=sources, ids=list(range(n))), bad


def test_all_unlabelled_rows_are_labelled_in_each_round(spark):
    docs, bad = _mixed_docs(spark)
    rows = docs.orderBy("doc_id").collect()
    known = [r for r in rows if r.doc_id < 60]
    free = [r for r in rows if r.doc_id >= 60]
    y = (~bad[:60]).astype(float)
    views = cotraining._both(known)
    teachers = tuple(cotraining.calibrated(cotraining.logistic(v, y), v, y) for v in views)
    got = cotraining.sums_of(docs.filter("doc_id >= 60").repartition(7), teachers)
    both = cotraining._both(free)
    want = {}  # row by row
    for k in (0, 1):
        for row in range(len(free)):
            odds = float(teachers[k].log_odds(both[k][row:row + 1])[0])
            if abs(odds) < np.log(9):
                continue
            x = both[1 - k][row]
            band = min(int((abs(odds) - np.log(9)) / cotraining.BAND_WIDTH), cotraining.BANDS - 1)
            side = x @ cotraining._planes(len(x)) > 0
            key = (k, int(odds > 0), band, int(side[0]) + 2 * int(side[1]))
            n, total = want.get(key, (0, 0))
            want[key] = (n + 1, total + np.rint(x * 65536).astype(np.int64))
    assert sum(n for n, _ in want.values()) > len(free)
    assert got.keys() == want.keys()
    for key, (n, total) in want.items():
        assert got[key][0] == n and (got[key][1] == total).all()
    # the whole fit, with the unlabelled rows in memory, gives the same model
    labels = spark.createDataFrame([(k, int(not bad[k])) for k in range(60)], "doc_id long, quality int")
    model = cotraining.train(docs, labels)
    order = sorted(range(60), key=lambda k: zlib.crc32(str(k).encode()))
    check = np.arange(60) % 3 == 0
    alone = cotraining.cotrain(tuple(v[order] for v in views), y[order], check, both)
    for view, other in zip((model.text, model.meta), alone, strict=True):
        assert np.allclose(view.weights, other.weights, rtol=1e-4, atol=1e-4)
        assert np.isclose(view.slope, other.slope, rtol=1e-3)


def test_bands_pass_from_the_surest_down_until_enough_rows():
    one = np.array([65536])
    sums = {(0, 1, 11, 0): (2, 2 * one), (0, 1, 11, 3): (1, 3 * one), (0, 1, 4, 1): (4, 4 * one),
            (0, 1, 0, 0): (9, 9 * one), (1, 1, 11, 0): (7, one), (0, 0, 11, 0): (7, one)}
    assert [(n, x[0]) for n, x in cotraining.passed(sums, 0, 1, 3)] == [(2, 1.0), (1, 3.0)]
    assert [n for n, _ in cotraining.passed(sums, 0, 1, 3.5)] == [2, 1, 4]
    assert cotraining.passed(sums, 0, 1, 0) == []


def test_many_labels_take_all_rows_or_leave_some(spark, monkeypatch):
    docs, bad = _mixed_docs(spark, 200)
    labels = spark.createDataFrame([(k, int(not bad[k])) for k in range(200)], "doc_id long, quality int")
    told = [r.quality for r in cotraining.score(docs, cotraining.train(docs, labels)).orderBy(
        "doc_id").collect()]
    assert np.mean(np.array(told) == ~bad) > 0.95  # nothing unlabelled
    monkeypatch.setattr(cotraining, "BROADCAST_IDS", 0)
    clash = docs.withColumnsRenamed({"slot": "_id"}) if "slot" in docs.columns else docs
    model = cotraining.train(clash, labels.filter("doc_id < 150"))
    assert cotraining.score(clash, model).count() == 200


def test_quality_cases(spark):
    docs = documents(spark, [None, "", LONG, "a"], langs=[None] * 4, sources=[None, "s", "s", "s"],
                     ids=[0, None, 2, 2])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in cotraining.score(docs, cotraining.train(docs, none)).collect()] == [0.5] * 4
    ones = spark.createDataFrame([(0, 1), (2, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert {r.score for r in cotraining.score(docs, cotraining.train(docs, ones)).collect()} == {1.0}
    both = spark.createDataFrame([(0, 1), (2, 0), (2, 1), (7, 0)], "doc_id long, quality int")
    rows = cotraining.score(docs, cotraining.train(docs, both)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert cotraining.score(docs.limit(0), cotraining.train(docs.limit(0), both)).collect() == []


def test_stage_rejects_texts_of_no_learned_language(spark):
    rng = np.random.default_rng(3)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang")

    def alien(letters):
        return " ".join("".join(rng.choice(list(letters), rng.integers(3, 9))) for _ in range(120))

    odd = [alien("абвгдежзиклмнопрстуфхцчшщыэюя") for _ in range(10)]
    odd += [alien("abcdefghijklmnopqrstuvwxyz") for _ in range(10)]
    docs = real.union(spark.createDataFrame(
        [(-1 - k, text, None) for k, text in enumerate(odd)], real.schema))
    kept = {r.doc_id for r in language_id.known_language(spark, docs, "").collect()}
    assert kept == {r.doc_id for r in real.collect()}


def test_numerals_that_are_no_letters_are_undetermined(spark):
    model = language_id.fit(["the cat and the dog", "der hund und die katze"] * 20, ["en", "de"] * 20)
    langs, scores, _ = language_id.predict(model, ["\u00bd \u2460", "\u2167", "12 _", "\u00aa", "\u0e01"])
    assert langs[:3] == ["und"] * 3 and scores[:3] == [0.0] * 3
    assert "und" not in langs[3:]
