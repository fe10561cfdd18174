"""Importance resampling against a word-by-word count."""

import math
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from tests.llm.helpers import LONG, documents, prose
from tilepyramid.llm import resampling as r


def features(text):
    lowered = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def expected(rows, target):
    """{row number: (n_features, weight, score, rank)}."""
    def counts(texts):
        return Counter(crc32(f.encode()) % 10000 for t in texts for f in features(t)[1])

    s, t = counts(x for _, x in rows), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    found, scored = {}, []
    for k, (doc_id, text) in enumerate(rows):
        words, runs = features(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000)
                                               / ((s[b] + 1) * (t_all + 10000))))
                    for b in (crc32(f.encode()) % 10000 for f in runs))
        weight = total // len(runs) if runs else 0
        h = int(sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found[k] = (len(runs), weight, score, None)
        if len(words) >= 20:
            scored.append((-score, (doc_id is not None, doc_id), k))
    scored.sort()
    for place, (_, _, k) in enumerate(scored[:25 * len(scored) // 100]):
        found[k] = (*found[k][:3], place + 1)
    return found


TEXTS = [prose(k, 15 + k % 30) for k in range(60)] + [
    None, "", "...", "Ä Straße 1st 2ND", "one", LONG, "x" * 5000,
    *["same words again and again " * 5] * 3]
TARGET = [prose(3, 50), prose(90, 40), None]


@pytest.mark.parametrize("piece", [r.PIECE, 7])
def test_agrees_with_counting(spark, monkeypatch, piece):
    monkeypatch.setattr(r, "PIECE", piece)
    ids = [None if k % 17 == 5 else k for k in range(len(TEXTS))]
    docs = documents(spark, TEXTS, ids=ids)
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, weight long")
    want = expected(list(zip(ids, TEXTS)), TARGET)
    got = r.resample(docs, target).collect()
    assert sorted((x.doc_id or -1, x.n_features, x.weight, x.score, x.rank or 0) for x in got) == \
        sorted((i or -1, *want[k][:3], want[k][3] or 0) for k, i in enumerate(ids))


def test_bit_planes_are_exact():
    rng = np.random.default_rng(1)
    gains = rng.integers(-9000, 9000, r.BUCKETS)
    planes, worth = r.signed_planes(gains)
    for top in (2, 1000, 1 << 33):
        counts = rng.integers(0, top, r.BUCKETS)
        assert r.summed_gain(counts, planes, worth) == int((counts * gains).sum())
    assert r.summed_gain(np.zeros(r.BUCKETS, dtype=int), planes, worth) == 0


def test_empty_tables(spark):
    docs = documents(spark, ["a b c " * 10])
    target = spark.createDataFrame([], "text string")
    assert r.resample(docs.limit(0), target).count() == 0
    assert r.resample(docs, target).count() == 1


def test_many_equal_scores_rank_without_gaps(spark):
    docs = documents(spark, ["w " * 25] * 40, ids=[None] * 40)
    got = r.resample(docs, docs).collect()
    assert sorted(x.rank for x in got if x.rank) == list(range(1, 11))
    assert len({x.score for x in got}) == 1
