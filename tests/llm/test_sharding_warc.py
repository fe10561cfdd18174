import hashlib
import zlib
from collections import defaultdict

import numpy as np
from helpers import LONG, documents, prose
from pyspark.sql import functions as F

from tilepyramid.llm import sharding, warc


def check_shards(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert len(rows) == len(texts)


def test_shards_balance_and_keep_equal_texts_together(spark):
    texts = [prose(k, 5 + k * 37 % 90) for k in range(900)] + [prose(k, 30) for k in range(40)] * 3
    rows = sharding.assign(documents(spark, texts), shards=6).collect()
    check_shards(rows, texts, 6)
    where = defaultdict(set)
    size = np.zeros((6, 3))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.tokens) == (len(raw) + 8, zlib.crc32(raw), len(raw.split()))
        where[raw].add(r.shard)
        size[r.shard] += [r.size, r.tokens, 1]
    assert all(len(s) == 1 for s in where.values())
    assert (size.max(0) / size.min(0) < 1.02).all()


def test_a_group_with_a_third_of_all_rows_is_split(spark):
    texts = [prose(0, 40)] * 400 + [prose(k, 40) for k in range(1, 801)]
    rows = sharding.assign(documents(spark, texts), shards=8).collect()
    check_shards(rows, texts, 8)
    counts = np.bincount([r.shard for r in rows], minlength=8)
    assert counts.max() / counts.min() < 1.15


def test_a_hot_group_without_ids_is_split_too(spark):
    for hot in (None, 7):
        texts = [prose(0, 40)] * 400 + [prose(k, 40) for k in range(1, 801)]
        ids = [hot] * 400 + [1000 + k for k in range(800)]
        rows = sharding.assign(documents(spark, texts, ids=ids), shards=8).collect()
        check_shards(rows, texts, 8)
        size = np.bincount([r.shard for r in rows], [r.size for r in rows], minlength=8)
        assert size.max() / size.min() < 1.1


def test_shard_cases(spark):
    texts = [None, "", " \n ", LONG, "a", "a", "é"]
    rows = sharding.assign(documents(spark, texts, ids=[None, 1, 2, 3, 4, 4, None]), shards=3).collect()
    check_shards(rows, texts, 3)
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 8 for t in texts)
    assert sharding.assign(documents(spark, []), shards=3).collect() == []


def test_last_stage_keeps_the_order_of_the_files(spark, tmp_path):
    docs = documents(spark, [prose(k, 9) for k in range(300)]).orderBy(F.xxhash64("doc_id"))
    docs.repartitionByRange(5, F.xxhash64("doc_id")).sortWithinPartitions(
        F.xxhash64("doc_id")).write.parquet(f"{tmp_path}/d")
    rows = sharding.sharded(spark, spark.read.parquet(f"{tmp_path}/d"), "").withColumn(
        "h", F.xxhash64("doc_id")).orderBy("shard", "slot").collect()
    assert len(rows) == 300
    assert all(a.h < b.h for a, b in zip(rows, rows[1:], strict=False) if a.shard == b.shard)


def test_pack_fills_the_emptiest_by_dot_product():
    rng = np.random.default_rng(2)
    v = rng.random((500, 3))
    chosen = sharding.pack(v / v.sum(0), 5)
    load = np.stack([np.bincount(chosen, v[:, d], minlength=5) for d in range(3)])
    assert (load.max(1) / load.min(1) < 1.02).all()
    assert sharding.pack(np.zeros((0, 3)), 4).tolist() == []


def leaves(spark, hashes):
    return spark.createDataFrame(
        [(f, n, n * 10, n * 10 + 10, h) for f, n, h in hashes],
        "file long, record_no long, start long, end long, hash string")


def test_audit_finds_corrupt_missing_and_surplus_records(spark):
    good = [(f, n, hashlib.sha256(f"{f}/{n}".encode()).hexdigest()) for f in range(3) for n in range(700)]
    bad = [(f, n, "0" * 64 if (f, n) in {(0, 5), (2, 300), (2, 301)} else h) for f, n, h in good
           if (f, n) != (0, 699)] + [(1, 700, "1" * 64)]
    a, b = warc.tree(leaves(spark, good)), warc.tree(leaves(spark, bad))
    got = {(r.file, r.node, r.a_hash is None, r.b_hash is None) for r in warc.differing(a, b).collect()}
    assert got == {(0, 5, False, False), (2, 300, False, False), (2, 301, False, False),
                   (0, 699, False, True), (1, 700, True, False)}
    assert warc.differing(a, a).collect() == []
    assert warc.differing(a, warc.tree(leaves(spark, []))).count() == 2100


def test_whole_records_at_other_offsets_are_found(spark):
    good = [(0, n, f"h{n}") for n in range(600)]
    moved = leaves(spark, good).withColumn("start", F.when(
        F.col("record_no") == 300, F.col("start") - 2).otherwise(F.col("start")))
    found = warc.differing(warc.tree(leaves(spark, good)), warc.tree(moved)).collect()
    assert [(r.file, r.node) for r in found] == [(0, 300)]


def test_long_and_clashing_pages(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000, 5, "f"), (2, "v", None, 6, "g")],
                                  "page_id long, url string, html string, start long, file string")
    rec = warc.record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = warc.manifest(pages, {"d": F.sha2(rec, 256)}, F.octet_length(rec)).collect()
    assert sorted(r.end - r.start for r in rows)[1] > 3_000_000 and {r.file for r in rows} == {0}


def test_records_are_laid_end_to_end(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>"), (None, None, None), (1, "u", "<p>é</p>"),
                                   (2, "v", "")], "page_id long, url string, html string")
    rec = warc.record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = warc.manifest(pages, {"d": F.sha2(rec, 256)}, F.octet_length(rec)).orderBy("start").collect()
    assert [r.start for r in rows] == [0, *[r.end for r in rows[:-1]]]
    want = pages.select(rec.alias("r")).collect()
    assert sorted(r.d for r in rows) == sorted(hashlib.sha256(w.r).hexdigest() for w in want)
    body = [w.r for w in want if b"\xc3\xa9" in w.r][0]
    assert b"Content-Length: 9\r\n\r\n<p>\xc3\xa9</p>\r\n\r\n" in body
    assert warc.manifest(pages.limit(0), {"d": F.sha2(rec, 256)}, F.octet_length(rec)).collect() == []
