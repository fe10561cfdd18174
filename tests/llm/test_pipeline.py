"""The whole pipeline, stage by stage, and the registered SQL at the smallest scale."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from helpers import prose

import corpus_pipeline
from tilepyramid.llm import registry
from tilepyramid.llm.common import scratch, shared_dir, stored, with_totals
from tilepyramid.llm.decontamination import leaks
from tilepyramid.llm.mixing import mixed
from tilepyramid.llm.ngram_join import joined
from tilepyramid.llm.sharding import sharded

DATA = "/root/testdata/sf0.001"


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if name in ("mixing", "sharding", "language_id"):
            assert set(ids) == before  # no document there is without letters
        if name == "ngram_join":
            assert 0 < len(before) - len(ids) < 40
            assert joined(docs, 5, 80).filter("doc_id <> component_id").isEmpty()
        if name == "decontamination":
            items = spark.read.parquet(f"{DATA}/benchmark.parquet")
            assert leaks(docs, items).isEmpty() and len(ids) < len(before)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        before = set(ids)
    assert {"shard", "slot"} <= set(docs.columns)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(before)


def test_totals_of_groups_and_their_folder(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("a", 5), ("b", 2), (None, 3), (None, 4)],
                                 "k string, v long")
    with scratch(spark) as folder:
        got = with_totals(rows, ["k"], [F.max("v").alias("top"), F.count("v").alias("n")], "n > 1")
        with scratch(spark) as inner:
            assert stored(rows, "rows").count() == 6
        assert sorted(map(tuple, got.collect())) == [("a", 1, 5, 3), ("a", 5, 5, 3), ("a", 5, 5, 3)]
        shown = got._jdf.queryExecution().toString()
        assert "Window" not in shown
    base = Path(shared_dir(spark).removeprefix("file:"))
    assert base.exists()
    assert not [f for f in (folder, inner) if Path(f.removeprefix("file:")).exists()]


def test_pipeline_leaves_its_stages_only(spark):
    base = Path(shared_dir(spark).removeprefix("file:"))
    before = set(base.iterdir())
    corpus_pipeline.run(spark, DATA).count()
    new = [p.name for p in set(base.iterdir()) - before]
    assert len(new) == 1 and new[0].startswith("pipeline-")


CLASHING = ["lang_pred", "score", "ambiguous", "row", "stream", "block", "slot", "phase", "release",
            "deadline", "position"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    texts = [prose(k, 60) for k in range(60)] + [None, "", "one", prose(1, 60)]
    rows = [(k, t, "en", f"s{k % 3}", 1, *[f"mine{k}"] * len(CLASHING)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                 "n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept = docs.collect()
        assert docs.columns[-len(CLASHING):] == CLASHING and len(kept) >= 58
        assert all(r[c] == f"mine{r.doc_id}" for r in kept for c in CLASHING)


def test_stages_and_pipeline_on_null_repeated_and_no_rows(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    texts = [prose(3, 40), prose(3, 40), None, "", prose(4, 40)]
    rows = [(1, texts[0], "en", None, 9), (1, texts[1], "en", None, 9), (None, texts[4], None, "a", 1),
            (None, texts[4], None, "a", 1), (2, None, "en", "a", None), (3, "", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (mixed, sharded):
        got = stage(spark, docs, DATA).select(*docs.columns).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, docs.collect()))
        assert stage(spark, docs.limit(0), DATA).count() == 0
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(
            f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    rows = {tuple(r) for r in want.fetchall()}
    got = {tuple(r[n] for n in names) for r in registry.queries()[name](spark, DATA).collect()}
    assert got == rows
