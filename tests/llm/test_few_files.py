"""What an executor holds or starts besides its rows: files, Python workers, features of short texts."""

from pathlib import Path

import pytest
from helpers import documents, edited, prose

from tilepyramid.llm import language_id, ngram_join
from tilepyramid.llm.common import gathered, scratch, small_table, stored


def parts(folder: str) -> dict[str, int]:
    """Files of each stored table."""
    tables = Path(folder.removeprefix("file:")).iterdir()
    return {t.name[len("llm-"):-33]: len(list(t.glob("part-*"))) for t in tables}


def test_few_rows_go_to_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1_000, 1, 50)
    with scratch(spark):
        few = stored(gathered(rows, 1_000), "few")
        assert len(few.inputFiles()) <= cores and few.count() == few.distinct().count() == 1_000
        # as many as the rows take, and never more than there were
        assert len(stored(gathered(rows, 1_000, 50), "some").inputFiles()) == 20
        assert len(stored(gathered(rows, 1_000, 1), "all").inputFiles()) == 50


@pytest.fixture
def many_partitions(spark):
    """Shuffles of more partitions than rows need, which are not merged."""
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_the_files_of_the_ngram_join_go_with_its_rows(spark, many_partitions, monkeypatch):
    texts = [prose(k, 30) for k in range(120)]
    texts += [edited(texts[k % 20], 1, k) for k in range(120)]
    docs = documents(spark, texts)
    made = []
    real = ngram_join.text_copies
    monkeypatch.setattr(ngram_join, "text_copies", lambda docs: made.append(1) or real(docs))
    with scratch(spark) as folder:
        kept = ngram_join.one_of_each(spark, docs, "")
        assert 100 <= kept.count() < 240
        files = parts(folder)
    assert len(made) == 1  # texts are told apart once
    cores = spark.sparkContext.defaultParallelism
    assert len(files) > 10
    # the packed keys are not counted before they are stored
    assert {k: n for k, n in files.items() if n > cores and k != "ngram-signed"} == {}


def test_rows_of_the_driver_need_no_python_worker(spark):
    rows = [("a", 1, b"x"), (None, None, None), ("b", 2**40, b"")]
    schema = "name string, number long, raw binary"
    small, plain = small_table(spark, rows, schema), spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in small.collect()] == [tuple(r) for r in plain.collect()]
    assert small.schema == plain.schema
    assert small_table(spark, [], schema).schema == plain.schema and small_table(spark, [], schema).isEmpty()
    lineage = [df._jdf.queryExecution().toRdd().toDebugString() for df in (small, plain)]
    assert ["PythonRDD" in x for x in lineage] == [False, True]


def test_features_of_short_texts_are_held_a_few_at_a_time(monkeypatch):
    langs = ["en", "de"] * 40
    model = language_id.fit([f"{lang} {prose(k, 30)}" for k, lang in enumerate(langs)], langs)
    texts = [prose(k, 3) if k % 7 else None for k in range(1_000)]
    held = []
    real = language_id.features
    monkeypatch.setattr(language_id, "features", lambda raws: held.append(len(raws)) or real(raws))
    few = language_id.predict(model, texts)
    assert sum(held) == 1_000 and max(held) <= language_id.CHUNK_TEXTS
    monkeypatch.setattr(language_id, "CHUNK_TEXTS", 1_000)
    whole = language_id.predict(model, texts)
    assert few[0] == whole[0] and few[2] == whole[2] and few[1] == pytest.approx(whole[1], abs=1e-6)
