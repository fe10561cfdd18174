"""The corpus pipeline: documents through five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tilepyramid.llm.common import read, scratch, shared_dir
from tilepyramid.llm.decontamination import clean
from tilepyramid.llm.language_id import known_language
from tilepyramid.llm.mixing import mixed
from tilepyramid.llm.ngram_join import one_of_each
from tilepyramid.llm.sharding import sharded

STAGES = [
    ("language_id", known_language),
    ("ngram_join", one_of_each),
    ("decontamination", clean),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: No SQL: language ID fits a classifier. tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from ``documents``; what each keeps is written as Parquet
    in the shared folder and is all that the next one reads. What a stage stores on its way is dropped
    when it is written."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
