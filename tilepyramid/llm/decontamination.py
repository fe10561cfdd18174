"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item leaks into a document if the document holds at least ``THRESHOLD`` of the item's distinct
word shingles (``WORDS`` words each; an item with fewer words is one shingle as it stands). A
signature of a whole document cannot tell this: an item may be a thousandth of it. So only the
items are sketched. Items are partitioned by size (powers of two); the sketch of an item is its
``k`` smallest shingle hashes (bottom-k MinHash), with ``k`` set for the partition's largest size
so that a document that misses all k must miss too many shingles: no leak can be lost. Documents
too short for a partition do not probe it. The shingles of all documents are hashed in one scan
and probe the sketches; the pairs found, a small part of the documents, are then counted exactly
on the shingles themselves.

The items are broadcast only while their counted sketches are few (``BROADCAST_HASHES``); beyond
that the same join shuffles. DataFrame and SQL functions only.

Words are maximal runs of letters and digits, lower-cased. Defined results: null and empty texts,
and items without words, match nothing; null ids are kept as such; repeated documents and items
each give their own rows (rows equal in id and text give one); documents may be of any length and
are read whole; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid.llm.common import gathered, read, stored

WORDS = 5
THRESHOLD = 0.8
BROADCAST_HASHES = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles_at(size: int, place: str = "i") -> list[Column]:
    return [F.expr(f"w[{place} + {k}]") for k in range(size)]


def item_shingles(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item_no, item_id, span, shingle, size): distinct shingles with the item's count of them.

    ``span`` is the number of words in a shingle, ``item_no`` tells repeated ids apart.
    """
    rows = (items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w"))
            .filter(F.size("w") > 0).distinct()
            .withColumn("item_no", F.xxhash64("item_id", "w"))
            .withColumn("span", F.least(F.size("w"), F.lit(width))))
    each = (rows.withColumn("i", F.explode(F.expr("sequence(0, size(w) - span)")))
            .select("item_no", "item_id", "span",
                    F.expr("array_join(slice(w, i + 1, span), ' ')").alias("shingle")).distinct())
    sizes = each.groupBy("item_no").agg(F.count(F.lit(1)).alias("size"))
    return each.join(sizes, "item_no")


def needed(size: Column, threshold: float) -> Column:
    """The least number of shingles that reaches the threshold, safe from rounding."""
    return F.ceil(F.round(size * F.lit(threshold), 9)).cast("int")


def sketches(shingles: DataFrame, threshold: float) -> DataFrame:
    """(span, hash, item_no, least_words): the bottom-k hashes of each item.

    k is set by the size partition: its largest size may miss ``size - needed`` shingles, so of
    ``size - needed + 1`` one must be there.
    """
    ceiling = F.expr("IF(size = 1, 1, shiftleft(1, length(bin(size - 1))))")
    k = ceiling - needed(ceiling, threshold) + 1
    # a smaller item of the partition may miss no more than a larger one
    floor = F.expr("IF(size = 1, 1, shiftleft(1, length(bin(size - 1)) - 1) + 1)")
    least = needed(floor, threshold)
    lists = shingles.groupBy("item_no", "span", "size").agg(
        F.array_sort(F.collect_list(shingle_hash(F.col("shingle")))).alias("hashes"))
    return lists.select("item_no", "span", (least + F.col("span") - 1).alias("least_words"),
                        F.explode(F.slice("hashes", F.lit(1), k)).alias("hash"))


def shingle_hash(shingle: Column) -> Column:
    return F.xxhash64(shingle)


def document_hashes(docs: DataFrame, doc_id: str, text: str, spans: list[int]) -> DataFrame:
    """(doc_id, n_words, span, hash) of every shingle place of every document.

    The hash is of the words and the spaces between them, as in :func:`item_shingles`.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    parts = []
    for span in spans:
        rows = base.filter(F.size("w") >= span).withColumn(
            "i", F.explode(F.expr(f"sequence(0, size(w) - {span})")))
        parts.append(rows.select("doc_id", F.size("w").alias("n_words"), F.lit(span).alias("span"),
                                 shingle_hash(F.concat_ws(" ", *_shingles_at(span))).alias("hash")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", width: int = WORDS,
          threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): every leak of an item into a document."""
    return leaking_texts(docs, items, F.xxhash64(text), doc_id, text, item_id, item_text, width,
                         threshold).drop("copy")


def leaking_texts(docs: DataFrame, items: DataFrame, copy: Column, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  width: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The leaks with ``copy``, which tells texts of the same id apart."""
    shingles = stored(item_shingles(items, item_id, item_text, width), "item-shingles")
    spans = sorted(r[0] for r in shingles.select("span").distinct().collect())  # <= width values
    spark = docs.sparkSession
    if not spans:
        return spark.createDataFrame([], f"doc_id {docs.schema[doc_id].dataType.simpleString()}, "
                                     f"item_id {items.schema[item_id].dataType.simpleString()}, "
                                     "n_shared long, n_item long, containment double") \
            .withColumn("copy", F.lit(None).cast("string"))
    sketch = stored(gathered(sketches(shingles, threshold), shingles.count()), "item-sketches")
    few = sketch.count() <= BROADCAST_HASHES
    probe = sketch.withColumnRenamed("span", "item_span")
    probe = F.broadcast(probe) if few else probe
    hashes = document_hashes(docs, doc_id, text, spans)
    found = hashes.join(probe, "hash").filter(
        (F.col("span") == F.col("item_span")) & (F.col("n_words") >= F.col("least_words")))
    pairs = stored(found.select("doc_id", "item_no").distinct(), "leak-candidates")

    suspects = pairs.select(F.col("doc_id").alias("_doc")).distinct()
    again = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                        copy.alias("copy")).join(
        F.broadcast(suspects) if suspects.count() <= BROADCAST_HASHES else suspects,
        F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    again = again.distinct().select(
        "doc_id", "copy", words(F.col("text")).alias("w"))
    held = None
    for span in spans:
        rows = (again.filter(F.size("w") >= span)
                .withColumn("i", F.explode(F.expr(f"sequence(0, size(w) - {span})")))
                .select("doc_id", "copy", F.lit(span).alias("span"),
                        F.concat_ws(" ", *_shingles_at(span)).alias("shingle")))
        held = rows if held is None else held.union(rows)
    items_side = shingles.withColumnRenamed("span", "item_span").withColumnRenamed(
        "shingle", "item_shingle")
    items_side = F.broadcast(items_side) if few and shingles.count() <= BROADCAST_HASHES \
        else items_side
    shared = (held.join(items_side, (F.col("shingle") == F.col("item_shingle"))
                        & (F.col("span") == F.col("item_span")))
              .select("doc_id", "copy", "item_no", "item_id", "size", "shingle").distinct()
              .groupBy("doc_id", "copy", "item_no", "item_id", "size")
              .agg(F.count(F.lit(1)).alias("n_shared")))
    shared = shared.join(pairs.withColumnsRenamed({"doc_id": "_doc", "item_no": "_item"}),
                         F.col("doc_id").eqNullSafe(F.col("_doc"))
                         & (F.col("item_no") == F.col("_item")), "left_semi")
    return (shared.filter(F.col("n_shared") >= needed(F.col("size"), threshold))
            .select("doc_id", "item_id", "n_shared", F.col("size").alias("n_item"),
                    (F.col("n_shared") / F.col("size")).alias("containment"), "copy"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents into which no benchmark item leaks; an id, or its lack, that clean and
    leaking texts share is no reason to go."""
    copy = F.sha2(F.col("text").cast("binary"), 256)
    found = leaking_texts(docs, read(spark, sf_dir, "benchmark"), copy).select(
        F.col("doc_id").alias("_bad"), F.col("copy").alias("_copy")).distinct()
    found = stored(gathered(found, docs.count()), "leaking-documents")
    found = F.broadcast(found) if found.count() <= BROADCAST_HASHES else found
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_bad")) & (copy == F.col("_copy")),
                     "left_anti")


OP4_SQL = rf"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'),
                             lambda x: x <> '') AS w FROM documents),
item AS (
  SELECT item_id, w, least(len(w), {WORDS}) AS span FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'),
                                lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
ish AS (
  SELECT DISTINCT item_id, span, array_to_string(w[i + 1:i + span], ' ') AS s
  FROM (SELECT *, unnest(range(len(w) - span + 1)) AS i FROM item)),
size AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id),
dsh AS (
  SELECT DISTINCT doc_id, span, array_to_string(w[i + 1:i + span], ' ') AS s
  FROM (SELECT doc_id, w, span, unnest(range(len(w) - span + 1)) AS i
        FROM doc, (SELECT DISTINCT span FROM item) WHERE len(w) >= span))
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
FROM dsh JOIN ish USING (span, s) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n_item
HAVING count(*) >= ceil(round({THRESHOLD} * n_item, 9))
"""
