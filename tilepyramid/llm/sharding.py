"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly; equal texts together.

A group is all rows of one text; its vector is (bytes, tokens, rows). Each vector is scaled by the
total, so a shard's capacity is 1/shards in each dimension. Items, the largest first, go to the
shard whose residual capacity has the highest dot product with the item's vector; shards that
would overflow come only after those that would not.

To stay small at any size, the packer sees items and not groups: a group of at least
1/(``LARGE`` * shards) of the total in some dimension is an item of its own (at most 3 * LARGE *
shards of them), and all other groups are hashed by text into ``BUNDLES`` items. A group of more
than half a shard in some dimension is cut into pieces of at most about half a shard, by the place of
a row among the group's ids, since whole it would break the balance. The packer is a loop over this bounded table on the
driver; documents never go there.

Law: ``bytes`` (sizes near equal); the size is the text's UTF-8 bytes plus 8.

Defined results: a null text has size 8, CRC-32 0 and no tokens, and its own group (not that of the
empty text); null ids are allowed; repeated rows are rows like any other; an empty table gives an
empty result. Other columns pass through (those named as an added one are replaced).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid.llm.common import gathered, id_key, ranked, read, small_table, stored

SHARDS = 24
LARGE = 32
BUNDLES = 4096
OVERHEAD = 8
DIMENSIONS = ("size", "tokens", "rows")
ADDED = ("size", "tokens", "text_crc32", "shard", "slot")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with size, tokens, CRC-32 and the key of the group of equal texts."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    return docs.withColumns({
        "size": (F.octet_length(raw) + OVERHEAD).cast("long"),
        "tokens": F.when(F.col(text).isNull(), 0).otherwise(words).cast("long"),
        "text_crc32": F.crc32(raw),
        "_group": F.coalesce(F.unhex(F.sha2(F.col(text).cast("binary"), 256)),
                             F.lit(b"").cast("binary")),
    })


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; ``vectors`` are shares of the total, one row per item."""
    residual = np.full((shards, vectors.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(vectors), dtype=int)
    for item in np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1, initial=0))):
        vector = vectors[item]
        fits = (residual >= vector - 1e-12).all(axis=1)
        # in an overfull shard the residual is negative and so is its part of the product
        score = residual @ vector
        pick = np.lexsort((np.arange(shards), -score, ~fits))[0]
        chosen[item] = pick
        residual[pick] -= vector
    return chosen


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id",
           order: tuple[Column, Column] | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with size, tokens, text_crc32, shard and slot; without the text if so asked.

    Slots count from 0 in each shard, in a mixed order of the ids, or by ``order``: a part and
    the key within it, as :func:`ranked` takes them. Texts are measured in one scan, which is
    stored without them; with the text asked for, a second scan carries it to its shard.
    """
    part, key = order or (None, id_key(F.col(doc_id)))
    kept = [c for c in docs.columns if c not in ADDED]
    rows = measured(docs.select(*kept, key.alias("_key"), *(
        [part.alias("_by")] if order else [])), text)
    lean = stored(rows.drop(*[c for c in kept if c != doc_id and (keep_text or c == text)]),
                  "measured")
    groups = stored(gathered(lean.groupBy("_group").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"),
        F.count(F.lit(1)).alias("rows")), lean.count()), "text-groups")
    totals = groups.agg(*[F.sum(d) for d in DIMENSIONS]).first()
    total = [float(max(x or 0, 1)) for x in totals]
    share = F.greatest(*[F.col(d) / F.lit(t) for d, t in zip(DIMENSIONS, total, strict=True)])
    large = (groups.filter(share >= 1.0 / (LARGE * shards))
             .select("_group", F.ceil(share * 2 * shards).cast("int").alias("_pieces")))
    known = small_table(
        docs.sparkSession, large.collect(), "_group binary, _pieces int")  # 3 * LARGE * shards rows at most

    def with_item(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(known), "_group", "left")
        small = joined.filter(F.col("_pieces").isNull()).withColumn(
            "_item", F.concat(F.lit("b"), F.pmod(F.xxhash64("_group"), F.lit(BUNDLES))))
        if known.isEmpty():
            return small
        # rows equal in group and id are alike to the packer, so their order does not matter
        whole = joined.filter(F.col("_pieces").isNotNull()).withColumns(
            {"_name": F.hex("_group"), "_id": id_key(F.col(doc_id))})
        cut = ranked(whole, ["_name"], "_id", [F.col(doc_id)], "_rank", int(totals[2] or 0))
        piece = (F.col("_rank") % F.col("_pieces")).cast("string")
        return small.unionByName(cut.withColumn("_item", F.concat_ws("/", "_name", piece)).drop(
            "_name", "_id", "_rank"))

    items = (with_item(lean).groupBy("_item")
             .agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1)))
             .orderBy("_item").collect())  # BUNDLES and the pieces of the large groups at most
    vectors = np.array([[r[k + 1] / total[k] for k in range(3)] for r in items]).reshape(-1, 3)
    where = [(r[0], int(s)) for r, s in zip(items, pack(vectors, shards), strict=True)]
    target = small_table(docs.sparkSession, where, "_item string, shard int")
    placed = (with_item(rows if keep_text else lean).join(F.broadcast(target), "_item")
              .drop("_group", "_pieces", "_item"))
    return ranked(placed, ["shard"], "_key", [F.col(doc_id), F.col("text_crc32")], "slot",
                  int(totals[2] or 0), F.col("_by") if order else None).drop("_key", "_by")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return assign(docs, keep_text=False).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: all documents with their shard and their slot in it.

    The slots of a shard keep the order in which the stage before wrote the rows, which is the
    mix: each shard is a sample of it in its order. Rows that come from no file have no such order
    and get that of the ids.
    """
    if not docs.inputFiles():
        return assign(docs)
    row = F.lpad(F.hex(F.col("_metadata.row_index")), 16, "0")
    return assign(docs, order=(F.col("_metadata.file_name"), row))
