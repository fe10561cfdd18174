"""WARC fixity audit by Merkle trees.

Records are laid out in files of ``RECORDS_PER_FILE`` in a fixed mixed order, each at a byte offset.
A leaf is the SHA-256 of a record's offsets and of the SHA-256 of its bytes; a node is that of its own
offsets and of its ``FANOUT`` children's hashes with their places: a record that is whole but not where
it should be differs as well. A file has ``LEVELS`` levels
above its leaves, the last being the root. Two replicas are compared at the roots; only below a
node that differs are the children compared, down to the records that are corrupt, missing or
surplus. Every group is bounded: ``FANOUT`` children, ``RECORDS_PER_FILE`` records of a file.

DataFrame and SQL functions only. Defined results: a null url or page counts as empty; a null id
is written as ``null``; repeated pages are records of their own; equal replicas, and empty ones,
give no row; records of any length are hashed whole; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilepyramid.llm.common import id_key, ranked, read, stored

FANOUT = 16
LEVELS = 3
RECORDS_PER_FILE = FANOUT ** LEVELS


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    ).cast("binary")


def manifest(pages: DataFrame, digests: dict[str, Column], length: Column,
             page_id: str = "page_id") -> DataFrame:
    """(file, record_no, start, end, page_id and a column for each of ``digests``), stored.

    Bytes are hashed where they are read; only ids, lengths and digests move.
    """
    slim = pages.select(F.col(page_id).alias("page_id"), length.cast("long").alias("_length"),
                        *[d.alias(name) for name, d in digests.items()],
                        F.lit(0).alias("_all"), id_key(F.col(page_id)).alias("_key"))
    slim = stored(slim, "warc-digests")
    ties = [F.col("page_id"), *[F.col(name) for name in digests]]
    rank = ranked(slim, ["_all"], "_key", ties, "_rank", slim.count())
    placed = rank.withColumns({
        "file": F.expr(f"_rank div {RECORDS_PER_FILE}"),
        "record_no": F.expr(f"_rank % {RECORDS_PER_FILE}")})
    before = Window.partitionBy("file").orderBy("record_no").rowsBetween(
        Window.unboundedPreceding, 0)
    end = F.sum("_length").over(before)
    return stored(placed.withColumn("end", end).select(
        "file", "record_no", (F.col("end") - F.col("_length")).alias("start"), "end", "page_id",
        *digests), "warc-manifest")


def tree(leaves: DataFrame) -> DataFrame:
    """(level, file, node, start, end, hash) of all levels, from (file, record_no, start, end,
    hash), the last being the digest of the record's bytes; stored."""
    own = F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"),
                             "hash"), 256)
    level = leaves.select("file", F.col("record_no").alias("node"), "start", "end",
                          own.alias("hash"))
    found = level.select(F.lit(0).alias("level"), "*")
    for number in range(1, LEVELS + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))
        told = F.array_join(F.transform(children, lambda c: F.concat_ws(
            ":", (c["node"] % FANOUT).cast("string"), c["hash"])), "\n")
        ends = [F.min("start"), F.max("end")]
        whole = F.concat_ws(":", *[e.cast("string") for e in ends], told)
        level = level.groupBy("file", F.expr(f"node div {FANOUT}").alias("parent")).agg(
            ends[0].alias("start"), ends[1].alias("end"),
            F.sha2(whole, 256).alias("hash")).withColumnRenamed("parent", "node")
        found = found.union(level.select(F.lit(number).alias("level"), "file", "node", "start",
                                         "end", "hash"))
    return stored(found, "merkle-tree")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves that differ between two trees: (file, node, start, end, a_hash, b_hash).

    Starts with the roots and looks at children of differing nodes only. A leaf that one side
    lacks has a null hash there.
    """
    suspects = None
    for number in range(LEVELS, -1, -1):
        left, right = (t.filter(F.col("level") == number).select(
            "file", "node", "start", "end", "hash") for t in (a, b))
        if suspects is not None:
            left, right = (t.join(suspects, (t["file"] == F.col("_file"))
                                  & (F.expr(f"node div {FANOUT}") == F.col("_node")), "left_semi")
                           for t in (left, right))
        right = right.select("file", "node", F.col("start").alias("_start"),
                             F.col("end").alias("_end"), F.col("hash").alias("b_hash"))
        found = (left.withColumnRenamed("hash", "a_hash").join(right, ["file", "node"], "full")
                 .filter(~F.col("a_hash").eqNullSafe(F.col("b_hash")))
                 .select("file", "node", F.coalesce("start", "_start").alias("start"),
                         F.coalesce("end", "_end").alias("end"), "a_hash", "b_hash"))
        suspects = found.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
    return found


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages in which some runs of records have rotted or moved.

    The faults are the audit's test case, not given data: in every file, the version line of each
    record whose number modulo 512 is below 3 reads 1.0 instead of 1.1, and the offsets of those for
    which it is 300 to 302 are stale by 4 bytes.
    """
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    good = record(F.col("page_id"), F.col("url"), F.col("html"))
    bad = F.overlay(good, F.lit(b"0").cast("binary"), F.lit(8), F.lit(1))
    table = manifest(pages, {"good": F.sha2(good, 256), "bad": F.sha2(bad, 256)},
                     F.octet_length(good))
    rotten = F.col("record_no") % 512 < 3
    archive = tree(table.withColumn("hash", F.col("good")))
    stale = F.when((F.col("record_no") % 512).between(300, 302), 4).otherwise(0)
    replica = tree(table.withColumns({
        "hash": F.when(rotten, F.col("bad")).otherwise(F.col("good")),
        "start": F.col("start") + stale, "end": F.col("end") + stale}))
    found = differing(archive, replica).withColumnRenamed("node", "record_no")
    return found.join(table.select("file", "record_no", "page_id"), ["file", "record_no"]).select(
        "file", "record_no", "page_id", F.col("start").alias("start_byte"),
        F.col("end").alias("end_byte"), F.col("a_hash").alias("archive_hash"),
        F.col("b_hash").alias("replica_hash"))


OP9_SQL = f"""
WITH body AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
rec AS (
  SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10),
    'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), 'null'), '>', chr(13), chr(10),
    'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'Content-Length: ', strlen(html), chr(13), chr(10), chr(13), chr(10), html,
    chr(13), chr(10), chr(13), chr(10)) AS r FROM body),
ranked AS (
  SELECT *, row_number() OVER (
    ORDER BY coalesce(md5(CAST(page_id AS VARCHAR)), ''), page_id) - 1 AS rnk FROM rec),
placed AS (
  SELECT *, rnk // {RECORDS_PER_FILE} AS file, rnk % {RECORDS_PER_FILE} AS record_no FROM ranked),
spans AS (
  SELECT *, sum(strlen(r)) OVER (PARTITION BY file ORDER BY record_no)::BIGINT AS end_byte
  FROM placed)
SELECT file, record_no, page_id, end_byte - strlen(r) AS start_byte, end_byte,
       sha256(concat_ws(':', end_byte - strlen(r), end_byte, sha256(r))) AS archive_hash,
       sha256(concat_ws(':', end_byte - strlen(r) + moved, end_byte + moved, sha256(
         CASE WHEN moved = 0 THEN concat('WARC/1.0', substr(r, 9)) ELSE r END))) AS replica_hash
FROM (SELECT *, CASE WHEN record_no % 512 >= 300 THEN 4 ELSE 0 END AS moved FROM spans)
WHERE record_no % 512 < 3 OR record_no % 512 BETWEEN 300 AND 302
"""
