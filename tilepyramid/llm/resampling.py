"""Importance resampling of documents towards a target distribution, by bit-sliced aggregation.

A document is its bag of hashed word runs: how often each of ``BUCKETS`` buckets is hit. A bucket's
gain says how much more frequent it is in the target texts than in the corpus. The summed gain of a
document is found on bit planes: its counts become planes of ``BUCKETS`` bits (plane p holds bit p of
every count), the gains become planes of their own, positive and negative apart, and

    sum = sum over p, q of 2**(p+q) * (popcount(C_p & G+_q) - popcount(C_p & G-_q))

which is exact in integers. The mean of it is the document's weight; with a Gumbel term from its id
it is the score, and the highest scores are drawn, without replacement.

Bucket totals are summed within each task over all texts, so that at most ``BUCKETS`` rows of a task
move; gains are 10,000 numbers. The draw numbers all eligible rows by range of the score, so no
score, id or group of copies is the work of one task.

Defined results: a null or empty text, or one without words, has no features and weight 0 and is not
drawn. A null doc_id is hashed as ``7:`` and sorts first among equal scores. Repeated rows are rows of
their own with equal scores, drawn in any order among themselves. Texts of any length are read whole,
``PIECE`` bytes at a time. An empty corpus gives no row; with no target texts the gains still hold
(t and T are 0). Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid.llm.common import importable, numbered, read, stored
from tilepyramid.llm.sqlcrc import CRC_TABLE, crc32 as sql_crc32

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE_PERCENT = 25
SEED = 7
#: Bytes of one text whose words are held at a time.
PIECE = 1 << 20
#: 10,000 bits take 157 words of 64 bits.
PLANE_WORDS = -(-BUCKETS // 64)
#: A-Z to a-z, other ASCII but digits and letters to a space; all bytes of longer characters stay.
PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39
              or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def hits(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their runs of one and two words) of a text, piece by piece."""
    plain, at, last = raw.translate(PLAIN), 0, None
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        found = plain[at:end].split()
        at = end
        if not found:
            continue
        single = list(map(crc32, found))
        # crc32 goes on from the crc of the first word and the space
        second = [b" " + w for w in (found[1:] if last is None else found)]
        double = map(crc32, second, single if last is None else [last, *single])
        last = single[-1]
        runs = np.fromiter((*single, *double), dtype=np.int64)
        yield len(found), runs % BUCKETS


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def bucket_totals(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often the texts of all rows hit each bucket; at most ``BUCKETS`` rows reach the driver."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                for _, runs in hits(encoded(value)):
                    total += np.bincount(runs, minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, type=pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    parts = docs.select(text).mapInArrow(run, "bucket int, n long")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies, floored."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * (s_all + BUCKETS)
                                   / ((float(s) + 1) * (t_all + BUCKETS))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def plane(bits: np.ndarray) -> np.ndarray:
    """``BUCKETS`` zeros and ones as 64-bit words."""
    packed = np.zeros(PLANE_WORDS * 8, dtype=np.uint8)
    packed[:-(-BUCKETS // 8)] = np.packbits(bits.astype(np.uint8))
    return packed.view(np.uint64)


def signed_planes(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The planes of all gains, and what a bit of each counts: 2**q or -2**q."""
    planes, worth = [], []
    for sign in (1, -1):
        size = np.maximum(sign * gains, 0)
        for q in range(int(size.max(initial=0)).bit_length()):
            planes.append(plane(size >> q & 1))
            worth.append(sign << q)
    return (np.array(planes, dtype=np.uint64).reshape(-1, PLANE_WORDS),
            np.array(worth, dtype=np.int64))


def summed_gain(counts: np.ndarray, planes: np.ndarray, worth: np.ndarray) -> int:
    """The gains of a document's features, added up on the bit planes of its counts."""
    total = 0
    for p in range(int(counts.max(initial=0)).bit_length()):
        common = np.bitwise_count(planes & plane(counts >> p & 1)).sum(axis=1, dtype=np.int64)
        total += int(common @ worth) << p
    return total


def weighed(docs: DataFrame, gains: np.ndarray, text: str = "text",
            doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    importable(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(signed_planes(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, worth = shipped.value
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                n_words, counts = 0, np.zeros(BUCKETS, dtype=np.int64)
                for n, runs in hits(encoded(value)):
                    n_words += n
                    counts += np.bincount(runs, minlength=BUCKETS)
                n = int(counts.sum())
                rows.append((n_words, n, summed_gain(counts, planes, worth) // n if n else 0))
            made = np.array(rows, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(made[:, k]) for k in range(3)]],
                names=["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column) -> Column:
    """A document's fixed Gumbel term in thousandths, from its id."""
    told = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("long")
    u = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id",
             target_text: str = "text", share_percent: int = SHARE_PERCENT,
             least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document with ``n_words, n_features, weight, score`` and, if it is among the
    ``share_percent`` of the documents of ``least_words`` words or more, its ``rank`` from 1 on."""
    gains = bucket_gains(bucket_totals(docs, text), bucket_totals(target, target_text))
    scored = stored(weighed(docs, gains, text, doc_id).withColumn(
        "score", F.col("weight") + gumbel(F.col("doc_id"))), "resampling-scores")
    eligible = F.col("n_words") >= least_words
    drawn = share_percent * scored.filter(eligible).count() // 100
    placed = numbered(scored.filter(eligible), [F.desc("score"), F.asc("doc_id")], "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    rest = scored.filter(~eligible)
    return placed.withColumn("rank", rank).drop("place").unionByName(
        rest.withColumn("rank", F.lit(None).cast("long")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = f"""
WITH {CRC_TABLE},
texts AS (
  SELECT 'corpus' AS side, row_number() OVER () AS row_no, doc_id, text FROM documents UNION ALL
  SELECT 'target', row_number() OVER (), NULL, text FROM benchmark),
worded AS (
  SELECT side, row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, row_no, unnest(w) AS run FROM worded UNION ALL
  SELECT side, row_no, unnest(list_transform(
    range(1, length(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM worded),
bucketed AS (
  SELECT run, ({sql_crc32("run")} % {BUCKETS})::BIGINT AS bucket
  FROM (SELECT DISTINCT run FROM runs), crc_table),
hit AS (
  SELECT side, row_no, bucket, count(*) AS n FROM runs JOIN bucketed USING (run) GROUP BY ALL),
totals AS (SELECT side, sum(n)::DOUBLE AS total FROM hit GROUP BY side),
gains AS (
  SELECT b AS bucket, floor(1000 * ln(
    (coalesce(t.n, 0) + 1e0) * (coalesce((SELECT total FROM totals WHERE side = 'corpus'), 0) + {BUCKETS})
    / ((coalesce(s.n, 0) + 1e0)
       * (coalesce((SELECT total FROM totals WHERE side = 'target'), 0) + {BUCKETS}))))::BIGINT AS gain
  FROM range({BUCKETS}) x(b)
  LEFT JOIN (SELECT bucket, sum(n) AS n FROM hit WHERE side = 'corpus' GROUP BY 1) s ON s.bucket = b
  LEFT JOIN (SELECT bucket, sum(n) AS n FROM hit WHERE side = 'target' GROUP BY 1) t ON t.bucket = b),
summed AS (
  SELECT row_no, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
  FROM hit JOIN gains USING (bucket) WHERE side = 'corpus' GROUP BY row_no),
weighed AS (
  SELECT doc_id, row_no, length(w) AS n_words, coalesce(n_features, 0) AS n_features,
    -- floored division of integers: % has the sign of the dividend
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM worded LEFT JOIN summed USING (row_no) WHERE side = 'corpus'),
scored AS (
  SELECT *, (weight + floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0))))::BIGINT AS score,
    n_words >= {LEAST_WORDS} AS eligible FROM weighed),
placed AS (
  SELECT *, CASE WHEN eligible THEN row_number() OVER (
    PARTITION BY eligible ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score,
  CASE WHEN place <= ({SHARE_PERCENT} * (SELECT count(*) FROM scored WHERE eligible)) // 100
    THEN place END AS rank
FROM placed
"""
