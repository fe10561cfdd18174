"""N-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its distinct word shingles. Two sets link when ``100 * |A & B| >= percent *
|A | B|``. Sets are grouped by size band: group g holds the sets of band g and the larger ones that
can still link to them. In a group two linked sets differ in at most H tokens, H known from the
band. Tokens are hashed into m segments; segment i has an allowance v_i of 1 or 2. Were two sets to
differ in v_i tokens or more in every segment, they would differ in the sum of all v_i, which is
more than H. So linked sets have a segment where their subsets are equal (v = 1) or differ in one
token at most (v = 2: a subset meets the other's one-deletion neighbourhood).

The allocation is by cost, twice. How many segments get v = 2 is what makes the expected cost of a
group least: fewer and larger segments with their neighbourhoods for small sets, plain segments for
large ones. And groups of large sets have ``spare`` segments beyond H + 1: linked sets then agree in
``spare + 1`` segments, so each set may give up (v = 0) its ``spare`` costliest keys, by the number
of sets in which each key occurs, and pairs that share no more than ``spare`` keys are dropped
before their texts are looked at. A passage that many documents share costs nothing this way.

A shingle is told by 128 bits made from the 128-bit BLAKE2 digests of its words; keys use the first
half. What is left is verified on the whole shingle sets of the whole texts: each document with its best
hub; then, where a key is held by several components, every pair of different ones. Keys with few
holders give pairs; documents tied by keys with many holders are compared chunk by chunk, as a
product of matrices that returns a spanning forest, so a group of thousands of near copies never
becomes a table of its pairs. No link is lost that could join two components. Exact copies are one
document throughout.

Defined results: a text without words, or null, has no shingles, links with nothing and is its own
component; a null id gets its n_shingles, a null component, and no links; rows repeating id and
text give equal rows; rows that share an id but not a text count as one document for links, with the
largest n_shingles: each text is a set of its own, and what links with one is tied to the others
(texts without shingles tie nothing). The pipeline's stage judges texts, not ids. Texts are read whole,
whatever their length. An empty table gives no row. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilepyramid.llm.blocks import spanning_forest
from tilepyramid.llm.common import gathered, read, small_batches, stored, with_totals
from tilepyramid.llm.components import components
from tilepyramid.llm.textbytes import chunks, with_text_columns

WORDS = 4
PERCENT = 85
GROWTH = 1.25
#: One spare segment for so many of H + 1.
SPARE_OF = 5
#: Sets that the cost of a key is reckoned for.
EXPECTED_SETS = 1_000
#: Documents compared with one hub in one run of rows; a hub with more gets several runs.
RUN = 512
#: Ids broadcast at most; beyond that the same join shuffles.
BROADCAST_IDS = 200_000
#: Texts that a task compares, where a table has few.
TASK_TEXTS = 4_000

#: A key with more holders is compared in blocks of ``CHUNK`` documents instead of by pairs.
DENSE = 32
CHUNK = 256
#: Columns of the token matrix held at once in a block.
SLICE = 4_096
#: Keys of a group are told apart by group * PART + spare.
PART = 1 << 20
#: Buckets for each shuffle partition, and keys that a task holds before it deals them: as many as
#: ``FLUSH``, and ``PER_BUCKET`` for each bucket.
BUCKETS = 8
FLUSH = 1 << 18
PER_BUCKET = 64

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                   0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * PLACES[0]
    x = (x ^ (x >> np.uint64(27))) * PLACES[1]
    return x ^ (x >> np.uint64(31))


def word_digests(raws: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The 128-bit BLAKE2 digests, as two numbers each, of all words of the texts in order, and the
    number of words of each text."""
    split = [raw.translate(LOWER).split() for raw in raws]  # at 0x20 and 0x09 to 0x0D
    words = [w for found in split for w in found]
    place = {w: k for k, w in enumerate(dict.fromkeys(words))}
    told = b"".join(blake2b(w, digest_size=16).digest() for w in place)
    digests = np.frombuffer(told, dtype=np.uint64).reshape(-1, 2)
    which = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
    return digests[which], [len(found) for found in split]


def shingle_sets(raws: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Of each text its distinct shingles, sorted: a row of two numbers each, made from the two halves
    of the digests of its words."""
    digests, counts = word_digests(raws)
    at = 0
    for n in counts:
        words = digests[at:at + n]
        at += n
        if n == 0:
            yield words
        elif n < width:
            places = PLACES[np.arange(n) % len(PLACES), None]
            yield mixed((words * places).sum(axis=0, keepdims=True) + np.uint64(n))
        else:
            total = np.full((n - width + 1, 2), width, dtype=np.uint64)
            for k in range(width):
                total += words[k:n - width + 1 + k] * PLACES[k]
            yield distinct(mixed(total))


def distinct(tokens: np.ndarray) -> np.ndarray:
    """The different rows, sorted."""
    rows = tokens[np.argsort(tokens[:, 0], kind="stable")]
    same = rows[1:, 0] == rows[:-1, 0]
    if (rows[1:][same, 1] != rows[:-1][same, 1]).any():  # different shingles of one first number
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        same = (rows[1:] == rows[:-1]).all(axis=1)
    return rows[np.concatenate([[True], ~same])]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many rows two sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    low = np.searchsorted(b[:, 0], a[:, 0])
    found = 0
    while len(a):  # once, unless rows of ``b`` agree in the first number only
        held = low < len(b)
        a, low = a[held], low[held]
        held = b[low, 0] == a[:, 0]
        a, low = a[held], low[held]
        equal = b[low, 1] == a[:, 1]
        found += int(equal.sum())
        a, low = a[~equal], low[~equal] + 1
    return found


@lru_cache(maxsize=8)
def _bands(up_to: int) -> list[int]:
    """First sizes of the bands, until beyond ``up_to``."""
    firsts = [1]
    while firsts[-1] <= up_to:
        firsts.append(max(firsts[-1] + 1, int(firsts[-1] * GROWTH)))
    return firsts


def groups_of(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(group, its least size, H) of the groups a set of ``size`` tokens takes part in."""
    firsts = _bands(1 << max(10, int(size).bit_length()))
    own = int(np.searchsorted(firsts, size, side="right")) - 1
    found = []
    for g in range(own, -1, -1):
        largest = firsts[g + 1] - 1
        if size * percent > 100 * largest:
            break
        found.append((g, firsts[g], largest * (100 - percent) // percent))
    return found


@lru_cache(maxsize=512)
def allocation(most: int, size: int) -> tuple[int, int, int]:
    """(segments, segments with v = 2, spare) of a group by its H and least size.

    The expected cost of a key is writing it and the sets that share it by chance.
    """
    spare = (most + 1) // SPARE_OF if most + 1 >= 2 * SPARE_OF else 0
    best = None
    for twos in range((most + 1) // 2 + 1 if not spare else 1):
        m = most + 1 + spare - twos
        tokens = size / m
        cost = (m - twos) * (1 + EXPECTED_SETS * np.exp(-tokens)) + twos * (1 + tokens) * (
            1 + EXPECTED_SETS * np.exp(1 - tokens))
        if best is None or cost < best[0]:
            best = (cost, m, twos)
    return best[1], best[2], spare


def signatures(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and for each its part: group * PART + spare."""
    keys, parts = [], []
    size, tokens = len(tokens), tokens[:, 0]
    for group, least, most in groups_of(size, percent):
        m, twos, spare = allocation(most, least)
        segment = ((tokens >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, dtype=np.uint64)
        np.add.at(sums, segment, tokens)
        salt = mixed(np.arange(m, dtype=np.uint64) + np.uint64(group << 32))
        keys.append(mixed(sums + salt))
        cut = np.flatnonzero(segment < twos)
        if len(cut):
            at = segment[cut]
            keys.append(mixed(sums[at] - tokens[cut] + salt[at]))
        parts.append(np.full(m + len(cut), group * PART + spare, dtype=np.int64))
    return np.concatenate(keys), np.concatenate(parts)


def stored_tasks(df: DataFrame, name: str) -> DataFrame:
    """:func:`stored` for what Python tasks make of whole texts or packed keys."""
    with small_batches(df.sparkSession):
        return stored(df, name)


def signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Flat rows (key, doc, part): the keys of (doc, text) that more than one row holds, and for each
    doc a row whose part is -1 - n_shingles.

    Most keys have one holder and link nothing. Keys are moved once, packed by bucket, and a bucket lets
    only those through that come to it twice.
    """
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flush = max(FLUSH, PER_BUCKET * buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            ids, at = batch.column("doc").to_pylist(), 0
            for raws in chunks(batch.column("text").to_pylist()):
                for doc, tokens in zip(ids[at:at + len(raws)], shingle_sets(raws, width), strict=True):
                    held.append(_rows(doc, tokens, percent))
                    n += len(held[-1][0])
                    if n >= flush:
                        yield packed(held, buckets)
                        held, n = [], 0
                at += len(raws)
        if held:
            yield packed(held, buckets)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            columns = batch.columns[1:]
            for at, found in enumerate(batch.column("bucket").to_pylist()):
                if found != bucket and held:
                    yield let_through(bucket, held)
                    held = []
                bucket = found
                held.append(tuple(c[at].as_buffer() for c in columns))
                if bucket < 0:
                    yield let_through(bucket, held)
                    held = []
        if held:
            yield let_through(bucket, held)

    dealt = docs.select("doc", "text").mapInArrow(
        run, "bucket long, key binary, doc binary, part binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        sieve, "key long, doc long, part long")


def _rows(doc: int, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, doc and part of the rows of one document."""
    size = np.array([-1 - len(tokens)])
    keys, parts = np.array([doc], dtype=np.int64), size
    if len(tokens):
        key, part = signatures(tokens, percent)
        keys, parts = np.concatenate([key.view(np.int64), keys]), np.concatenate([part, size])
    return keys, np.full(len(keys), doc, dtype=np.int64), parts.astype(np.int32)


def packed(held: list[tuple], buckets: int) -> pa.RecordBatch:
    """One row (bucket, key, doc, part) for each bucket, with the rows of ``held`` as bytes.

    Two holders of a key are enough for its bucket to let all of them through. Those after the second
    go past the buckets, in a row of negative bucket, as do sizes: a key that very many hold is not the
    work of one task.
    """
    key, doc, part = (np.concatenate(c) for c in zip(*held, strict=True))
    bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    past = part < 0
    order = np.flatnonzero(~past)
    order = order[np.argsort(key[order], kind="stable")]
    third = key[order][2:] == key[order][:-2]
    past[order[2:][third]] = True
    bucket[past] = -1 - bucket[0]
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    bounds = [*firsts.tolist(), len(bucket)]
    columns = [pa.array([c[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)],
                        pa.binary()) for c in (key[order], doc[order], part[order])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[firsts]), *columns],
                                      names=["bucket", "key", "doc", "part"])


def let_through(bucket: int, held: list[tuple]) -> pa.RecordBatch:
    """The rows of a bucket whose key is there more than once; all rows of a negative bucket."""
    key, doc, part = (np.concatenate([np.frombuffer(c, dtype=t) for c in column])
                      for column, t in zip(zip(*held, strict=True), (np.int64, np.int64, np.int32),
                                           strict=True))
    if bucket >= 0:
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        key, doc, part = key[order], doc[order], part[order]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, doc, part.astype(np.int64))],
                                      names=["key", "doc", "part"])


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (doc, hub) that link, by their exact sets; stored, as ``pairs`` is.

    The texts of a hub's documents go to where the hub is, in runs of about ``RUN``; a task holds
    one hub's set and one batch of texts at a time.
    """
    runs = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / RUN).cast("int").alias("runs"))
    # who goes where: (doc, hub, run, role), hubs themselves with role 0
    sent = pairs.join(runs, "hub").select(
        "doc", "hub", F.expr("CAST(pmod(xxhash64(doc), runs) AS INT)").alias("run"),
        F.lit(1).alias("role")).union(runs.select(
            F.col("hub").alias("doc"), "hub",
            F.explode(F.expr("sequence(0, runs - 1)")).alias("run"), F.lit(0).alias("role")))
    count = pairs.count()
    sent = stored(gathered(sent, 2 * count), "ngram-sent")  # a hub has no more runs than documents
    rows = with_texts(sent, docs).select("hub", "run", "role", "doc", "text")
    rows = rows.repartition("hub", "run").sortWithinPartitions("hub", "run", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, None
        for batch in batches:
            frame = batch.to_pydict()
            at, found = 0, []
            for raws in chunks(frame["text"]):
                for tokens in shingle_sets(raws, width):
                    if frame["role"][at] == 0:
                        hub, held = frame["hub"][at], tokens
                    elif frame["hub"][at] == hub and len(tokens) and len(held):
                        both = shared(tokens, held)
                        if 100 * both >= percent * (len(tokens) + len(held) - both):
                            found.append((frame["doc"][at], hub))
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    links = rows.mapInArrow(run, "a long, b long")
    return stored_tasks(gathered(links, 2 * count, TASK_TEXTS), "ngram-links")


def with_texts(sent: DataFrame, docs: DataFrame) -> DataFrame:
    """``sent``, which is stored, with the text of each ``doc``; few rows go to the texts, many meet
    them halfway."""
    few = sent.count() <= BROADCAST_IDS
    return docs.select("doc", "text").join(F.broadcast(sent) if few else sent, "doc")


def copy_of(text: str = "text") -> Column:
    """What tells texts apart; empty for a null text."""
    return F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit(""))


def text_copies(docs: DataFrame) -> DataFrame:
    """(doc, copy, rep, node): each text of each document, with the smallest id that has the same
    text, and the id of the text itself; stored.

    The node of a text is its ``rep``, or a hash where another text took that before.
    """
    keyed = docs.filter(F.col("doc").isNotNull()).select("doc", copy_of().alias("copy")).distinct()
    reps = keyed.groupBy("copy").agg(F.min("doc").alias("rep"))
    count = docs.count()
    turn = F.row_number().over(Window.partitionBy("rep").orderBy("copy"))
    reps = reps.withColumn("node", F.when(turn == 1, F.col("rep")).otherwise(
        F.xxhash64("copy", F.lit("text"))))
    reps = stored(gathered(reps, count), "text-reps")  # both sides of the join are shuffled: copies may be many
    keyed = keyed.join(reps, "copy").select("doc", "copy", "rep", "node")
    return stored(gathered(keyed, count), "text-copies")


def several_texts(copies: DataFrame) -> bool:
    """Whether an id has more than one text."""
    return not copies.groupBy("doc").count().filter("count > 1").isEmpty()


def by_text(docs: DataFrame, told: DataFrame, how: str, doc: str = "doc",
            text: str = "text") -> DataFrame:
    """``docs`` joined with ``told`` (doc, copy, ..) by id and text."""
    told = stored(told.withColumnsRenamed({"doc": "_doc", "copy": "_copy"}), "ngram-texts")
    few = told.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(told) if few else told, (F.col(doc) == F.col("_doc"))
                     & (copy_of(text) == F.col("_copy")), how).drop("_doc", "_copy")


def without(docs: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """``docs`` but for those whose ``on`` is in the one column of ``ids``."""
    ids = ids.toDF("_out")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col(on) == F.col("_out"), "left_anti")


def joined(documents: DataFrame, width: int = WORDS, percent: int = PERCENT,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``documents``."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    copies = text_copies(docs)
    return joined_texts(docs, copies, several_texts(copies), width, percent)


def joined_texts(docs: DataFrame, copies: DataFrame, several: bool, width: int,
                 percent: int) -> DataFrame:
    """:func:`joined` of (doc, text), by their :func:`text_copies`."""
    sizes, links = text_links(docs, copies, several, width, percent)
    if several:
        # texts of one document are tied
        nodes = copies.join(sizes.withColumnRenamed("doc", "node"), "node").filter("n > 0")
        first = nodes.groupBy("doc").agg(F.min("node").alias("b"))
        links = links.union(nodes.join(first, "doc").filter("node <> b").select(
            F.col("node").alias("a"), "b"))
    known = copies.join(_parts(sizes, components(links, rows=links.count())), "node")
    if several:
        known = stored(known, "ngram-known")
        # a component is named by its smallest document, which may not be its smallest node
        names = stored(known.filter("n > 0").groupBy("part").agg(F.min("doc").alias("name"))
                       .filter("part <> name"), "ngram-names")
        names = F.broadcast(names) if names.count() <= BROADCAST_IDS else names
        known = known.join(names, "part", "left").withColumn("part", F.coalesce("name", "part"))
    known = (known.groupBy("doc").agg(
        F.max("n").alias("n_shingles"),
        F.coalesce(F.min(F.when(F.col("n") > 0, F.col("part"))), F.col("doc"))
        .alias("component_id")))
    ids = docs.select("doc").filter(F.col("doc").isNotNull())
    return ids.join(known, "doc").select(
        F.col("doc").alias("doc_id"), "n_shingles", "component_id").union(_nameless(docs, width))


def _parts(sizes: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, n, part): the component of every distinct text; stored, so that what is joined with it
    is shuffled beside it and a text with very many copies can be cut."""
    placed = sizes.withColumnRenamed("doc", "node").join(
        parts.withColumnRenamed("id", "node"), "node", "left").select(
        "node", "n", F.coalesce("component", "node").alias("part"))
    return stored(gathered(placed, sizes.count()), "ngram-parts")


def text_links(docs: DataFrame, copies: DataFrame, several: bool, width: int,
               percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc, n) and the links (a, b) of all distinct texts, by their nodes."""
    if several:
        single = by_text(docs, copies.filter("doc = rep").select("doc", "copy", "node"), "inner")
        single = single.select(F.col("node").alias("doc"), "text")
    else:
        single = without(docs.filter(F.col("doc").isNotNull()),
                         copies.filter("doc <> rep").select("doc"), "doc")
    told = stored_tasks(signed(single, width, percent), "ngram-signed")
    sizes = told.filter("part < 0").groupBy("doc").agg((-1 - F.min("part")).alias("n"))
    # a repeated row only makes its set give up fewer keys
    count = told.count()
    keys = stored(gathered(with_totals(
        told.filter("part >= 0"), ["key"],
        [F.count(F.lit(1)).alias("freq"), F.min("doc").alias("low"), F.max("doc").alias("high")],
        "low < high", rows=count).select("key", "doc", "part", "freq"), count), "ngram-keys")
    count = keys.count()
    costly = Window.partitionBy("doc", "part").orderBy(F.desc("freq"), "key")
    used = stored(gathered(
        keys.withColumn("rank", F.row_number().over(costly))
        .filter(F.col("rank") > F.col("part") % PART).select("key", "doc", "part"), count),
        "ngram-used-keys")
    lists = stored(gathered(keys.groupBy("doc", "part").agg(F.collect_list("key").alias("keys"))
                            .join(sizes, "doc"), count), "ngram-key-lists")

    # round 1: each document with the hub that it shares most keys with
    hubs = with_totals(used, ["key"], [F.min("doc").alias("hub")], rows=count).filter("doc <> hub")
    best = hubs.groupBy("doc", "hub", "part").agg(F.count(F.lit(1)).alias("shared"))
    best = best.groupBy("doc").agg(
        F.max_by(F.struct("hub", "part"), F.struct("shared", -F.col("hub"))).alias("b"))
    links = _links(best.select("doc", "b.hub", "b.part"), lists, single, width, percent, count)
    # round 2: what else shares a key across components
    held = _open_keys(used, components(links, rows=links.count()), count)
    few = held.filter(F.col("held") <= DENSE)
    links = links.union(_links(_pairs(few), lists, single, width, percent, DENSE * few.count()))
    links = links.union(_dense_links(held.filter(F.col("held") > DENSE), single, width, percent))
    return sizes, links


def _nameless(docs: DataFrame, width: int) -> DataFrame:
    def work(texts: list) -> list[list]:
        return [[len(s) for raws in chunks(texts) for s in shingle_sets(raws, width)]]

    added = T.StructType([T.StructField("n_shingles", T.LongType())])
    rows = with_text_columns(docs.filter(F.col("doc").isNull()), "text", added, work)
    return rows.select(F.col("doc").alias("doc_id"), "n_shingles",
                       F.lit(None).cast("long").alias("component_id"))


def _held() -> list[Column]:
    """Of a key or shingle: its holders, and the first and last of their components."""
    return [F.count(F.lit(1)).alias("held"), F.min("comp").alias("low"),
            F.max("comp").alias("high")]


def _open_keys(used: DataFrame, parts: DataFrame, rows: int) -> DataFrame:
    """(key, doc, part, comp, held): used keys, ``rows`` at most, that several components hold;
    stored."""
    placed = used.join(parts.withColumnRenamed("id", "doc"), "doc", "left").withColumn(
        "comp", F.coalesce("component", "doc")).drop("component")
    placed = stored(gathered(placed, rows), "ngram-placed-keys")
    return stored(gathered(with_totals(placed, ["key"], _held(), "low < high", rows=rows)
                           .drop("low", "high"), rows), "ngram-open-keys")


def _pairs(held: DataFrame) -> DataFrame:
    """(doc, hub, part) of different components that share a key of at most ``DENSE`` holders."""
    other = held.select("key", F.col("doc").alias("hub"), F.col("comp").alias("hub_comp"))
    return (held.join(other, "key")
            .filter((F.col("doc") > F.col("hub")) & (F.col("comp") != F.col("hub_comp")))
            .select("doc", "hub", "part").distinct())


def _dense_links(held: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links among documents that share keys with many holders, without a row for each pair.

    Documents tied by such keys form clusters. One of at most about ``CHUNK`` documents is one
    task's block. In a larger one documents are first told apart by shingles: those that link share
    one of the rarest few, so that a passage which many hold ties no two of them. Only what is tied
    by a rare shingle with more than ``DENSE`` holders still goes to blocks.
    """
    clusters = _clusters(held, ["key"])
    links = _block_links(clusters.filter("chunks = 1"), docs, width, percent)
    large = clusters.filter("chunks > 1").select(F.col("id").alias("doc"))
    if large.isEmpty():
        return links
    token = ["hi", "lo"]
    who = held.select("doc", "comp").distinct().join(large, "doc")
    rare = _rare_shingles(gathered(who, held.count()), docs, width, percent)
    count = rare.count()
    rare = stored(gathered(with_totals(rare, token, _held(), "low < high", rows=count)
                           .drop("low", "high"), count), "ngram-rare")
    few = rare.filter(F.col("held") <= DENSE)
    other = few.select(*token, *[F.col(c).alias(f"hub_{c}") for c in ("doc", "comp", "n")])
    pairs = few.join(other, token).filter(
        (F.col("doc") > F.col("hub_doc")) & (F.col("comp") != F.col("hub_comp"))
        & (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent))
    pairs = pairs.select("doc", F.col("hub_doc").alias("hub")).distinct()
    pairs = stored(gathered(pairs, DENSE * few.count()), "ngram-pairs")
    links = links.union(verified(pairs, docs, width, percent))
    return links.union(_block_links(
        _clusters(rare.filter(F.col("held") > DENSE), token), docs, width, percent))


def _rare_shingles(who: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, comp, n, hi, lo): of each document in ``who`` (doc, comp) so many of its shingles, the
    rarest of all of theirs first, that two documents which link have one of these in common.

    A document of n shingles shares at least ``need``, its percentage of n, with one that it links
    to, so one of those is among its first n - need + 1. What no other document holds is left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "comp")]
            at = 0
            for raws in chunks(batch.column("text").to_pylist()):
                sets = list(shingle_sets(raws, width))
                sizes = np.array([len(x) for x in sets])
                rows = np.concatenate([*sets, np.zeros((0, 2), np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.repeat(c[at:at + len(sets)], sizes)) for c in told],
                     pa.array(np.repeat(sizes, sizes)), pa.array(rows[:, 0].copy()),
                     pa.array(rows[:, 1].copy())], names=["doc", "comp", "n", "hi", "lo"])
                at += len(sets)

    who = stored(who, "ngram-sent")
    texts = with_texts(who, docs).select("doc", "comp", "text")
    shingles = texts.mapInArrow(run, "doc long, comp long, n long, hi long, lo long")
    shingles = stored_tasks(gathered(shingles, who.count(), TASK_TEXTS), "ngram-shingles")
    count = shingles.count()
    own = Window.partitionBy("doc")
    # A repeated row repeats its shingles: equal ones share a rank.
    ranked = with_totals(shingles, ["hi", "lo"], [F.count(F.lit(1)).alias("often")],
                         "often > 1", rows=count).withColumn(
        "rank", F.dense_rank().over(own.orderBy("often", "hi", "lo"))).withColumn(
        "last", F.max("rank").over(own))
    need = F.expr(f"(n * {percent} + 99) div 100")
    return stored(gathered(ranked.filter(F.col("rank") <= F.col("last") - need + 1).select(
        "doc", "comp", "n", "hi", "lo"), count), "ngram-prefixes")


def _clusters(held: DataFrame, key: list[str]) -> DataFrame:
    """(id, component, chunks) of the documents that share keys, and into how many chunks of about
    ``CHUNK`` their cluster is cut; stored."""
    count = held.count()
    ties = with_totals(held, key, [F.min("doc").alias("hub")], rows=count)
    clusters = components(ties.select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct(),
                          rows=count)
    sizes = clusters.groupBy("component").agg(
        F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    return stored(gathered(clusters.join(sizes, "component"), count), "ngram-clusters")


def _block_links(clusters: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links within clusters (id, component, chunks): each task compares one chunk with another and
    returns a spanning forest of the links it finds."""
    dealt = (clusters
             .withColumn("own", F.expr("CAST(pmod(xxhash64(id), chunks) AS INT)"))
             .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
             .select(F.col("id").alias("doc"), "component", F.least("own", "other").alias("low"),
                     F.greatest("own", "other").alias("high"), "own"))
    count = clusters.agg(F.sum("chunks")).first()[0] or 0
    rows = with_texts(stored(gathered(dealt, count), "ngram-sent"), docs)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("own", kind="stable")
        sets = [s for raws in chunks(frame["text"]) for s in shingle_sets(raws, width)]
        ids = frame["doc"].to_numpy()
        first = int((frame["own"] == frame["low"]).sum())
        left = slice(0, first)
        right = left if frame["low"].iloc[0] == frame["high"].iloc[0] else slice(first, len(ids))
        sizes = np.array([len(s) for s in sets])
        both = shared_counts(sets, left, right)
        total = sizes[left, None] + sizes[None, right] - both
        hits = (both > 0) & (100 * both >= percent * total) & (
            ids[left, None] != ids[None, right])
        tied = spanning_forest(hits, ids[left], ids[right])
        return pd.DataFrame({"a": tied[:, 0], "b": tied[:, 1]})

    found = rows.groupBy("component", "low", "high").applyInPandas(compare, "a long, b long")
    return stored_tasks(gathered(found, count, TASK_TEXTS), "ngram-links")


def shared_counts(sets: list[np.ndarray], left: slice, right: slice) -> np.ndarray:
    """Sizes of the intersections of the sets of ``left`` with those of ``right``.

    A product of 0/1 matrices, taken over slices of the tokens that several sets hold, so that
    memory is bounded whatever the length of the texts.
    """
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    rows = np.concatenate([*sets, np.zeros((0, 2), np.uint64)])
    by = np.lexsort((rows[:, 1], rows[:, 0]))
    new = (rows[by][1:] != rows[by][:-1]).any(axis=1)
    token = np.zeros(len(rows), dtype=np.int64)
    token[by] = np.concatenate([np.zeros(min(1, len(rows)), np.int64), np.cumsum(new)])
    kept = np.bincount(token)[token] > 1 if len(rows) else np.zeros(0, dtype=bool)
    order = np.argsort(token[kept], kind="stable")
    owner, token = owner[kept][order], token[kept][order]
    out = np.zeros((len(sets[left]), len(sets[right])), dtype=np.int64)
    at = 0
    while at < len(token):
        end = np.searchsorted(token, token[at] + SLICE)
        part = np.zeros((len(sets), SLICE), dtype=np.float32)
        part[owner[at:end], token[at:end] - token[at]] = 1
        out += (part[left] @ part[right].T).astype(np.int64)
        at = end
    return out


def _links(pairs: DataFrame, lists: DataFrame, docs: DataFrame, width: int,
           percent: int, rows: int) -> DataFrame:
    """The links (a, b) among ``pairs`` (doc, hub, part), ``rows`` at most: by size, by shared keys, by
    the sets."""
    mine = lists.select("doc", "part", "keys", "n")
    other = mine.toDF("hub", "part", "hub_keys", "hub_n")
    able = (pairs.join(mine, ["doc", "part"]).join(other, ["hub", "part"])
            .filter((F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)
                    & (F.size(F.array_intersect("keys", "hub_keys")) > F.col("part") % PART))
            .select("doc", "hub").distinct())
    return verified(stored(gathered(able, rows), "ngram-pairs"), docs, width, percent)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(read(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each group of linked documents (five words, 0.8) the smallest id stays."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    copies = text_copies(keyed)
    if several_texts(copies):
        sizes, links = text_links(keyed, copies, True, 5, 80)
        parts = _parts(sizes, components(links, rows=links.count()))
        own = copies.join(parts, "node").filter("n > 0")
        first = own.groupBy("part").agg(F.min(F.struct("doc", "copy")).alias("kept"))
        surplus = own.join(first, "part").filter("struct(doc, copy) <> kept").select("doc", "copy")
        kept = by_text(docs, surplus, "left_anti", "doc_id")
        return (kept.filter("doc_id IS NOT NULL").withColumn("_copy", copy_of())
                .dropDuplicates(["doc_id", "_copy"]).drop("_copy")
                .unionByName(kept.filter("doc_id IS NULL")))
    told = gathered(joined_texts(keyed, copies, False, 5, 80), docs.count())
    told = stored(told, "ngram-components")
    surplus = told.filter("doc_id <> component_id").select("doc_id").distinct()
    kept = without(docs, surplus, "doc_id")
    repeated = told.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(
        kept.filter("doc_id IS NULL"))


OP2_SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + {WORDS}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {WORDS - 1}, 1))) AS i
        FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
reach AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN low ON d.doc_id = low.a
"""
