"""Main text of web pages by wrapper induction.

Every page becomes a tree of blocks. The pages of a host are aligned with one of them, the seed, by
simple tree matching; a text of the seed that stands in the same place of at least ``CONSTANT`` of the
host's different articles belongs to the template, what varies is a slot. A page's content is the slots
that are main text by their place: within the article (else the main element, else the body), outside
navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and
reader comments, which elements and words of class, id and role tell (``htmltree``).

A host with fewer than ``LEAST_ARTICLES`` different articles has no template: pages that are copies
of one article agree in it and are no evidence, so articles and not pages are counted, by a 128-bit
digest of their text. Nothing of a host passes one task: trees are a few hundred bytes a page, the seed
is a minimum (nearest to the host's mean size, then by digest), agreements are counted, and wrappers are
broadcast if their counted bytes are within ``BROADCAST_BYTES``, else joined with salt.

Defined results: null html is empty; a page without content has an empty text; a page whose url is
null or names no host has no template. Character references are decoded, white space within a block
is one space, blocks are joined by one space, in page order; nothing else is dropped or cut, whatever
the length. Repeated rows give equal rows. An empty table gives no row. Other columns are not looked
at. Broken markup is read as far as it goes: end tags may lack, an unclosed comment ends the page.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilepyramid.llm.common import importable, read, stored
from tilepyramid.llm.htmltree import Page, Tree, aligned, packed, parse

CONSTANT = 0.8
LEAST_ARTICLES = 5
BROADCAST_BYTES = 32 << 20
SALTS = 32


def host(url: Column) -> Column:
    """The host of a URL in lower case, or an empty string."""
    return F.coalesce(F.lower(F.regexp_extract(
        url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def main_texts(page: Page) -> list[str]:
    return [t for t, main in zip(page.text, page.main) if t and main]


def trees(pages: DataFrame) -> DataFrame:
    """(host, article, tree, n_nodes) of every page, from (host, html)."""
    importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            articles, found = [], []
            for source in batch.column(1).to_pylist():
                page = parse(source)
                told = " ".join(main_texts(page)).encode("utf-8", "surrogatepass")
                articles.append(blake2b(told, digest_size=16).digest())
                found.append(packed(page))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(articles, pa.binary()), pa.array(found, pa.binary()),
                 pa.array([len(t) // 12 for t in found], pa.int64())],
                names=["host", "article", "tree", "n_nodes"])

    return pages.select("host", "html").mapInArrow(
        run, "host string, article binary, tree binary, n_nodes long")


def with_host(rows: DataFrame, side: DataFrame, weight: Column, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``side`` for their host; ``weight`` is the bytes of such a row."""
    size = side.agg(F.sum(weight)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(side), "host", how)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["host", "_salt"], how).drop("_salt")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, seed, constants): a tree of each host and its nodes that are template; from (host,
    html). Hosts without a template are left out."""
    found = stored(trees(pages.filter(F.col("host") != "")), "wrapper-trees")
    # the articles of a host, each with one of its trees
    articles = stored(found.groupBy("host", "article").agg(
        F.min(F.struct("n_nodes", "tree")).alias("t")).select("host", "article", "t.*"),
        "wrapper-articles")
    sizes = articles.groupBy("host").agg(
        F.avg("n_nodes").alias("mean"), F.count(F.lit(1)).alias("n_articles")).filter(
        F.col("n_articles") >= LEAST_ARTICLES)
    off = F.abs(F.col("n_nodes") - F.col("mean"))
    near = with_host(articles, sizes, F.lit(64) + F.octet_length("host"))
    seeds = stored(near.groupBy("host").agg(
        F.min_by(F.struct(F.col("tree").alias("seed"), "n_articles"),
                 F.struct(off, "article")).alias("s")).select("host", "s.*"), "wrapper-seeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, nodes = [], []
            for name, tree, seed in zip(*[c.to_pylist() for c in batch.columns]):
                agreed = _agreed(Tree(tree), Tree(seed))
                hosts += [name] * len(agreed)
                nodes += [j for _, j in agreed]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(nodes, pa.int32())],
                names=["host", "node"])

    weight = F.octet_length("seed") + F.octet_length("host")
    agreed = with_host(articles.select("host", "tree"), seeds.select("host", "seed"), weight)
    votes = agreed.select("host", "tree", "seed").mapInArrow(run, "host string, node int")
    counts = votes.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"))
    constant = with_host(counts, seeds.select("host", "n_articles"), F.lit(64)).filter(
        F.col("n") >= F.col("n_articles") * CONSTANT)
    nodes = constant.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("constants"))
    return stored(seeds.select("host", "seed").join(nodes, "host"), "wrappers")


def _agreed(tree: Tree, seed: Tree) -> list[tuple[int, int]]:
    """Aligned nodes with the same text."""
    return [(i, j) for i, j in aligned(tree, seed)
            if tree.text[i] and tree.text[i] == seed.text[j]]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_template): the main text of every page, its code points, and
    how many of its texts were left out as template."""
    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                         F.col(html).cast("string").alias("html"))
    given = given.withColumn("host", host(F.col("url")))
    weight = F.octet_length("seed") + 4 * F.size("constants") + F.octet_length("host")
    joined = with_host(given, wrappers(given), weight, "left")
    kind = given.schema["page_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, left_out = [], []
            for source, seed, constants in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                page, template = parse(source), set()
                if seed is not None:
                    chosen = set(constants)
                    template = {i for i, j in _agreed(Tree(packed(page)), Tree(seed))
                                if j in chosen and page.main[i]}
                texts.append(" ".join(t for k, (t, main) in enumerate(zip(page.text, page.main))
                                      if t and main and k not in template))
                left_out.append(len(template))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(left_out, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_template"])

    return joined.select("page_id", "url", "html", "seed", "constants").mapInArrow(
        run, f"page_id {kind.simpleString()}, url string, text string, n_chars long, "
             "n_template long")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
