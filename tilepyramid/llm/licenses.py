"""License scan: exact set-similarity join of text blocks with license templates.

A template is a known license notice; blocks and templates are sets of words. A document's blocks
are its lines, and, as a notice may be wrapped anywhere, for each template every run of as many
consecutive words as its text has and one more for each word that may be missing. A block matches
where it holds at least ``THRESHOLD`` of the template's words, in any order. Words are ordered by
their frequency in the corpus, rare ones first. If a block misses too few words to fail, it must
hold one of the template's first ``size - needed + 1`` words in that order (prefix filter); it
needs at least ``needed`` distinct words (length filter), and from the first shared word on the
template must have enough words left (positional filter). What passes is counted exactly; runs are
counted by sliding over the places of the template's words, so long texts take linear time.

Phrases are found in the same way: a phrase is a template whose words are all needed and must
stand consecutively, so only documents that hold its rarest word are looked at.

Templates are given as texts with labels or as a table of them (:func:`templates_of`), which may hold
whole paragraphs. They are broadcast, so a table of more than ``TEMPLATE_BYTES`` is refused.

Defined results: a null or empty text has no words, null first and last word, empty labels and
score 0; an empty table gives no row. Lines and templates without words match nothing. Repeated rows
give equal rows; ties in frequency are broken by the word. Other columns are not looked at, whatever
their names. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilepyramid.llm.common import read
from tilepyramid.llm.textbytes import with_text_columns

THRESHOLD = 0.8
#: Lower-case ASCII letters, digits and all bytes of longer characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The phrases and labels that the contract names.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of license notices in common use, with a label for each.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "released under the mit license": "mit-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by 4 0": "cc-by-4.0-notice",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "you may not use this file except in compliance with the license": "apache-2.0-header",
    "redistribution and use in source and binary forms with or without modification are permitted":
        "bsd-grant",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation either version 2 of "
    "the license or at your option any later version": "gpl-2.0-or-later-header",
    "the above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the software": "mit-condition",
    "permission to use copy modify and or distribute this software for any purpose with or without "
    "fee is hereby granted provided that the above copyright notice and this permission notice "
    "appear in all copies": "isc-grant",
    "unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind either "
    "express or implied": "apache-2.0-warranty",
    "redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer": "bsd-source-condition",
}

#: Text and labels of all templates at most, as they are broadcast.
TEMPLATE_BYTES = 64 << 20


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # rare first
    needed: int
    reach: int  # words of a run

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[:len(self.words) - self.needed + 1]


class Index:
    """Templates and phrases, reached by the words of their prefixes."""

    def __init__(self, frequency: dict[bytes, int], templates: dict[str, str] = TEMPLATES,
                 phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> None:
        def rare_first(words):
            return tuple(sorted(set(words), key=lambda w: (frequency.get(w, 0), w)))

        self.by_word: dict[bytes, list[tuple[int, Template]]] = {}
        for text, label in templates.items():
            written = WORD.findall(_lower(text))
            words = rare_first(written)
            # the least count that reaches the threshold, safe from rounding
            needed = max(1, math.ceil(round(threshold * len(words), 9)))
            template = Template(label, words, needed, len(written) + len(words) - needed)
            for place, word in enumerate(template.prefix):
                self.by_word.setdefault(word, []).append((place, template))
        self.phrases: dict[bytes, list[tuple[list[bytes], int, str]]] = {}
        for text, label in phrases.items():
            words = WORD.findall(_lower(text))
            rarest = rare_first(words)[0]
            self.phrases.setdefault(rarest, []).append((words, words.index(rarest), label))
        self.words = frozenset(self.by_word) | frozenset(self.phrases)

    def places(self, words: list[bytes], hits: frozenset[bytes]) -> list[tuple[int, str]]:
        """(first word, label) of every place where a phrase stands."""
        found = []
        for at, word in enumerate(words):
            if word in hits:
                for phrase, inside, label in self.phrases.get(word, ()):
                    start = at - inside
                    if start >= 0 and words[start:start + len(phrase)] == phrase:
                        found.append((start, label))
        return sorted(found)

    def candidates(self, hits: Iterable[bytes]) -> Iterator[Template]:
        """The templates that share a word of their prefix and have enough words left from there."""
        first: dict[Template, int] = {}
        for word in hits:
            for place, template in self.by_word.get(word, ()):
                first[template] = min(place, first.get(template, place))
        return (t for t, place in first.items() if len(t.words) - place >= t.needed)

    def blocks(self, lines: list[bytes], hits: frozenset[bytes]) -> list[tuple[int, str, float]]:
        """(line, label, containment) of every line that meets a template's threshold."""
        found = []
        for number, line in enumerate(lines):
            block = set(WORD.findall(line))
            for template in self.candidates(hits & block):
                held = sum(w in block for w in template.words) \
                    if len(block) >= template.needed else 0
                if held >= template.needed:
                    found.append((number, template.label, held / len(template.words)))
        return sorted(found)

    def wrapped(self, lines: list[bytes], hits: frozenset[bytes]) -> list[tuple[int, str, float]]:
        """(line, label, containment) of the runs over line breaks that meet a template's threshold:
        of those whose first word of the template is in a line, the best."""
        able = list(self.candidates(hits)) if len(lines) > 1 else []
        vocabulary = {w for t in able for w in t.words}
        spots: dict[bytes, list[tuple[int, int]]] = {}  # (place, line) of each word
        at = 0
        for number, line in enumerate(lines) if able else ():
            for word in WORD.findall(line):
                if word in vocabulary:
                    spots.setdefault(word, []).append((at, number))
                at += 1
        found = []
        for template in able:
            if sum(w in spots for w in template.words) < template.needed:
                continue
            run = sorted((*spot, w) for w in template.words for spot in spots.get(w, ()))
            best: dict[int, int] = {}
            held: Counter = Counter()
            first = 0
            for place, number, word in run:
                held[word] += 1
                while run[first][0] <= place - template.reach:
                    gone = run[first][2]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    first += 1
                start = run[first][1]
                if len(held) >= template.needed and start < number:
                    best[start] = max(best.get(start, 0), len(held))
            found += [(n, template.label, k / len(template.words)) for n, k in best.items()]
        return sorted(found)


def templates_of(table: DataFrame, text: str = "text", label: str = "label") -> dict[str, str]:
    """Templates from a table of texts and labels, for :func:`scan`; rows with nulls go, and of
    several labels of one text the least stays. Fails beyond ``TEMPLATE_BYTES``."""
    rows = table.select(F.col(text).alias("text"), F.col(label).alias("label")).dropna()
    rows = rows.groupBy("text").agg(F.min("label").alias("label"))
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("label"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates, over the {TEMPLATE_BYTES} that are broadcast")
    return {r.text: r.label for r in rows.orderBy("text").collect()}


def _lower(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""


def frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each word of the templates' vocabulary occurs in all documents.

    Counted in every task and summed by Spark: the driver gets one number for each word of the
    vocabulary, which does not grow with the corpus.
    """
    wanted = frozenset(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch[text]:
                counts.update(filter(wanted.__contains__, WORD.findall(_lower(value))))
        if counts:
            yield pd.DataFrame({"word": [w.decode() for w in counts], "n": list(counts.values())})

    rows = (docs.select(text).mapInPandas(run, "word string, n long")
            .groupBy("word").agg(F.sum("n")).collect())
    return {r[0].encode(): r[1] for r in rows}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``places`` (phrase matches by first word) and
    ``blocks`` (matching lines, and lines where matching runs over line breaks begin, with label and
    containment)."""
    vocabulary = {w for t in [*templates, *phrases] for w in WORD.findall(_lower(t))}
    index = Index(frequencies(docs, vocabulary, text), templates, phrases, threshold)
    shipped = docs.sparkSession.sparkContext.broadcast(index)
    place = T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())])
    block = T.StructType([T.StructField("line", T.LongType()), T.StructField("label", T.StringType()),
                          T.StructField("containment", T.DoubleType())])
    added = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)),
        T.StructField("blocks", T.ArrayType(block))])

    def work(texts: list) -> list[list]:
        own, counts, places, blocks = shipped.value, [], [], []
        for value in texts:
            raw = _lower(value)
            words = WORD.findall(raw)
            counts.append(len(words))
            hits = own.words.intersection(words)
            places.append([{"word": p, "label": k} for p, k in own.places(words, hits)]
                          if hits else [])
            lines = raw.split(b"\n")
            blocks.append([{"line": n, "label": k, "containment": c}
                           for n, k, c in own.blocks(lines, hits) + own.wrapped(lines, hits)]
                          if hits else [])
        return [counts, places, blocks]

    return with_text_columns(docs.select(doc_id, text), text, added, work).drop(text)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = "transform(places, p -> p.label)"
    return scan(read(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words", "CAST(size(places) AS BIGINT) AS n_base",
        "array_min(transform(places, p -> p.word)) AS first_word",
        "array_max(transform(places, p -> p.word)) AS last_word",
        f"array_join(array_sort(array_distinct({base})), ',') AS base_labels",
        f"array_join(array_sort(array_distinct(concat({base}, transform(blocks, b -> b.label)))), "
        "',') AS labels",
        # a phrase is wholly contained where it stands
        "CASE WHEN size(places) > 0 THEN 1.0D "
        "ELSE coalesce(array_max(transform(blocks, b -> b.containment)), 0.0D) END AS score")


def _values(rows) -> str:
    return ", ".join(f"({', '.join(repr(x) for x in row)})" for row in rows)


SQL_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP10_SQL = f"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
doc AS (SELECT doc_id, t, regexp_extract_all(t, {SQL_WORD}) AS words FROM low),
phrase(p, label) AS (VALUES {_values(PHRASES.items())}),
place AS (
  SELECT d.doc_id, label, unnest(list_filter(range(len(words)), lambda i:
    array_to_string(words[i + 1:i + len(string_split(p, ' '))], ' ') = p)) AS spot
  FROM doc d, phrase),
base AS (
  SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word FROM place
  GROUP BY doc_id),
template(p, label) AS (VALUES {_values(TEMPLATES.items())}),
tw AS (SELECT label, p, list_distinct(string_split(p, ' ')) AS ws,
              CAST(ceil(round({THRESHOLD} * len(ws), 9)) AS BIGINT) AS needed,
              len(string_split(p, ' ')) + len(ws) - needed AS reach FROM template),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc),
block AS (SELECT doc_id, list_distinct(regexp_extract_all(l, {SQL_WORD})) AS ws FROM line),
match AS (
  SELECT doc_id, label, len(list_intersect(block.ws, tw.ws))::DOUBLE / len(tw.ws) AS containment
  FROM block, tw
  WHERE len(list_intersect(block.ws, tw.ws)) >= needed),
word AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM doc),
spot AS (
  SELECT doc_id, label, i, reach, w FROM word
  JOIN (SELECT label, reach, unnest(ws) AS w FROM tw) USING (w)),
run AS (
  SELECT a.doc_id, a.label, a.i, count(DISTINCT b.w) AS held
  FROM spot a JOIN spot b
    ON a.doc_id = b.doc_id AND a.label = b.label AND b.i > a.i - a.reach AND b.i <= a.i
  GROUP BY ALL),
runs AS (
  SELECT doc_id, label, max(held)::DOUBLE / len(tw.ws) AS containment FROM run JOIN tw USING (label)
  WHERE held >= needed GROUP BY doc_id, label, tw.ws),
label AS (
  SELECT doc_id, label, true AS is_base, CAST(1 AS DOUBLE) AS s FROM place
  UNION ALL SELECT doc_id, label, false, containment FROM match
  UNION ALL SELECT doc_id, label, false, containment FROM runs),
told AS (
  SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '')
           AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(s) AS score
  FROM label GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM doc d LEFT JOIN base USING (doc_id) LEFT JOIN told USING (doc_id)
"""
