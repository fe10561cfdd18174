"""Language ID by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed letter n-grams predicts each bit.
A document goes to the codeword with the least loss, each bit weighted by how well its classifier
did in training; a small lead over the second codeword marks the document as ambiguous.

The pipeline's stage also rejects documents that are near no codeword: those whose weighted loss to
the nearest one exceeds a bound. The bound is the worst loss of the training rows, each told by
classifiers fitted on the other half of them, so that documents of the known languages stay; it is
never below ``LEAST_BOUND``. With under ``MIN_CALIBRATION`` training rows or one language there is no
bound.

Defined results: a null text or one without a letter (Unicode category L) is ``und`` with score 0 and not ambiguous;
with no learned language every document is ``und``; with one, every document with a letter is that
language with score 1. A null doc_id is not held out. Repeated rows give equal rows. Ties between
codewords go to the language that sorts first. Texts are read whole, whatever their length. Only
the columns named by parameters are read; others pass through :func:`identify` untouched, and
through the stage whatever their names. An empty table gives no row.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilepyramid.llm.common import free_names, read
from tilepyramid.llm.textbytes import chunks, gram_counts, joined, scaled, with_text_columns

UNDETERMINED = "und"
BITS = 12
GRAMS = (2, 3)
#: The classifiers are fitted on about so many labelled rows, shared among the languages.
MAX_TRAINING_ROWS = 2_400
#: A lead of less than this share of probability marks a document as ambiguous.
AMBIGUOUS_BELOW = 0.2
ROUNDS = 120
MIN_CALIBRATION = 100
#: Texts whose features a task holds at once: 2**BITS numbers each, however short they are.
CHUNK_TEXTS = 256
#: Half of the loss of a classifier that knows nothing.
LEAST_BOUND = float(np.log(2)) / 2
#: Bytes that are not ASCII letters nor part of a longer character count as a space.
LETTERS_ONLY = np.array(
    [b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
     for b in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # (languages, bits) of +-1
    weights: np.ndarray  # (features + 1, bits)
    trust: np.ndarray  # (bits,)
    bound: float = np.inf  # of the loss, beyond which a text is in no learned language


def features(raws: list[bytes]) -> np.ndarray:
    flat, owner = joined(raws, b"   ")
    x = scaled(gram_counts(LETTERS_ONLY[flat], owner, len(raws), GRAMS, BITS))
    return np.hstack([x, np.ones((len(raws), 1), dtype=np.float32)])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of +-1 per language: every split in two for up to 5 languages, else 15*log2(n)
    random splits, of which no column is constant."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=float).T
    rng = np.random.default_rng(seed)
    width = int(np.ceil(15 * np.log2(n)))
    best = None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1
        apart = min(np.sum(a != b) for a, b in itertools.combinations(code, 2))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def fit(texts: list[str | None], langs: list[str]) -> Model:
    """Logistic classifiers for all bits at once by gradient steps with momentum."""
    languages = tuple(sorted(set(langs)))
    codes = codewords(len(languages))
    x = np.vstack([features(c) for c in chunks(texts)]) if texts else np.zeros((0, (1 << BITS) + 1))
    x = x.astype(np.float32)
    rank = np.array([languages.index(lang) for lang in langs], dtype=int)
    target = codes[rank].astype(np.float32)
    share = np.bincount(rank, minlength=len(languages)).astype(np.float32)
    row_weight = (1 / share[rank] / len(languages))[:, None] if len(rank) else np.zeros((0, 1))
    w = np.zeros((x.shape[1], codes.shape[1]), dtype=np.float32)
    pace = np.zeros_like(w)
    for _ in range(ROUNDS if codes.shape[1] else 0):
        pull = target / (1 + np.exp(np.clip(target * (x @ w), -30, 30))) * row_weight
        pace = 0.9 * pace + 4.0 * (x.T @ pull - 1e-5 * w)
        w += pace
    hits = (np.sign(x @ w) == target).mean(axis=0) if codes.shape[1] else np.zeros(0)
    error = np.clip(1 - hits, 0.01, 0.49)
    return Model(languages, codes, w, np.log((1 - error) / error))


def losses(model: Model, x: np.ndarray) -> np.ndarray:
    """(rows, languages): loss of each bit for each codeword, weighted and averaged."""
    margin = x @ model.weights
    loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * model.codes, -30, 30)))
    return (loss * model.trust).sum(axis=2) / model.trust.sum()


def bound(texts: list[str | None], langs: list[str]) -> float:
    """The worst loss of the rows, each under a model of the other half of them."""
    if len(texts) < MIN_CALIBRATION or len(set(langs)) < 2:
        return np.inf
    worst = LEAST_BOUND
    for k in (0, 1):
        model = fit(texts[k::2], langs[k::2])
        if len(model.languages) < 2:
            return np.inf
        for raws in chunks(texts[1 - k::2]):
            worst = max(worst, float(losses(model, features(raws)).min(axis=1).max()))
    return worst


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword by weighted loss, its probability, and its lead."""
    if len(model.languages) == 1:
        one = np.ones(len(x))
        return np.zeros(len(x), dtype=int), one, one
    margin = x @ model.weights
    loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * model.codes, -30, 30)))
    near = -(loss * model.trust).sum(axis=2) / model.trust.mean()
    p = np.exp(near - near.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    top = p.argmax(axis=1)
    ordered = np.sort(p, axis=1)
    return top, ordered[:, -1], ordered[:, -1] - ordered[:, -2]


def predict(model: Model, texts) -> list[list]:
    langs, scores, unsure = [], [], []
    for raws in chunks(texts, most=CHUNK_TEXTS):
        # isalpha is true of the Unicode categories L*, as \p{L} is
        lettered = [any(map(str.isalpha, r.decode("utf-8", "replace"))) for r in raws]
        if model.languages:
            x = features(raws)
            top, score, lead = decode(model, x)
            if model.bound < np.inf:
                near = losses(model, x).min(axis=1) <= model.bound
                lettered = [ok and bool(n) for ok, n in zip(lettered, near, strict=True)]
        for k, ok in enumerate(lettered):
            known = ok and bool(model.languages)
            langs.append(model.languages[top[k]] if known else UNDETERMINED)
            scores.append(float(score[k]) if known else 0.0)
            unsure.append(bool(known and lead[k] < AMBIGUOUS_BELOW))
    return [langs, scores, unsure]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          max_rows: int = MAX_TRAINING_ROWS, bounded: bool = False) -> Model:
    """A model from about ``max_rows`` rows of ``labelled``.

    Each language gives an equal share at most, taken by a hash of the id, so rare languages are
    not lost. Nulls in ``lang`` are left out, as are texts without a letter. A ``bounded`` model
    finds texts of no learned language ``und``.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(
        F.desc("count"), lang).limit(max_rows).collect()}
    each = max_rows / max(1, len(counts))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))]) \
        if counts else None
    if share is None:
        return fit([], [])
    draw = F.pmod(F.xxhash64(doc_id), F.lit(1_000_003)) / F.lit(1_000_003.0)
    some = rows.filter(draw < share[F.col(lang)]).select(text, lang).limit(2 * max_rows).collect()
    some.sort(key=lambda r: (r[1], r[0]))
    texts, langs = [r[0] for r in some], [r[1] for r in some]
    model = fit(texts, langs)
    return replace(model, bound=bound(texts, langs)) if bounded else model


def identify(docs: DataFrame, model: Model, text: str = "text",
             names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` with the predicted language, its score and whether it is ambiguous, as ``names``
    (columns of these names are replaced)."""
    added = T.StructType([T.StructField(n, t) for n, t in zip(
        names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True)])
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    return with_text_columns(docs, text, added, lambda texts: predict(shipped.value, texts))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2,
                      F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(slim, model).drop("text")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents whose language can be told; those found ``und`` go, which are texts without
    letters and texts of no learned language."""
    model = train(docs.filter(~held_out(F.col("doc_id"))), bounded=True)
    names = free_names(docs, "lang_pred", "score", "ambiguous")
    return (identify(docs, model, names=names).filter(F.col(names[0]) != UNDETERMINED)
            .select(*docs.columns))
