"""Quality classifier by co-training two views.

The text view sees hashed byte n-grams of the whole text, the metadata view the document's source,
language, stored length and layout (line count, line length, shares of letters, capitals, digits,
marks and repeated lines). Each view has its own logistic classifier. In every round both
classifiers, calibrated, label all unlabelled documents in one Spark scan, and the rows of which one
is most sure train the other. Then each view is calibrated on labelled rows kept out of training,
and the two calibrated log-odds are added, less the prior's, to score all documents.

What one view is sure of reaches the other as sums: the learner's features of all rows of one
(teacher, label, band of the teacher's confidence, cell of the learner's feature space) are added
up where they are scanned and merged by a shuffle, in whole numbers, so that neither order nor a
repeated task changes them. Bands are taken from the surest down until ``PASSED`` of the
unlabelled rows, dealt to the classes by their share, have passed; the threshold thus follows from
counts of all rows. The learner trains on the cells' means, weighted by their rows; pseudo-labels
of a class weigh ``TRUST`` times its labelled rows at any corpus size.

Only the labelled rows that the driver fits on are a sample, of at most about ``MAX_LABELLED`` rows
drawn by a hash of the id; the bound is a parameter. No unlabelled row is left out of a round.

Defined results: a null text counts as empty, a null source, language or length as a value of its
own; documents without a label are scored like the others; several labels of one document are each
a training row; a null label is none; without labelled rows of both classes every score is the share
of good labels, or 0.5 without labels. Without unlabelled rows the views learn from labels alone.
Repeated rows give equal rows, an empty table no rows; other columns, whatever their names, are not
read. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilepyramid.llm.common import read, stored
from tilepyramid.llm.textbytes import chunks, gram_counts, joined, scaled

BITS = 11
GRAMS = (1, 2, 3)
MAX_LABELLED = 2_000
ROUNDS = 3
#: Share of the unlabelled rows that a view passes to the other in a round (whole bands of
#: confidence), how sure it must be at least, and what the passed rows of a class weigh.
PASSED = 0.2
SURE = 0.9
TRUST = 1.0
#: Bands of log-odds from SURE up, their width, and planes that cut the learner's features in cells.
BANDS = 12
BAND_WIDTH = 0.5
PLANES = 2
#: Features are added up as whole multiples of this.
UNIT = 2.0 ** -16
#: Labelled ids up to which they are broadcast to take them out of the unlabelled rows.
BROADCAST_IDS = 500_000
META_HASHED = 128
CLASSES = np.array([
    1 if 0x61 <= b <= 0x7A or b >= 0x80 else 2 if 0x41 <= b <= 0x5A else 3 if 0x30 <= b <= 0x39
    else 0 if b in b" \t\r\n" else 4 for b in range(256)], dtype=np.int64)


@dataclass(frozen=True)
class View:
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (x @ self.weights) + self.shift


@dataclass(frozen=True)
class Model:
    text: View | None
    meta: View | None
    prior: float  # log-odds
    share: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def text_view(raws: list[bytes]) -> np.ndarray:
    flat, owner = joined(raws, b"\n\n")
    x = scaled(gram_counts(flat, owner, len(raws), GRAMS, BITS))
    return np.hstack([x, np.ones((len(raws), 1), dtype=np.float32)])


def _slot(kind: str, value) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % META_HASHED


def meta_view(raws: list[bytes], langs: list, sources: list, lengths: list) -> np.ndarray:
    out = np.zeros((len(raws), META_HASHED + 9), dtype=np.float32)
    for k, raw in enumerate(raws):
        length = lengths[k]
        size = "null" if length is None else int(np.log2(max(int(length), 0) + 1) * 2)
        for kind, value in (("lang", langs[k]), ("source", sources[k]), ("size", size)):
            out[k, _slot(kind, value)] += 1
        lines = raw.split(b"\n")
        shares = np.bincount(CLASSES[np.frombuffer(raw, dtype=np.uint8)], minlength=5) / max(
            len(raw), 1)
        out[k, META_HASHED:] = [*shares * 4, np.log1p(len(lines)) / 4,
                                np.log1p(len(raw) / len(lines)) / 4,
                                2 - 2 * len(set(lines)) / len(lines), 1]
    return out


def logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray | None = None, rounds: int = 250,
             decay: float = 1e-5) -> np.ndarray:
    """Weights by gradient steps with momentum, both classes weighing the same; ``mass`` is what
    each row weighs in its class."""
    mass = np.ones(len(y)) if mass is None else mass
    good = y > 0.5
    weight = np.where(good, 0.5 / max(mass[good].sum(), 1e-9), 0.5 / max(mass[~good].sum(), 1e-9))
    weight = (weight * mass).astype(np.float32)
    rate = 4.0 / max(float((weight[:, None] * x * x).sum()), 1e-6)
    w = np.zeros(x.shape[1], dtype=np.float32)
    pace = np.zeros_like(w)
    for _ in range(rounds):
        pull = x.T @ (weight * (y - _sigmoid(x @ w)).astype(np.float32)) - decay * w
        pace = 0.9 * pace + rate * pull
        w += pace
    return w


def calibrated(weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> View:
    """Platt scaling on rows that were kept out of training."""
    margin = x @ weights
    scale = float(np.abs(margin).mean()) or 1.0
    z = np.stack([margin / scale, np.ones_like(margin)], axis=1)
    # smoothed targets, so that separable rows do not call for endless confidence
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([1.0, 0.0])
    for _ in range(100):
        p = _sigmoid(z @ a)
        curve = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, z.T @ (target - p))
        a += np.clip(step, -1, 1)
    return View(weights, max(float(a[0]), 0.0) / scale, float(a[1]))


#: (teacher, label, band, cell): rows, and the sums of the learner's features in UNITs.
Sums = dict[tuple[int, int, int, int], tuple[int, np.ndarray]]


def _planes(size: int) -> np.ndarray:
    return np.random.default_rng(size).normal(size=(size, PLANES)).astype(np.float32)


def add_sums(held: Sums, teachers: tuple[View, View], rows: tuple[np.ndarray, np.ndarray]) -> None:
    """Add to ``held`` what each teacher is sure of among ``rows``."""
    least = np.log(SURE / (1 - SURE))
    for k in (0, 1):
        odds, other = teachers[k].log_odds(rows[k]), rows[1 - k]
        if not teachers[k].slope:  # knows nothing but the share of good rows
            continue
        sure = np.flatnonzero(np.abs(odds) >= least)
        if not len(sure):
            continue
        x = other[sure]
        band = np.minimum((np.abs(odds[sure]) - least) / BAND_WIDTH, BANDS - 1).astype(np.int64)
        cell = (x @ _planes(x.shape[1]) > 0) @ (1 << np.arange(PLANES))
        key = ((odds[sure] > 0) * BANDS + band << PLANES) + cell
        order = np.argsort(key, kind="stable")
        keys, starts = np.unique(key[order], return_index=True)
        counts = np.diff(np.append(starts, len(order)))
        totals = np.add.reduceat(np.rint(x[order] / UNIT).astype(np.int64), starts, axis=0)
        for code, n, total in zip(keys.tolist(), counts.tolist(), totals, strict=True):
            label, rest = divmod(code, BANDS << PLANES)
            _add(held, (k, label, rest >> PLANES, rest & (1 << PLANES) - 1), n, total)


def _add(held: Sums, key: tuple, n: int, total: np.ndarray) -> None:
    if key in held:
        n += held[key][0]
        total = total + held[key][1]
    held[key] = (n, total)


def passed(sums: Sums, teacher: int, label: int, wanted: float) -> list[tuple[int, np.ndarray]]:
    """(rows, mean) of the cells in the teacher's surest bands, down to the one with which
    ``wanted`` rows have passed."""
    out, taken = [], 0
    for band in range(BANDS - 1, -1, -1):
        cells = [sums[key] for key in sorted(sums) if key[:3] == (teacher, label, band)]
        if cells and taken < wanted:
            out += [(n, (total * (UNIT / n)).astype(np.float32)) for n, total in cells]
            taken += sum(n for n, _ in cells)
    return out


def cotrained(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, check: np.ndarray, free: int,
              label_all: Callable[[tuple[View, View]], Sums],
              rounds: int = ROUNDS) -> tuple[View, View]:
    """The calibrated views after ``rounds`` in which ``label_all`` gives the sums of what two
    teachers are sure of among the ``free`` unlabelled rows; ``check`` marks the labelled rows kept
    for calibration."""
    good = float(y.mean())
    own = y[~check]

    def fitted(sums: Sums) -> tuple[View, View]:
        out = []
        for k in (0, 1):
            x, target, mass = views[k][~check], own, np.ones(len(own))
            for label, share in ((1, good), (0, 1 - good)):
                taught = passed(sums, 1 - k, label, PASSED * share * free)
                if taught:
                    rows = np.array([n for n, _ in taught], dtype=np.float64)
                    x = np.vstack([x, *[mean for _, mean in taught]])
                    target = np.append(target, np.full(len(rows), float(label)))
                    mass = np.append(mass, rows / rows.sum() * TRUST * (own == label).sum())
            out.append(calibrated(logistic(x, target, mass), views[k][check], y[check]))
        return tuple(out)

    model = fitted({})
    for _ in range(rounds if free else 0):
        model = fitted(label_all(model))
    return model


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, check: np.ndarray,
            pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> tuple[View, View]:
    """:func:`cotrained` with the unlabelled rows' features in memory."""
    def label_all(teachers: tuple[View, View]) -> Sums:
        held: Sums = {}
        add_sums(held, teachers, pool)
        return held

    return cotrained(views, y, check, len(pool[0]), label_all, rounds)


COLUMNS = ("text", "lang", "source", "n_chars")


def _both(rows: list) -> tuple[np.ndarray, np.ndarray]:
    texts, metas, at = [], [], 0
    for raws in chunks([r["text"] for r in rows]):
        part = rows[at:at + len(raws)]
        at += len(raws)
        texts.append(text_view(raws))
        metas.append(meta_view(raws, *[[r[c] for r in part] for c in COLUMNS[1:]]))
    if not rows:
        return np.zeros((0, (1 << BITS) + 1), np.float32), np.zeros((0, META_HASHED + 9), np.float32)
    return np.vstack(texts), np.vstack(metas)


def sums_of(unlabelled: DataFrame, teachers: tuple[View, View]) -> Sums:
    """What the teachers are sure of among all rows: added up within each task, then by key."""
    shipped = unlabelled.sparkSession.sparkContext.broadcast(teachers)
    names = ["teacher", "label", "band", "cell"]
    schema = f"{', '.join(f'{n} int' for n in names)}, n long, total array<long>"

    def rows(held: Sums) -> pa.RecordBatch:
        keys = list(zip(*held)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [*[pa.array(k, pa.int32()) for k in keys], pa.array([n for n, _ in held.values()], pa.int64()),
             pa.array([t for _, t in held.values()], pa.list_(pa.int64()))], names=[*names, "n", "total"])

    def label(batches):
        held: Sums = {}
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in COLUMNS}
            at = 0
            for raws in chunks(cols["text"]):
                part = slice(at, at + len(raws))
                at += len(raws)
                metas = meta_view(raws, *[cols[c][part] for c in COLUMNS[1:]])
                add_sums(held, shipped.value, (text_view(raws), metas))
        yield rows(held)

    def merge(batches):
        held: Sums = {}
        for batch in batches:
            keys = zip(*[batch.column(n).to_pylist() for n in names])
            totals = batch.column("total")
            for k, (key, n) in enumerate(zip(keys, batch.column("n").to_pylist())):
                _add(held, key, n, totals[k].values.to_numpy())
        yield rows(held)

    parts = unlabelled.select(*COLUMNS).mapInArrow(label, schema)
    merged = parts.repartition(*names).mapInArrow(merge, schema).collect()  # 2 x 2 x 12 x 4 at most
    shipped.unpersist()
    return {tuple(r[n] for n in names): (r["n"], np.array(r["total"], dtype=np.int64)) for r in merged}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          max_labelled: int = MAX_LABELLED) -> Model:
    """A model from ``docs`` (doc_id, text, lang, source, n_chars) and ``labels`` (doc_id,
    label)."""
    labels = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("y"))
    labels = labels.filter(F.col("y").isNotNull() & F.col("_id").isNotNull())
    count, share = labels.agg(F.count(F.lit(1)), F.avg((F.col("y") > 0.5).cast("double"))).first()
    if not count or share in (0.0, 1.0):
        return Model(None, None, 0.0, 0.5 if share is None else share)
    draw = F.pmod(F.xxhash64("_id", F.lit("co")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    some = F.broadcast(labels.filter(draw < max_labelled / count).limit(2 * max_labelled))
    slim = docs.select("doc_id", *COLUMNS)
    known = slim.join(some, slim["doc_id"] == F.col("_id")).select("doc_id", *COLUMNS, "y").limit(
        4 * max_labelled).collect()  # rows of one id may be many
    known.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r)))
    y = np.array([float(r["y"] > 0.5) for r in known])
    check = np.arange(len(known)) % 3 == 0
    if not all(0 < part.sum() < len(part) for part in (y[check], y[~check])):
        return Model(None, None, 0.0, share)
    ids = labels.select("_id").distinct()
    if count <= BROADCAST_IDS:
        unlabelled = slim.join(F.broadcast(ids), slim["doc_id"] == F.col("_id"), "left_anti")
    else:  # texts are shuffled once, not in each round
        unlabelled = stored(slim.join(ids, slim["doc_id"] == F.col("_id"), "left_anti"), "unlabelled")
    free = unlabelled.select("doc_id").count()
    text, meta = cotrained(_both(known), y, check, free, lambda t: sums_of(unlabelled, t))
    prior = (y[check].sum() + 1) / (check.sum() + 2)
    return Model(text, meta, float(np.log(prior / (1 - prior))), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_score, meta_score, score, quality) of every row of ``docs``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], *[
        T.StructField(n, T.DoubleType()) for n in ("text_score", "meta_score", "score")],
        T.StructField("quality", T.IntegerType())])

    def run(batches):
        model = shipped.value
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in COLUMNS}
            out, at = [], 0
            for raws in chunks(cols["text"]):
                part = slice(at, at + len(raws))
                at += len(raws)
                if model.text is None:
                    flat = np.full(len(raws), model.share)
                    out.append(np.stack([flat, flat, flat]))
                    continue
                a = model.text.log_odds(text_view(raws))
                b = model.meta.log_odds(meta_view(raws, *[cols[c][part] for c in COLUMNS[1:]]))
                out.append(np.stack([_sigmoid(a), _sigmoid(b), _sigmoid(a + b - model.prior)]))
            told = np.hstack(out) if out else np.zeros((3, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(t, pa.float64()) for t in told],
                 pa.array(told[2] >= 0.5).cast(pa.int32())],
                names=["doc_id", "text_score", "meta_score", "score", "quality"])

    return docs.select("doc_id", *COLUMNS).mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
