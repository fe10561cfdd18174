"""Vectorised work on batches of UTF-8 texts inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tilepyramid.llm.common import BATCH_BYTES, importable

CHUNK_BYTES = 1 << 20
GRAM_FACTOR = np.uint32(0x9E3779B1)


def chunks(texts: Iterable, limit: int = CHUNK_BYTES, most: int | None = None) -> Iterator[list[bytes]]:
    """Texts as bytes (null: empty) in order, cut into lists of about ``limit`` bytes and of ``most``
    texts.

    A longer text is a list of its own: it is never cut.
    """
    held, size = [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if held and (size + len(raw) > limit or len(held) == most):
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def joined(raws: list[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by ``gap``, as one array, and the text number of each byte."""
    flat = np.frombuffer(gap.join(raws) + gap, dtype=np.uint8)
    lengths = np.array([len(r) + len(gap) for r in raws])
    return flat, np.repeat(np.arange(len(raws), dtype=np.int64), lengths)


def gram_counts(flat: np.ndarray, owner: np.ndarray, n: int, sizes: tuple[int, ...],
                bits: int) -> np.ndarray:
    """Hashed byte n-gram counts of each text, float32 of shape (n, 2**bits).

    Texts are followed by a gap in ``flat``; a gram that reaches into the next text is not counted,
    so a text's counts do not depend on its neighbours.
    """
    out = np.zeros(n << bits, dtype=np.float32)
    wide = flat.astype(np.uint32)
    for size in sizes:
        if len(wide) < size:
            continue
        gram = np.full(len(wide) - size + 1, size, dtype=np.uint32)
        for k in range(size):
            gram = gram * np.uint32(257) + wide[k:len(wide) - size + 1 + k]
        gram *= GRAM_FACTOR
        gram >>= np.uint32(32 - bits)
        inside = owner[:len(gram)] == owner[size - 1:]
        cells = ((owner[:len(gram)] << bits) + gram)[inside]
        out += np.bincount(cells, minlength=n << bits).astype(np.float32)
    return out.reshape(n, 1 << bits)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts, each row scaled to length one; an empty row stays zero."""
    rooted = np.sqrt(counts)
    norms = np.sqrt((rooted * rooted).sum(axis=1, keepdims=True))
    return rooted / np.maximum(norms, 1e-9)


def slices(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of about ``limit`` bytes or of one row."""
    step = max(1, batch.num_rows * limit // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def with_text_columns(df: DataFrame, text: str, added: T.StructType,
                      work: Callable[[list], list[list]]) -> DataFrame:
    """``df`` with columns that ``work`` makes from the texts of a part of a batch, one list each.

    Every other column passes through as it is; columns with an added name are replaced.
    """
    importable(df.sparkSession)
    names = [f.name for f in added]
    kept = df.select(*[c for c in df.columns if c not in names or c == text])
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(m, type=t) for m, t in zip(made, types, strict=True)]],
                    names=[*part.schema.names, *names])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added.fields]))
