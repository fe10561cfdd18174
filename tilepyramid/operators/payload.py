"""Tile payloads: raw bytes, 16-bit cells and grey PNG (O-K1..O-K5).

This is the only per-tile Python: one Arrow batch of tile rows in, one binary column out.
Batches are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilepyramid.constants import TILE, TILE_CELLS
from tilepyramid.operators.stretch import tile_entries

PAYLOADS = ("raw", "png", "u16")
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _png_encoder(side: int = TILE):
    """Encoder of ``side`` x ``side`` bytes as an 8-bit grey PNG; self-contained for workers."""
    def encode(cells: bytes) -> bytes:
        import struct
        import zlib

        def chunk(kind: bytes, data: bytes) -> bytes:
            crc = struct.pack(">I", zlib.crc32(kind + data))
            return struct.pack(">I", len(data)) + kind + data + crc

        lines = b"".join(b"\0" + cells[k:k + side] for k in range(0, side * side, side))
        header = struct.pack(">IIBBBBB", side, side, 8, 0, 0, 0, 0)
        return (signature + chunk(b"IHDR", header)
                + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))

    signature = PNG_SIGNATURE
    return encode


def _packer(payload: str, compat: bool):
    """A pandas UDF (entries, lo, hi, blank) -> payload bytes."""
    side, png, bias, high = TILE, _png_encoder(), 0 if compat else 32768, 0 if compat else 255

    def pack(entries: pd.Series, lo: pd.Series, hi: pd.Series, blank: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for packed, low, top, unfilled in zip(entries, lo, hi, blank):
            packed = np.asarray(packed, dtype=np.int32)
            cell, value = packed & 0xFFFF, (packed >> 16) + bias
            if payload == "u16":
                canvas = np.zeros(side * side, dtype="<u2")
                canvas[cell] = value.astype("<i4").astype("<u2")
                out.append(canvas.tobytes())
                continue
            canvas = np.full(side * side, unfilled, dtype=np.uint8)
            canvas[cell] = 0
            inside = (value >= low) & (value <= top)
            if top != low:
                canvas[cell[inside]] = ((value[inside] - low) / ((top - low) / 255.0)).astype("i4")
            canvas[cell[value > top]] = high
            raw = canvas.tobytes()
            out.append(png(raw) if payload == "png" else raw)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(pack, "binary")


def pack_entries(entries: DataFrame, payload: str = "png", compat: bool = True) -> DataFrame:
    """Add ``tile_data`` to the rows of :func:`~tilepyramid.operators.stretch.tile_entries`."""
    if payload not in PAYLOADS:
        raise ValueError(f"unknown payload {payload!r}")
    packed = _packer(payload, compat)(
        F.col("entries"), F.col("lo"), F.col("hi"), F.col("blank"))
    return entries.withColumn("tile_data", packed).drop("entries")


def pack_tiles(
    cells: DataFrame, payload: str = "png", compat: bool = True, touched: DataFrame | None = None
) -> DataFrame:
    """Payload of every (tile, band) of a packed mosaic and, all zero, of ``touched`` tiles.

    All 65,536 cells of a tile are stretched: one that no scene filled holds the stretched 0.
    """
    return pack_entries(tile_entries(cells, compat, touched), payload, compat)


def blank_payload(payload: str) -> bytes:
    """Payload of a tile without data."""
    if payload == "u16":
        return bytes(2 * TILE_CELLS)
    return _png_encoder()(bytes(TILE_CELLS)) if payload == "png" else bytes(TILE_CELLS)


def payload_sum(tile_data: Column) -> Column:
    """Sum of the cell bytes of a raw or PNG payload (written here); a check on content."""
    signature, side = PNG_SIGNATURE, TILE

    def total(data: pd.Series) -> pd.Series:
        import zlib

        import numpy as np

        sums = []
        for blob in data:
            raw = bytes(blob)
            if raw.startswith(signature):
                at, idat = len(signature), b""
                while at < len(raw):
                    size = int.from_bytes(raw[at:at + 4], "big")
                    if raw[at + 4:at + 8] == b"IDAT":
                        idat += raw[at + 8:at + 8 + size]
                    at += 12 + size
                lines = np.frombuffer(zlib.decompress(idat), dtype=np.uint8)
                sums.append(int(lines.reshape(side, side + 1)[:, 1:].sum(dtype=np.int64)))
            else:
                sums.append(int(np.frombuffer(raw, dtype=np.uint8).sum(dtype=np.int64)))
        return pd.Series(sums, dtype="int64")

    return F.pandas_udf(total, "bigint")(tile_data)
