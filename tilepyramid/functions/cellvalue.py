"""Cell value encodings (O-P15, O-P16 and the 16-bit wrap of unsigned samples)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_byte(v: Column) -> Column:
    return F.when(v > 127, v - 256).otherwise(v)


def unsigned_byte(v: Column) -> Column:
    return F.when(v < 0, v + 256).otherwise(v)


def signed_bytes(cells: Column) -> Column:
    return F.transform(cells, signed_byte)


def unsigned_bytes(cells: Column) -> Column:
    return F.transform(cells, unsigned_byte)


def sample(v: Column, compat: bool = True) -> Column:
    """A 16-bit unsigned sample as it is compared and stored: ``compat`` wraps it to signed."""
    return (v + 32768).bitwiseAND(0xFFFF) - 32768 if compat else v
