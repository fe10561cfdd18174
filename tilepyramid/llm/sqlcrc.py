"""The CRC-32 of UTF-8 texts in DuckDB SQL, for the queries that check operators."""

from __future__ import annotations

POLYNOMIAL = 0xEDB88320
#: A one-row relation holding the remainders of all bytes, made by the rule that defines them.
CRC_TABLE = f"""crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM range(256) bytes(b))"""


def crc32(text: str, table: str = "t") -> str:
    """The unsigned CRC-32 of a non-null VARCHAR expression; ``table`` is ``crc_table``'s list."""
    digit = "(strpos('0123456789ABCDEF', substr(h, {at}, 1)) - 1)"
    byte = f"({digit.format(at='k')} * 16 + {digit.format(at='k + 1')})"
    return f"""xor(4294967295, list_reduce(
      list_transform([hex(encode({text}))], lambda h:
        list_transform(range(1, length(h)::BIGINT, 2), lambda k: {byte}::BIGINT))[1],
      lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT))"""
