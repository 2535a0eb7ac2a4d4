"""CRC-32 for DuckDB, which has no such function: list steps built from the polynomial."""

from __future__ import annotations

# fixed value: the reflected polynomial of CRC-32
POLYNOMIAL = 0xEDB88320

_STEP = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END"

# a one-row relation with the 256 remainders
TABLE = f"""crc_table AS (
  WITH RECURSIVE steps AS (
    SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT i, {_STEP}, k + 1 FROM steps WHERE k < 8
  ) SELECT list(c ORDER BY i) AS remainders FROM steps WHERE k = 8
)"""


def crc32(text: str, table: str = "remainders") -> str:
    """An expression for the unsigned CRC-32 of a text's UTF-8 bytes; ``table`` names the list of remainders."""
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    folded = f"list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255)::INT + 1]))"
    return f"xor({folded}, 4294967295::BIGINT)"
