"""Uniform draws from keyed digests, in built-in expressions that SQL engines share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(name: str) -> Column:
    """A column as text; null counts as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def draw(*parts: Column | str) -> Column:
    """A number in (0, 1), fixed by the parts: 52 bits of their md5."""
    joined = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def draw_sql(*parts: str) -> str:
    """The same in DuckDB's dialect; every part is an SQL text expression."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r})"


def crc_table_sql() -> str:
    """CTE ``crc(crc_table)`` in DuckDB's dialect: the 256 entries of the CRC-32 table, made by its rule."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    entry = "i::BIGINT"
    for _ in range(8):
        entry = f"(SELECT {step} FROM (SELECT {entry} AS c))"
    return f"crc AS (SELECT list(entry ORDER BY i) AS crc_table FROM (SELECT i, {entry} AS entry FROM range(256) AS s(i)))"


def crc_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text expression; ``crc_table`` must be in scope."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode({text}))::BIGINT), "
        f"lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)), "
        "lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295)"
    )
