"""What the corpus operators share: stored stages, safe names, bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.stages import release, shared_dir, stored

__all__ = ["BROADCAST_BYTES", "HOT_KEYS", "ascii_lower", "crc_sql", "release", "remainder", "shared_dir", "stored", "table", "unused"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast only if it is measured to be below this many bytes.
BROADCAST_BYTES = 64 << 20
#: Keys with over 1/HOT_KEYS of all rows are split off; there can be no more than HOT_KEYS.
HOT_KEYS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_sql(keys: str) -> str:
    """DuckDB CTEs that end in crc (key, crc): the crc32 of each string in the query ``keys``."""
    return f"""WITH RECURSIVE
crc_bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS lut FROM crc_bits WHERE k = 8),
crc AS (SELECT key, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(hex(key)) // 2), lambda i: ('0x' || substr(hex(key), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(lut[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM ({keys}), crc_table)"""
