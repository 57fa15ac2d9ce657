"""Exact duplicates by two passes over a partitioned Bloom filter.

Pass 1 hashes every text once and counts how many rows set each bit of a Bloom filter;
the filter keeps the bits that at least two rows set.  What pass 1 sends on is bit numbers,
combined in each task, and never a row or a text; since a task's bits lie scattered over a
filter that grows with the corpus, numbers are smaller than the bitmaps of all slices a task
touches.  Pass 2 tests every row: if one of
its bits was set by that row alone, no other row has its text, and it goes straight
through.  Only the others, the repeated rows and a few false hits, are grouped by digest.

The filter has a fixed number of bits a row, so it grows with the corpus.  It is kept as
4 KB slices and broadcast only while its measured size is below ``broadcast_bytes``;
beyond that rows meet their slices in a shuffle join, with the same result.  Groups
holding over 1/1024 of the candidates (at most 1024 such groups, whatever the input) join
by broadcast, so no task gathers the members of a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_BYTES, HOT_KEYS, ascii_lower, stored, unused

_SLICE_BITS, _SLICE_BYTES = 32768, 4096


def _bit(digest: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(bits)) + 1


def _is_set(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (position % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def repeated_bits(digests: DataFrame, column: str, bits: int, hashes: int = 2) -> DataFrame:
    """Slices (bucket, bitmap) of the Bloom filter of bits that two rows or more set."""
    each = F.explode(F.array(*[_bit(F.col(column), j, bits) for j in range(hashes)])).alias("bit")
    often = digests.select(each).groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return often.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = 16,
    hashes: int = 2,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Groups rows whose texts are equal after lower-casing A-Z only.

    Returns one row per input row: ``id_col``, ``keep_id`` (largest id of the group),
    ``group_size``, ``kept``, ``text_sha256``.  Null text counts as empty.  A null id
    never beats another id; in a group without any id, keep_id is null and all are kept.
    Rows repeated with the same id and text are one record: all carry the same ``kept``.
    Other columns of the input are ignored, whatever their names.  An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256)).alias("digest"))
    rows = stored(rows, "digests")
    n = rows.count()
    bits = _SLICE_BITS
    while bits < n * bits_per_row:
        bits *= 2
    slices = stored(repeated_bits(rows, "digest", bits, hashes), "bloom")
    small = slices.count() * _SLICE_BYTES <= broadcast_bytes

    tested = rows
    for j in range(hashes):
        bit = _bit(F.col("digest"), j, bits)
        tested = tested.withColumns({"bucket": F.bitmap_bucket_number(bit), "position": F.bitmap_bit_position(bit)})
        tested = tested.join(F.broadcast(slices) if small else slices, "bucket", "left")
        tested = tested.withColumn(f"hit{j}", _is_set(F.col("bitmap"), F.col("position"))).drop("bucket", "position", "bitmap")
    hit = F.lit(True)
    for j in range(hashes):
        hit = hit & F.col(f"hit{j}")
    tested = stored(tested.select("id", "digest", hit.alias("maybe")), "tested")

    maybe = tested.where("maybe").select("id", "digest")
    groups = stored(maybe.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    many = max(1, maybe.count() // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col("group_size") > many))
    cold = groups.where(F.col("group_size") <= many)
    single = tested.where("not maybe").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    found = single.unionByName(maybe.join(hot, "digest")).unionByName(maybe.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input rows, all columns as they are, that ``exact_dedup`` keeps, once each.

    Rows whose id is null or not unique are told apart by their digest, and of rows with
    the same id and text one stays.  All other rows are matched by id alone, against the
    dropped ids; these are broadcast while measured to be few.
    """
    key, sha = unused(docs, "copy_id"), unused(docs, "copy_sha")
    found = stored(exact_dedup(docs, id_col, text_col, **options).select(F.col(id_col).alias(key), "kept", F.col("text_sha256").alias(sha)), "copies")
    odd = stored(found.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) & F.col(key).isNotNull()).select(key), "odd_ids")
    gone = stored(found.where(~F.col("kept") & F.col(key).isNotNull()).join(odd, key, "left_anti").select(key), "gone")
    fit = lambda df: F.broadcast(df) if df.count() * 16 <= BROADCAST_BYTES else df
    gone, odd = fit(gone), fit(odd)
    same = F.col(id_col) == F.col(key)
    plain = docs.where(F.col(id_col).isNotNull()).join(gone, same, "left_anti").join(odd, same, "left_anti")
    rest = docs.where(F.col(id_col).isNull()).unionByName(docs.join(odd, same, "left_semi"))
    own = unused(docs, "own_sha")
    rest = rest.withColumn(own, F.sha2(ascii_lower(F.col(text_col)).cast("binary"), 256))
    stays = found.where("kept").select(key, sha).distinct()
    rest = rest.join(stays, F.col(own).eqNullSafe(F.col(sha)) & F.col(id_col).eqNullSafe(F.col(key)), "left_semi").dropDuplicates([id_col, own])
    return plain.unionByName(rest.drop(own))


SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
