"""Exact deduplication by two-pass Bloom filtering (DataFrame functions only).

Texts are read and hashed once, to a written table of narrow keys (id, text
hash, SHA-256 of the normalised text, length).  Pass 1 sets ``HASHES`` bits per
digest in a blocked Bloom filter and keeps the bits that were set more than
once; bits are summed with partial aggregation.  Pass 2 tests each key against
those: a key with a bit that was set once is certainly unique and passes
straight through; only the others shuffle, to be grouped by their whole digest,
so false positives cost a little shuffle and never a wrong result.  The texts
themselves are joined with what goes, where they lie (:func:`join_in_place`).

The filter grows with the rows (``BITS_PER_ROW``).  All bits of a digest lie in
one block of 4 KB, so a filter over ``BROADCAST_BYTES`` is matched by a join of
keys and blocks, without any other change; texts never take part in that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, delete_space, without_rows

BITS_PER_ROW = 16
HASHES = 3
#: Bits of one block, a bitmap made by ``bitmap_construct_agg`` (4096 bytes).
BLOCK_BITS = 32768

SHA, LEN, HASH = "__sha", "__len", "__hash"


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written keys (id, __hash, __sha, __len) of all rows: hash of the text, digest of it without ASCII white space, code points; null is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(delete_space(text).cast("binary"), 256)
    return cut(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias(HASH), digest.alias(SHA), F.char_length(text).cast("long").alias(LEN)))


def filter_blocks(rows: int) -> int:
    """Blocks of the filter for so many rows: a power of two."""
    return 1 << max(0, (max(rows, 1) * BITS_PER_ROW - 1).bit_length() - 15)


def _block(blocks: int) -> Column:
    return F.xxhash64(F.col(SHA)).bitwiseAND(F.lit(blocks - 1))


def _places() -> list[Column]:
    """The digest's bits in its block."""
    other = F.xxhash64(F.col(SHA), F.lit(1))
    return [F.shiftrightunsigned(other, 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(HASHES)]


def repeated_bits(keys: DataFrame, blocks: int) -> DataFrame:
    """Bits set by two rows or more, as (block, 4 KB bitmap)."""
    slots = F.array(*[F.shiftleft(_block(blocks), 15).bitwiseOR(p) for p in _places()])
    twice = keys.select(F.explode(slots).alias("slot")).groupBy("slot").count().filter("count > 1")
    return twice.groupBy(F.shiftright("slot", 15).alias("block")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(BLOCK_BITS - 1))).alias("bitmap")
    )


def _bit_is_set(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), place.bitwiseAND(F.lit(7)).cast("int")) == 1


def split_by_filter(keys: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(keys that may have an equal, keys that have none)."""
    blocks = filter_blocks(rows)
    bits = cut(repeated_bits(keys, blocks))
    if blocks * (BLOCK_BITS // 8) <= BROADCAST_BYTES:
        bits = F.broadcast(bits)
    on = _block(blocks) == bits["block"]
    for place in _places():
        on = on & _bit_is_set(bits["bitmap"], place)
    return keys.join(bits, on, "left_semi"), keys.join(bits, on, "left_anti")


def best_of_groups(maybe: DataFrame) -> DataFrame:
    """(__g, best, group_size) of each digest: the longest original, then the smallest id (null after all), then the smallest text hash.

    Copies are summed before they travel.  The result is written, which lets
    the adaptive planner split a hot digest on the other side of a join.
    """
    counted = maybe.groupBy(SHA, LEN, "id", HASH).agg(F.count("*").alias("n"))
    first = F.min(F.struct((-F.col(LEN)).alias("neg"), F.col("id").isNull().alias("no_id"), "id", F.col(HASH).alias("hash"), "n"))
    return cut(counted.groupBy(F.col(SHA).alias("__g")).agg(first.alias("best"), F.sum("n").alias("group_size")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: one for each distinct text.

    Texts are equal when they are so without ASCII white space; null is empty.
    The longest original stays, then the smallest id, a null id after all
    others; of rows equal in id and text one stays.  An empty table gives an
    empty one.  No text is shuffled but those of rows given several times.
    """
    keys = keys_of(docs, id_col, text_col)
    maybe, _ = split_by_filter(keys, keys.count())
    best = best_of_groups(maybe).filter("group_size > 1")
    each = maybe.groupBy(SHA, "id", HASH).agg(F.count("*").alias("n"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col(HASH) == F.col("best.hash"))
    verdict = each.join(best, each[SHA] == best["__g"]).select(F.col("id").alias("__id"), F.col(HASH).alias("__h"), stays.alias("__stays"), "n")
    return without_rows(docs, cut(verdict.filter("not __stays or n > 1").drop("n")), id_col, text_col)


def exact_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, dropped ones too, read once: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty ones and are equal to these; a null id stays only
    where its group has no other.  Rows equal in length, id and normalised text
    are one document given several times: all carry ``kept``.  An empty table
    gives an empty report.
    """
    keys = keys_of(docs, id_col, text_col)
    maybe, alone = split_by_filter(keys, keys.count())
    best = best_of_groups(maybe)
    kept = (F.col(LEN) == -F.col("best.neg")) & F.col("id").eqNullSafe(F.col("best.id"))
    out = ("keep_id", "group_size", "kept")
    grouped = maybe.join(best, maybe[SHA] == best["__g"]).select("id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), SHA)
    single = alone.select("id", *[v.alias(n) for n, v in zip(out, (F.col("id"), F.lit(1).cast("long"), F.lit(True)))], SHA)
    return single.unionByName(grouped).select(F.col("id").alias("doc_id"), *out, F.col(SHA).alias("text_sha256"))
