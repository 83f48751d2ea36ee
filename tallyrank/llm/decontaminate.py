r"""Benchmark decontamination (DataFrame functions only).

The normalised n-grams of the benchmark make a hash set that is sent to every
task.  A document is scanned once: at each word the pair (first word, last
word) of the window is tested against a bit array, then the hash of all its
words against another, at two places; the few survivors are verified word for
word by a hash join with the n-grams themselves.  Clean documents leave the
scan as one narrow row.

The bit arrays grow with the benchmark, ``BITS_PER_GRAM`` bits each, so under a
hundredth of clean windows pass at any size up to ``FILTER_BYTES`` an array (16
million n-grams); beyond that more windows have to be verified.  They are built
in Spark and reach the scan as scalar subqueries.  The n-grams are broadcast
while they have at most BROADCAST_BYTES; a larger table is joined by a shuffle
of the surviving windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, cut, join_in_place

#: What separates words, after lower-casing: all ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
BITS_PER_GRAM = 32
FILTER_BYTES = 64 << 20
#: 64-bit words of a bit array that are gathered in one row on the way.
_ROW_WORDS = 1024


def words_of(text: Column) -> Column:
    """Words of a text; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(items: DataFrame, n: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows (size, gram, item_ids) of the items: n words, or a whole shorter item. Items without words have none."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    sized = words.withColumn("size", F.least(F.size("w"), F.lit(n)))
    spread = sized.select("item_id", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    grams = spread.select("item_id", "size", F.slice("w", F.col("at"), F.col("size")).alias("gram"))
    return grams.groupBy("size", "gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))


def filter_bits(grams: int) -> int:
    """Bits of an array for so many n-grams: a power of two, at most FILTER_BYTES."""
    return min(8 * FILTER_BYTES, max(1 << 16, 1 << (max(grams, 1) * BITS_PER_GRAM - 1).bit_length()))


def _ends(size: Column, first: Column, last: Column) -> Column:
    return F.xxhash64(size, first, last)


def _places(h: Column, bits: int) -> list[Column]:
    """Two places of the hash of a whole window."""
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def bit_array(places: DataFrame, bits: int) -> DataFrame:
    """One row, one column: the array of 64-bit words with a bit for each value of column ``at``."""
    spark = places.sparkSession
    own = places.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    every = own.unionByName(spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    words = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    rows = words.withColumn("row", F.floor(F.col("word") / _ROW_WORDS)).groupBy("row").agg(ordered("word", "bits").alias("part"))
    return rows.agg(F.flatten(ordered("row", "part")).alias("array"))


def _in(bits: Column, at: Column) -> Column:
    return F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def scanned(base: DataFrame, grams: DataFrame) -> DataFrame:
    """``base`` (doc_id, text_hash, w) as rows (doc_id, text_hash, n_words, at, size, gram): the windows that the bit arrays let through.

    at counts from 0; each row of ``base`` also gives one row with at = -1.
    """
    about = grams.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row for each window length
    sizes = sorted(r["size"] for r in about)
    bits = filter_bits(sum(r["n"] for r in about))
    ends = grams.select(_ends(F.col("size"), F.element_at("gram", 1), F.element_at("gram", -1)).bitwiseAND(F.lit(bits - 1)).alias("at"))
    whole = grams.select(F.explode(F.array(*_places(F.xxhash64("gram"), bits))).alias("at"))
    # A row for each window length.  Above that explode each array is named once, so the optimiser puts
    # the subquery in that place, where it is held by reference: no row carries a copy.
    sized = base.select("doc_id", "text_hash", "w", F.explode(F.array(*map(F.lit, [0, *sizes] if len(sizes) != 1 else sizes))).alias("length"))
    with_arrays = sized.withColumns({"ends": cut(bit_array(ends, bits)).scalar(), "whole": cut(bit_array(whole, bits)).scalar()})
    w, n = F.col("w"), F.col("length")
    gram = lambda i: F.slice(w, i + 1, n)
    starts = F.when((n > 0) & (F.size(w) >= n), F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    by_ends = F.filter(starts, lambda i: _in(F.col("ends"), _ends(n, F.get(w, i), F.get(w, i + n - 1)).bitwiseAND(F.lit(bits - 1))))
    hits = F.filter(by_ends, lambda i: F.forall(F.array(*_places(F.xxhash64(gram(i)), bits)), lambda p: _in(F.col("whole"), p)))
    found = F.transform(hits, lambda i: F.struct(i.alias("at"), n.alias("size"), gram(i).alias("gram")))
    kind = "array<struct<at:int,size:int,gram:array<string>>>"
    mark = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("array<string>").alias("gram"))).cast(kind)
    both = F.concat(mark, found.cast(kind)) if len(sizes) == 1 else F.when(n == 0, mark).otherwise(found.cast(kind))
    kept = with_arrays.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), both.alias("found"))
    # The outer form, as the other would have the optimiser search each text once more for arrays that are empty.
    return kept.select("doc_id", "text_hash", "n_words", F.explode_outer("found").alias("c")).select("doc_id", "text_hash", "n_words", "c.*").filter("at is not null")


def contamination_report(
    docs: DataFrame, items: DataFrame, n: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, item_ids.

    A word inside any occurrence of a benchmark window is hit.  Null and empty
    texts have no words and no hits; an empty or null-only benchmark hits
    nothing; items sharing an id count once.  Rows with one id and one text
    get the same verdict, each its own row.  An empty table of documents gives
    an empty report.
    """
    grams = cut(benchmark_windows(items, n, item_col, item_text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
    spread = scanned(base, grams)
    known = grams.select(F.col("gram").alias("g"), "item_ids")
    length = F.aggregate("g", F.lit(64), lambda a, x: a + 16 + F.octet_length(x)) + 32 * F.size("item_ids")
    if (known.agg(F.sum(length).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    # The rows that stand for whole documents match nothing; their keys differ, so a shuffle spreads them.
    key = F.coalesce("gram", F.array(F.concat(F.lit(" "), F.col("text_hash").cast("string"))))
    seen = spread.join(known, key == known["g"], "left").filter("at < 0 or g is not null")
    per_doc = seen.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count_if(F.col("at") < 0).alias("rows"),
        F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "size"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1)))))
    out = per_doc.withColumns({"n_hit": covered.cast("long"), "item_ids": F.array_sort("item_ids")})
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        "doc_id", "text_hash", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "item_ids", "hits",
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, mode: str = "documents", n: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contamination, in its own columns.

    ``mode="documents"`` drops every document with a hit.  ``mode="spans"``
    keeps it and removes each hit word with what separates it from the word
    before; clean texts stay as they are, byte for byte.  Null and empty texts
    are clean; repeated rows get one verdict; an empty table gives an empty one.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    report = contamination_report(docs, items, n, id_col, text_col)
    hit = report.filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), F.col("hits").alias("__hits"))
    if mode == "documents":
        return join_in_place(docs, cut(hit.drop("__hits").distinct()), "left_anti", F.lit(48), id_col, text_col).select("row.*")
    hit = cut(hit.dropDuplicates(["__id", "__h"]))
    joined = join_in_place(docs, hit, "left", 64 + 16 * F.size("__hits"), id_col, text_col)
    text = F.col("row").getField(text_col)
    # One piece per word: the word with the separators before it; what follows the last word is a piece too.
    pieces = F.regexp_extract_all(text, F.lit(r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$)"), F.lit(1))
    gone = F.array_distinct(F.flatten(F.transform("__hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    cleaned = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(gone, i)), "")
    return joined.withColumn("row", F.col("row").withField(text_col, F.when(F.col("__hits").isNull(), text).otherwise(cleaned))).select("row.*")
