r"""Licence scan by canonical digest lookup (DataFrame functions).

A text is brought to a canonical form: A-Z in lower case, every run of ASCII
punctuation, blanks and typographic marks one blank, lines that only state a
copyright left out, spellings that count as equal made equal.  The SHA-256 of
the whole canonical text is joined with the digests of known licences.  So are
the digests of phrases inside its lines, for notices that name a licence in
passing: runs of as many words as a known notice has, where a word stands that
a notice begins with.  Of the notices that begin at one word the longest counts.
The known table is broadcast up to ``MAX_BROADCAST_ROWS``, else the join
shuffles digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut
from .license_texts import EQUIVALENT, KNOWN, MORE_NOTICES, TEXT_DIGESTS

MAX_BROADCAST_ROWS = 100_000
MAX_FIRST_WORDS = 16
TYPOGRAPHIC = "“”‘’„«»–—−·•…©®™ "
COPYRIGHT_LINE = r"^(copyright|c copyright|c [0-9]{4}|all rights reserved)\b.*$"


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that has one; copyright lines and empty lines are left out. A null text has none."""
    text = F.translate(ascii_lower(F.coalesce(text, F.lit(""))), TYPOGRAPHIC, " " * len(TYPOGRAPHIC))
    text = F.regexp_replace(text, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    for spelling, same in EQUIVALENT:
        text = F.replace(text, F.lit(spelling), F.lit(same))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~(x.rlike("^(c|a)") & x.rlike(COPYRIGHT_LINE)))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known_digests(licenses: DataFrame) -> DataFrame:
    """(digest, kind, license_id, size, first) of a table (license_id, kind, text); kind is text or notice, size its words, first the first.

    Texts that are null or empty in canonical form have no digest.
    """
    lines = licenses.select("license_id", "kind", canonical_lines(F.col("text")).alias("lines")).filter(F.size("lines") > 0)
    words = F.split(F.array_join("lines", " "), " ")
    named = lines.select("license_id", "kind", words.alias("w"))
    return named.select(_sha(F.array_join("w", " ")).alias("digest"), "kind", "license_id", F.size("w").alias("size"), F.element_at("w", 1).alias("first")).distinct()


def builtin_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN + MORE_NOTICES, "license_id string, kind string, text string")


def builtin_digests(spark: SparkSession) -> DataFrame:
    """Digests of the built-in licences, of the long ones as well."""
    long_ = spark.createDataFrame([(g, "text", i) for i, g in TEXT_DIGESTS], "digest string, kind string, license_id string")
    return known_digests(builtin_licenses(spark)).unionByName(long_, allowMissingColumns=True)


def _phrases(lines: Column, sizes: list[int], firsts: list[str]) -> Column:
    """(kind, digest, line, at, size) of the runs of words, of the given sizes, that begin with one of the words ``firsts``."""
    kind = "array<struct<kind:string,digest:string,line:int,at:int,size:int>>"
    if not sizes:
        return F.array().cast(kind)

    def of_line(x: Column, line: Column) -> Column:
        def of_words(w: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(firsts))
            runs = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: i + n <= F.size(w)), lambda n: F.struct(i.alias("at"), n.alias("size")))))
            return F.transform(
                runs, lambda r: F.struct(F.lit("notice").alias("kind"), _sha(F.array_join(F.slice(w, r["at"] + 1, r["size"]), " ")).alias("digest"), line.alias("line"), r["at"].alias("at"), r["size"].alias("size"))
            )

        return F.flatten(F.transform(F.array(F.split(x, " ")), of_words))

    near = F.transform(lines, lambda x, k: F.struct(x.alias("x"), k.alias("line")))
    if len(firsts) <= MAX_FIRST_WORDS:  # a cheap test before lines are split
        near = F.filter(near, lambda n: reduce(Column.__or__, [n["x"].contains(w) for w in firsts]))
    return F.flatten(F.transform(near, lambda n: of_line(n["x"], n["line"]))).cast(kind)


def license_report(docs: DataFrame, licenses: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_digest, whole_license, licenses, n_notices.

    text_digest is that of the whole canonical text (of the empty one for null
    and empty texts, which match nothing); whole_license is the licence whose
    text it is, else null; licenses lists, sorted and comma-joined, that one and
    those named by notices; n_notices counts the notices, repeats included.  Of
    several licences with one digest the first by name counts.  Rows equal in id
    and text get one verdict, each its own row.  An empty table of documents
    gives an empty report; without known licences nothing is found.
    """
    spark = docs.sparkSession
    given = known_digests(licenses) if licenses is not None else builtin_digests(spark)
    known = cut(given.groupBy("digest", "kind").agg(F.min("license_id").alias("license_id"), F.first("size").alias("size"), F.first("first").alias("first")))
    small = known.count() <= MAX_BROADCAST_ROWS
    notices = known.filter("kind = 'notice'")
    # Lengths and first words of notices: a few, whatever the number of licences.
    sizes = sorted(r["size"] for r in notices.select("size").distinct().collect())
    firsts = sorted(r["first"] for r in notices.select("first").distinct().collect())
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), canonical_lines(F.col(text_col)).alias("lines"))
    whole = F.struct(F.lit("text").alias("kind"), _sha(F.array_join("lines", " ")).alias("digest"), F.lit(-1).alias("line"), F.lit(0).alias("at"), F.lit(0).alias("size"))
    found = base.select("doc_id", "text_hash", F.explode(F.concat(F.array(whole), _phrases(F.col("lines"), sizes, firsts))).alias("c")).select("doc_id", "text_hash", "c.*")
    table = known.select(F.col("kind").alias("k"), F.col("digest").alias("g"), "license_id")
    joined = found.join(F.broadcast(table) if small else table, (found["digest"] == F.col("g")) & (found["kind"] == F.col("k")), "left")
    kept = joined.filter("kind = 'text' or license_id is not null")
    per_doc = kept.groupBy("doc_id", "text_hash").agg(
        F.count_if(F.col("kind") == "text").alias("rows"),
        F.max(F.when(F.col("kind") == "text", F.col("digest"))).alias("text_digest"),
        F.max(F.when(F.col("kind") == "text", F.col("license_id"))).alias("whole_license"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "notice", F.struct("line", "at", (-F.col("size")).alias("less"), "license_id")))).alias("hits"),
    )
    # Sorted, the longest notice at a place comes first.
    first = F.filter("hits", lambda h, k: (k == 0) | (F.get("hits", k - 1)["line"] != h["line"]) | (F.get("hits", k - 1)["at"] != h["at"]))
    out = per_doc.withColumn("named", first)
    licenses_of = F.array_distinct(F.concat(F.transform("named", lambda h: h["license_id"]), F.when(F.col("whole_license").isNotNull(), F.array("whole_license")).otherwise(F.array().cast("array<string>"))))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("doc_id", "text_digest", "whole_license", F.array_join(F.array_sort(licenses_of), ",").alias("licenses"), F.size("named").cast("long").alias("n_notices"))
