"""The registered queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, html_extract, license_scan, packing, quality, simhash, substring_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup_report(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_html_extraction": op8_html_extraction,
    "op9_warc": op9_warc,
    "op10_license_scan": op10_license_scan,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""



def _license_sql() -> str:
    """The licence scan in SQL: every known text is put in canonical form by the same SQL as the documents."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ",\n".join(f"({quoted(i)}, {quoted(k)}, {quoted(t)})" for i, k, t in license_scan.KNOWN + license_scan.MORE_NOTICES)
    digests = ", ".join(f"({quoted(g)}, 'text', {quoted(i)}, 0)" for i, g in license_scan.TEXT_DIGESTS)
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    text = f"translate({text}, {quoted(license_scan.TYPOGRAPHIC)}, {quoted(' ' * len(license_scan.TYPOGRAPHIC))})"
    text = rf"regexp_replace({text}, '[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')"
    for spelling, same in license_scan.EQUIVALENT:
        text = f"replace({text}, '{spelling}', '{same}')"
    lines = rf"""list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(copyright|c copyright|c [0-9]{{4}}|all rights reserved)\b'))"""
    return rf"""
WITH given(license_id, kind, text) AS (VALUES {known}),
named_text AS (SELECT license_id, kind, array_to_string({lines}, ' ') AS t FROM given),
known AS (
  SELECT g, kind, min(license_id) AS license_id, any_value(size) AS size FROM (
    SELECT sha256(t) AS g, kind, license_id, len(string_split(t, ' ')) AS size FROM named_text WHERE t <> ''
    UNION ALL SELECT * FROM (VALUES {digests})
  ) GROUP BY 1, 2
),
sizes AS (SELECT DISTINCT size FROM known WHERE kind = 'notice'),
firsts AS (SELECT DISTINCT string_split(t, ' ')[1] AS f FROM named_text WHERE kind = 'notice'),
doc AS (SELECT doc_id, {lines} AS l FROM documents),
whole AS (SELECT doc_id, sha256(array_to_string(l, ' ')) AS text_digest FROM doc),
line AS (SELECT doc_id, k, string_split(l[k], ' ') AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM doc)),
start AS (SELECT doc_id, k, i, w FROM (SELECT doc_id, k, w, unnest(range(1, len(w) + 1)) AS i FROM line) JOIN firsts ON w[i] = f),
named AS (
  SELECT doc_id, license_id FROM start, sizes JOIN known ON kind = 'notice' AND known.size = sizes.size
  WHERE i + sizes.size - 1 <= len(w) AND g = sha256(array_to_string(w[i : i + sizes.size - 1], ' '))
  QUALIFY row_number() OVER (PARTITION BY doc_id, k, i ORDER BY sizes.size DESC) = 1
),
text AS (SELECT doc_id, text_digest, license_id AS whole_license FROM whole LEFT JOIN known ON kind = 'text' AND g = text_digest),
every AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses
  FROM (SELECT * FROM named UNION ALL SELECT doc_id, whole_license FROM text WHERE whole_license IS NOT NULL) GROUP BY doc_id
),
n AS (SELECT doc_id, count(*) AS n FROM named GROUP BY doc_id)
SELECT doc_id, text_digest, whole_license, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_notices
FROM text LEFT JOIN every USING (doc_id) LEFT JOIN n USING (doc_id)
"""


ORACLE_SQL = {
    "op1_benchmark_decontamination": rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
gram AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, w[i : i + least(len(w), 10) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM gram),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, size, i, w[i : i + size - 1] AS g
  FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)
),
hit AS (SELECT doc_id, i, size, item_id FROM win JOIN gram USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op3_substring_dedup": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc WHERE len(w) >= 20)
),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM later) GROUP BY doc_id),
word AS (
  SELECT doc_id, p, w[p] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc)
  ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) USING (doc_id, p)
),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k FROM word GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM doc LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
""",
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op10_license_scan": _license_sql(),
}
