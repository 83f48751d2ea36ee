"""Training-corpus pipeline: five operators over documents, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes
it as Parquet in the folder that the cluster shares and hands the reread table
on.  All stages but the last return the columns of documents; the last returns
packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrank.llm import common, decontaminate, exact_dedup, packing, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model of the labelled documents among these.

    Null and empty texts stay, repeated rows go or stay together; without labels of both kinds nothing goes.
    """
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the longest original, then the smallest id. Null texts count as empty, repeated rows as one."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: that of the smallest id. Texts without words are one component."""
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none; an empty benchmark drops nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null or empty text is one closing token; repeated rows are packed as often as they come; no documents give no pieces."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained models, components and token packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``sf_dir``'s documents. A stage's table is removed when the next one is written, the last with the session."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        folder = common.scratch(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/docs")
        docs = spark.read.parquet(f"{folder}/docs")
        if before:
            common.remove_folder(spark, before)
        before = folder
    return docs
