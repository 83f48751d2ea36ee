"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the contracts, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"

#: Bytes of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``.

    Only a local session (tests) may go without: it gets a temporary folder.
    Anywhere else a machine's own folder would hold parts that others cannot read.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyrank-ckpt-"))
    return sc.getCheckpointDir()


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder beside the checkpoints, for tables that are read again; it is deleted when the session's JVM ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    files, path = _hadoop(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, path = _hadoop(spark, folder)
    files.delete(path, True)


#: Bytes of one Arrow batch sent to a Python worker.
ARROW_BATCH_BYTES = 8 << 20


def _show_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started; a cluster gets it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    env = spark.sparkContext.environment
    given = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in [*known, *given]:
        env["PYTHONPATH"] = os.pathsep.join([root, *given])


def bound_batches(spark: SparkSession) -> None:
    """Before Python work: keep Arrow batches small, as whole texts differ in length a thousandfold; a smaller limit of the session stays."""
    _show_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = str(spark.conf.get(key, "64m")).strip().lower()
    number = int(text.rstrip("bkmg") or 0)
    now = number << {"k": 10, "m": 20, "g": 30}.get(text.rstrip("b")[-1:], 0)
    if now <= 0 or now > ARROW_BATCH_BYTES:
        spark.conf.set(key, f"{ARROW_BATCH_BYTES}b")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(row, id, h and, where the scan tells it, the file) of ``docs``; rows travel as one struct, so no name of theirs can clash."""
    own = [F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h")]
    try:
        return docs.select(*own, docs.metadataColumn("_metadata").getField("file_path").alias("file")), True
    except AnalysisException:
        return docs.select(*own), False


def join_in_place(docs: DataFrame, table: DataFrame, how: str, size: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as ``row``, joined ("left" or "left_anti") with a written table (__id, __h, ...) on id and text hash; texts stay where they are.

    ``size`` estimates a table row's bytes.  A table of at most BROADCAST_BYTES
    is sent to the tasks.  A larger one is dealt by the files that hold its
    rows: each group of files is joined with no more than its own part of the
    table, and written to the shared folder, so no size makes a text travel.
    Only ids and hashes are shuffled to find that part.  Rows that come from no
    files are written first.
    """
    spark = docs.sparkSession
    if (table.agg(F.sum(size).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES:
        return _joined(_keyed_rows(docs, id_col, text_col)[0], F.broadcast(table), how)
    rows, known = _keyed_rows(docs, id_col, text_col)
    if not known:
        folder = f"{scratch(spark, 'rows')}/0"
        rows.write.parquet(folder)
        rows = spark.read.parquet(folder)
        rows = rows.select("row", "id", "h", rows.metadataColumn("_metadata").getField("file_path").alias("file"))
    narrow = rows.select("file", "id", "h")
    on = (narrow["h"] == table["__h"]) & narrow["id"].eqNullSafe(table["__id"])
    parts = cut(narrow.join(table, on).drop("id", "h"))
    sizes = {r["file"]: r["n"] for r in parts.groupBy("file").agg(F.sum(size).alias("n")).collect()}
    groups, held = [[]], 0
    for file in sorted(r["file"] for r in narrow.select("file").distinct().collect()):  # a row a file
        if groups[-1] and held + sizes.get(file, 0) > BROADCAST_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(file)
        held += sizes.get(file, 0)
    out = scratch(spark, "joined")
    for k, files in enumerate(groups):
        own = parts.filter(F.col("file").isin(files)).drop("file").distinct()
        _joined(rows.filter(F.col("file").isin(files)), F.broadcast(own), how).write.parquet(f"{out}/{k}")
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{out}/{k}") for k in range(len(groups))])


def _joined(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    on = (rows["h"] == table["__h"]) & rows["id"].eqNullSafe(table["__id"])
    return rows.join(table, on, how).drop("id", "h", "file", "__id", "__h")


def without_rows(docs: DataFrame, odd: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, in its own columns, without the rows that ``odd`` (__id, __h, __stays) names, but one of each with ``__stays``.

    Those that stay are documents given several times; only they are shuffled.
    """
    once = join_in_place(docs, odd.drop("__stays"), "left_anti", F.lit(48), id_col, text_col).select("row.*")
    again = odd.filter("__stays").drop("__stays")
    if again.isEmpty():
        return once
    marked = join_in_place(docs, again.withColumn("__hit", F.lit(True)), "left", F.lit(48), id_col, text_col).filter("__hit")
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    several = marked.select("row", F.col("row").getField(id_col).alias("id"), F.xxhash64(text).alias("h")).dropDuplicates(["id", "h"])
    return once.unionByName(several.select("row.*"))


def delete_space(text: Column) -> Column:
    """``text`` without the six ASCII white-space characters.

    One bytewise replacement for each character: cheaper than a regular
    expression, and equal for any UTF-8 text.
    """
    for ch in ASCII_SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are.

    ``lower`` does that by itself on a pure ASCII text, where it has a fast
    path; ``translate`` serves the other texts.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )
