"""Records to wide rows: one nullable FLOAT column per field, with NaN as missing.

Every reader gives (id STRING, values MAP<STRING, FLOAT>) or wide rows; a record
without any value can never be found and is dropped.  Ids need not be unique.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("values", T.MapType(T.StringType(), T.FloatType()))])


def from_records(spark: SparkSession, records: Iterable[tuple[str, Mapping[str, float]]]) -> DataFrame:
    """Records of a client's batch, in order."""
    rows = []
    for ident, values in records:
        for name, v in values.items():
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise ValueError(f"field {name!r} of record {ident!r} is no number: {v!r}")
        rows.append((str(ident), {str(k): float(v) for k, v in values.items()}))
    return spark.createDataFrame(rows, RECORD).coalesce(1) if rows else spark.createDataFrame([], RECORD)


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines {"id": ..., "values": {...}}; keys match in any case. A malformed line becomes a record without values."""
    return parse_json_lines(spark.read.text(path))


def parse_json_lines(text: DataFrame) -> DataFrame:
    """(id, values) of a frame of lines (value STRING), also a streaming one."""
    schema = "id string, `values` map<string,float>"
    named = F.regexp_replace(F.regexp_replace("value", r'(?i)"id"(\s*:)', '"id"$1'), r'(?i)"values"(\s*:)', '"values"$1')
    return text.select(F.from_json(named, schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.id", F.col("r.values").alias("values"))


def read_csv(spark: SparkSession, path: str | list[str], id_column: str | None = None) -> DataFrame:
    """Wide rows of CSV files with a header. Cells that are no number are missing.

    Without ``id_column`` the records are numbered "1", "2", ... in file order
    and every column is a field; a column without any number (such as a text id) gives no field values.
    """
    raw = spark.read.csv(path, header=True)
    fields = [c for c in raw.columns if c != id_column]
    cells = [_number(F.expr(f"try_cast(`{c}` as float)")).alias(c) for c in fields]
    if id_column is not None:
        return raw.select(F.col(f"`{id_column}`").alias("id"), *cells)
    wide = raw.select(*[c.alias(f"f_{i}") for i, c in enumerate(cells)], F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m"))
    numbered = with_row_number(wide, "__p", "__m", 0, "__n")
    return numbered.select(F.col("__n").cast("string").alias("id"), *[F.col(f"f_{i}").alias(c) for i, c in enumerate(fields) if c.lower() != "id"])


def with_row_number(df: DataFrame, partition: str, place: str, base: int, name: str) -> DataFrame:
    """Number rows from base + 1 in partition order, dense, without moving them.

    ``partition`` and ``place`` are the partition's number and the row's
    monotonic id.  Only a row count per partition is gathered.
    """
    in_partition = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    counts = df.groupBy(partition).agg(F.count("*").alias("n")).collect()
    before, offsets = base, []
    for p, n in sorted((r[partition], r["n"]) for r in counts):
        offsets.append((p, before))
        before += n
    table = df.sparkSession.createDataFrame(offsets, "__q int, __before long")
    return df.join(F.broadcast(table), F.col(partition) == F.col("__q"), "left").withColumn(name, F.col("__before") + in_partition + 1).drop("__q", "__before", partition, place)


def _number(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def read_fixed_width(spark: SparkSession, path: str | list[str], layout: Mapping[str, tuple[int, int]], id_column: str = "id") -> DataFrame:
    """Wide rows of fixed-width text: ``layout`` maps a name to (first character from 1, number of characters)."""
    text = spark.read.text(path)
    cells = []
    for name, (start, length) in layout.items():
        raw = F.trim(F.substring("value", start, length))
        cells.append(raw.alias("id") if name == id_column else _number(raw.try_cast("float")).alias(name))
    return text.select(*cells)


def from_long(df: DataFrame, ident: str, name: str, value: str, fields: list[str]) -> DataFrame:
    """Wide rows of (id, field, value) triples; the listed fields only. Of repeated triples the largest value stays."""
    wide = df.groupBy(F.col(ident).cast("string").alias("id")).pivot(name, fields).agg(F.max(_number(F.col(value).cast("float"))))
    return wide.select("id", *[F.col(f"`{f}`").alias(f) for f in fields])


def field_names(records: DataFrame) -> list[str]:
    """All keys of the value maps, sorted: the table's schema, gathered once per batch."""
    keys = records.select(F.explode(F.map_keys("values")).alias("k")).distinct().collect()
    return sorted(r["k"] for r in keys if r["k"])


def to_wide(records: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(id, one FLOAT per field) of map records."""
    fields = field_names(records) if fields is None else fields
    return records.select("id", *[_number(F.col("values").getItem(f)).alias(f) for f in fields])


def drop_empty(wide: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows with a value at least."""
    fields = [F.col(f"`{c}`") for c in wide.columns if c not in keep]
    return wide.filter(F.coalesce(*fields).isNotNull()) if fields else wide.filter(F.lit(False))
