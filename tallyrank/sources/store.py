"""Append-only store: Parquet batches under one folder, listed by numbered manifests.

A batch is written first and becomes visible when the next manifest appears, so
a failed or repeated job never shows half a batch.  The manifest carries each
field's range and count, for pruning, and the next document id.  There is one
writer; a second one that committed meanwhile makes the append fail.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pruned import prune, threshold
from ..operators.topk import DOC, ID, Query, best_first, scored_rows
from ..plans.bounds import Interval, forward
from . import ingest
from .files import Folder

MANIFESTS = "_manifests"
ROW_GROUP_BYTES = 16 << 20


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = Folder(spark, f"{self.path}/{MANIFESTS}")
        self.reload()

    def reload(self) -> None:
        """Take the newest manifest."""
        names = [n for n in self._folder.names() if n.endswith(".json") and not n.startswith(".")]
        self.manifest = json.loads(self._folder.read(names[-1])) if names else {"version": 0, "next_id": 1, "batches": []}

    # Reading

    def fields(self) -> dict[str, Interval]:
        """Range of each field over all batches."""
        out: dict[str, Interval] = {}
        for batch in self.manifest["batches"]:
            for name, (lo, hi, _) in batch["fields"].items():
                old = out.get(name)
                out[name] = Interval(lo, hi) if old is None else Interval(min(old.lo, lo), max(old.hi, hi))
        return out

    def _read(self, batches: list[dict]) -> DataFrame:
        names = sorted({n for b in self.manifest["batches"] for n in b["fields"]})
        schema = T.StructType([T.StructField(DOC, T.LongType()), T.StructField(ID, T.StringType()), *(T.StructField(n, T.FloatType()) for n in names)])
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{b['dir']}" for b in batches])

    def read(self) -> DataFrame:
        """(_doc_id, id, fields...) of all records; a field that a batch lacks is null there."""
        return self._read(self.manifest["batches"])

    def query(self, query: Query, pruned: bool = True) -> DataFrame:
        """(rank, id, score). With ``pruned`` the most promising batches serve as the seed of the threshold."""
        batches = self.manifest["batches"]
        df = self._read(batches)
        stats = self.fields()
        if pruned and query.limit and set(query.score.fields()) <= set(stats):
            wanted = query.offset + query.limit
            ranked = sorted(batches, key=lambda b: -forward(query.score, self._ranges(b)).hi if self._has_all(b, query) else float("inf"))
            seed, rows = [], 0
            for b in ranked:
                if rows >= 10 * wanted or not self._has_all(b, query):
                    break
                seed.append(b)
                rows += b["rows"]
            if len(seed) == len(batches):
                tau = query.min_score  # a seed that is everything saves nothing
            else:
                tau = threshold(self._read(seed), query) if seed else query.min_score
            if tau is not None:
                alive = [b for b in batches if self._has_all(b, query) and self._can_reach(b, query, tau)]
                df = prune(self._read(alive), query.score, tau, stats)
        return best_first(scored_rows(df, query.score, query.min_score), query)

    @staticmethod
    def _ranges(batch: dict) -> dict[str, Interval]:
        return {n: Interval(lo, hi) for n, (lo, hi, _) in batch["fields"].items()}

    @staticmethod
    def _has_all(batch: dict, query: Query) -> bool:
        return set(query.score.fields()) <= set(batch["fields"])

    def _can_reach(self, batch: dict, query: Query, tau: float) -> bool:
        best = forward(query.score, self._ranges(batch))
        return best.hi + 1e-4 * max(1.0, abs(best.hi), abs(best.lo)) >= tau if best.hi == best.hi and abs(best.lo) != float("inf") else True

    # Writing

    def bulk_index(self, records: DataFrame, marks: dict | None = None) -> int:
        """Append records (id, values MAP<STRING, FLOAT>), in order; returns how many."""
        return self.append(ingest.to_wide(records), marks=marks)

    def index(self, ident: str, values: dict[str, float]) -> int:
        """Append one record. A batch of one: costly, for occasional use."""
        return self.bulk_index(ingest.from_records(self.spark, [(ident, values)]))

    def append(self, wide: DataFrame, cluster_by: list[str] | None = None, marks: dict | None = None) -> int:
        """Append wide rows (id and FLOAT fields).

        ``marks`` are entries of the manifest that change in the same commit.

        Rows get dense ids in the order of the frame.  ``cluster_by`` sorts the
        stored rows by those fields, so that pruned scans can skip row groups.
        """
        wide = ingest.drop_empty(wide)
        base = self.manifest["next_id"] - 1
        draft = f"{self.path}/_drafts/{uuid.uuid4().hex}"
        # The rows are written once before they are numbered, so both passes see the same ones in the same order.
        marked = wide.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
        marked.write.parquet(draft)
        fields = [c for c in wide.columns if c != ID]
        numbered = ingest.with_row_number(self.spark.read.parquet(draft), "__p", "__m", base, DOC)
        rows = numbered.select(F.col(DOC), F.col(ID).cast("string").alias(ID), *[F.when(~F.isnan(F.col(f"`{c}`").cast("float")), F.col(f"`{c}`").cast("float")).alias(c) for c in fields])
        if cluster_by:
            rows = rows.repartitionByRange(*[F.col(f"`{c}`") for c in cluster_by]).sortWithinPartitions(*[F.col(f"`{c}`") for c in cluster_by])
        name = f"batch-{uuid.uuid4().hex}"
        rows.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{self.path}/{name}")
        stored = self.spark.read.parquet(f"{self.path}/{name}")
        aggs = [f(f"`{c}`").alias(f"{k}{i}") for i, c in enumerate(fields) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
        stat = stored.agg(F.count("*").alias("rows"), *aggs).first()
        Folder(self.spark, draft).remove()
        if not stat["rows"]:
            if marks:
                self._commit({**self.manifest, **marks, "version": self.manifest["version"] + 1})
            return 0
        batch = {
            "dir": name, "rows": stat["rows"], "first_id": base + 1,
            "fields": {c: [stat[f"lo{i}"], stat[f"hi{i}"], stat[f"n{i}"]] for i, c in enumerate(fields) if stat[f"n{i}"]},
        }
        batches = [*self.manifest["batches"], batch]
        self._commit({**self.manifest, **(marks or {}), "version": self.manifest["version"] + 1, "next_id": base + 1 + stat["rows"], "batches": batches})
        return stat["rows"]

    def compact(self, cluster_by: list[str] | None = None) -> None:
        """Rewrite all batches as one, clustered; ids stay. Old batches remain on disk for running readers."""
        rows = self.read()
        fields = [c for c in rows.columns if c not in (DOC, ID)]
        if cluster_by:
            rows = rows.repartitionByRange(*[F.col(f"`{c}`") for c in cluster_by]).sortWithinPartitions(*[F.col(f"`{c}`") for c in cluster_by])
        name = f"batch-{uuid.uuid4().hex}"
        rows.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{self.path}/{name}")
        totals = {c: [r.lo, r.hi, sum(b["fields"].get(c, [0, 0, 0])[2] for b in self.manifest["batches"])] for c, r in self.fields().items()}
        batch = {"dir": name, "rows": sum(b["rows"] for b in self.manifest["batches"]), "first_id": 1, "fields": {c: totals[c] for c in fields if c in totals}}
        self._commit({**self.manifest, "version": self.manifest["version"] + 1, "batches": [batch]})

    def _commit(self, manifest: dict) -> None:
        if not self._folder.create(f"{manifest['version']:012d}.json", json.dumps(manifest)):
            raise Conflict(f"version {manifest['version']} of {self.path} exists already; reload and append again")
        self.manifest = manifest


class MemoryStore:
    """Records held by the session, for tests and small tables: a cached frame behind the same calls."""

    def __init__(self, spark: SparkSession):
        self.spark, self.df, self._next = spark, None, 1

    def bulk_index(self, records: DataFrame) -> int:
        wide = ingest.drop_empty(ingest.to_wide(records)).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}).cache()
        n = wide.count()
        numbered = ingest.with_row_number(wide, "__p", "__m", self._next - 1, DOC)
        self.df = numbered if self.df is None else self.df.unionByName(numbered, allowMissingColumns=True)
        self._next += n
        return n

    def index(self, ident: str, values: dict[str, float]) -> int:
        return self.bulk_index(ingest.from_records(self.spark, [(ident, values)]))

    def read(self) -> DataFrame:
        return self.df if self.df is not None else self.spark.createDataFrame([], f"{DOC} long, {ID} string")

    def query(self, query: Query) -> DataFrame:
        return best_first(scored_rows(self.read(), query.score, query.min_score), query)
