"""Continuous ingest: a stream of JSON lines is appended to a store, one committed batch per trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import parse_json_lines
from ..sources.store import Store


def read_json_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(id, values) of JSON-lines files as they appear in ``folder``."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return parse_json_lines(text)


def feed(records: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch to ``store``. A batch that was committed before a restart is not appended again."""

    def append(batch: DataFrame, number: int) -> None:
        store.reload()
        fed = store.manifest.get("fed", {})
        if number > fed.get(checkpoint, -1):
            # Rows and mark become visible in one commit.
            store.bulk_index(batch.filter(F.col("values").isNotNull()), {"fed": {**fed, checkpoint: number}})

    return records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
