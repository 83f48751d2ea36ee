"""Growing benchmark: query times against the number of records, at checkpoints."""

from __future__ import annotations

import csv
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.topk import collect, linear_query
from .sources.ingest import read_csv
from .sources.store import Store

# Weights of the six census queries, ten results each.
CENSUS_QUERIES = [
    {"fertility": 10.0, "age": 1.0},
    {"age": 10000.0, "wages": 1.0},
    {"age": 100.0, "wages": 1.0},
    {"sex": 40.0, "weekly_work_hours": 1.0},
    {"sex": 100.0, "fertility": 9.0, "age": 1.0, "weekly_work_hours": 1.0},
    {"fertility": 5.0, "age": 1.0, "weekly_work_hours": 1.0},
]
RESULTS = 10


def checkpoints(most: int) -> list[int]:
    """Numbers of records at which queries are timed: batches of 1,000, then three times as many, 100,000 at most."""
    out, batch, total = [], 1000, 0
    while total < most:
        total = min(total + batch, most)
        out.append(total)
        batch = min(batch * 3, 100_000)
    return out


def run(spark: SparkSession, rows: DataFrame, folder: str, most: int, queries: list[dict[str, float]] = CENSUS_QUERIES) -> list[list[float]]:
    """Append ``rows`` (id, fields) to a new store in growing batches; at each checkpoint (records, seconds to append, seconds of each query)."""
    store = Store(spark, folder)
    numbered = rows.withColumn("__place", F.col("id").cast("long")).persist()
    most = min(most, numbered.count())
    out, before = [], 0
    for total in checkpoints(most):
        began = time.perf_counter()
        store.append(numbered.filter((F.col("__place") > before) & (F.col("__place") <= total)).drop("__place"))
        line = [total, time.perf_counter() - began]
        for weights in queries:
            began = time.perf_counter()
            collect(store.query(linear_query(weights, RESULTS)))
            line.append(time.perf_counter() - began)
        out.append(line)
        before = total
    numbered.unpersist()
    return out


def run_csv(spark: SparkSession, source: str, folder: str, most: int, target: str) -> None:
    """Benchmark a CSV file of census records and write the times, in seconds, as CSV."""
    lines = run(spark, read_csv(spark, source), folder, most)
    with open(target, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["records", "index", *(f"query_{k + 1}" for k in range(len(CENSUS_QUERIES)))])
        out.writerows([[int(line[0]), *(f"{t:.6f}" for t in line[1:])] for line in lines])
