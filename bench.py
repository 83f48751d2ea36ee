"""Headline timings: prints one JSON line. Scale by BENCH_SF_DIR, cores by BENCH_CPUS."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyrank import queries as engine
from tallyrank.operators.topk import linear_query, top_k
from tallyrank.sources.files import scratch
from tallyrank.sources.store import Store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

# Six weighted sums over line items, of the shapes that such engines are usually timed on.
LINEAR = {
    "linear_tax_quantity": {"l_tax": 10.0, "l_quantity": 1.0},
    "linear_quantity_10000_price": {"l_quantity": 10000.0, "l_extendedprice": 1.0},
    "linear_quantity_100_price": {"l_quantity": 100.0, "l_extendedprice": 1.0},
    "linear_discount_quantity": {"l_discount": 40.0, "l_quantity": 1.0},
    "linear_four_fields": {"l_discount": 100.0, "l_tax": 9.0, "l_quantity": 1.0, "l_linenumber": 1.0},
    "linear_three_fields": {"l_tax": 5.0, "l_quantity": 1.0, "l_linenumber": 1.0},
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {}
    for name, weights in LINEAR.items():
        jobs[name] = lambda w=weights: top_k(engine.numbered_lines(spark, SF_DIR), linear_query(w, 10), ident="l_linenumber")
    for name in ("topk_field_price", "topk_sum_weighted", "topk_product", "topk_min", "topk_pow_sq", "topk_custom_linear", "topk_custom_map", "topk_geo_distance", "topk_nested", "offset_page", "missing_field_sparse", "pruned_topk_sum", "ingest_long_to_wide"):
        jobs[name] = lambda q=engine.QUERIES[name]: q(spark, SF_DIR)
    # A store of all line items, clustered: the same query pruned and plain.
    store = Store(spark, f"{scratch(spark)}/lines")
    items = engine.table(spark, SF_DIR, "lineitem")
    began = time.perf_counter()
    store.append(items.select(F.col("l_orderkey").cast("string").alias("id"), *[F.col(c).cast("float").alias(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount")]), cluster_by=["l_extendedprice"])
    appended = round(time.perf_counter() - began, 4)
    best = linear_query({"l_quantity": 100.0, "l_extendedprice": 1.0}, 10)
    jobs["store_plain"] = lambda: store.query(best, pruned=False)
    jobs["store_pruned"] = lambda: store.query(best)
    jobs["topk_field_price"]().collect()  # starts the session's machinery
    times = {}
    for name, job in jobs.items():
        own = []
        for _ in range(RUNS):
            began = time.perf_counter()
            job().collect()
            own.append(time.perf_counter() - began)
        times[name] = round(statistics.median(own), 4)
    began = time.perf_counter()
    engine.QUERIES["score_all_lineitem"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times["score_all_lineitem"] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "median seconds of headline queries, summed", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "store_append": appended, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
