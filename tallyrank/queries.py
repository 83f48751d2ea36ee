"""The engine's registered queries over the test tables, each with a hand-written SQL twin.

Document ids are unique keys of their tables, so every ranking is total.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.pruned import pruned_top_k
from .operators.topk import DOC, ID, Query, linear_query, parse_weights, score_all, top_k
from .sources.files import scratch
from .sources.ingest import from_long, read_csv, read_fixed_width, read_json_lines, to_wide
from .sources.store import MemoryStore, Store
from .sources.versions import VersionedStore
from .streaming.feed import feed, read_json_stream

KEYS = {"orders": "o_orderkey", "part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ranked(name: str, score: list, prune: bool = False, **options) -> Callable[[SparkSession, str], DataFrame]:
    query = Query(score, **{"limit": 10, **options})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ask = pruned_top_k if prune else top_k
        return ask(table(spark, sf_dir, name), query, doc=KEYS[name], ident=KEYS[name])

    return run


_F = lambda n: ["field", n]
_SUM_ORDERS = ["sum", _F("o_totalprice"), ["scale", 30, _F("o_custkey")]]
_SUM_PART = ["sum", _F("p_size"), ["scale", 0.5, _F("p_retailprice")]]
_NESTED = [
    "sum",
    ["scale", 0.25, ["custom_linear", [[1, 0], [20, 8], [50, 2]], _F("p_size")]],
    ["min", ["diff", 950, _F("p_retailprice")], ["pow", _F("p_size"), 0.5]],
    ["product", ["custom_map", [[7, 2.5], [9, 1.5]], 0.5, _F("p_size")], ["scale", 0.01, _F("p_retailprice")]],
]


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 180 - 90).cast("float").alias("lat"), (F.col("c_custkey") * 7 % 360 - 180).cast("float").alias("lng")
    )
    near = Query(["scale", -1, ["geo_distance", 45, -69.9, "lat", "lng"]], limit=25)
    return top_k(places, near, "c_custkey", "c_custkey")


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return top_k(labelled, Query(["sum", _F("n_chars"), ["scale", 1000, _F("quality")], ["scale", -500, _F("toxic")]], limit=50), "doc_id", "doc_id")


def _linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "customer"), linear_query({"c_acctbal": -1.0}, 400), "c_custkey", "c_custkey")


def _all_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return score_all(items, ["sum", ["scale", 100, _F("l_quantity")], _F("l_extendedprice")], None, "l_orderkey", "l_linenumber")


def _wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), "event_type", "value")
    return from_long(events, "u", "event_type", "value", ["click", "purchase", "view"])


def _records(spark: SparkSession, sf_dir: str, name: str, fields: dict[str, str]) -> DataFrame:
    """Wide rows (id, fields) of a table, in the order of its key."""
    rows = table(spark, sf_dir, name).orderBy(KEYS[name])
    return rows.select(F.col(KEYS[name]).cast("string").alias("id"), *[F.col(c).cast("float").alias(f) for f, c in fields.items()])


_ORDER_FIELDS = {"price": "o_totalprice", "cust": "o_custkey"}
_STORE_QUERY = Query(["sum", _F("price"), ["scale", 30, _F("cust")]], limit=25)


def _order_store(spark: SparkSession, sf_dir: str, **options) -> Store:
    """All orders in two batches, by key: cheap ones and dear ones, so that batches differ in range."""
    store, rows = Store(spark, scratch(spark)), _records(spark, sf_dir, "orders", _ORDER_FIELDS)
    store.append(rows.filter("price < 300000"), **options)
    store.append(rows.filter("price >= 300000"), **options)
    return Store(spark, store.path)  # opened anew


def _store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_store(spark, sf_dir).read().select("id", "price", "cust")


def _store_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_store(spark, sf_dir).read().select(F.col(DOC).alias("doc"), ID)


def _store_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_store(spark, sf_dir).query(_STORE_QUERY, pruned=False)


def _store_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_store(spark, sf_dir).query(_STORE_QUERY)


def _store_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_store(spark, sf_dir, cluster_by=["price"]).query(_STORE_QUERY)


def _store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _order_store(spark, sf_dir)
    store.compact(["cust", "price"])
    return Store(spark, store.path).query(_STORE_QUERY)


def _store_of_unlike_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of batches with different fields: a field that a batch lacks is null there."""
    store = Store(spark, scratch(spark))
    store.append(_records(spark, sf_dir, "customer", {"balance": "c_acctbal", "nation": "c_nationkey"}))
    store.append(_records(spark, sf_dir, "supplier", {"balance": "s_acctbal"}))
    return store.read().select("id", "balance", "nation")


def _store_single_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark))
    store.append(_records(spark, sf_dir, "supplier", {"balance": "s_acctbal"}))
    store.index("best", {"balance": 1e6})
    store.index("1", {"balance": 1e6})
    return store.query(Query(_F("balance"), limit=10))


def _memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = MemoryStore(spark)
    rows = _records(spark, sf_dir, "part", {"size": "p_size", "price": "p_retailprice"})
    store.bulk_index(rows.select("id", F.create_map(F.lit("size"), "size", F.lit("price"), "price").alias("values")))
    return store.query(Query(["product", _F("size"), _F("price")], limit=30))


def _json_lines(spark: SparkSession, sf_dir: str) -> str:
    """Folder of JSON lines of all customers, some keys in capitals, with lines that are none among them."""
    rows = table(spark, sf_dir, "customer")
    values = F.create_map(F.lit("balance"), F.col("c_acctbal").cast("float"), F.lit("nation"), F.col("c_nationkey").cast("float"))
    line = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("Id"), values.alias("values")))
    folder = f"{scratch(spark)}/lines"
    rows.select(line.alias("value")).unionByName(spark.createDataFrame([("{not json",), ("",)], "value string")).write.text(folder)
    return folder


def _ingest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_wide(read_json_lines(spark, _json_lines(spark, sf_dir))).filter("id is not null")


def _ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells are no numbers and so missing."""
    folder = f"{scratch(spark)}/csv"
    table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment").write.csv(folder, header=True)
    return read_csv(spark, folder, id_column="c_custkey")


def _ingest_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/fixed"
    rows = table(spark, sf_dir, "part")
    rows.select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 10, " "), F.lpad(F.col("p_size").cast("string"), 4, "0"), F.lpad(F.col("p_retailprice").cast("string"), 12, " ")).alias("value")).write.text(folder)
    return read_fixed_width(spark, folder, {"id": (1, 10), "size": (11, 4), "price": (15, 12)})


def _stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    store = Store(spark, f"{root}/store")
    feed(read_json_stream(spark, _json_lines(spark, sf_dir)), store, f"{root}/checkpoint").awaitTermination()
    store.reload()
    return store.read().select("id", "balance", "nation")


def _version_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first version is served; a later one appears and answers after the next look."""
    root = scratch(spark)
    Store(spark, f"{root}/orders-1").append(_records(spark, sf_dir, "supplier", {"price": "s_acctbal"}))
    served = VersionedStore(spark, root, "orders-")
    Store(spark, f"{root}/orders-2").append(_records(spark, sf_dir, "orders", _ORDER_FIELDS))
    served.refresh()
    return served.query(Query(_F("price"), limit=15))


def _parsed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "part"), linear_query(parse_weights("p_size=20, p_retailprice=-0.5"), 30, None), "p_partkey", "p_partkey")


_CURVE = [[1, 5], [10, 1], [10, 8], [30, 3], [45, 9]]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topk_field_price": _ranked("orders", _F("o_totalprice")),
    "topk_field_ties": _ranked("part", _F("p_size"), limit=100),
    "topk_scale_neg": _ranked("customer", ["scale", -2.5, _F("c_acctbal")]),
    "topk_sum_two": _ranked("orders", ["sum", _F("o_totalprice"), _F("o_custkey")]),
    "topk_sum_weighted": _ranked("part", _SUM_PART, limit=20),
    "topk_product": _ranked("part", ["product", _F("p_size"), _F("p_retailprice")]),
    "topk_min": _ranked("part", ["min", ["scale", 20, _F("p_size")], _F("p_retailprice")]),
    "topk_diff": _ranked("orders", ["diff", 250000, _F("o_totalprice")]),
    "topk_diff_expr": _ranked("part", ["diff", ["scale", 20, _F("p_size")], _F("p_retailprice")]),
    "topk_pow_sqrt": _ranked("part", ["pow", _F("p_retailprice"), 0.5]),
    "topk_pow_sq": _ranked("orders", ["pow", ["scale", 0.001, _F("o_totalprice")], 2]),
    "topk_pow_neg_exp": _ranked("part", ["pow", _F("p_size"), -1.3], limit=60),
    "topk_pow_nan_dropped": _ranked("customer", ["pow", _F("c_acctbal"), 0.5], limit=5000),
    "topk_custom_map": _ranked("part", ["custom_map", [[3, 7], [11, 9.5], [48, 2]], 1, _F("p_size")], limit=150),
    "topk_custom_map_dup": _ranked("part", ["custom_map", [[3, 7], [3, 2], [11, 9.5]], 1, _F("p_size")], limit=150),
    "topk_custom_linear": _ranked("orders", ["custom_linear", [[0, 0], [100000, 40], [300000, 10], [500000, 90]], _F("o_totalprice")], limit=50),
    "topk_custom_linear_step": _ranked("part", ["custom_linear", _CURVE, _F("p_size")], limit=500),
    "topk_custom_linear_single": _ranked("part", ["custom_linear", [[10, 4]], _F("p_size")], limit=12),
    "topk_geo_distance": _geo,
    "topk_nested": _ranked("part", _NESTED, limit=40),
    "min_score_inclusive": _ranked("part", _F("p_size"), limit=5000, min_score=45),
    "limit_zero": _ranked("orders", _F("o_totalprice"), limit=0),
    "offset_page": _ranked("orders", _F("o_totalprice"), limit=7, offset=5),
    "offset_compat": _ranked("part", _F("p_size"), limit=9, offset=4, min_score=50, offset_mode="compat"),
    "offset_compat_short": _ranked("supplier", _F("s_acctbal"), limit=90, offset=60, offset_mode="compat"),
    "missing_field_sparse": _sparse,
    "unknown_field_empty": _ranked("part", ["sum", _F("p_size"), _F("p_colour")]),
    "linear_query_floor0": _linear,
    "score_all_lineitem": _all_lineitem,
    "ingest_long_to_wide": _wide_events,
    "ingest_json_lines": _ingest_json,
    "ingest_csv": _ingest_csv,
    "ingest_fixed_width": _ingest_fixed,
    "stream_feed": _stream_feed,
    "store_round_trip": _store_round_trip,
    "store_document_ids": _store_ids,
    "store_topk": _store_topk,
    "store_pruned_topk": _store_pruned,
    "store_clustered_topk": _store_clustered,
    "store_compacted_topk": _store_compacted,
    "store_union_of_batches": _store_of_unlike_batches,
    "store_single_inserts": _store_single_inserts,
    "memory_store_topk": _memory_store,
    "version_swap": _version_swap,
    "linear_query_parsed": _parsed_weights,
    "pruned_topk_sum": _ranked("orders", _SUM_ORDERS, prune=True),
    "pruned_topk_sum_ties": _ranked("part", _SUM_PART, prune=True, limit=20),
    "pruned_topk_product": _ranked("part", ["product", _F("p_size"), _F("p_retailprice")], prune=True),
    "pruned_topk_nested": _ranked("part", _NESTED, prune=True, limit=40),
    "pruned_topk_map": _ranked("part", ["custom_map", [[3, 7], [11, 9.5], [48, 2]], 1, _F("p_size")], prune=True, limit=30),
    "pruned_offset_page": _ranked("orders", _SUM_ORDERS, prune=True, limit=7, offset=5),
}


def _top(name: str, score: str, limit: int, offset: int = 0, where: str = "TRUE") -> str:
    """Ranking of a score that is written in REAL arithmetic, without NaN and null scores."""
    key = KEYS[name]
    return f"""
WITH s AS (SELECT {key} AS k, CAST({score} AS REAL) AS score FROM {name}),
r AS (SELECT k, score, row_number() OVER (ORDER BY score DESC, k DESC) AS n FROM s WHERE score IS NOT NULL AND NOT isnan(score) AND ({where}))
SELECT n - {offset} AS rank, CAST(k AS VARCHAR) AS id, score FROM r WHERE n > {offset} AND n <= {offset + limit}
"""


def _r(x: object) -> str:
    return f"CAST({x} AS REAL)"


_SIZE, _PRICE, _TOTAL, _BAL = _r("p_size"), _r("p_retailprice"), _r("o_totalprice"), _r("c_acctbal")


def _root(x: str, e: float | str) -> str:
    return f"CASE WHEN {x} < 0 THEN 'NaN'::REAL ELSE CAST(pow(CAST({x} AS DOUBLE), CAST({_r(e)} AS DOUBLE)) AS REAL) END"


def _segment(v: str, x0: float, y0: float, x1: float, y1: float) -> str:
    t = f"CAST(({v} - {_r(x0)}) / ({_r(x1)} - {_r(x0)}) AS REAL)"
    return f"({_r(y1)} * {t} + {_r(y0)} * ({_r(1)} - {t}))"


def _line(v: str, points: list) -> str:
    out = f"CASE WHEN {v} <= {_r(points[0][0])} THEN {_r(points[0][1])} "
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x1 > x0:
            out += f"WHEN {v} <= {_r(x1)} THEN {_segment(v, x0, y0, x1, y1)} "
    return out + f"ELSE {_r(points[-1][1])} END"


_SUM_ORDERS_SQL = f"{_TOTAL} + {_r('o_custkey')} * {_r(30)}"
_SUM_PART_SQL = f"{_SIZE} + {_PRICE} * {_r(0.5)}"
_MAP_SQL = f"CASE {_SIZE} WHEN 3 THEN {_r(7)} WHEN 11 THEN {_r(9.5)} WHEN 48 THEN {_r(2)} ELSE {_r(1)} END"
_NESTED_SQL = (
    f"({_line(_SIZE, [[1, 0], [20, 8], [50, 2]])}) * {_r(0.25)} + least(abs({_PRICE} - {_r(950)}), {_root(_SIZE, 0.5)})"
    f" + (CASE {_SIZE} WHEN 7 THEN {_r(2.5)} WHEN 9 THEN {_r(1.5)} ELSE {_r(0.5)} END) * ({_PRICE} * {_r(0.01)})"
)
_GEO_SQL = f"""
WITH p AS (SELECT c_custkey AS k, CAST(c_custkey % 180 - 90 AS REAL) AS lat, CAST(c_custkey * 7 % 360 - 180 AS REAL) AS lng FROM customer),
d AS (SELECT k, abs(lat - {_r(45)}) AS a, CAST(abs(lng - {_r(-69.9)}) * CAST(cos(radians(45)) AS REAL) AS REAL) AS b FROM p),
q AS (SELECT k, CAST(pow(CAST(a AS DOUBLE), 2) AS REAL) + CAST(pow(CAST(b AS DOUBLE), 2) AS REAL) AS s FROM d),
s AS (SELECT k, CAST(CAST(CAST(sqrt(CAST(s AS DOUBLE)) AS REAL) * CAST(6371 * pi() / 180 AS REAL) AS REAL) * {_r(-1)} AS REAL) AS score FROM q),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, k DESC) AS rank FROM s)
SELECT rank, CAST(k AS VARCHAR) AS id, score FROM r WHERE rank <= 25
"""

ORACLE_SQL: dict[str, str] = {
    "topk_field_price": _top("orders", _TOTAL, 10),
    "topk_field_ties": _top("part", _SIZE, 100),
    "topk_scale_neg": _top("customer", f"{_BAL} * {_r(-2.5)}", 10),
    "topk_sum_two": _top("orders", f"{_TOTAL} + {_r('o_custkey')}", 10),
    "topk_sum_weighted": _top("part", _SUM_PART_SQL, 20),
    "topk_product": _top("part", f"{_SIZE} * {_PRICE}", 10),
    "topk_min": _top("part", f"least({_SIZE} * {_r(20)}, {_PRICE})", 10),
    "topk_diff": _top("orders", f"abs({_TOTAL} - {_r(250000)})", 10),
    "topk_diff_expr": _top("part", f"abs({_SIZE} * {_r(20)} - {_PRICE})", 10),
    "topk_pow_sqrt": _top("part", _root(_PRICE, 0.5), 10),
    "topk_pow_sq": _top("orders", _root(f"({_TOTAL} * {_r(0.001)})", 2), 10),
    "topk_pow_neg_exp": _top("part", _root(_SIZE, -1.3), 60),
    "topk_pow_nan_dropped": _top("customer", _root(_BAL, 0.5), 5000),
    "topk_custom_map": _top("part", _MAP_SQL, 150),
    "topk_custom_map_dup": _top("part", f"CASE {_SIZE} WHEN 3 THEN {_r(2)} WHEN 11 THEN {_r(9.5)} ELSE {_r(1)} END", 150),
    "topk_custom_linear": _top("orders", _line(_TOTAL, [[0, 0], [100000, 40], [300000, 10], [500000, 90]]), 50),
    "topk_custom_linear_step": _top("part", _line(_SIZE, _CURVE), 500),
    "topk_custom_linear_single": _top("part", _r(4), 12),
    "topk_geo_distance": _GEO_SQL,
    "topk_nested": _top("part", _NESTED_SQL, 40),
    "min_score_inclusive": _top("part", _SIZE, 5000, where="score >= 45"),
    "limit_zero": _top("orders", _TOTAL, 0),
    "offset_page": _top("orders", _TOTAL, 7, 5),
    "offset_compat": """
WITH s AS (SELECT p_partkey AS k, CAST(p_size AS REAL) AS score FROM part WHERE p_size >= 50),
r AS (SELECT k, score, row_number() OVER (ORDER BY score DESC, k DESC) AS rank, count(*) OVER () AS n FROM s)
SELECT rank, CAST(k AS VARCHAR) AS id, score FROM r WHERE rank <= least(n, 13) - 4
""",
    "offset_compat_short": """
WITH r AS (
  SELECT s_suppkey AS k, CAST(s_acctbal AS REAL) AS score, count(*) OVER () AS n,
         row_number() OVER (ORDER BY CAST(s_acctbal AS REAL) DESC, s_suppkey DESC) AS rank
  FROM supplier
)
SELECT rank, CAST(k AS VARCHAR) AS id, score FROM r WHERE rank <= least(n, 150) - 60
""",
    "missing_field_sparse": f"""
WITH s AS (
  SELECT doc_id AS k, CAST(CAST(n_chars AS REAL) + CAST(quality AS REAL) * {_r(1000)} + CAST(toxic AS REAL) * {_r(-500)} AS REAL) AS score
  FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL
),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, k DESC) AS rank FROM s)
SELECT rank, CAST(k AS VARCHAR) AS id, score FROM r WHERE rank <= 50
""",
    "unknown_field_empty": "SELECT CAST(0 AS BIGINT) AS rank, '' AS id, CAST(0 AS REAL) AS score WHERE FALSE",
    "linear_query_floor0": _top("customer", f"{_BAL} * {_r(-1)}", 400, where="score >= 0"),
    "score_all_lineitem": f"""
SELECT l_orderkey AS _doc_id, CAST(l_linenumber AS VARCHAR) AS id, CAST({_r('l_quantity')} * {_r(100)} + {_r('l_extendedprice')} AS REAL) AS score FROM lineitem
""",
    "ingest_long_to_wide": """
SELECT CAST(user_id AS VARCHAR) AS id, max(CAST(value AS REAL)) FILTER (event_type = 'click') AS click,
       max(CAST(value AS REAL)) FILTER (event_type = 'purchase') AS purchase, max(CAST(value AS REAL)) FILTER (event_type = 'view') AS view
FROM events GROUP BY user_id
""",
}
_STORE_TOPK_SQL = f"""
WITH s AS (SELECT o_orderkey AS k, {_TOTAL} + {_r('o_custkey')} * {_r(30)} AS score, o_totalprice >= 300000 AS late FROM orders),
r AS (SELECT k, CAST(score AS REAL) AS score, row_number() OVER (ORDER BY CAST(score AS REAL) DESC, late DESC, k DESC) AS rank FROM s)
SELECT rank, CAST(k AS VARCHAR) AS id, score FROM r WHERE rank <= 25
"""
_CUSTOMERS_SQL = f"SELECT CAST(c_custkey AS VARCHAR) AS id, {_BAL} AS balance, {_r('c_nationkey')} AS nation FROM customer"
ORACLE_SQL |= {
    "ingest_json_lines": _CUSTOMERS_SQL,
    "ingest_csv": f"SELECT CAST(c_custkey AS VARCHAR) AS id, {_BAL} AS c_acctbal, {_r('c_nationkey')} AS c_nationkey, CAST(NULL AS REAL) AS c_mktsegment FROM customer",
    "ingest_fixed_width": f"SELECT CAST(p_partkey AS VARCHAR) AS id, {_SIZE} AS size, {_PRICE} AS price FROM part",
    "stream_feed": _CUSTOMERS_SQL,
    "store_round_trip": f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_TOTAL} AS price, {_r('o_custkey')} AS cust FROM orders",
    "store_document_ids": """
SELECT row_number() OVER (ORDER BY CAST(o_totalprice AS REAL) >= 300000, o_orderkey) AS doc, CAST(o_orderkey AS VARCHAR) AS id FROM orders
""",
    "store_topk": _STORE_TOPK_SQL,
    "store_pruned_topk": _STORE_TOPK_SQL,
    "store_clustered_topk": _STORE_TOPK_SQL,
    "store_compacted_topk": _STORE_TOPK_SQL,
    "store_union_of_batches": f"{_CUSTOMERS_SQL} UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CAST(s_acctbal AS REAL), CAST(NULL AS REAL) FROM supplier",
    "store_single_inserts": """
WITH r AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_acctbal AS REAL) AS score, s_suppkey AS k FROM supplier
           UNION ALL SELECT 'best', CAST(1000000 AS REAL), 100000000 UNION ALL SELECT '1', CAST(1000000 AS REAL), 100000001)
SELECT row_number() OVER (ORDER BY score DESC, k DESC) AS rank, id, score FROM r ORDER BY score DESC, k DESC LIMIT 10
""",
    "memory_store_topk": _top("part", f"{_SIZE} * {_PRICE}", 30),
    "version_swap": _top("orders", _TOTAL, 15),
    "linear_query_parsed": _top("part", f"{_SIZE} * {_r(20)} + {_PRICE} * {_r(-0.5)}", 30),
}
ORACLE_SQL |= {
    "pruned_topk_sum": _top("orders", _SUM_ORDERS_SQL, 10),
    "pruned_topk_sum_ties": ORACLE_SQL["topk_sum_weighted"],
    "pruned_topk_product": ORACLE_SQL["topk_product"],
    "pruned_topk_nested": ORACLE_SQL["topk_nested"],
    "pruned_topk_map": _top("part", _MAP_SQL, 30),
    "pruned_offset_page": _top("orders", _SUM_ORDERS_SQL, 7, 5),
}


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, which have no key, with their place in the file as the document id: the same however files are split."""
    items = table(spark, sf_dir, "lineitem")
    return items.withColumn(DOC, items.metadataColumn("_metadata").getField("row_index") + 1)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum of quantity and tax over line items, by line."""
    query = Query(["sum", _F("l_quantity"), ["scale", 2, _F("l_tax")]], limit=10)
    return top_k(numbered_lines(spark, sf_dir).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")), query)
