"""Retrieval semantics on small records: all functions, options and traps."""

import math

import pytest

from tallyrank.operators.topk import Query, collect, linear_query, parse_weights, top_k
from tallyrank.sources import ingest
from tallyrank.sources.store import MemoryStore

PEOPLE = [
    ("r1", {"age": 32, "height": 2.0, "lat": 45, "lon": -70}),
    ("r2", {"age": 25, "height": 1.5, "lat": 43, "lon": -69}),
    ("r3", {"age": 16, "height": 2.5, "lat": 45, "lon": -95}),
]
AGE, HEIGHT = ["field", "age"], ["field", "height"]

CASES = [
    (HEIGHT, 2, ["r3", "r1"], [2.5, 2.0]),
    (["sum", AGE, HEIGHT], 2, ["r1", "r2"], [34, 26.5]),
    (["sum", AGE, HEIGHT], 1, ["r1"], [34]),
    (["sum", ["scale", 0.1, AGE], ["scale", 10, HEIGHT]], 2, ["r3", "r1"], [26.6, 23.2]),
    (["sum", ["scale", -1, AGE], ["scale", -1, HEIGHT]], 2, ["r3", "r2"], [-18.5, -26.5]),
    (["sum", AGE, ["scale", -100, HEIGHT]], 3, ["r2", "r1", "r3"], [-125, -168, -234]),
    (["sum", AGE, HEIGHT], 0, [], []),
    (["sum", AGE, ["pow", HEIGHT, 2]], 3, ["r1", "r2", "r3"], [36, 27.25, 22.25]),
    (["sum", AGE, ["pow", HEIGHT, 10]], 3, ["r3", "r1", "r2"], [9552.743, 1056, 82.66504]),
    (["product", AGE, HEIGHT], 3, ["r1", "r3", "r2"], [64, 40, 37.5]),
    (["min", AGE, HEIGHT], 3, ["r3", "r1", "r2"], [2.5, 2.0, 1.5]),
    (["custom_linear", [[0, 0], [30, 1], [100, 0]], AGE], 3, ["r1", "r2", "r3"], [0.9714286, 0.8333333, 0.53333336]),
    (["geo_distance", 45, -69.9, "lat", "lon"], 3, ["r3", "r2", "r1"], [1973.530, 233.3770, 7.862549]),
    (["geo_distance", 20, 70, "lat", "lon"], 3, ["r3", "r1", "r2"], [17463.37, 14890.25, 14747.43]),
]


@pytest.fixture(scope="module")
def people(spark):
    store = MemoryStore(spark)
    store.bulk_index(ingest.from_records(spark, PEOPLE))
    return store


@pytest.mark.parametrize("score,limit,ids,scores", CASES)
def test_people(people, score, limit, ids, scores):
    got = collect(people.query(Query(score, limit=limit)))
    assert got["Ids"] == ids
    assert got["Scores"] == pytest.approx(scores, rel=2e-6)


@pytest.fixture(scope="module")
def sparse(spark):
    rows = [
        (1, "p", 1.0, 4.0), (2, "q", None, 9.0), (3, "p", 3.0, None), (4, "s", 3.0, 1.0),
        (5, "t", -2.0, 3.0), (6, "u", 0.0, 3.0), (7, "v", float("nan"), 3.0),
    ]
    return spark.createDataFrame(rows, "_doc_id long, id string, a float, b float")


def ask(df, score, **options):
    return collect(top_k(df, Query(score, **options)))


A, B = ["field", "a"], ["field", "b"]


def test_only_complete_rows_answer(sparse):
    assert ask(sparse, ["min", A, B])["Ids"] == ["v", "s", "p", "u", "t"]  # NaN is left out of a minimum
    assert ask(sparse, ["sum", A, ["scale", 0, B]])["Ids"] == ["s", "p", "u", "t"]


def test_unknown_field_gives_nothing(sparse):
    assert ask(sparse, ["sum", A, ["field", "colour"]]) == {"Ids": [], "Scores": []}
    assert ask(sparse, ["custom_map", [], 3, ["field", "colour"]])["Ids"] == []


def test_ties_rank_the_later_document_first_and_ids_may_repeat(sparse):
    assert ask(sparse, A, limit=3)["Ids"] == ["s", "p", "p"]


def test_nan_is_dropped_and_infinity_kept(sparse):
    assert ask(sparse, A)["Ids"] == ["s", "p", "p", "u", "t"]
    got = ask(sparse, ["pow", A, -1])
    assert got["Ids"][0] == "u" and got["Scores"][0] == math.inf
    assert "t" not in ask(sparse, ["pow", A, 0.5])["Ids"]


def test_min_score_is_inclusive(sparse):
    assert ask(sparse, B, min_score=3)["Ids"] == ["q", "p", "v", "u", "t"]


def test_both_offsets(sparse):
    assert ask(sparse, B, limit=2, offset=1)["Ids"] == ["p", "v"]
    assert ask(sparse, B, limit=2, offset=1, offset_mode="compat")["Ids"] == ["q", "p"]
    assert ask(sparse, B, limit=5, offset=4, offset_mode="compat")["Ids"] == ["q", "p"]
    assert ask(sparse, B, limit=2, offset=50)["Ids"] == []
    assert ask(sparse, B, limit=2, offset=50, offset_mode="compat")["Ids"] == []


def test_product_of_negatives_and_distance_of_two(sparse):
    assert ask(sparse, ["product", A, A, B], limit=1)["Scores"] == [12.0]
    assert ask(sparse, ["diff", A, B], limit=1) == {"Ids": ["t"], "Scores": [5.0]}
    assert ask(sparse, ["diff", 2, A], limit=1)["Scores"] == [4.0]


def test_repeated_points(sparse):
    assert ask(sparse, ["custom_map", [[3, 7], [3, 5], [-0.0, 6]], 1, A])["Scores"] == [6, 5, 5, 1, 1, 1]
    step = ["custom_linear", [[0, 0], [1, 1], [1, 9], [3, 5]], A]
    assert sorted(ask(sparse, step)["Scores"]) == [0, 0, 1, 5, 5, 5]
    assert ask(sparse, ["custom_linear", [[1, 4]], A], limit=1)["Scores"] == [4]


def test_long_tables_of_points(spark):
    rows = spark.createDataFrame([(i, str(i), float(i)) for i in range(50)], "_doc_id long, id string, a float")
    points = [[i, (i * 37) % 101] for i in range(0, 600)]
    got = ask(rows, ["custom_map", points, -1, A], limit=50)
    want = sorted((((i * 37) % 101, i) for i in range(50)), reverse=True)
    assert [(s, int(i)) for s, i in zip(got["Scores"], got["Ids"])] == want
    assert ask(rows, ["custom_linear", points, A], limit=50) == got


@pytest.mark.parametrize(
    "bad",
    [
        [], "x", "[", 3, None, ["sum"], ["product"], ["min"], ["max", A], ["field"], ["field", 3], ["field", "a", "b"], ["scale", "2", A], ["scale", True, A],
        ["scale", A, 2], ["diff", 1], ["pow", A, None], ["pow", 2, A], ["custom_map", [[1]], 0, A], ["custom_map", 5, 0, A], ["custom_linear", [], A],
        ["custom_linear", [[2, 1], [1, 1]], A], ["geo_distance", 1, 2, "a"], ["sum", []], ["scale", 1e60, A], ["scale", float("nan"), A], [["field", "a"]],
    ],
)
def test_malformed_expressions(bad):
    with pytest.raises(ValueError):
        Query(bad)


def test_unknown_function_names_itself():
    with pytest.raises(ValueError, match="'max' is not recognized"):
        Query(["max", A])


@pytest.mark.parametrize("options", [{"limit": -1}, {"offset": -1}, {"limit": 1.5}, {"limit": True}, {"min_score": "1"}, {"min_score": math.nan}, {"offset_mode": "x"}])
def test_bad_options(options):
    with pytest.raises(ValueError):
        Query(A, **options)


def test_linear_queries(sparse):
    assert parse_weights("a=1, b=-2.5") == {"a": 1.0, "b": -2.5}
    for bad in ("a", "=1", "a=x"):
        with pytest.raises(ValueError):
            parse_weights(bad)
    assert collect(top_k(sparse, linear_query({"a": 1.0}, 10)))["Ids"] == ["s", "p", "p", "u"]
    with pytest.raises(ValueError):
        linear_query({}, 3)


def test_clashing_names_and_empty_tables(spark, sparse):
    more = sparse.selectExpr("*", "a as score", "b as rank", "b as `odd.name`")
    assert ask(more, ["sum", ["field", "score"], ["field", "rank"]], limit=1)["Ids"] == ["p"]
    assert ask(more, ["field", "odd.name"], limit=1)["Ids"] == ["q"]
    assert ask(sparse.limit(0), A) == {"Ids": [], "Scores": []}


def test_plan_keeps_only_the_best_rows(sparse):
    plan = top_k(sparse, Query(["sum", A, B], limit=3))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
