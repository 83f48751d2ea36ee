"""Ingest, store, versions, streaming and the HTTP front end."""

import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from tallyrank.operators.topk import Query, collect
from tallyrank.service import serve
from tallyrank.sources import ingest
from tallyrank.sources.store import Conflict, MemoryStore, Store
from tallyrank.sources.versions import VersionedStore
from tallyrank.streaming.feed import feed, read_json_stream

AGE, WEIGHT = ["field", "age"], ["field", "weight"]
PAIR = [("jim", {"age": 21, "weight": 170}), ("bob", {"age": 34, "weight": 150})]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_append_query_reopen(spark, store):
    assert store.bulk_index(ingest.from_records(spark, PAIR)) == 2
    assert collect(store.query(Query(AGE)))["Ids"] == ["bob", "jim"]
    assert collect(store.query(Query(["sum", AGE, WEIGHT])))["Ids"] == ["jim", "bob"]
    store.index("ann", {"age": 50})
    store.index("jim", {"age": 34, "height": 2})
    again = Store(spark, store.path)
    assert [(r["_doc_id"], r["id"]) for r in again.read().orderBy("_doc_id").collect()] == [(1, "jim"), (2, "bob"), (3, "ann"), (4, "jim")]
    assert collect(again.query(Query(AGE)))["Ids"] == ["ann", "jim", "bob", "jim"]
    assert collect(again.query(Query(["sum", AGE, WEIGHT])))["Ids"] == ["jim", "bob"]
    assert collect(again.query(Query(["sum", AGE, ["field", "height"]])))["Ids"] == ["jim"]
    assert collect(again.query(Query(["field", "nothing"])))["Ids"] == []
    again.compact(["age"])
    assert collect(Store(spark, store.path).query(Query(AGE)))["Ids"] == ["ann", "jim", "bob", "jim"]


def test_empty_store_and_empty_records(spark, store):
    assert collect(store.query(Query(AGE))) == {"Ids": [], "Scores": []}
    assert store.bulk_index(ingest.from_records(spark, [])) == 0
    assert store.bulk_index(ingest.from_records(spark, [("x", {}), ("y", {"age": float("nan")})])) == 0
    assert store.bulk_index(ingest.from_records(spark, [("x", {}), ("y", {"age": 1})])) == 1
    assert [r["_doc_id"] for r in store.read().collect()] == [1]


def test_second_writer_is_refused(spark, store):
    other = Store(spark, store.path)
    store.index("a", {"v": 1})
    with pytest.raises(Conflict):
        other.index("b", {"v": 2})
    other.reload()
    other.index("b", {"v": 2})
    assert collect(other.query(Query(["field", "v"])))["Ids"] == ["b", "a"]


def test_pruned_store_equals_plain(spark, store):
    df = spark.range(3000).selectExpr("cast(id as string) as id", "cast((id * 7919) % 1000 as float) as a", "cast((id * 104729) % 77 as float) as b")
    for k in range(3):
        store.append(df.filter(f"cast(id as long) % 3 = {k}"), cluster_by=["a"])
    for score in (["sum", ["field", "a"], ["scale", 5, ["field", "b"]]], ["product", ["field", "a"], ["field", "b"]], ["scale", -1, ["field", "a"]]):
        query = Query(score, limit=12)
        assert collect(store.query(query)) == collect(store.query(query, pruned=False))
    assert sorted(r["_doc_id"] for r in store.read().select("_doc_id").collect()) == list(range(1, 3001))


def test_json_lines(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"id": "person_1", "values": {"age": 10, "height": 53}}\n{"Id": "person_2", "VALUES": {"age": 32}}\nbroken\n\n{"id": "p3"}\n')
    store = MemoryStore(spark)
    assert store.bulk_index(ingest.read_json_lines(spark, str(path))) == 2
    assert collect(store.query(Query(AGE)))["Ids"] == ["person_2", "person_1"]


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("id,first,second,third\nr1,1,2,3\nr2,0.1,11.234,1.23\nr3,0,NaN,x\n")
    rows = ingest.read_csv(spark, str(path)).orderBy("id").collect()
    assert [r.asDict() for r in rows] == [
        {"id": "1", "first": 1.0, "second": 2.0, "third": 3.0},
        {"id": "2", "first": pytest.approx(0.1), "second": pytest.approx(11.234), "third": pytest.approx(1.23)},
        {"id": "3", "first": 0.0, "second": None, "third": None},
    ]
    assert [r["id"] for r in ingest.read_csv(spark, str(path), "id").orderBy("id").collect()] == ["r1", "r2", "r3"]


def test_fixed_width_and_long(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("ab 12 7\ncd  x 9\n")
    rows = ingest.read_fixed_width(spark, str(path), {"id": (1, 2), "age": (3, 3), "n": (7, 1)}).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("ab", 12.0, 7.0), ("cd", None, 9.0)]
    long = spark.createDataFrame([("u", "a", 1.0), ("u", "b", 2.0), ("w", "a", 5.0), ("w", "c", 9.0)], "k string, f string, v double")
    assert sorted(tuple(r) for r in ingest.from_long(long, "k", "f", "v", ["a", "b"]).collect()) == [("u", 1.0, 2.0), ("w", 5.0, None)]


def test_bad_values_are_refused(spark):
    for bad in ({"a": "1"}, {"a": True}, {"a": None}):
        with pytest.raises(ValueError):
            ingest.from_records(spark, [("x", bad)])


def test_versions(spark, tmp_path):
    live = VersionedStore(spark, str(tmp_path / "live"), "v")
    with pytest.raises(LookupError):
        live.query(Query(AGE))
    Store(spark, str(tmp_path / "live" / "v1")).index("old", {"age": 1})
    Store(spark, str(tmp_path / "live" / "x9")).index("other", {"age": 1})
    assert live.refresh() and collect(live.query(Query(AGE)))["Ids"] == ["old"]
    Store(spark, str(tmp_path / "live" / "v2")).index("new", {"age": 1})
    assert collect(live.query(Query(AGE)))["Ids"] == ["old"]
    assert live.refresh() and collect(live.query(Query(AGE)))["Ids"] == ["new"]
    assert not live.refresh()


def test_stream_feeds_a_store_once(spark, tmp_path, store):
    folder, mark = tmp_path / "drop", str(tmp_path / "mark")
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"id": "a", "values": {"age": 1}}\n{"id": "b", "values": {"age": 2}}\n')
    feed(read_json_stream(spark, str(folder)), store, mark).awaitTermination()
    (folder / "2.jsonl").write_text('{"id": "c", "values": {"age": 3}}\nnonsense\n')
    feed(read_json_stream(spark, str(folder)), store, mark).awaitTermination()
    feed(read_json_stream(spark, str(folder)), store, mark).awaitTermination()
    store.reload()
    assert collect(store.query(Query(AGE)))["Ids"] == ["c", "b", "a"]
    assert store.manifest["fed"] == {mark: 1}
    store.index("d", {"age": 0})
    store.compact()
    assert Store(spark, store.path).manifest["fed"] == {mark: 1}


@pytest.fixture
def site(spark):
    server = serve(MemoryStore(spark))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def call(url, method="GET", body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, method=method)) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def test_http(site):
    assert call(f"{site}/jim", "PUT", b'{"age": 21, "weight": 170}') == (200, b"")
    assert call(f"{site}/", "PUT", json.dumps([{"id": "bob", "values": {"age": 34, "weight": 150}}, {"Id": "eve", "Values": {"age": 5}}]).encode()) == (200, b"")
    get = lambda **p: call(f"{site}/?{urllib.parse.urlencode(p)}")
    status, body = get(score=json.dumps(AGE))
    assert status == 200 and json.loads(body) == {"Ids": ["bob", "jim", "eve"], "Scores": [34.0, 21.0, 5.0]}
    assert json.loads(get(score=json.dumps(AGE), limit=1, offset=1, minScore=6)[1])["Ids"] == ["jim"]
    assert get(score="[")[0] == 400 and get()[0] == 400 and get(score=json.dumps(AGE), limit="x")[0] == 400
    assert get(score='["max", 1]')[0] == 500
    assert call(f"{site}/other")[0] == 404 and call(f"{site}/", "POST", b"[]")[0] == 404
    assert call(f"{site}/x", "PUT", b"[1]")[0] == 400 and call(f"{site}/x", "PUT", b'{"a": "b"}')[0] == 400
