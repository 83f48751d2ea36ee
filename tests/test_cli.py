"""Command line, watched versions and the growing benchmark."""

import argparse
import csv
import json
import threading
import time
import urllib.parse
import urllib.request

import pytest

from tallyrank import benchmark, cli
from tallyrank.operators.topk import Query, collect
from tallyrank.service import serve
from tallyrank.sources import ingest
from tallyrank.sources.store import Store

AGE = ["field", "age"]


def test_arguments():
    args = cli.parser().parse_args(["serve", "--datadir", "/x", "--readonly", "--numshards", "4"])
    assert (args.port, args.interface, args.readonly, args.automigrate) == (11625, "", True, False)
    assert cli.parser().parse_args(["load"]).files == []
    for wrong in ([], ["drop"], ["benchmark"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(wrong)


def test_load_from_lines(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    lines = [json.dumps({"id": f"p{k}", "values": {"age": k}}) + "\n" for k in range(5)]
    lines.insert(2, "{broken\n")
    assert cli.load_lines(store, lines, 2) == 5
    assert collect(Store(spark, store.path).query(Query(AGE, limit=3)))["Ids"] == ["p4", "p3", "p2"]
    assert len(store.manifest["batches"]) == 3 and cli.load_lines(store, []) == 0


def test_served_versions_change_while_serving(spark, tmp_path):
    def version(name, ident):
        Store(spark, str(tmp_path / name)).bulk_index(ingest.from_records(spark, [(ident, {"age": 1})]))

    versions = cli.open_served(spark, argparse.Namespace(automigrate=True, datadir=f"{tmp_path}/people-", poll=0.1))
    with pytest.raises(LookupError):
        versions.query(Query(AGE))
    server = serve(versions)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for name, ident in (("people-1", "old"), ("people-2", "new")):
            version(name, ident)
            until = time.time() + 30
            while versions.name != name and time.time() < until:
                time.sleep(0.05)
            url = f"http://127.0.0.1:{server.server_address[1]}/?score={urllib.parse.quote(json.dumps(AGE))}"
            assert json.load(urllib.request.urlopen(url))["Ids"] == [ident]
        version("people-0", "older")
        time.sleep(0.5)
        assert versions.name == "people-2"
    finally:
        versions.close()
        server.shutdown()


def test_growing_benchmark(spark, tmp_path):
    assert benchmark.checkpoints(300_000) == [1000, 4000, 13_000, 40_000, 121_000, 221_000, 300_000]
    source = tmp_path / "census.csv"
    with source.open("w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["fertility", "age", "wages", "sex", "weekly_work_hours"])
        out.writerows([k % 5, k % 90, k % 977, k % 2, k % 60] for k in range(1500))
    benchmark.run_csv(spark, str(source), str(tmp_path / "store"), 5000, str(tmp_path / "out.csv"))
    lines = list(csv.reader((tmp_path / "out.csv").open()))
    assert lines[0] == ["records", "index", *(f"query_{k}" for k in range(1, 7))] and [line[0] for line in lines[1:]] == ["1000", "1500"]
    store = Store(spark, str(tmp_path / "store"))
    assert collect(store.query(Query(AGE, limit=1)))["Scores"] == [89.0] and store.read().count() == 1500
