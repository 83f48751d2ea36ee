"""The driver's contract, with and without the optional subpackage."""

import importlib
import sys

import __spark_entry__ as entry
from tallyrank.queries import ORACLE_SQL, QUERIES


def test_engine_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert all(entry.oracle_sql()[k] == v for k, v in ORACLE_SQL.items())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, 11))


def test_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("tallyrank.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tallyrank.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    fresh = importlib.reload(entry)
    assert set(fresh.queries()) == set(QUERIES) and fresh.oracle_sql() == ORACLE_SQL


def test_a_missing_dependency_of_the_subpackage_is_an_error(monkeypatch):
    import pytest

    for name in [m for m in sys.modules if m.startswith("tallyrank.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    pytest.importorskip("tallyrank.llm")
    for name in [m for m in sys.modules if m.startswith("tallyrank.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "pyarrow", None)
    with pytest.raises(ImportError):
        importlib.reload(entry).queries()
