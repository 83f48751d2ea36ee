"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import pytest

from tallyrank.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
