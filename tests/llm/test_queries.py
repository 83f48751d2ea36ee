"""Registered queries: SQL twins, and the pipeline against brute force."""

import glob
import os

import corpus_pipeline
import numpy as np
import pytest
from test_operators import ITEMS, ODD_SCHEMA, SHARED, brute_fingerprint, check_pieces, prose, roots_of, words

from tallyrank.llm import toxicity
from tallyrank.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark, tmp_path):
    """Every stage by hand on a small corpus: insults, copies, near copies, benchmark passages."""
    base = [prose(150) for _ in range(60)]
    texts = [*base, base[0], base[1].replace(" ", "  "), base[2] + " tail", *(f"{b} Grimblot. {b[:40]}" for b in base[10:30]), base[3] + SHARED, None, ""]
    docs = [(i, t, None, "s", 1) for i, t in enumerate(texts)]
    toxic = [(i, 1, int("Grimblot" in (t or ""))) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, ODD_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS[:1], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = toxicity.train_on(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    import pyarrow as pa

    worst = model.probability(toxicity.Scorer(model).evidence(pa.array(texts, pa.string())))
    left = {i: t or "" for i, t in enumerate(texts) if worst[i] < toxicity.THRESHOLD}
    assert not any("Grimblot" in t for t in left.values()) and len(left) > 50
    seen = {}
    for i in sorted(left, key=lambda i: (-len(left[i]), i)):
        seen.setdefault("".join(left[i].encode().decode().translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))), i)
    left = {i: left[i] for i in seen.values()}
    fp = {i: brute_fingerprint(t) for i, t in left.items()}
    roots = roots_of(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i in sorted(left, reverse=True):
        least[roots[fp[i]]] = i
    item = words(ITEMS[0][1])
    grams = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    left = {i: left[i] for i in least.values() if not any(tuple(words(left[i])[k : k + 10]) in grams for k in range(len(words(left[i]))))}
    assert 83 not in left and 55 < len(left) < 64

    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in pieces.collect()} == set(left)
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    frame = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == table.columns
    from tallyrank.llm import packing

    check_pieces([(r["doc_id"], r["text"]) for r in frame.collect()], packing.pack(frame).collect())
    assert np.isfinite(worst).all()
