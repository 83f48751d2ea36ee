"""The training-data operators against brute-force versions and on odd inputs."""

import gzip
import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyrank.llm import common, components, decontaminate, exact_dedup, license_scan, packing, quality, simhash, substring_dedup, toxicity, warc
from tallyrank.llm.license_texts import KNOWN

SF01 = "/root/testdata/sf0.1"
RNG = random.Random(11)
VOCAB = "the of and wörd straße naïve Ab C1 end. stop, x y zz long-word #tag 日本 été".split()


def prose(n, rng=RNG):
    return "".join(rng.choice(VOCAB) + rng.choice([" ", " ", " ", "\n", "\t", "  ", "\x0b", "\r\n", "\x0c"]) for _ in range(n))


SHARED = prose(60)
TEXTS = [
    None, "", " \n\t", "one", "one", "two words", "two\twords", " two  words ", SHARED, SHARED + "tail", "head " + SHARED, SHARED + SHARED,
    *(prose(RNG.randrange(1, 90)) for _ in range(40)), prose(4000), "a " * 300, " x y\u0085z", "A" * 5000,
]
TEXTS += [TEXTS[20], TEXTS[21].replace(" ", "  "), TEXTS[22] + SHARED]
ROWS = [(i * 3 % len(TEXTS), t) for i, t in enumerate(TEXTS)]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", 1) for i, t in ROWS], ODD_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, one id with two texts."""
    rows = [(None, "a b", None, None, None), (None, "a b", None, None, None), (1, "a b", "x", "y", 0), (1, "a  b", "x", "y", 0), (1, SHARED, "x", "y", 0), (1, SHARED, "x", "y", 0), (2, None, "x", "y", 0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Exact dedup


def test_exact_dedup(docs):
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[(t or "").translate(strip)].append((-len(t or ""), i))
    got = by_id(exact_dedup.exact_dedup_report(docs))
    assert len(got) == len(ROWS)
    for key, members in groups.items():
        for _, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(members)[1], len(members), i == min(members)[1])
            assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(m)[1] for m in groups.values())


def test_exact_dedup_beyond_the_broadcast_bound(spark, docs, tmp_path, monkeypatch):
    want = sorted(map(tuple, exact_dedup.exact_dedup_report(docs).collect()))
    kept = sorted(r["doc_id"] for r in exact_dedup.exact_dedup(docs).collect())
    docs.repartition(5).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sorted(map(tuple, exact_dedup.exact_dedup_report(docs).collect())) == want
        assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(docs).collect()) == kept  # rows of no file
        plans, made = [], type(docs).join

        def seen(self, other, *args, **options):
            out = made(self, other, *args, **options)
            plans.append((self.columns, out._jdf.queryExecution().executedPlan().toString()))
            return out

        monkeypatch.setattr(type(docs), "join", seen)
        assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()) == kept
        with_rows = [plan for columns, plan in plans if "row" in columns]
        assert len(with_rows) > 1  # a join for each group of files
        for plan in with_rows:
            left = plan[: plan.index("BroadcastExchange")]
            assert "Exchange hashpartitioning" not in left and "Sort" not in left
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_single_set_bit_lets_a_row_pass(spark):
    keys = exact_dedup.keys_of(spark.range(20_000).selectExpr("id as doc_id", "concat('text ', id) as text"))
    maybe, alone = exact_dedup.split_by_filter(keys, 20_000)
    assert maybe.count() < 400 and maybe.count() + alone.count() == 20_000


def test_exact_dedup_odd_rows(odd, nothing):
    rows = exact_dedup.exact_dedup_report(odd).collect()
    assert len(rows) == 8 and sum(r["group_size"] == 4 for r in rows) == 4
    kept = exact_dedup.exact_dedup(odd).collect()
    assert sorted((r["text"] or "") for r in kept) == sorted(["", "a  b", SHARED])
    assert next(r["doc_id"] for r in kept if not r["text"]) == 2
    assert exact_dedup.exact_dedup(nothing).collect() == [] and exact_dedup.exact_dedup_report(nothing).collect() == []


NAMES = ["__sha", "__len", "row", "id", "kept", "best", "keep_id", "__id", "__h", "h", "d", "w", "lines", "hits", "root", "fp", "label", "score", "toxic", "count"]


def test_clashing_columns_stay_as_they_are(spark, odd, docs, items):
    more = odd.filter("doc_id is not null").selectExpr("doc_id", "text", *[f"'{n}' as `{n}`" for n in NAMES])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for result in (
        exact_dedup.exact_dedup(more), simhash.near_dedup(more), decontaminate.remove_contaminated(more, items.limit(0)),
        decontaminate.remove_contaminated(more, items, mode="spans"), toxicity.remove_toxic(more, labels),
    ):
        assert result.columns == more.columns
        for r in result.collect():
            assert all(r[n] == n for n in NAMES)
    for report in (
        exact_dedup.exact_dedup_report(more), simhash.near_duplicates(more), decontaminate.contamination_report(more, items), substring_dedup.substring_dedup(more),
        license_scan.license_report(more), toxicity.toxicity_report(more, labels), quality.quality_report(more, labels),
    ):
        assert report.count() == more.count()
    assert packing.pack(more).count() >= more.count()


# Decontamination


def words(text):
    import re

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


ITEMS = [(1, SHARED), (2, "the of"), (3, None), (4, ""), (10, prose(12)), (5, SHARED[: len(SHARED) // 2]), (6, "!!!")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def brute_contamination(text):
    w, hit, ids = words(text), set(), set()
    for i, t in ITEMS:
        v = words(t)
        n = min(10, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == v[a : a + n]:
                    hit.update(range(b, b + n))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def test_contamination(docs, items):
    got = by_id(decontaminate.contamination_report(docs, items))
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        n, hit, ids = brute_contamination(t)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(ids), hit > 0), t
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()


def test_removal_of_documents_and_spans(docs, items, odd, nothing, monkeypatch):
    clean = {i for i, t in ROWS if not brute_contamination(t)[1]}
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == clean
    cut = decontaminate.remove_contaminated(docs, items, mode="spans")
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    for i, t in ROWS:
        if i in clean:
            assert texts[i] == t
        else:
            assert len(words(texts[i])) == len(words(t)) - brute_contamination(t)[1]
    assert len(decontaminate.contamination_report(odd, items).collect()) == 8
    assert decontaminate.contamination_report(nothing, items).collect() == []
    assert decontaminate.contamination_report(docs, items.limit(0)).filter("contaminated").count() == 0
    with pytest.raises(ValueError):
        decontaminate.remove_contaminated(docs, items, mode="x")
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert {r["doc_id"] for r in decontaminate.remove_contaminated(docs, items).collect()} == clean


def test_few_clean_windows_pass_whatever_the_benchmark_has(spark):
    grams = spark.range(200_000).selectExpr("10 as size", "transform(sequence(1, 10), k -> concat(id % 50, '-', if(k in (1, 10), 0, id * k))) as gram", "array('1') as item_ids")
    clean = spark.range(2000).selectExpr("id as doc_id", "0L as text_hash", "transform(sequence(1, 109), k -> concat(id % 50, '-', if(k % 9 = 1, 0, -id * k - k))) as w")
    passed = decontaminate.scanned(clean, grams).filter("at >= 0").count()
    assert passed < 0.01 * 2000 * 12 and decontaminate.filter_bits(4_000_000) // 4_000_000 >= 32  # of twelve windows with the end words of all grams
    assert decontaminate.scanned(clean, grams.limit(0)).count() == 2000


def test_items_of_every_length_match(spark):
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(1, 13)]
    docs = [(n, f"a b {t} c") for n, t in items] + [(100, "a b c"), (101, "")]
    report = decontaminate.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: (r["n_hit"], list(r["item_ids"])) for r in report.collect()} == {**{n: (n, [str(n)]) for n, _ in items}, 100: (0, []), 101: (0, [])}


def test_no_python_on_native_paths(docs, items):
    for df in (exact_dedup.exact_dedup(docs), decontaminate.contamination_report(docs, items), license_scan.license_report(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


# Substring dedup


def brute_substrings(rows, k):
    split = {i: (t or "").encode().split() for i, t in rows}
    seen, out = set(), {}
    for i in sorted(split):
        w, gone = split[i], set()
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            if key in seen:
                gone.update(range(a, a + k))
            seen.add(key)
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


@pytest.mark.parametrize("window,mer", [(20, 4), (5, 2), (3, 3)])
def test_substring_dedup(docs, window, mer):
    got = by_id(substring_dedup.substring_dedup(docs, window, mer))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == brute_substrings(ROWS, window)


def test_substring_dedup_over_slices_and_odd_rows(docs, odd, nothing, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 300)
    got = by_id(substring_dedup.substring_dedup(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == brute_substrings(ROWS, 20)
    rows = substring_dedup.substring_dedup(odd, 2, 1).collect()
    assert len(rows) == 8 and sum(r["n_removed"] for r in rows if r["doc_id"] is None) == 4
    assert substring_dedup.substring_dedup(nothing).collect() == []


def test_substring_dedup_of_one_row_given_in_two_slices(spark):
    once, twice = [(5, SHARED + "tail"), (2, prose(40) + SHARED), (7, prose(30))], [(1, SHARED), (3, SHARED + SHARED), (4, prose(50))]
    rows = [(i, t, None, "s", 1) for i, t in once + twice + twice]
    apart = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), ODD_SCHEMA)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(apart).collect())
    expected = brute_substrings(once + twice, 20)
    assert expected[1][1] == 0 and got == sorted((i, *expected[i]) for i, _ in once + twice + twice)


def test_heavy_stretches_only_reroute(docs, monkeypatch):
    keyed = docs.selectExpr("cast(coalesce(text, '') as binary) as text")
    heavy, n = substring_dedup.heavy_stretches(keyed, 1, 0.02)
    assert 0 < len(heavy) <= 100 and n == sum(len((t or "").encode().split()) for _, t in ROWS)
    assert [len(substring_dedup.heavy_stretches(keyed.limit(0))[0]), substring_dedup.heavy_stretches(keyed.limit(0))[1]] == [0, 0]
    monkeypatch.setattr(substring_dedup, "heavy_stretches", lambda keyed, mer: (heavy, n))
    got = by_id(substring_dedup.substring_dedup(docs, 4, 1))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == brute_substrings(ROWS, 4)


def test_buckets_follow_the_words_and_large_ones_take_rounds(docs, monkeypatch):
    partitions, buckets = substring_dedup.dealing(10**12, 200)
    assert 3.2e12 / buckets <= substring_dedup.BUCKET_WORDS * 1.01 and partitions <= substring_dedup.MAX_PARTITIONS
    assert substring_dedup.dealing(1000, 4) == (4, 24)
    monkeypatch.setattr(substring_dedup, "ROUND_WORDS", 500)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = by_id(substring_dedup.substring_dedup(docs))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == brute_substrings(ROWS, 20)


def test_equal_hashes_are_settled_by_words():
    number = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    same = np.zeros(len(number), np.uint64)
    assert substring_dedup.repeats(number, same, np.arange(7), 3).tolist() == [False] * 6 + [True]


# SimHash


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = list(nodes)
    for a in range(len(nodes)):
        for b in range(a):
            if linked(nodes[a], nodes[b]):
                parent[find(nodes[a])] = find(nodes[b])
    return {n: find(n) for n in nodes}


def test_near_duplicates(docs, odd, nothing):
    fp = {i: brute_fingerprint(t) for i, t in ROWS}
    roots = roots_of(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i in sorted(fp, reverse=True):
        least[roots[fp[i]]] = i
    got = by_id(simhash.near_duplicates(docs))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{f:016x}", least[roots[f]]) for i, f in fp.items()}
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert len(simhash.near_duplicates(odd).collect()) == 8 and simhash.near_duplicates(nothing).collect() == []
    assert len(simhash.near_dedup(odd).collect()) == 3 and simhash.near_dedup(nothing).collect() == []


def test_shingles_hash_as_in_spark(spark):
    import xxhash

    from pyspark.sql import functions as F

    text = "été two three"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("n,flips", [(400, 3), (3000, 6)])
def test_links_of_planted_fingerprints(spark, n, flips):
    rng = np.random.default_rng(n)
    centers = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    points = set()
    for k in range(n):
        x = int(centers[k % 2 if k % 3 else k % 6])
        for b in rng.choice(64, rng.integers(0, flips + 1), replace=False):
            x ^= 1 << int(b)
        points.add(x)
    points |= {int(v) for v in rng.integers(0, 1 << 63, 200, dtype=np.uint64)}
    fps = np.array(sorted(points), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in components.connected_components(simhash.fingerprint_links(df)).collect()}
    label = simhash._least_labels(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    signed = fps.view(np.int64)
    mine = [got.get(int(v), int(v)) for v in signed]
    pairs = {(int(a), m) for a, m in zip(label, mine)}
    assert len(pairs) == len(set(label.tolist())) == len(set(mine))


def test_crowded_cells_are_dealt_out_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    alternating = int("01" * 32, 2)  # every segment counts one bit
    points = set()
    for _ in range(300):
        x = alternating
        for k in rng.choice(32, 16, replace=False):
            x ^= 3 << (2 * int(k))  # swaps keep all counts
        for _ in range(4):
            y = x
            for b in rng.choice(64, 3, replace=False):
                y ^= 1 << int(b)
            points |= {x, y}
    fps = np.array(sorted(points), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    want = components.connected_components(simhash.fingerprint_links(df)).collect()
    whole = simhash.dealt_cells(df).groupBy("grid", "cell").count().agg({"count": "max"}).first()[0]
    monkeypatch.setattr(simhash, "CROWD", 20)
    finer = simhash.dealt_cells(df).groupBy("grid", "cell").count().agg({"count": "max"}).first()[0]
    got = components.connected_components(simhash.fingerprint_links(df)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 1000 and finer * 10 < whole


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000), (None, 3)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + k: 1000 for k in range(50)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# Packing


def check_pieces(rows, pieces):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    of = defaultdict(list)
    seq = defaultdict(list)
    for p in pieces:
        of[p["doc_id"]].append(p)
        seq[p["sequence_id"]].append(p)
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(of.pop(i), key=lambda p: p["start"])
        assert b"".join(p["ids"] for p in own) == ids.tobytes() and {p["doc_tokens"] for p in own} == {len(ids)}
        assert [p["start"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
    assert not of
    sizes = []
    for own in seq.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0] + [p["length"] for p in own])[:-1].tolist()
        sizes.append(sum(p["length"] for p in own))
    assert all(s == 2048 or s & (s - 1) == 0 and s < 2048 for s in sizes)


SPECIAL = [(900, "<|endoftext|> x"), (907, "a <|endoftext|> b"), (908, "x<|endoftext|>"), (909, "<|endoftext|><|endoftext|>  <|endoftext"), (901, "don't  stop now 　 ok  a"), (902, "  lead"), (903, "trail  "), (904, "\n\n"), (905, "a\u0085 b"), (906, "é è \x7f x")]


def test_packing(spark, docs, nothing):
    rows = ROWS + SPECIAL
    extra = spark.createDataFrame([(i, t, None, "s", 1) for i, t in SPECIAL], ODD_SCHEMA)
    pieces = packing.pack(docs.union(extra).coalesce(2)).collect()
    check_pieces(rows, pieces)
    assert packing.pack(nothing).collect() == []
    whole = packing.sequences(spark.createDataFrame(pieces, packing.PIECES)).collect()
    assert all(len(r["ids"]) == 4 * r["padded_to"] for r in whole)


def test_packing_of_odd_rows(odd):
    pieces = packing.pack(odd.coalesce(1)).collect()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_registered_ids_are_those_of_the_unmodified_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    from tallyrank.llm.queries import op6_packing

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>x"), (3, "plain  text"), (4, None), (5, ""), (6, "<|endoftext|>"), (7, "<|endoftext| >"), *((10 + i, t) for i, t in enumerate(TEXTS))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for p in packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect():
        got[p["doc_id"]].append((p["start"], p["ids"]))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in rows}
    assert {i: b"".join(x for _, x in sorted(own)) for i, own in got.items()} == ids
    of = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in op6_packing(spark, str(tmp_path)).collect()}
    assert 50256 in np.frombuffer(ids[1], "<u4") and of[6, 0] == zlib.crc32(ids[6])


def test_the_pool_stays_bounded_where_lengths_do_not_fit(monkeypatch):
    monkeypatch.setattr(packing, "POOL_TOKENS", 64)
    out = defaultdict(list)
    packer = packing.Packer(8, lambda doc_id, start, ids, total, sequence, offset: out[sequence].append((doc_id, start, ids)))
    for i in range(200):
        packer.add(i, np.arange(5) + 5 * i)
        assert packer.tokens < 64
    packer.finish()
    pieces = sorted((i, start, ids.tolist()) for own in out.values() for i, start, ids in own)
    assert [x for _, _, ids in pieces for x in ids] == list(range(1000)) and {sum(len(p[2]) for p in own) for own in out.values()} == {8}


def test_closest_fill_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            for _ in range(c):
                sums |= {s + n for s in sums if s + n <= room}
        used = packing.closest_fill(sorted(counts), counts.__getitem__, room)
        assert sum(n * c for n, c in used.items()) == max(sums)
        assert all(c <= counts[n] for n, c in used.items())


def test_other_tokenizer_files():
    import public_tokenizers

    assert packing.byte_ranks(public_tokenizers.path("word_bpe_49k.json")) is None
    assert len(packing.byte_ranks(packing.default_tokenizer())) == 50256


# Classifiers


def test_toxicity_tolerates_disguise():
    rng = random.Random(1)
    clean = ["".join(rng.choice("aeioubcdfglmnprstv") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    bad = ["grimblot", "zwafflen", "snorkite"]
    texts, toxic = [], []
    for k in range(400):
        t = [rng.choice(clean) for _ in range(40)]
        if k % 4 == 0:
            t[rng.randrange(40)] = rng.choice(bad).capitalize() + rng.choice([".", "", ","])
        texts.append(" ".join(t) + ".")
        toxic.append(k % 4 == 0)
    scorer = toxicity.Scorer(model := toxicity.train(texts, np.array(toxic)))
    import pyarrow as pa

    score = lambda xs: model.probability(scorer.evidence(pa.array(xs, pa.string())))
    assert ((score(texts) >= toxicity.THRESHOLD) == np.array(toxic)).mean() > 0.99
    hidden = ["aa bo g.r.i.m.b.l.o.t da", "aa g r i m b l o t da", "bo zwaff-len", "SNORKITE!", "bo grimbblot da", "aa gr1mbl0t bo", "aa snor kite bo", "aa grimb bo grimlot"]
    assert (score(hidden) >= toxicity.THRESHOLD).all()
    plain = score(["", None, "!!! ...", " ".join(clean[:50])])
    assert (plain < toxicity.THRESHOLD).all() and ((plain >= 0) & (plain <= 1)).all()


def naive_kernel(x, y):
    """Sum over common three-letter subsequences within the span of the products of their weights, normalised."""
    def features(s):
        out = defaultdict(float)
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    def dot(u, v):
        return sum(w * v[f] for f, w in u.items() if f in v)

    a, b = features(x), features(y)
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_windows_are_compared_by_the_gap_weighted_kernel():
    words = ["idiot", "idxiot", "idit", "abcabc", "worthles", "wörtlich", "xyz", "id^iot"]
    points = toxicity.windows_of([w for w in words])[0]
    order = toxicity.windows_of(words)[1]
    index, weight = toxicity.subsequences(points)
    dense = [defaultdict(float) for _ in words]
    for row, k in enumerate(order):
        for f, w in zip(index[row].tolist(), weight[row].tolist()):
            dense[k][f] += w
    for a in range(len(words)):
        for b in range(len(words)):
            mine = sum(w * dense[b][f] for f, w in dense[a].items() if f in dense[b])
            length = [sum(w * w for w in d.values()) ** 0.5 for d in (dense[a], dense[b])]
            assert mine / length[0] / length[1] == pytest.approx(naive_kernel("^" + words[a], "^" + words[b]), abs=1e-3)


def test_the_machine_is_the_nystrom_one():
    """Folded weights score a window as the embedding of its kernel values with the landmarks does."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
    points, _ = toxicity.windows_of(words)
    y = np.where(np.arange(60) % 3 == 0, 1.0, -1.0)
    model = toxicity._fit(points, y, np.ones(60), points[:20])

    def features(p):
        index, weight = toxicity.subsequences(p)
        out = np.zeros((len(p), 1 << toxicity.DIM_LOG2))
        np.add.at(out, (np.arange(len(p))[:, None], index), weight)
        return out

    all_, base = features(points), features(points[:20])
    values, vectors = np.linalg.eigh(base @ base.T)
    x = all_ @ base.T @ (vectors / np.sqrt(np.maximum(values, 1e-3)))
    w = toxicity._svm(x, y, np.ones(60))
    assert model.windows(points) == pytest.approx(x @ w[:-1] + w[-1], abs=1e-3)


def test_evidence_is_the_best_mixture():
    ratios = np.exp(np.linspace(-4, 9, 2 * len(toxicity.STEPS))).reshape(2, -1)
    rng = np.random.default_rng(1)
    doc, margin = np.repeat(np.arange(5), 30), rng.uniform(-3, 4, 150)
    pair = np.arange(150) % 4 == 0
    got = toxicity.Units(doc, margin, pair, np.full(5, 25)).evidence(ratios)
    for d in range(5):
        near = [(ratios[int(p), int((m + 1) // 0.25)]) for m, p in zip(margin[doc == d], pair[doc == d]) if m >= -1]
        best = max(sum(np.log(1 - s + s * r) for r in near) + max(25 - len(near), 0) * np.log(1 - s) for s in toxicity.SHARES)
        assert got[d] == pytest.approx(max(best, 0))


@pytest.mark.skipif(not os.path.isdir(SF01), reason="no test tables")
def test_toxicity_on_held_out_labels():
    import pyarrow as pa
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: r for r in pq.read_table(f"{SF01}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()}
    rows = [(docs[r["doc_id"]], r["toxic"] == 1, zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in pq.read_table(f"{SF01}/labels.parquet").to_pylist() if r["doc_id"] in docs]
    learn = [(d["text"] or "", t) for d, t, held in rows if not held and len(d["text"] or "") <= toxicity.SAMPLE_CHARS]
    scorer = toxicity.Scorer(model := toxicity.train([x for x, _ in learn], np.array([t for _, t in learn])))
    shuffled = [learn[k] for k in np.random.default_rng(0).permutation(len(learn))]
    again = toxicity.train([x for x, _ in shuffled], np.array([t for _, t in shuffled]))
    assert (again.weights == model.weights).all() and again.shift == model.shift

    def score(texts):
        return np.concatenate([model.probability(scorer.evidence(pa.array(texts[k : k + 200], pa.string()))) for k in range(0, len(texts), 200)])

    held = [(d, t) for d, t, h in rows if h]
    said = score([d["text"] or "" for d, _ in held]) >= toxicity.THRESHOLD
    truth = np.array([t for _, t in held])
    assert (said & truth).sum() >= 0.92 * truth.sum() and (said & truth).sum() >= 0.92 * said.sum()
    english = np.array([d["lang"] == "en" for d, _ in held])
    assert not (said & ~truth & english).any()
    rng = random.Random(5)
    clean = [(d["text"] or "").split()[:12] for d, t in held if d["lang"] == "en" and not t]
    insults = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()
    hidden = []
    for word in insults * 20:
        at = rng.randrange(1, len(word))
        form = word[:at] + rng.choice("abcdefghijklmnopqrstuvwxyz") + word[at:] if rng.random() < 0.5 else word[:at] + word[at + 1 :]
        own = list(rng.choice(clean))
        own.insert(rng.randrange(len(own) + 1), form)
        hidden.append(" ".join(own))
    assert (score(hidden) >= toxicity.THRESHOLD).mean() >= 0.88


def test_classifiers_with_one_label_or_none():
    assert toxicity.train([], np.array([], bool)).tokens(["x"])[0] < 0
    assert toxicity.train(["a b"], np.array([True])).tokens(["a"])[0] < 0
    assert quality.fit(np.empty((0, 3)), np.empty(0)).probability(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    assert quality.fit(np.zeros((4, 2), np.float32), np.ones(4)).probability(np.zeros((1, 2)))[0] > 0.7


def test_forest_learns_and_walks_like_its_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        out = forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            k = 0
            for _ in range(quality.DEPTH):
                k = 2 * k + 1 + int(row[f[k]] > c[k])
            out += leaf[k - (2**quality.DEPTH - 1)]
        return out

    assert forest.margin(x[:20]) == pytest.approx([walk(r) for r in x[:20]])


def naive_statistics(text):
    import math
    from collections import Counter

    raw = text.encode()
    members = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "blank": " \t", "newline": "\n\r\x0b\x0c", "stop": ".,;:?", "shout": "!", "bar": "|", "quote": "'\"()-"}
    chars = max(len(text), 1)
    out = {"log_chars": math.log1p(len(text))}
    for name, those in members.items():
        out[f"share_{name}"] = sum(c in those for c in text) / chars
    out["share_wide"] = sum(ord(c) > 127 for c in text) / chars
    out["share_other"] = sum(ord(c) < 128 and not any(c in those for those in members.values()) for c in text) / chars
    out["entropy"] = -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values()) if raw else 0
    words = text.split()
    n, lines = max(len(words), 1), text.split("\n")
    out["log_words"] = math.log1p(len(words))
    out["word_length"] = sum(map(len, words)) / n
    out["word_spread"] = math.sqrt(max(sum(len(w) ** 2 for w in words) / n - out["word_length"] ** 2, 0))
    out["distinct_words"] = len(set(words)) / n
    out["top_word"] = max(Counter(words).values(), default=0) / n
    out["distinct_pairs"] = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    out["ends_stop"] = sum(w[-1] in ".,;:?" for w in words) / n
    out["capital"] = sum("A" <= w[0] <= "Z" for w in words) / n
    out["all_upper"] = sum(sum("A" <= c <= "Z" for c in w) > 1 and not any("a" <= c <= "z" for c in w) for w in words) / n
    out["no_letter"] = sum(not any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w) for w in words) / n
    out["log_lines"] = math.log1p(len(lines))
    out["repeated_lines"] = 1 - len(set(lines)) / len(lines)
    out["line_length"] = len(text) / len(lines)
    return [out[f] for f in quality.FEATURES]


def test_statistics_are_those_of_a_naive_count():
    import pyarrow as pa

    texts = [t or "" for t in TEXTS] + ["A. B, c!! | 12 (x) - \"q\"\nA. B\n\nA. B", "ÄÖ ÜÜ ßß\n日本 語", "NASA the THE 9 9 9 9"]
    assert quality.statistics(pa.array(texts, pa.string())) == pytest.approx(np.array([naive_statistics(t) for t in texts]), rel=1e-4, abs=1e-5)


def test_statistics_of_odd_texts():
    import pyarrow as pa

    x = quality.statistics(pa.array([None, "", " \n", "A b! c.\nA b! c.", "日本"], pa.string()))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()
    named = dict(zip(quality.FEATURES, x[3]))
    assert named["repeated_lines"] == 0.5 and named["distinct_words"] == 0.5


def test_reports_on_tables(spark, docs, odd, nothing):
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _ in ROWS] + [(None, 1, 1), (5000, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for report, mod, rest in ((toxicity.toxicity_report, 3, 1), (quality.quality_report, 4, 2)):
        got = by_id(report(docs, labels))
        assert len(got) == len(ROWS)
        for i, r in got.items():
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % mod == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert len(report(odd, labels).collect()) == 8
        assert report(nothing, labels.limit(0)).collect() == []
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns


# WARC


PAGES = [(1, "http://h.example/a?b c\n", "x" * 300), (2, None, "x" * 300), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (0, "é", "é" * 200), (9, "u", "é" * 200), (7, "u", "y" * 700_000)]


@pytest.mark.parametrize("split", [50, 4096, 1 << 30])
def test_warc_round_trip(spark, tmp_path, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    got = {r["page_id"]: r for r in warc.warc_round_trip(pages, str(tmp_path / "w"), split).collect()}
    assert len(got) == len(PAGES)
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [j for j, _, h in PAGES if h == html and len(body) >= 100]
        first = min(same, default=i)
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
    full = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path / "w"), split).collect()}
    assert bytes(full[7]["payload"]) == b"y" * 700_000 and full[1]["url"] == "http://h.example/a?b%20c%0A"
    for file in (tmp_path / "w").glob("part-*"):
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert not list((tmp_path / "w").glob(".part-*"))


def test_warc_ranges_are_read_by_as_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, "u", "".join(rng.choices("abcdefgh", k=2000))) for i in range(300)], "page_id long, url string, html string").repartition(2)
    warc.write_warc(warc.plan_records(pages), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), 40_000).select("page_id", F.spark_partition_id().alias("p")).collect()
    ranges = sum(-(-f.stat().st_size // 40_000) for f in (tmp_path / "w").glob("part-*"))
    assert sorted(r["page_id"] for r in got) == list(range(300)) and len({r["p"] for r in got}) == ranges > 5


def test_warc_passes_over_foreign_bytes(spark, tmp_path):
    record = warc._member(1, "u", b"payload", None, "1970-01-01T00:00:00Z", 6)
    (tmp_path / "x.warc.gz").write_bytes(b"junk\x1f\x8b\x08junk" + record + gzip.compress(b"no record") + record[:40] + record)
    rows = warc.read_warc(spark, str(tmp_path), 16).collect()
    assert [bytes(r["payload"]) for r in rows] == [b"payload"] * 2


def test_warc_odd_tables(spark, tmp_path):
    schema = "page_id long, url string, html string"
    rows = [(None, None, None), (None, "u", "z" * 200), (4, "u", "z" * 200), (4, "u", "z" * 200)]
    got = warc.warc_round_trip(spark.createDataFrame(rows, schema), str(tmp_path / "a")).collect()
    assert sorted((r["page_id"] is None, r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"]) == [(False, "response", None), (False, "response", None), (True, "revisit", 4)]
    assert warc.warc_round_trip(spark.createDataFrame([], schema), str(tmp_path / "b")).collect() == []


# Licences


def test_license_scan(spark, odd, nothing):
    mit = next(t for i, k, t in KNOWN if i == "MIT" and k == "text")
    rows = [
        (1, "Copyright (c) 2020 Someone\n" + mit.upper()), (2, mit.replace("sublicense", "sub-license").replace(",", " ,").replace("\n", "\n\n")),
        (3, mit + " more"), (4, "Text.\nLicensed under CC BY-NC 4.0\n  licensed UNDER cc-by-nc 4.0. \nReleased under the MIT Licence."), (8, "All of it is, if not said otherwise, distributed under the terms of the MIT License; the rest is licensed under GPLv3, see there."), (5, None), (6, ""), (7, "© 2001 All"),
    ]
    got = by_id(license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (r["whole_license"], r["licenses"], r["n_notices"]) for i, r in got.items()} == {
        1: ("MIT", "MIT", 0), 2: ("MIT", "MIT", 0), 3: (None, "", 0), 4: (None, "CC-BY-NC-4.0,MIT", 3), 8: (None, "GPL-3.0-only,MIT", 2), 5: (None, "", 0), 6: (None, "", 0), 7: (None, "", 0),
    }
    assert len(license_scan.license_report(odd).collect()) == 8 and license_scan.license_report(nothing).collect() == []


def test_license_scan_knows_common_identifiers_and_long_texts(spark, monkeypatch):
    lines = {1: ("# SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0-only"), 2: ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), 3: ("Released under the Mozilla Public License, version 2.0.", "MPL-2.0"), 4: ("// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later")}
    got = by_id(license_scan.license_report(spark.createDataFrame([(i, f"Some words.\n{t}\nmore") for i, (t, _) in lines.items()], "doc_id long, text string")))
    assert {i: (r["licenses"], r["n_notices"]) for i, r in got.items()} == {i: (name, 1) for i, (_, name) in lines.items()}
    text = "A long licence,\n  of two lines."
    digest = by_id(license_scan.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")))[1]["text_digest"]
    monkeypatch.setattr(license_scan, "TEXT_DIGESTS", [*license_scan.TEXT_DIGESTS, ("Long-1.0", digest)])
    row = license_scan.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["whole_license"], row["licenses"]) == ("Long-1.0", "Long-1.0")
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0"} <= {i for i, _ in license_scan.TEXT_DIGESTS}


def test_whole_licenses_as_in_sql(spark, tmp_path):
    """A table of whole licences, some changed, against the SQL twin: the join of whole texts does work here."""
    duckdb = pytest.importorskip("duckdb")
    from tallyrank.llm.queries import ORACLE_SQL, op10_license_scan

    folder = "/usr/share/common-licenses"
    long_ = [open(f"{folder}/{n}", encoding="utf-8").read() for n in sorted(os.listdir(folder))] if os.path.isdir(folder) else []
    texts = [t for _, kind, t in KNOWN if kind == "text"] + long_
    rows = [(10 * k + j, v) for k, t in enumerate(texts) for j, v in enumerate((t, "  Copyright 2020 A\n" + t.upper(), t.replace(" ", "  ") + "\n", t + " or so", "Released under the MIT License, or\n" + t))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op10_license_scan(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(db.execute(ORACLE_SQL["op10_license_scan"]).fetchall())
    whole = {r[0]: r[2] for r in got}
    assert all(whole[10 * k] and whole[10 * k] == whole[10 * k + 1] == whole[10 * k + 2] for k in range(len(KNOWN)))
    assert len({v for v in whole.values() if v}) >= 8 + 6 * bool(long_) and not any(whole[10 * k + 3] for k in range(len(texts)))


def test_checkpoints_follow_the_session(spark):
    common.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, kept in (("64m", f"{8 << 20}b"), ("1g", f"{8 << 20}b"), ("4m", "4m"), ("1000b", "1000b")):
        spark.conf.set(key, given)
        common.bound_batches(spark)
        assert spark.conf.get(key) == kept
    spark.conf.unset(key)
