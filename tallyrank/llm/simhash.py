"""Near-duplicate detection by SimHash fingerprints in a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments.  The
Manhattan distance of two embeddings never exceeds the fingerprints' Hamming
distance, so links at ``MAX_BITS`` are a range join under Manhattan distance
with an exact check behind it.  The grid: the segments are dealt to six bands;
points within distance 3 differ in three bands at most, so they agree in the
other three and share one of the 20 cells that fix three bands' counts.

Copies collapse to distinct fingerprints first.  A cell is read as one sorted
run; the points are ordered by their total bit count, compared only within a
difference of ``MAX_BITS`` in it, and verified by XOR.  A cell emits a spanning
forest of its links, never its pairs.  In a crowded cell the points that a
linear sweep already joined to the largest component are not compared with each
other again; only the others are compared with all, in blocks of bounded size.

A cell of more than ``CROWD`` points is dealt out further.  Points that agree in
three bands' counts differ inside these bands by at most one swap of two
neighbouring bits, so they agree bit for bit in two of the three bands: a
crowded cell becomes three sets of finer cells that fix the bits of two bands
and the counts of the third.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices
from .common import BROADCAST_BYTES, bound_batches, cut, without_rows
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Two-bit segments of each of the six bands.
BAND_SEGMENTS = (6, 6, 5, 5, 5, 5)
SWEEP = 16
BLOCK = 1024
#: Points of a cell above which it is dealt out by two bands' bits.
CROWD = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; zero where it has no words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashes = np.fromiter(
        (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())),
        np.uint64, len(words) - shingle + 1,
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long. A null text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.fromiter((fingerprint(t or b"") for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return narrow.mapInArrow(work, "doc_id long, text_hash long, fp long")


def _band_masks() -> list[int]:
    masks, at = [], 0
    for n in BAND_SEGMENTS:
        masks.append(((1 << (2 * n)) - 1) << at)
        at += 2 * n
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, packed two bits each."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_cells(points: DataFrame, fp_col: str = "fp") -> DataFrame:
    """(grid, cell, fp): the 20 cells of each fingerprint."""
    bands = _band_masks()
    masks = [_signed(a | b | c) for a, b, c in combinations(bands, 3)]
    e = points.select(F.col(fp_col).alias("fp"), embedding(F.col(fp_col)).alias("e"))
    cells = F.array(*[F.struct(F.lit(g).cast("byte").alias("grid"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for g, m in enumerate(masks)])
    return e.select("fp", F.explode(cells).alias("c")).select("c.grid", "c.cell", "fp")


def dealt_cells(points: DataFrame, fp_col: str = "fp") -> DataFrame:
    """(grid, cell, fp) with the crowded cells replaced by finer ones."""
    cells = grid_cells(points, fp_col)
    crowded = cut(cells.groupBy("grid", "cell").count().filter(F.col("count") > CROWD).select(F.col("grid").alias("__g"), F.col("cell").alias("__c"), F.lit(True).alias("full")))
    n = crowded.count()
    if not n:
        return cells
    if n * 64 <= BROADCAST_BYTES:
        crowded = F.broadcast(crowded)
    bands, e = _band_masks(), embedding(F.col("fp"))
    trios = list(combinations(bands, 3))
    finer = []
    for k in range(3):
        counts = F.element_at(F.array(*[F.lit(_signed(t[k])) for t in trios]), F.col("grid").cast("int") + 1)
        bits = F.element_at(F.array(*[F.lit(_signed(sum(t) - t[k])) for t in trios]), F.col("grid").cast("int") + 1)
        grid = (len(trios) + 3 * F.col("grid").cast("int") + k).cast("byte")
        finer.append(F.struct(grid.alias("grid"), F.col("fp").bitwiseAND(bits).bitwiseOR(e.bitwiseAND(counts)).alias("cell")))
    joined = cells.join(crowded, (cells["grid"] == crowded["__g"]) & (cells["cell"] == crowded["__c"]), "left")
    own = F.when(F.col("full"), F.array(*finer)).otherwise(F.array(F.struct("grid", "cell")))
    return joined.select("fp", F.explode(own).alias("c")).select("c.grid", "c.cell", "fp")


def _least_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least index of each point's component under the links a-b (and the labels so far)."""
    label = np.arange(n) if label is None else label
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        label = label[label]
        if np.array_equal(old, label):
            return label


def _crowded(fp: np.ndarray, bits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of one large cell, sorted by ``bits``: what a sweep has not joined to the largest part is compared with all."""
    label = _least_labels(len(fp), np.arange(0), np.arange(0), label)
    largest = np.bincount(label).argmax()
    open_ = np.flatnonzero(label != largest)
    for at in range(0, len(open_), BLOCK):
        rows = open_[at : at + BLOCK]
        low = np.searchsorted(bits, bits[rows[0]] - MAX_BITS, "left")
        high = np.searchsorted(bits, bits[rows[-1]] + MAX_BITS, "right")
        for col in range(low, high, 8 * BLOCK):
            to = min(col + 8 * BLOCK, high)
            i, j = np.nonzero(np.bitwise_count(fp[rows, None] ^ fp[None, col:to]) <= MAX_BITS)
            label = _least_labels(len(fp), rows[i], j + col, label)
    return label


def links_of_run(grid: np.ndarray, cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (a, b) of the links inside each cell of a run of whole cells."""
    bits = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((fp, bits, cell, grid))
    grid, cell, fp, bits = grid[order], cell[order], fp[order], bits[order]
    new = np.concatenate([[True], (grid[1:] != grid[:-1]) | (cell[1:] != cell[:-1])])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    alive = sizes[group] > 1
    grid, cell, fp, bits, group = grid[alive], cell[alive], fp[alive], bits[alive], group[alive]
    n = len(fp)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = np.arange(n)
    for d in range(1, SWEEP + 1):
        if d >= n:
            break
        ok = (group[d:] == group[:-d]) & (bits[d:] - bits[:-d] <= MAX_BITS)
        i = np.flatnonzero(ok)
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= MAX_BITS]
        label = _least_labels(n, i, i + d, label)
    _, first, counts = np.unique(group, return_index=True, return_counts=True)
    for at, size in zip(first[counts > SWEEP + 1].tolist(), counts[counts > SWEEP + 1].tolist()):
        own = slice(at, at + size)
        label[own] = at + _crowded(fp[own], bits[own], label[own] - at)
    member = np.flatnonzero(label != np.arange(n))
    return fp[label[member]].view(np.int64), fp[member].view(np.int64)


def fingerprint_links(points: DataFrame) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints within ``MAX_BITS``; a forest of each cell's links."""

    def links(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        grid, cell, fp = (np.concatenate(x) for x in zip(*parts))
        a, b = links_of_run(grid, cell, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the last cell so far, put together when it ends
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            # The last cell may go on in the next batch.
            to = int(np.argmax((now[0] == now[0][-1]) & (now[1] == now[1][-1])))
            if to:
                yield links([*held, [x[:to] for x in now]])
                held = [[x[to:] for x in now]]
            elif held and (held[0][0][0] != now[0][0] or held[0][1][0] != now[1][0]):
                yield links(held)
                held = [now]
            else:
                held.append(now)
        if held:
            yield links(held)

    cells = dealt_cells(points).repartition("grid", "cell").sortWithinPartitions("grid", "cell")
    return cells.mapInArrow(work, "a long, b long").distinct()


def _components_of(rows: DataFrame) -> DataFrame:
    """(fp, root, component_id) of the distinct fingerprints in ``rows`` (doc_id, fp); root is a component's least fingerprint."""
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(points))
    linked = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = cut(linked)
    ids = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    return linked.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, fingerprint (16 hex digits), root, component_id.

    component_id is the smallest doc_id reachable over links; a null id counts
    only where a component has no other.  root, the component's least
    fingerprint, tells components apart even where ids repeat.  Texts without words share the
    fingerprint zero and are linked like any other.  An empty table gives an
    empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    ids = cut(_components_of(rows)).withColumnRenamed("fp", "__fp")
    out = rows.join(ids, rows["fp"] == ids["__fp"]).drop("__fp")
    return out.select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with their own columns.

    The row of the smallest id stays (then the smallest text hash); of equal
    rows one.  Null and empty texts are one component.  What goes is found by
    key and joined with the texts where they lie.  An empty table gives an
    empty one.
    """
    marked = near_duplicates(docs, id_col, text_col)
    keyed = cut(marked.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    best = cut(keyed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("best")))
    best = best.withColumnRenamed("root", "__root")
    verdict = keyed.join(best, keyed["root"] == best["__root"])
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    odd = cut(verdict.filter(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"), stays.alias("__stays")))
    return without_rows(docs, odd, id_col, text_col)
