"""Quality by histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts with flat numpy passes over a slice of
documents.  Training bins each statistic by its quantiles, grows depth-limited
trees on gradient histograms (logistic loss), and the trees are flattened into
arrays of one length, so that scoring walks all documents through all trees
with ``DEPTH`` vectorised steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import flat, slices
from .common import bound_batches
from .toxicity import held_out

#: Bound of the labelled sample, for each label value.
SAMPLE_ROWS = 10_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, RIDGE, LEAF_ROWS = 120, 4, 64, 0.12, 1.0, 5

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t",
    "newline": b"\n\r\x0b\x0c",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "quote": b"'\"()-",
}
_OTHER_ASCII, _LEAD, _CONT = len(_CLASSES), len(_CLASSES) + 1, len(_CLASSES) + 2
_N_CLASSES = len(_CLASSES) + 3


def _class_table() -> np.ndarray:
    table = np.full(256, _OTHER_ASCII, np.int64)
    table[0x80:0xC0] = _CONT
    table[0xC0:] = _LEAD
    for k, members in enumerate(_CLASSES.values()):
        table[list(members)] = k
    return table


_CLASS_OF = _class_table()

FEATURES = [
    "log_chars", *(f"share_{c}" for c in [*_CLASSES, "other", "wide"]), "entropy",
    "log_words", "word_length", "word_spread", "distinct_words", "top_word", "distinct_pairs",
    "ends_stop", "capital", "all_upper", "no_letter", "log_lines", "repeated_lines", "line_length",
]


def _by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null and empty texts have zeros."""
    column = column.fill_null("").cast(pa.large_string())
    data, offsets = flat(column)
    n = len(column)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    byte_counts = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    classes = np.zeros((n, _N_CLASSES))
    for k in range(_N_CLASSES):
        classes[:, k] = byte_counts[:, _CLASS_OF == k].sum(axis=1)
    chars = size - classes[:, _CONT]
    per_char = 1 / np.maximum(chars, 1)
    shares = classes[:, :_CONT] * per_char[:, None]
    p = byte_counts / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    # Words
    split = pc.utf8_split_whitespace(column)
    words = split.flatten()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.not_equal(words, "")
    wdoc = np.repeat(np.arange(n), counts)
    keep = some.to_numpy(zero_copy_only=False).astype(bool) if len(words) else np.zeros(0, bool)
    words, wdoc = words.filter(some), wdoc[keep]
    n_words = np.bincount(wdoc, minlength=n).astype(float)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    wbytes, woff = flat(coded.dictionary)
    length = np.diff(woff)
    k = len(length)
    owner = np.repeat(np.arange(k), length)
    kinds = np.bincount(owner * _N_CLASSES + _CLASS_OF[wbytes], minlength=k * _N_CLASSES).reshape(k, _N_CLASSES)
    alpha = kinds[:, 0] + kinds[:, 1] + kinds[:, _LEAD]
    first, last = (wbytes[woff[:-1]], wbytes[woff[1:] - 1]) if k else (np.empty(0, np.uint8),) * 2
    is_stop = np.isin(last, np.frombuffer(b".,;:?", np.uint8))
    capital = (first >= 65) & (first <= 90)
    upper = (kinds[:, 1] > 1) & (kinds[:, 0] == 0)
    glyphs = length - kinds[:, _CONT]
    inv = 1 / np.maximum(n_words, 1)
    mean = _by_doc(glyphs[ids], wdoc, n) * inv
    spread = np.sqrt(np.maximum(_by_doc(glyphs[ids] ** 2, wdoc, n) * inv - mean**2, 0))
    pair, times = np.unique(wdoc << 32 | ids, return_counts=True)
    distinct = np.bincount(pair >> 32, minlength=n) * inv
    top = np.zeros(n)
    np.maximum.at(top, pair >> 32, times)
    same = wdoc[1:] == wdoc[:-1]
    both = ((ids[:-1] * 0x9E3779B1 + ids[1:]) & 0xFFFFFFFF)[same]
    pair2 = np.unique(wdoc[1:][same] << 32 | both)
    distinct2 = np.bincount(pair2 >> 32, minlength=n) / np.maximum(n_words - 1, 1)
    # Lines
    lines = pc.split_pattern(column, "\n")
    lcounts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    lids = lines.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    ldoc = np.repeat(np.arange(n), lcounts)
    distinct_lines = np.bincount(np.unique(ldoc << 32 | lids) >> 32, minlength=n)
    return np.column_stack(
        [
            np.log1p(chars), *shares.T, entropy,
            np.log1p(n_words), mean, spread, distinct, top * inv, distinct2,
            _by_doc(is_stop[ids], wdoc, n) * inv, _by_doc(capital[ids], wdoc, n) * inv, _by_doc(upper[ids], wdoc, n) * inv, _by_doc((alpha == 0)[ids], wdoc, n) * inv,
            np.log1p(lcounts), 1 - distinct_lines / np.maximum(lcounts, 1), chars / np.maximum(lcounts, 1),
        ]
    ).astype(np.float32)


@dataclass
class Forest:
    """Complete trees of one depth as arrays: a node's children are 2k+1 and 2k+2; leaf values follow the inner nodes' order."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; x <= cut goes left
    leaf: np.ndarray  # trees x 2**DEPTH
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                right = part[rows, self.feature[trees, node]] > self.cut[trees, node]
                node = 2 * node + 1 + right
            out[at : at + 4096] += self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for labels 0/1. Without rows the score is a half everywhere; with one label it is that label's."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    n, m = x.shape if x.ndim == 2 else (0, len(FEATURES))
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    empty = Forest(np.zeros((1, inner), np.int64), np.zeros((1, inner), np.float32), np.zeros((1, leaves)), base)
    if n == 0 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for f in range(m)]
    bins = np.column_stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(m)])  # bin <= b  <=>  x <= cuts[b]
    flat_bins = bins + np.arange(m) * BINS
    margin = np.full(n, base)
    features, values, leafs = [], [], []
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (m * BINS) + flat_bins).ravel()
            total = width * m * BINS
            gh = [np.bincount(where, np.repeat(v, m), minlength=total).reshape(width, m, BINS).cumsum(axis=2) for v in (g, h, np.ones(n))]
            gl, hl, cl = gh
            ga, ha, ca = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(cl < LEAF_ROWS) | (ca - cl < LEAF_ROWS)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = -np.bincount(at, g, minlength=leaves) / (np.bincount(at, h, minlength=leaves) + RIDGE) * RATE
        margin += leaf[at]
        features.append(feature)
        values.append(cut)
        leafs.append(leaf)
    return Forest(np.array(features), np.array(values), np.array(leafs), base)


def train_on(docs: DataFrame, labels: DataFrame) -> Forest:
    """Forest trained on the driver from the statistics of at most 2 * SAMPLE_ROWS labelled documents, none held out.

    Null texts count as empty, null ids and labels are left out; of an id's labels one counts.  Without rows the score is a half everywhere.
    """
    own = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label")).filter("__id is not null and label in (0, 1)")
    own = own.filter(~held_out(F.col("__id"), 4, 2)).dropDuplicates(["__id"])
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = own.filter("label = 0").orderBy(*order).limit(SAMPLE_ROWS).unionByName(own.filter("label = 1").orderBy(*order).limit(SAMPLE_ROWS))
    rows = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(chosen), "__id").select("__id", "text", "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "label", "x"])

    bound_batches(docs.sparkSession)
    got = rows.mapInArrow(work, "id long, label int, x array<float>").orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE_ROWS).collect()
    if not got:
        return fit(np.empty((0, len(FEATURES)), np.float32), np.empty(0))
    return fit(np.array([r["x"] for r in got], np.float32), np.array([r["label"] for r in got], float))


def score_quality(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns quality_score (0 to 1) and good, over whole texts.

    Null is empty; equal texts score alike, however often they come; an empty table gives an empty one.
    """

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            parts = [forest.probability(statistics(b.column(0))) for b in slices(iter([batch]), "text")]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    bound_batches(docs.sparkSession)
    score = F.arrow_udf(work, "double")(F.col(text_col))
    return docs.withColumn("quality_score", score).withColumn("good", F.col("quality_score") >= THRESHOLD)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text scores as an empty one, a null id is held out, repeated rows
    each get their row, and an empty table gives an empty report.
    """
    scored = score_quality(docs.select("doc_id", "text"), train_on(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("quality_score").alias("score"), F.col("good").cast("int").alias("predicted"))
