r"""Substring deduplication over windows of words, by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the least hash of
the ``MER``-word stretches in it; consecutive windows mostly share it, so a run
of them travels as one packed string (a super-k-mer) to the bucket of that
minimiser.  Equal windows have equal minimisers and meet in one bucket, where
sorting by window hash brings them together and word-for-word comparison makes
the result exact.  All but the earliest occurrence of a window are reported.

Before anything travels, each slice of documents is searched by itself: a
window that repeats inside the slice is reported there and only its first
occurrence goes on.  A passage shared by a third of the documents so reaches
its bucket once per slice, not once per document.

What is left of a frequent phrase are windows that reach over its ends, with ever
different words beside it.  A pass over all texts therefore counts the stretches
first, and those that make up more than ``HEAVY`` of all words come last in the
order of minimisers: a window takes one only where it has no other.  There are
at most 2 / HEAVY of them, which bounds what is sent to the tasks.  They decide where windows meet, never which are equal.

The same pass counts the words, from which the number of buckets follows: one
holds about ``BUCKET_WORDS`` sent words.  The strings for one bucket and slice
are one zstd block.  A bucket is handled at a time, in the order of a spilling
sort; one of more than ``ROUND_WORDS`` is settled in rounds by window hash, so
that memory stays bounded.  What goes from a document is joined with its
text where that lies (:func:`join_in_place`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import expand, flat, slices
from .common import bound_batches, cut, join_in_place

WINDOW = 20
MER = 4
LEVEL = 3
SLICE_BYTES = 8 << 20
#: Share of all words above which a stretch is heavy.
HEAVY = 1e-5
#: Sent words of a bucket; each word is sent about SENT times.
BUCKET_WORDS, SENT = 1 << 20, 3.2
#: Sent words that are settled at once.
ROUND_WORDS = 1 << 22
BUCKETS_PER_PARTITION, MAX_PARTITIONS = 6, 50_000
_C = 0x9E3779B97F4A7C15
_NO_ID = np.iinfo(np.int64).max


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_C, k, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def packed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the words of all texts, each followed by one blank; offsets of the words in that, with the end; words of each text)."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    start = ~space
    start[1:] &= space[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    start[edge] = ~space[edge]
    end = ~space
    end[:-1] &= space[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    end[last] = ~space[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    lengths = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(lengths)])
    packed = data[np.minimum(expand(starts, lengths), max(len(data) - 1, 0))] if len(starts) else np.empty(0, np.uint8)
    packed[at[1:] - 1] = 0x20
    counts = np.diff(np.searchsorted(starts, offsets))
    return packed, at, counts


def word_numbers(packed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, equal exactly for equal words; hash of each word, the same everywhere)."""
    from xxhash import xxh64_intdigest

    if len(at) < 2:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(packed))])
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy()
    hashes = np.fromiter(map(xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return number, hashes[number]


def stretch_hashes(h: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size the hash of every stretch of so many words, by doubling."""
    out = []
    for size in sizes:
        total, done, power, width = None, 0, h, 1
        while done < size:
            if size - done & width:
                part = power[done : len(h) - size + 1 + done]
                total = part if total is None else total * _power(width) + part
                done += width
            if done < size:
                power = power[: len(power) - width] * _power(width) + power[width:]
                width *= 2
        out.append(_mix(total if len(h) >= size else np.empty(0, np.uint64)))
    return out


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value among each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def repeats(number: np.ndarray, window_hash: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Which windows (word numbers of their starts in ``index``, in order of precedence) equal an earlier one."""
    found = np.zeros(len(index), bool)
    h = window_hash[index]
    order = np.argsort(h)
    ordered = h[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(h) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    several = np.flatnonzero(np.diff(np.concatenate([heads, [len(h)]])) > 1)
    if not len(several):
        return found
    group = np.cumsum(first) - 1
    member = order[np.isin(group, several)] if len(several) < len(heads) else order
    least = np.minimum.reduceat(order, heads)
    leader = least[group[np.isin(group, several)]] if len(several) < len(heads) else least[group]
    later = member != leader
    member, leader = member[later], leader[later]
    a, b = index[member], index[leader]
    equal = np.ones(len(member), bool)
    for j in range(size):
        equal &= number[a + j] == number[b + j]
    found[member[equal]] = True
    if not equal.all():
        # Different windows of one hash: settle those words by words, in order.
        seen: set[bytes] = {number[index[k] : index[k] + size].tobytes() for k in np.unique(leader[~equal])}
        for k in np.sort(member[~equal]).tolist():
            key = number[index[k] : index[k] + size].tobytes()
            found[k] = key in seen
            seen.add(key)
    return found


def _runs(values: np.ndarray, *breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of runs of consecutive values that none of ``breaks`` interrupts."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.diff(values) != 1
    for b in breaks:
        new |= b[1:] != b[:-1]
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    return first, np.diff(np.concatenate([first, [len(values)]]))


_BLOB = "bucket int, head binary, packed binary"
_RANGES = "d long, h long, start int, count int"


def _bytewise(x: np.ndarray) -> bytes:
    """Values with their first bytes together, then their second bytes and so on: small numbers then compress to little."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _head(d, h, start, count) -> bytes:
    """Where runs lie, as one zstd block."""
    import zstandard

    d, h = np.ascontiguousarray(d, np.int64), np.ascontiguousarray(h, np.int64)
    step = np.diff(d, prepend=d[:1] * 0)  # ids ascend in a block, so steps are small
    start, count = np.ascontiguousarray(start, np.int32), np.ascontiguousarray(count, np.int32)
    parts = [np.int64(len(d)).tobytes(), *(_bytewise(x) for x in (step, h, start, count))]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def _read_head(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in (np.int64, np.int64, np.int32, np.int32):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    out[0] = np.cumsum(out[0])
    return out


def heavy_stretches(keyed: DataFrame, mer: int = MER, share: float = HEAVY) -> tuple[np.ndarray, int]:
    """(hashes of the stretches that occur more than ``share`` times the number of words, sorted; the number of words).

    There are at most 2 / share.  A slice reports the stretches that reach half
    that share of its own words.  What it leaves out sums to less than half the
    share of all words, so every heavy stretch keeps a reported count over half.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            packed, at, counts = packed_words(*flat(batch.column(0)))
            _, hashes = word_numbers(packed, at)
            (mers,) = stretch_hashes(hashes, (mer,))
            mers.sort()
            first = np.flatnonzero(np.concatenate([[True], mers[1:] != mers[:-1]])) if len(mers) else np.empty(0, np.int64)
            times = np.diff(np.concatenate([first, [len(mers)]]))
            often = times > max(1, share / 2 * len(hashes))
            found = np.concatenate([mers[first[often]].view(np.int64), [0]])  # the last row has the number of words
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(found)) == len(found) - 1), pa.array(found), pa.array(np.concatenate([times[often], [len(hashes)]]), pa.int64())], names=["words", "h", "n"]
            )

    sums = cut(keyed.select("text").mapInArrow(count, "words boolean, h long, n long").groupBy("words", "h").agg(F.sum("n").alias("n")))
    total = sums.filter("words").agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = sums.filter(~F.col("words") & (F.col("n") > share / 2 * total)).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64)), total


def _ordered(mers: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Rank of each stretch among minimisers: its hash, the heavy ones after all others."""
    rank = mers >> np.uint64(1)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, mers), len(heavy) - 1)
        rank |= (heavy[at] == mers).astype(np.uint64) << np.uint64(63)
    return rank


def _super_kmers(batch: pa.RecordBatch, window: int, mer: int, buckets: int, heavy: np.ndarray) -> tuple[list, list, list]:
    """Rows of _BLOB for one slice (columns d, h, text); bucket -1-k holds ranges that the slice settled itself."""
    import zstandard

    order = np.lexsort((batch.column(1).to_numpy(), batch.column(0).to_numpy()))
    batch = batch.take(pa.array(order))
    # A document given twice counts once.
    d, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
    if not new.all():
        batch = batch.filter(pa.array(new))
        d, h = d[new], h[new]
    packed, at, counts = packed_words(*flat(batch.column(2)))
    doc = np.repeat(np.arange(len(counts)), counts)
    base = np.cumsum(counts) - counts
    number, hashes = word_numbers(packed, at)
    if len(number) < window:
        return [], [], []
    whole, mers = stretch_hashes(hashes, (window, mer))
    index = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    repeated = repeats(number, whole, index, window)
    out: tuple[list, list, list] = ([], [], [])
    gone = index[repeated]
    if len(gone):
        first, count = _runs(gone, doc[gone])
        k = doc[gone[first]]
        out[0].append(-1 - int(hashes[0] % np.uint64(buckets)))
        out[1].append(_head(d[k], h[k], gone[first] - base[k], count))
        out[2].append(b"")
    index = index[~repeated]
    if not len(index):
        return out
    least = sliding_least(_ordered(mers, heavy), window - mer + 1)[index]
    first, count = _runs(index, least, doc[index])
    start = index[first]
    bucket = (_mix(least[first] + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, start, count = bucket[order], start[order], count[order]
    size = at[start + count + window - 1] - at[start]
    k = doc[start]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = slice(a, b)
        out[0].append(int(bucket[a]))
        out[1].append(_head(d[k[own]], h[k[own]], start[own] - base[k[own]], count[own]))
        out[2].append(squeeze.compress(packed[expand(at[start[own]], size[own])].tobytes()))
    return out


def _sent_words(blobs: list[tuple[bytes, bytes]], window: int) -> tuple[int, int]:
    """(words, windows) of one bucket."""
    counts = [_read_head(head)[3] for head, _ in blobs]
    windows = sum(int(c.sum()) for c in counts)
    return windows + (window - 1) * sum(map(len, counts)), windows


def _one_round(head: bytes, packed: bytes, window: int, rounds: int, k: int) -> tuple[list[np.ndarray], bytes]:
    """(d, h, start, count) and words of the windows of one block whose hash belongs to round ``k``, each by itself."""
    import zstandard

    d, h, start, count = _read_head(head)
    text = np.frombuffer(zstandard.decompress(packed), np.uint8)
    at = np.concatenate([[0], np.flatnonzero(text == 0x20) + 1])
    _, hashes = word_numbers(text, at)
    (whole,) = stretch_hashes(hashes, (window,))
    word = np.cumsum(count + window - 1, dtype=np.int64) - (count + window - 1)
    index = expand(word, count.astype(np.int64))
    own = (whole[index] >> np.uint64(20)) % np.uint64(rounds) == k
    index, run = index[own], np.repeat(np.arange(len(count)), count)[own]
    place = expand(start.astype(np.int64), count.astype(np.int64))[own]
    words = text[expand(at[index], at[index + window] - at[index])]
    return [d[run], h[run], place.astype(np.int32), np.ones(len(run), np.int32)], words.tobytes()


def _settle(blobs: list[tuple[bytes, bytes]], window: int) -> Iterator[list[np.ndarray]]:
    """Ranges (d, h, start, count) of the windows in one bucket that equal an earlier one."""
    import zstandard

    words, windows = _sent_words(blobs, window)
    if words <= ROUND_WORDS:
        heads = [_read_head(head) for head, _ in blobs]
        yield _repeated([np.concatenate(x) for x in zip(*heads)], b"".join(zstandard.decompress(p) for _, p in blobs), window)
        return
    rounds = -(-windows * window // ROUND_WORDS)
    for k in range(rounds):
        parts = [_one_round(head, packed, window, rounds, k) for head, packed in blobs]
        yield _repeated([np.concatenate(x) for x in zip(*(p[0] for p in parts))], b"".join(p[1] for p in parts), window)


def _repeated(head: list[np.ndarray], text: bytes, window: int) -> list[np.ndarray]:
    d, h, start, count = head
    packed = np.frombuffer(text, np.uint8)
    at = np.concatenate([[0], np.flatnonzero(packed == 0x20) + 1])
    number, hashes = word_numbers(packed, at)
    (whole,) = stretch_hashes(hashes, (window,))
    word = np.cumsum(count + window - 1, dtype=np.int64) - (count + window - 1)
    order = np.lexsort((start, h, d))
    d, h, start, count, word = d[order], h[order], start[order], count[order], word[order]
    index = expand(word, count.astype(np.int64))
    run = np.repeat(np.arange(len(count)), count)
    place = expand(start.astype(np.int64), count.astype(np.int64))
    same = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    if (same & (start[1:] < start[:-1] + count[:-1])).any():
        # Copies of one row came from different slices: each of its windows counts once.
        owner = np.concatenate([[0], np.cumsum(~same)])
        _, once = np.unique(owner[run] << 32 | place, return_index=True)
        run, place, index = run[once], place[once], index[once]
    gone = np.flatnonzero(repeats(number, whole, index, window))
    if not len(gone):
        return [np.empty(0, np.int64)] * 4
    run, place = run[gone], place[gone]
    first, length = _runs(place, d[run], h[run])
    return [d[run[first]], h[run[first]], place[first], length]


def dealing(words: int, least: int) -> tuple[int, int]:
    """(partitions, buckets) for so many words of text: buckets of one size, and six of them or more to a partition."""
    buckets = max(least * BUCKETS_PER_PARTITION, int(SENT * words / BUCKET_WORDS))
    return max(least, min(buckets // BUCKETS_PER_PARTITION, MAX_PARTITIONS)), buckets


def repeated_ranges(keyed: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """(d, h, start, count): ``count`` windows from word ``start`` of document (d, h) occur earlier. ``keyed`` has d, h, text."""
    hashes, words = heavy_stretches(keyed, mer)
    partitions, buckets = dealing(words, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = keyed.sparkSession.sparkContext.broadcast(hashes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            number, head, packed = _super_kmers(batch, window, mer, buckets, heavy.value)
            if number:
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(head, pa.binary()), pa.array(packed, pa.binary())], names=["bucket", "head", "packed"])

    def ranges(columns: list[np.ndarray]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), k) for c, k in zip(columns, kinds)], names=["d", "h", "start", "count"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, head, packed in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket < 0:
                    yield ranges(_read_head(head))
                    continue
                if bucket != now and held:
                    yield from map(ranges, _settle(held, window))
                    held = []
                now = bucket
                held.append((head, packed))
        if held:
            yield from map(ranges, _settle(held, window))

    sent = keyed.select("d", "h", "text").mapInArrow(send, _BLOB)
    return sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(receive, _RANGES)


def substring_dedup(docs: DataFrame, window: int = WINDOW, mer: int = MER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""One row per row of ``docs``: doc_id, n_words, n_removed and kept, the words that stay joined by one blank.

    Words are ``[^\x20\x09-\x0D]+``; a word goes if a window over it starts
    earlier too: in a smaller id (null after all; then by the text's hash), or
    earlier in the same document.  Null and empty texts have no words.  Rows
    equal in id and text are one document, and each gets its result.  An empty
    table gives an empty result.  Ids are below 2**63 - 1, which stands for none.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = own.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    found = repeated_ranges(keyed, window, mer).groupBy("d", "h").agg(F.collect_list(F.struct("start", "count")).alias("r"))
    found = cut(found.select(F.nullif("d", F.lit(_NO_ID)).alias("__id"), F.col("h").alias("__h"), F.col("r.start").alias("starts"), F.col("r.count").alias("counts")))
    joined = join_in_place(own, found, "left", 96 + 8 * F.size("starts"))
    joined = joined.select("row.doc_id", F.col("row.text").cast("binary").alias("text"), "starts", "counts")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            packed, at, counts = packed_words(*flat(batch.column(1)))
            base = np.cumsum(counts) - counts
            lists = batch.column(2)
            owner = np.repeat(np.arange(len(counts)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            begin = base[owner] + lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            depth = np.zeros(len(at), np.int64)
            np.add.at(depth, begin, 1)
            np.add.at(depth, begin + batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64) + window - 1, -1)
            keep = np.cumsum(depth)[:-1] == 0
            doc = np.repeat(np.arange(len(counts)), counts)
            left = np.bincount(doc[keep], minlength=len(counts))
            size = np.diff(at)[keep]
            text = packed[expand(at[:-1][keep], size)].tobytes()
            upto = np.concatenate([[0], np.cumsum(size)])
            ends = np.concatenate([[0], np.cumsum(left)])
            kept = [text[upto[a] : upto[b] - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(counts - left, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(clean, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))
