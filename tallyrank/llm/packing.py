"""Packing of tokenised documents into fixed windows by minimum bin slack.

Each task packs its own input partition in one streaming pass, without any
shuffle.  A document's full windows are sequences of their own; what remains of
it joins a pool of bounded size.  For every window the largest remainder is
placed and a bitset subset-sum dynamic programme over the pooled lengths (each
with its count) finds the multiset that comes closest to the capacity; the
counts are read back from the recorded bitsets, and a pattern is repeated as
often as the counts allow.  Only what cannot fill a window exactly at the end
of a partition, or while the pool is at its bound, is cut, the last tokens into
powers of two, which need no padding.

Memory: one slice of texts, ``POOL_TOKENS`` tokens and one pass's output.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import expand, flat, slices
from .common import bound_batches

WINDOW = 2048
END_ID = 1
POOL_TOKENS = 1 << 20
SLICE_BYTES = 5 << 20

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Lead bytes of the characters outside ASCII that may be white space.
_SPACE_LEADS = np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)


def _visible_after(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that starts at each position is surely visible."""
    first = data[at]
    return (first > 0x20) & (first != 0x7F) & ~np.isin(first, _SPACE_LEADS)


def _visible_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is surely visible."""
    last = data[at - 1]
    ok = (last > 0x20) & (last != 0x7F)
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        lead, open_ = last[wide], np.ones(len(wide), bool)
        for back in (2, 3, 4):
            open_ &= (lead & 0xC0) == 0x80
            lead = np.where(open_, data[np.maximum(at[wide] - back, 0)], lead)
        ok[wide] = (lead >= 0xC0) & ~np.isin(lead, _SPACE_LEADS)
    return ok


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing their tokens: all offsets, and each lone blank between two visible characters.

    The byte-level pre-tokeniser always starts a new part there, whatever stands
    around it.  Next to a character that might be white space outside ASCII no cut is made.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[_visible_after(data, at + 1)]
    at = at[_visible_before(data, at)]
    marked = np.zeros(len(data) + 1, bool)
    marked[at] = True
    marked[offsets] = True
    return np.flatnonzero(marked)


# The pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a visible Latin-1 byte as itself and the others as characters from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def added_tokens(path: str) -> list[dict]:
    """The added tokens of a tokenizer file, which the tokenizers library cuts out of a text before anything else."""
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("added_tokens") or []


def _plainly_cut(tokens: list[dict]) -> bool:
    """Whether added tokens are cut by their characters alone, and none begins with another."""
    names = [t["content"] for t in tokens]
    rules = any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip"))
    return not rules and not any(a != b and b.startswith(a) for a in names for b in names)


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by token bytes of a tokenizer file; None unless it is plain byte-level BPE whose ids follow the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or model["type"] != "BPE" or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"][a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    of = _byte_of_char()
    return {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(pairs)}


class Encoder:
    """Ids of whole texts; equal stretches between cut points of a slice are encoded once.

    Merging is done by tiktoken from the tokenizer file's own vocabulary, which
    gives the ids of the tokenizers library several times faster; a file of
    another kind is run by the tokenizers library itself.  With ``added`` the
    file's added tokens get their own ids where a text holds them, as the
    library gives them unless told otherwise; without, they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        known = added_tokens(path) if added else []
        ranks = byte_ranks(path) if _plainly_cut(known) else None
        if ranks is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(path)
            self.whole.encode_special_tokens = not added
            return
        import tiktoken

        self.whole = None
        self.added = {t["content"]: t["id"] for t in known}
        self.merges = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(t) for t in ranks]

    def _of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text), text by text."""
        if self.whole is not None:
            got = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        else:
            got = [self.merges.encode_ordinary(t) for t in texts]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        return np.array([i for ids in got for i in ids], np.uint32), counts

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct chunks. Those that start and end at cuts are joined to one text, where they keep their tokens."""
        data, offsets = flat(chunks)
        starts, ends = offsets[:-1], offsets[1:]
        joinable = (ends - starts >= 2) & (data[starts] == 0x20)
        joinable[joinable] = _visible_after(data, starts[joinable] + 1) & _visible_before(data, ends[joinable])
        counts = np.zeros(len(chunks), np.int64)
        text = "".join(chunks.filter(pa.array(joinable)).to_pylist())
        joined = self.merges.encode_to_numpy(text).astype(np.uint32) if text else np.empty(0, np.uint32)
        lengths = (ends - starts)[joinable]
        upto = np.searchsorted(np.cumsum(self.bytes_of[joined]), np.cumsum(lengths), "left") + 1
        counts[joinable] = np.diff(upto, prepend=0)
        alone, own = self._of_texts(chunks.filter(pa.array(~joinable)).to_pylist())
        counts[~joinable] = own
        ids = np.empty(int(counts.sum()), np.uint32)
        side = np.repeat(joinable, counts)
        ids[side], ids[~side] = joined, alone
        return ids, counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts in them)."""
        data, offsets = flat(column)
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.whole is not None:
            ids, counts = self._of_texts(column.fill_null("").to_pylist())
            return ids, np.concatenate([[0], np.cumsum(counts)])
        held = reduce(pc.or_, [pc.match_substring(column.fill_null(""), name) for name in self.added]) if self.added else None
        if held is not None and pc.any(held).as_py():
            return self._with_added(column.fill_null(""), held)
        return self._ordinary(data, offsets)

    def _with_added(self, texts: pa.Array, held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same where some texts, those of ``held``, hold added tokens."""
        own = [np.array(self.merges.encode(t, allowed_special="all"), np.uint32) for t in texts.filter(held).to_pylist()]
        other, upto = self._ordinary(*flat(texts.filter(pc.invert(held))))
        others = iter(np.split(other, upto[1:-1]))
        mine = iter(own)
        parts = [next(mine if h else others) for h in held.to_pylist()]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _ordinary(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        cuts = cut_points(data, offsets)
        chunks = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        distinct, counts = self._of_chunks(coded.dictionary)
        number = coded.indices.to_numpy()
        lengths = counts[number]
        ids = distinct[expand((np.cumsum(counts) - counts)[number], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.searchsorted(cuts, offsets)]


def closest_fill(lengths: list[int], count_of: Callable[[int], int], room: int) -> dict[int, int]:
    """The multiset of lengths (ascending list, with their counts) whose sum is the largest not over ``room``.

    Bit s of ``reach`` says that some multiset sums to s.  A length with a count
    enters in parts 1, 2, 4, ... and a rest, so every smaller count is covered;
    the bitset before each part lets the used counts be read back.
    """
    mask = (1 << (room + 1)) - 1
    goal, reach, steps = 1 << room, 1, []
    for k in range(bisect_right(lengths, room) - 1, -1, -1):
        if reach & goal:
            break
        length = lengths[k]
        left, part = min(count_of(length), room // length), 1
        while left > 0 and not reach & goal:
            part = min(part, left)
            steps.append((length, part, reach))
            reach = (reach | reach << (length * part)) & mask
            left -= part
            part *= 2
    total, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + part
            total -= length * part
    return used


class Packer:
    """Pieces of documents in sequences; ``emit`` gets (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, emit: Callable):
        self.window, self.emit = window, emit
        self.pool: dict[int, list] = {}
        self.lengths: list[int] = []  # of the pool, ascending
        self.tokens = 0
        self.sequence = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._put([(doc_id, start, ids[start : start + self.window], len(ids))])
        if whole < len(ids):
            self._keep((doc_id, whole, ids[whole:], len(ids)))
        if self.tokens >= POOL_TOKENS:
            self._pack(last=False)

    def finish(self) -> None:
        self._pack(last=True)

    def _keep(self, piece: tuple) -> None:
        length = len(piece[2])
        if length not in self.pool:
            self.pool[length] = []
            insort(self.lengths, length)
        self.pool[length].append(piece)
        self.tokens += len(piece[2])

    def _take(self, length: int) -> tuple:
        pieces = self.pool[length]
        piece = pieces.pop()
        if not pieces:
            del self.pool[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        self.tokens -= length
        return piece

    def _put(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.emit(doc_id, start, ids, total, self.sequence, offset)
            offset += len(ids)
        self.sequence += 1

    def _pack(self, last: bool) -> None:
        while self.tokens >= self.window:
            top = self.lengths[-1]
            used = closest_fill(self.lengths, lambda n, top=top: len(self.pool[n]) - (n == top), self.window - top)
            used[top] = used.get(top, 0) + 1
            fill = sum(n * c for n, c in used.items())
            if fill < self.window:
                if not last and self.tokens < POOL_TOKENS:
                    return  # later documents may fill it
                pieces = [self._take(n) for n, c in used.items() for _ in range(c)]
                room = self.window - fill
                doc_id, start, ids, total = self._take(self.lengths[min(bisect_right(self.lengths, room), len(self.lengths) - 1)])
                pieces.append((doc_id, start, ids[:room], total))
                self._keep((doc_id, start + room, ids[room:], total))
                self._put(pieces)
                continue
            for _ in range(min(len(self.pool[n]) // c for n, c in used.items())):
                self._put([self._take(n) for n, c in used.items() for _ in range(c)])
        if last:
            self._rest()

    def _rest(self) -> None:
        """What is less than a window, in sequences of 2**k tokens."""
        pieces = [self._take(n) for n in sorted(self.pool, reverse=True) for _ in range(len(self.pool[n]))]
        left = sum(len(p[2]) for p in pieces)
        while left:
            size, own = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc_id, start, ids, total = pieces.pop(0)
                own.append((doc_id, start, ids[:size], total))
                if len(ids) > size:
                    pieces.insert(0, (doc_id, start + size, ids[size:], total))
                size -= len(own[-1][2])
            self._put(own)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", added: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    ``ids`` are little-endian unsigned 32-bit token ids; each document ends with
    id 1.  The tokenizer's added tokens get their own ids where a text holds
    them, as its library gives them; without ``added`` they are ordinary text.
    A null or empty text is that one id.  Repeated rows are packed as often as
    they come; an empty table has no pieces.  A sequence belongs to one
    partition: its number is the partition's in the upper bits and a counter below.
    """
    bound_batches(docs.sparkSession)
    path = tokenizer

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        encoder = Encoder(path or default_tokenizer(), added)
        out: list[list] = [[] for _ in range(7)]

        def emit(doc_id, start, ids, total, sequence, offset):
            for column, value in zip(out, (doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, base + sequence, offset)):
                column.append(value)

        def drain() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=PIECES.names)
            for column in out:
                column.clear()
            return batch

        packer = Packer(window, emit)
        end = np.array([END_ID], np.uint32)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, offsets = encoder.encode(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                packer.add(doc_id, np.concatenate([ids[offsets[k] : offsets[k + 1]], end]))
            if out[0]:
                yield drain()
        packer.finish()
        if out[0]:
            yield drain()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Training rows (sequence_id, ids, length, padded_to) of packed pieces: ids in order, padded with ``pad_id`` to the window unless the length is a power of two.

    Pieces have no nulls; no pieces give no rows.
    """
    joined = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length")
    )
    power = F.bit_count("length") == 1
    pad = F.when(power, 0).otherwise(window - F.col("length")).cast("int")
    padding = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), pad))
    ids = F.concat(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])), padding)
    return joined.select("sequence_id", ids.alias("ids"), "length", (F.col("length") + pad).alias("padded_to"))
