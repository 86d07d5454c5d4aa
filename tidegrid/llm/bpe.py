"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Texts are cut into pre-tokens by the tokenizer's pattern; each distinct pre-token of a batch is
encoded once and its ids are then looked up.  Encoding works on many pre-tokens at a time:
they are bucketed by length into padded numpy matrices, one row each; in every round each row
merges its leftmost pair of minimum rank, pair ranks come from a hashed table of all mergeable
pairs, and rows that have no mergeable pair left are taken out (compaction).  Rows longer than
``MATRIX_WIDTH`` bytes, for which the matrices would be quadratic, are merged with a heap over a
linked list: the same merges in the same order.

It is a narrow, map-only operator: no shuffle, no growing broadcast (the vocabulary's size is
fixed), and texts of any length are handled in pieces cut where no pre-token can span.

Defined results for odd input: null and empty texts have an empty list; blank texts and texts that
look like special tokens are ordinary text; repeated rows give repeated rows; an empty table gives
an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import share_code

TOKENIZERS = "/opt/tokenizers"
MATRIX_WIDTH = 256
CHUNK_CHARS = 1 << 21
CACHED_WORDS = 1 << 17
NONE = np.int32(2**31 - 1)

# The pre-token pattern of the vocabulary, once for any text and once for ASCII text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def read_ranks(path: str | Path) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Ranks of mergeable id pairs in an open-addressing hash table, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (2 * max(1, len(keys))).bit_length() + 1)
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo_k, todo_v = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(todo_k)
        while len(todo_k):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = todo_k[free]  # of several keys for one slot the last one stays
            won = self.keys[slot] == todo_k
            self.values[slot[won]] = todo_v[won]
            todo_k, todo_v, slot = todo_k[~won], todo_v[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.int64(-7046029254386353131)) >> np.int64(64 - self.bits)) & self.mask

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it does not merge; negative ids are padding."""
        key = (a.astype(np.int64) << np.int64(32)) | b.astype(np.int64)
        shape = key.shape
        key = key.ravel()
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class ByteBpe:
    """A byte-level BPE vocabulary; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        self.whole = ranks

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        for lo, hi in self._buckets(lengths):
            rows = np.flatnonzero((lengths > lo) & (lengths <= hi))
            for part in np.array_split(rows, max(1, len(rows) * hi >> 20)):
                if len(part):
                    self._matrix([words[i] for i in part], lengths[part], part, out)
        for i in np.flatnonzero(lengths > MATRIX_WIDTH):
            out[i] = self._heap(words[i])
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.empty(0, np.int32)), counts

    @staticmethod
    def _buckets(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        lo = 0
        for hi in (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, MATRIX_WIDTH):
            yield lo, hi
            lo = hi

    def _matrix(self, words: list[bytes], lengths: np.ndarray, place: np.ndarray, out: list[np.ndarray]) -> None:
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        x = self.bytes[raw]
        x[np.arange(width) >= lengths[:, None]] = -1
        r = self.pairs.ranks(x[:, :-1], x[:, 1:]) if width > 1 else np.empty((len(x), 0), np.int32)
        while True:
            best = r.min(axis=1) if r.shape[1] else np.full(len(x), NONE)
            done = best == NONE
            for row, i in zip(x[done], place[done], strict=True):
                out[i] = row[row >= 0]
            if done.all():
                return
            if done.any():
                x, r, place, best = x[~done], r[~done], place[~done], best[~done]
            at = r.argmin(axis=1)  # the leftmost minimum
            rows = np.arange(len(x))
            x[rows, at] = best
            cols = np.arange(x.shape[1] - 1)
            x = np.take_along_axis(x, cols + (cols > at[:, None]), axis=1)
            cols = cols[:-1]
            r = np.take_along_axis(r, cols + (cols >= at[:, None]), axis=1)
            for c in (at - 1, at):
                ok = np.flatnonzero((c >= 0) & (c < r.shape[1]))
                r[ok, c[ok]] = self.pairs.ranks(x[ok, c[ok]], x[ok, c[ok] + 1])

    def _heap(self, word: bytes) -> np.ndarray:
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(first) if rank != NONE]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                p = (ids[i], ids[j])
                if p not in memo:
                    memo[p] = int(self.pairs.ranks(np.array(p[:1]), np.array(p[1:]))[0])
                if memo[p] != NONE:
                    heapq.heappush(heap, (memo[p], i, *p))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([t for t in ids if t >= 0], np.int32)


_ASCII, _ANY = re.compile(ASCII_PATTERN), regex.compile(PATTERN)
_CUT = re.compile(r"(?<=\S)(?=\n)")
_ANY_CUT = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Consecutive parts of text, and whether each is ASCII.

    A pre-token has white space only at its start (one blank) or throughout, so none spans from a
    character that isn't white space to one that is: text can be cut there.
    """
    while len(text) > CHUNK_CHARS:
        m = _ANY_CUT.search(text, CHUNK_CHARS)
        if m is None:
            break
        yield from pieces(text[: m.start()])
        text = text[m.start() :]
    if text.isascii():
        yield text, True
        return
    run: list[str] = []
    kind = True
    for part in _CUT.split(text):
        if part.isascii() != kind and run:
            yield "".join(run), kind
            run = []
        kind = part.isascii()
        run.append(part)
    if run:
        yield "".join(run), kind


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of text, which join up to it."""
    if text.isascii() and len(text) <= CHUNK_CHARS:
        return _ASCII.findall(text)
    return list(chain.from_iterable((_ASCII if ascii_ else _ANY).findall(p) for p, ascii_ in pieces(text)))


class CachedEncoder:
    """Ids of texts by way of a bounded cache of pre-tokens."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe = bpe
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)

    def _learn(self, words: Iterable[str]) -> None:
        new = list(words)
        ids, counts = self.bpe.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(counts) - counts]
        self.flat, self.counts = np.r_[self.flat, ids], np.r_[self.counts, counts]
        base = len(self.index)
        self.index.update((w, base + i) for i, w in enumerate(new))

    def indexes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cache places of all pre-tokens, and how many each text has."""
        if len(self.index) > CACHED_WORDS:
            self._reset()
        words = [pre_tokens(t) if t else [] for t in texts]
        new = set(chain.from_iterable(words)).difference(self.index)
        if new:
            self._learn(new)
        n = np.fromiter(map(len, words), np.int64, len(words))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum())), n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        at, n = self.indexes(texts)
        counts = self.counts[at]
        ends = np.r_[0, np.cumsum(counts)]
        ids = self.flat[np.repeat(self.starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        bounds = ends[np.r_[0, np.cumsum(n)]]
        return ids, np.diff(bounds)

    def count(self, texts: list[str | None]) -> np.ndarray:
        at, n = self.indexes(texts)
        return np.diff(np.r_[0, np.cumsum(self.counts[at])][np.r_[0, np.cumsum(n)]])


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """The encoder of a vocabulary file, kept for the life of the worker."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(ByteBpe(read_ranks(path)))
    return _encoders[path]


def text_chunks(texts: list[str | None]) -> Iterator[slice]:
    """Slices of about CHUNK_CHARS characters, at least one text each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    share_code(df.sparkSession)
    path = f"{folder}/{vocabulary}.tiktoken"
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in text_chunks(texts):
                ids, n = enc.encode(texts[s])
                offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), type=pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), lists], ["doc_id", "ids"])

    return d.mapInArrow(run, schema)
