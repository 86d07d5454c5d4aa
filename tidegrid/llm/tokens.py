"""Sizes of texts in tokens of the public tokenizers, by way of cached distinct words.

A tokenizer cuts a text into words that it encodes one by one, so a text's size is the sum of its
words' sizes and each distinct word is encoded once per worker (bounded cache).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import share_code
from . import bpe

_LOWER_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_LOWER_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
# No piece spans from a character that isn't a blank to a blank, or a line end or digit: each of the latter is a token.
_PIECE = re.compile(r" *[^ \n0-9]+| +")
_SINGLE = re.compile(r"[\n0-9]")


class WordCounter:
    """Counts of texts from counts of words; cut gives the words of a text and what it counts besides."""

    def __init__(self, cut: Callable[[str], tuple[list[str], int]], count: Callable[[list[str]], list[int]]) -> None:
        self.cut, self.measure = cut, count
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > bpe.CACHED_WORDS:
            self.known = {}
        cut = [self.cut(t) if t else ([], 0) for t in texts]
        new = list(set(chain.from_iterable(w for w, _ in cut)).difference(self.known))
        if new:
            self.known.update(zip(new, self.measure(new), strict=True))
        get = self.known.__getitem__
        return np.fromiter((sum(map(get, w)) + more for w, more in cut), np.int64, len(cut))


def _lower_case(path: str) -> WordCounter:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True

    def cut(text: str) -> tuple[list[str], int]:
        if text.isascii():
            return _LOWER_ASCII.findall(text.lower()), 0
        # white space ends words, and normalising never joins what it parts, so lines can be cut one by one
        words: list[str] = []
        plain: list[str] = []
        for line in text.split("\n"):
            if line.isascii():
                plain.append(line)
            else:
                words += _LOWER_ANY.findall(tok.normalizer.normalize_str(line))
        return words + _LOWER_ASCII.findall("\n".join(plain).lower()), 0

    return WordCounter(cut, lambda ws: [len(e.ids) for e in tok.encode_batch(ws, add_special_tokens=False)])


def _sentence_pieces(path: str) -> WordCounter:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spanning = re.compile(r"[^▁]▁|.[\n0-9]|[\n0-9].", re.S)
    for i in range(sp.get_piece_size()):
        if not sp.is_byte(i) and not sp.is_control(i) and not sp.is_unknown(i) and spanning.search(sp.id_to_piece(i)):
            raise ValueError(f"piece {sp.id_to_piece(i)!r} spans words: texts cannot be cut for this model")

    # the encoder puts a blank before what it gets, so each word is given without its first one
    def measure(words: list[str]) -> list[int]:
        led = [w for w in words if w[0] == " "]
        bare = [w for w in words if w[0] != " "]
        size = dict(zip(led, map(len, sp.encode([w[1:] or "" for w in led], num_threads=1)), strict=True))
        # a lone blank encodes as the blank that is put before an empty text, which the encoder leaves out
        size |= {" ": 1} if " " in size else {}
        # a word after a line end or digit has no blank before it: measured behind a line end, which is one token after the blank's
        size |= dict(zip(bare, (len(x) - 2 for x in sp.encode(["\n" + w for w in bare], num_threads=1)), strict=True))
        return [size[w] for w in words]

    def cut(text: str) -> tuple[list[str], int]:
        s = " " + text.replace("▁", " ")
        return _PIECE.findall(s), len(_SINGLE.findall(s))

    return WordCounter(cut, measure)


class JointCounter:
    """Counts of a byte-level tokenizer and of the lower-case word tokenizer from one pass over plain text.

    In ASCII text without apostrophes a pre-token of the former holds whole words of the latter
    (letters, single digits or other marks), so both sizes are kept per distinct pre-token.  Lines
    with anything else are counted by each tokenizer on its own; lines part words in both.
    """

    def __init__(self, byte_level: bpe.CachedEncoder, lower: WordCounter) -> None:
        self.byte_level, self.lower = byte_level, lower
        self.lower_sizes = np.empty(0, np.int64)
        self.generation: dict[str, int] | None = None

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        plain, other = zip(*(_split_plain(t) if t else ("", "") for t in texts), strict=True)
        enc = self.byte_level
        at, n = enc.indexes(list(plain))
        if self.generation is not enc.index:  # the cache began anew
            self.generation, self.lower_sizes = enc.index, np.empty(0, np.int64)
        new = list(islice(enc.index, len(self.lower_sizes), None))
        if new:
            # an apostrophe is only in pre-tokens of other lines, whose lower-case sizes are not taken from here
            self.lower_sizes = np.r_[self.lower_sizes, self.lower.count([w if w.isascii() else "" for w in new])]
        ends = np.r_[0, np.cumsum(n)]
        per = [np.diff(np.r_[0, np.cumsum(sizes[at])][ends]) for sizes in (enc.counts, self.lower_sizes)]
        rest = [i for i, t in enumerate(other) if t]
        if rest:
            per[1][rest] += self.lower.count([other[i] for i in rest])
            per[0][rest] += enc.count([other[i] for i in rest])
        return per[0], per[1]


def _split_plain(text: str) -> tuple[str, str]:
    """The plain stretches of a text and the others, each joined up: cuts lie before line ends that follow other than white space."""
    if text.isascii() and "'" not in text:
        return text, ""
    plain, other = [], []
    for part in bpe._CUT.split(text):
        (plain if part.isascii() and "'" not in part else other).append(part)
    return "".join(plain), "".join(other)


_counters: dict[str, object] = {}


def counter(name: str, folder: str = bpe.TOKENIZERS):
    """The counter of a tokenizer, kept for the life of the worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = f"{folder}/{name}"
    if key not in _counters:
        if os.path.exists(key + ".tiktoken"):
            _counters[key] = bpe.encoder(key + ".tiktoken")
        elif os.path.exists(key + ".model"):
            _counters[key] = _sentence_pieces(key + ".model")
        else:
            _counters[key] = _lower_case(key + ".json")
    return _counters[key]


def _all_counts(tokenizers: list[str], texts: list[str | None], folder: str) -> list[np.ndarray]:
    """Sizes by each tokenizer, two of them together where that is possible."""
    made = {t: counter(t, folder) for t in tokenizers}
    byte_level = next((t for t, c in made.items() if isinstance(c, bpe.CachedEncoder)), None)
    lower = next((t for t in tokenizers if os.path.exists(f"{folder}/{t}.json") and isinstance(made[t], WordCounter)), None)
    if byte_level is None or lower is None:
        return [made[t].count(texts) for t in tokenizers]
    key = f"{folder}/{byte_level}+{lower}"
    if key not in _counters:
        _counters[key] = JointCounter(made[byte_level], made[lower])
    both = dict(zip((byte_level, lower), _counters[key].count(texts), strict=True))
    return [both[t] if t in both else made[t].count(texts) for t in tokenizers]


def token_sizes(df: DataFrame, tokenizers: list[str], doc_id: str = "doc_id", text: str = "text", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """doc_id and sizes (array of bigint, in the order of tokenizers); null texts have size 0."""
    share_code(df.sparkSession)
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("sizes", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in bpe.text_chunks(texts):
                sizes = np.stack(_all_counts(tokenizers, texts[s], folder), axis=1)
                offsets = pa.array(np.arange(0, sizes.size + 1, len(tokenizers), dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(sizes.ravel()), type=pa.list_(pa.field("element", pa.int64(), False)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), lists], ["doc_id", "sizes"])

    return d.mapInArrow(run, schema)
