"""Reading level of each document: sentence classifiers and calibrated document difficulty.

1. English sentences are taken from comments, docstrings, documentation and plain text; code (also
   commented out) and tables are not.
2. A model of sentence kinds (kinds.py) sets licence text and generators' banners apart, by a
   sentence's own words and those of the stretch of lines that it stands in.
3. Two softmax regressions with L2 penalty, on words and on character n-grams of words, are
   trained on the sentences of passages with known levels (at most ``MAX_PASSAGES``) and their
   probabilities are averaged after scaling by a temperature fitted on held-out passages.
4. A document's distribution is the mean of its sentences'; its difficulty is that distribution's
   expected level, mapped by the line that fits held-out passages best.

Training runs once on the driver on that bounded sample, on sparse rows: a sentence is its words,
a word its n-grams.  5,000 passages of six sentences of 20 words took 0.5 GB and 270 seconds;
MAX_PASSAGES keeps it below a third of that, and the 120 passages of the test tables take 2 seconds.
Classifying is one map-only pass over whole texts with the
model (fixed size) sent along.  A linear model's sentence score is a sum over words, so each
distinct word is scored once per worker.

Defined results for odd input: null, empty and blank texts, and texts without prose, have no
sentences, a null difficulty and no level; documents with fewer than MIN_SENTENCES have no level;
repeated rows give repeated rows; an empty table gives an empty table, no passages are an error;
only the named columns are read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import share_code
from . import kinds

MAX_PASSAGES = 1_500
MIN_SENTENCES = 3
PROSE_ODDS = 4.0
CHAR_BITS = 13
CACHED_WORDS = 1 << 17
SLICE_DOCS = 512  # texts taken at once

_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SYMBOL = re.compile(r"[{}<>=\[\]|\\^~`@$&*_#]")
_DOTTED, _CALL, _PATH = re.compile(r"\.\w"), re.compile(r"\w\(|\(\)"), re.compile(r"/\w+/")
_INLINE = re.compile(r"!?\[([^\]]*)\]\([^()\s]*\)|``?([^`]+)``?|\*\*([^*]+)\*\*|(?<!\w)[*_]([^\s*_](?:[^*_]*[^\s*_])?)[*_](?!\w)")
# Closed-class words, at least one of which an English sentence has.
FUNCTION_WORDS = frozenset("a an the this that these those each every all some any no not is are was were be been do does did to of in on at by for from with as it its we you they he she his her our your their i when while if unless until before after once because since although though and or but so than then which who whose what how one there".split())
# What opens a comment or docstring line, longest first, and what ends one.
OPENERS = ("<!--", '"""', "'''", 'r"""', "/**", "/*!", "///", "//!", "/*", "//", "--", "# ", "* ", "; ", "% ", "> ")
CLOSERS = ("*/", '"""', "'''", "-->")


def _strip_line(line: str) -> tuple[str, str]:
    """What a line says and the mark it began with: a comment's, an item's ("-") or none."""
    s = line.strip()
    mark = ""
    if s and not s[0].isalpha():
        for o in OPENERS:
            if s.startswith(o):
                mark, s = o.strip(), s[len(o) :].strip()
                break
        else:
            if s in ("#", "*", "%", ";"):
                return "", s
            if s[:2] in ("- ", "+ "):
                mark, s = "-", s[2:].strip()
            elif s[0].isdigit():
                number, _, rest = s.partition(" ")
                if rest and number[-1] in ".)" and number[:-1].isdigit():
                    mark, s = "-", rest.strip()
    if s and s[-1] in "/\"'>" and s.endswith(CLOSERS):
        s = s[: -2 if s[-1] == "/" else -3].strip()
    return s, mark


def _blocks(text: str) -> tuple[list[list[list[str]]], bool]:
    """Contiguous stretches of prose-like lines, each a list of paragraphs of lines; and whether there is code.

    Blank lines and lines of code end a stretch; so does a change between comment and text.
    """
    blocks: list[list[list[str]]] = []
    block: list[list[str]] = []
    kind, code = None, False
    for line in text.splitlines():
        body, mark = _strip_line(line)
        if not body and not mark or body and is_code(body):
            code |= bool(body)
            if block:
                blocks.append(block)
            block, kind = [], None
            continue
        # a docstring's first line has a mark and the others have none
        now = "text" if mark in ("", "-", ">", '"""', "'''", 'r"""') else mark[-1]
        if (now != kind and kind is not None or len(mark) > 2 and mark[0] in "\"'r") and block:
            blocks.append(block)
            block = []
        kind = now
        if not block or mark == "-" or not body:  # an item, or a comment line without words, parts paragraphs
            block.append([])
        if body:
            block[-1].append(plain_text(body))
    if block:
        blocks.append(block)
    return blocks, code


def prose_words(sentence: str) -> list[str]:
    """The words, in lower case, of an English sentence; none if it doesn't read like one.

    It begins with a capital, ends a thought, has three words or more, hardly anything but words,
    and at least one function word.
    """
    s = sentence.strip("\"'()[] ")
    if not s[:1].isupper() or s[-1] not in ".!?" or s.count(" ") < 2:
        return []
    words = _WORD.findall(s)
    if len(words) < 3 or sum(map(len, words)) < 0.7 * (len(s) - s.count(" ")):
        return []
    if not s.isascii() and sum(map(str.isascii, s)) < 0.9 * len(s):
        return []
    low = s.lower()
    own = words if low == s[0].lower() + s[1:] else [w for w in words if w[1:].islower() or len(w) == 1]
    if len(own) < 0.8 * len(words):
        return []
    words = _WORD.findall(low)
    return [] if FUNCTION_WORDS.isdisjoint(words) else words


def plain_text(line: str) -> str:
    """A line of documentation without its markup: the words of links, inline code and emphasis."""
    return _INLINE.sub(lambda m: next(g for g in m.groups() if g is not None), line) if "`" in line or "*" in line or "_" in line or "](" in line else line


def _marked(text: str) -> bool:
    return bool(_SYMBOL.search(text) or "::" in text or _DOTTED.search(text) or "(" in text and _CALL.search(text) or "/" in text and _PATH.search(text))


def is_code(line: str) -> bool:
    """Whether a line reads like code: it ends a statement, or more than a quarter of its words have marks that English doesn't."""
    if line[-1] in ";{":
        return True
    if not _marked(line):
        return False
    parts = plain_text(line).split()
    return 4 * sum(map(_marked, parts)) > len(parts)


@dataclass
class Sentences:
    """The English sentences of a text, as words in lower case, and the stretch of lines that each stands in."""

    words: list[list[str]]
    stretch: list[int]
    code: bool = False


def english_sentences(text: str | None) -> Sentences:
    """Sentences of a source, documentation or text file, in order, of whatever kind."""
    out = Sentences([], [])
    if not text or not text.strip():
        return out
    blocks, out.code = _blocks(text.removeprefix("\ufeff"))
    for i, block in enumerate(blocks):
        for paragraph in block:
            for s in _END.split(" ".join(paragraph)):
                words = prose_words(s)
                if words:
                    out.words.append(words)
                    out.stretch.append(i)
    return out


def prose_mask(docs: list[Sentences], model: ReadingModel, means: np.ndarray) -> np.ndarray:
    """Which of the texts' sentences, end to end, are neither licence text nor banners; means are their words' mean scores.

    A sentence's kind is the likeliest by the mean of its own probabilities and its stretch's, where
    prose is taken to be PROSE_ODDS times as frequent as either of the others.  A text without code
    most of whose stretches are licence text is one as a whole.
    """
    n = np.fromiter((len(d.words) for d in docs), np.int64, len(docs))
    if not n.sum():
        return np.zeros(0, bool)
    p = model.kind_probs([w for d in docs for w in d.words], means)
    p[:, kinds.PROSE] *= PROSE_ODDS
    p /= p.sum(axis=1, keepdims=True)
    doc = np.repeat(np.arange(len(docs)), n)
    own = np.fromiter((i for d in docs for i in d.stretch), np.int64, int(n.sum()))
    first = np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])]
    at = np.flatnonzero(first)
    mean = np.add.reduceat(p, at) / np.diff(np.r_[at, len(p)])[:, None]
    kind = ((p + mean[np.cumsum(first) - 1]) / 2).argmax(axis=1)
    legal = mean.argmax(axis=1) == kinds.LICENCE
    stretches, legals = np.bincount(doc[at], minlength=len(docs)), np.bincount(doc[at], weights=legal, minlength=len(docs))
    whole = (2 * legals > stretches) & ~np.array([d.code for d in docs])
    return (kind == kinds.PROSE) & ~whole[doc]


def prose_sentences(text: str | None, model: ReadingModel) -> list[list[str]]:
    """The English prose sentences of one text, in order, as words."""
    d = english_sentences(text)
    return [w for w, ok in zip(d.words, prose_mask([d], model, model.means(d.words)), strict=True) if ok]


def _grams(word: str) -> Iterator[int]:
    w = f"^{word}$"
    for n in (2, 3, 4):
        for i in range(len(w) - n + 1):
            h = 2166136261
            for ch in w[i : i + n]:
                h = (h ^ ord(ch)) * 16777619 & 0xFFFFFFFF
            yield (h ^ h >> 15) & ((1 << CHAR_BITS) - 1)


def tokens(sentence: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(sentence)]


def beginning(words: list[str]) -> tuple[str, str]:
    """How a sentence begins, as two more words for the model of kinds."""
    return f"^{words[0]}", f"^{words[0]} {words[1] if len(words) > 1 else ''}"


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Sparse:
    """A matrix as entries sorted by row, and again by column, for products with narrow dense ones."""

    def __init__(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, shape: tuple[int, int]) -> None:
        self.shape, self.room = shape, None
        self.by_row, self.by_col = self._sorted(row, col, val), self._sorted(col, row, val)

    @staticmethod
    def _sorted(at: np.ndarray, other: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        return at[first], first, other[order], val[order][:, None]

    def _times(self, parts: tuple[np.ndarray, ...], m: np.ndarray, n: int) -> np.ndarray:
        at, first, other, val = parts
        out = np.zeros((n, m.shape[1]))
        if len(first):
            if self.room is None or self.room.shape != (len(other), m.shape[1]):
                self.room = np.empty((len(other), m.shape[1]))  # one buffer for all products
            np.take(m, other, axis=0, out=self.room, mode="clip")
            self.room *= val
            out[at] = np.add.reduceat(self.room, first)
        return out

    def dot(self, m: np.ndarray) -> np.ndarray:
        return self._times(self.by_row, m, self.shape[0])

    def t_dot(self, m: np.ndarray) -> np.ndarray:
        return self._times(self.by_col, m, self.shape[1])


_SCALE = 8.0  # features are means over words; this brings them to unit spread


@dataclass
class Features:
    """Sentences as means of words (of the vocabulary), and words as means of character n-grams."""

    words: dict[str, int]
    s_words: Sparse
    s_all: Sparse
    grams: Sparse
    used: np.ndarray  # the n-grams' numbers that are there, the columns of grams

    @staticmethod
    def of(sentences: list[list[str]]) -> Features:
        every = {w: i for i, w in enumerate(sorted({w for s in sentences for w in s}))}
        n = np.fromiter(map(len, sentences), np.int64, len(sentences))
        row, col = np.repeat(np.arange(len(n)), n), np.fromiter((every[w] for s in sentences for w in s), np.int64, int(n.sum()))
        pair, count = np.unique(row * len(every) + col, return_counts=True)
        row, col = pair // max(len(every), 1), pair % max(len(every), 1)
        val = count / n[row] * _SCALE
        seen = np.bincount(col, minlength=len(every))  # a word of one sentence says nothing about others
        known = np.flatnonzero(seen > 1)
        number = np.full(len(every), -1)
        number[known] = np.arange(len(known))
        use = number[col] >= 0
        grams = [list(_grams(w)) for w in every]
        g = np.fromiter(map(len, grams), np.int64, len(grams))
        used, gram = np.unique(np.fromiter((x for y in grams for x in y), np.int64, int(g.sum())), return_inverse=True)
        return Features(
            {w: int(number[i]) for w, i in every.items() if number[i] >= 0},
            Sparse(row[use], number[col[use]], val[use], (len(n), len(known))),
            Sparse(row, col, val, (len(n), len(every))),
            Sparse(np.repeat(np.arange(len(g)), g), gram, np.repeat(1 / g, g), (len(every), len(used))),
            used,
        )


def _fit(x: list[Sparse], y: np.ndarray, classes: int, penalty: float, weights: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights (columns, fits, classes) and offsets of L2-penalised softmax regressions, by accelerated gradient descent.

    x is a chain of matrices whose product has a row per sentence; weights (sentences, fits) says
    how much each counts in each of the fits, which are made side by side.
    """
    fits = weights.shape[1]
    weights = weights / weights.sum(axis=0)

    def forward(m: np.ndarray) -> np.ndarray:
        for a in reversed(x):
            m = a.dot(m)
        return m

    def back(m: np.ndarray) -> np.ndarray:
        for a in x:
            m = a.t_dot(m)
        return m

    n, d = x[0].shape[0], x[-1].shape[1]
    t = np.eye(classes)[y][:, None, :]
    # the squared length of a row is at most _SCALE squared, and mostly far below
    size = np.zeros(n)
    at, first, _, val = x[0].by_row
    size[at] = np.add.reduceat(np.square(val[:, 0]), first) if len(first) else 0.0
    rate = 1.0 / (0.5 * (weights * size[:, None]).sum(axis=0).max() + 0.5 + penalty)
    w, b = np.zeros((d, fits * classes)), np.zeros(fits * classes)
    vw, vb = w.copy(), b.copy()
    for i in range(rounds):
        z = (forward(vw) + vb).reshape(n, fits, classes)
        e = np.exp(z - z.max(axis=2, keepdims=True))
        r = ((e / e.sum(axis=2, keepdims=True) - t) * weights[:, :, None]).reshape(n, -1)
        nw, nb = vw - rate * (back(r) + penalty * vw), vb - rate * r.sum(axis=0)
        m = i / (i + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w.reshape(d, fits, classes), b.reshape(fits, classes)


@dataclass
class SentenceModel:
    """Word and character models over classes, their probabilities averaged."""

    words: dict[str, int]
    word_w: np.ndarray
    word_b: np.ndarray
    char_w: np.ndarray
    char_b: np.ndarray
    temperature: float = 1.0

    @property
    def classes(self) -> int:
        return len(self.word_b)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Word score and character score of each word, side by side."""
        c = self.classes
        out = np.zeros((len(words), 2 * c))
        for i, w in enumerate(words):
            j = self.words.get(w)
            if j is not None:
                out[i, :c] = self.word_w[j]
            g = list(_grams(w))
            out[i, c:] = self.char_w[g].sum(axis=0) / len(g)
        return out

    def probs(self, mean: np.ndarray) -> np.ndarray:
        """Class probabilities of sentences from the mean scores of their words."""
        c, scale = self.classes, _SCALE / self.temperature
        return (_softmax(scale * mean[:, :c] + self.word_b / self.temperature) + _softmax(scale * mean[:, c:] + self.char_b / self.temperature)) / 2


@dataclass
class ReadingModel:
    """Models of sentences' kinds and levels, and the calibration of a document's difficulty."""

    levels: list[int]
    level: SentenceModel
    kind: SentenceModel
    slope: float = 1.0
    shift: float = 0.0
    known: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def _rows_of(self, words: Iterator[str], count: int) -> np.ndarray:
        """Scores of words, each distinct one scored once."""
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, count)
        return self.scores[at]

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHED_WORDS or self.scores is None:
            self.known, self.scores = {}, np.zeros((0, 2 * (self.level.classes + self.kind.classes)))
        new = sorted(words.difference(self.known))
        if new:
            base = len(self.known)
            self.known |= {w: base + i for i, w in enumerate(new)}
            self.scores = np.concatenate([self.scores, np.hstack([self.level.word_rows(new), self.kind.word_rows(new)])])

    def means(self, sentences: list[list[str]]) -> np.ndarray:
        """The mean of the words' scores of every sentence."""
        self._learn({w for s in sentences for w in s})
        if not sentences:
            return np.zeros((0, self.scores.shape[1]))
        n = np.fromiter(map(len, sentences), np.int64, len(sentences))
        rows = self._rows_of((w for s in sentences for w in s), int(n.sum()))
        return np.add.reduceat(rows, np.r_[0, np.cumsum(n)[:-1]]) / n[:, None]

    def sentence_probs(self, sentences: list[list[str]], means: np.ndarray | None = None) -> np.ndarray:
        """Level probabilities of tokenised, non-empty sentences."""
        means = self.means(sentences) if means is None else means
        return self.level.probs(means[:, : 2 * self.level.classes])

    def kind_probs(self, sentences: list[list[str]], means: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of kinds.PROSE, LICENCE and BANNER."""
        means = self.means(sentences) if means is None else means
        starts = [beginning(s) for s in sentences]
        self._learn({w for s in starts for w in s})
        more = self._rows_of((w for s in starts for w in s), 2 * len(starts))
        n = np.fromiter(map(len, sentences), np.int64, len(sentences))[:, None]
        mean = (means * n + more[::2] + more[1::2]) / (n + 2)
        return self.kind.probs(mean[:, 2 * self.level.classes :])


def _train(sentences: list[list[str]], y: np.ndarray, classes: int, penalty: float, weights: np.ndarray) -> list[SentenceModel]:
    """One model for each column of weights."""
    f = Features.of(sentences)
    ww, wb = _fit([f.s_words], y, classes, penalty, weights)
    part, cb = _fit([f.s_all, f.grams], y, classes, penalty, weights)
    cw = np.zeros((1 << CHAR_BITS, *part.shape[1:]))
    cw[f.used] = part
    return [SentenceModel(f.words, ww[:, i], wb[i], cw[:, i], cb[i]) for i in range(weights.shape[1])]


def train_kinds(passages: list[str], licences: list[str], penalty: float = 1e-4) -> SentenceModel:
    """The model of kinds: passages are prose, licences are texts of licence files; each kind weighs the same."""
    prose = {" ".join(tokens(s)) for p in [*passages, *kinds.PROSE_EXAMPLES] for s in _END.split(p)}
    legal = {" ".join(tokens(s)) for s in kinds.LICENCE_EXAMPLES} | {" ".join(w) for x in licences for w in english_sentences(x).words}
    banner = {" ".join(tokens(s)) for s in kinds.BANNER_EXAMPLES}
    parts = [sorted(prose - legal - banner - {""}), sorted(legal - {""}), sorted(banner - legal - {""})]
    # examples of ordinary prose weigh as much as all passages together: passages may be of a narrow kind
    ordinary = {" ".join(tokens(s)) for s in kinds.PROSE_EXAMPLES}
    share = np.concatenate([np.full(len(p), 1 / len(p)) for p in parts])
    near = np.array([s in ordinary for s in parts[0]])
    if near.any() and not near.all():
        share[: len(near)] = np.where(near, 0.5 / near.sum(), 0.5 / (~near).sum())
    y = np.repeat(np.arange(3), [len(p) for p in parts])
    sents = [s.split(" ") for p in parts for s in p]
    return _train([[*s, *beginning(s)] for s in sents], y, 3, penalty, share[:, None])[0]


def train(passages: list[tuple[int, str]], licences: list[str] = (), penalty: float = 1e-3, folds: int = 3) -> ReadingModel:
    """A model from (level, passage) pairs and licence texts, made once for equal input."""
    if not passages:
        raise ValueError("no labelled passages to train on")
    return _trained(tuple(passages), tuple(licences), penalty, folds)


@functools.lru_cache(maxsize=4)
def _trained(passages: tuple, licences: tuple, penalty: float, folds: int) -> ReadingModel:
    """The model; held-out passages give the temperature and the calibration."""
    levels = sorted({lv for lv, _ in passages})
    rows = [(i, levels.index(lv), tokens(s)) for i, (lv, p) in enumerate(passages) for s in (_END.split(p))]
    rows = [r for r in rows if r[2]]
    y, own = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    sents = [r[2] for r in rows]
    calibrate = len(passages) >= 2 * folds and len(levels) > 1
    held = own % folds
    # the last fit counts every sentence, the others leave one fold out
    weights = np.stack([*((held != f).astype(float) for f in range(folds if calibrate else 0)), np.ones(len(y))], axis=1)
    *parts, level = _train(sents, y, len(levels), penalty, weights)
    model = ReadingModel(levels, level, train_kinds([p for _, p in passages], list(licences)))
    if calibrate:
        means = [(np.flatnonzero(held == f), m) for f, m in enumerate(parts) if (held == f).any()]
        means = [(at, m, ReadingModel(levels, m, model.kind).means([sents[i] for i in at])[:, : 2 * len(levels)]) for at, m in means]
        best = None
        for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4):
            p = np.zeros((len(sents), len(levels)))
            for at, m, mean in means:
                m.temperature = t
                p[at] = m.probs(mean)
            loss = -np.log(p[np.arange(len(y)), y] + 1e-9).mean()
            if best is None or loss < best[0]:
                best = (loss, t, p)
        level.temperature = best[1]
        expected = np.array([(best[2][own == i].mean(axis=0) * levels).sum() for i in np.unique(own)])
        truth = np.array([passages[i][0] for i in np.unique(own)], float)
        if expected.std() > 0:
            slope, shift = np.polyfit(expected, truth, 1)
            model.slope, model.shift = float(slope), float(shift)
    return model


def labelled_passages(df: DataFrame, level: str = "reading_level", passage: str = "passage", item: str = "item_id", limit: int = MAX_PASSAGES) -> list[tuple[int, str]]:
    """The labelled sample: the first ``limit`` passages by id, a stated bound on what is fitted."""
    rows = df.where(F.col(level).isNotNull() & F.col(passage).isNotNull()).orderBy(item).limit(limit).select(level, passage).collect()
    return [(int(r[0]), r[1]) for r in rows]


def reading_levels(docs: DataFrame, model: ReadingModel, doc_id: str = "doc_id", text: str = "text", hard: tuple[int, ...] = (4, 5)) -> DataFrame:
    """doc_id, n_sentences, n_hard, level_shares, difficulty, level of every document.

    ``n_hard`` counts sentences that are more likely of a level in hard than not; ``level_shares`` is
    the mean distribution; ``difficulty`` the calibrated expected level; ``level`` the nearest level,
    null below MIN_SENTENCES sentences.
    """
    share_code(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("n_sentences", T.LongType()), T.StructField("n_hard", T.LongType()), T.StructField("level_shares", T.ArrayType(T.DoubleType())), T.StructField("difficulty", T.DoubleType()), T.StructField("level", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        is_hard = np.isin(m.levels, hard)
        for b in (x.slice(i, SLICE_DOCS) for x in batches for i in range(0, x.num_rows, SLICE_DOCS)):
            docs = [english_sentences(x) for x in b.column(1).to_pylist()]
            means = m.means([w for d in docs for w in d.words])
            keep = prose_mask(docs, m, means)
            owner = np.repeat(np.arange(len(docs)), [len(d.words) for d in docs])[keep]
            n = np.bincount(owner, minlength=len(docs))
            p = m.level.probs(means[keep][:, : 2 * len(m.levels)])
            n_hard = np.bincount(owner, weights=p[:, is_hard].sum(axis=1) > 0.5, minlength=len(n)).astype(np.int64)
            shares = np.stack([np.bincount(owner, weights=p[:, j], minlength=len(n)) for j in range(len(m.levels))], axis=1) / np.maximum(n, 1)[:, None]
            difficulty = np.clip(m.slope * (shares * m.levels).sum(axis=1) + m.shift, m.levels[0], m.levels[-1])
            nearest = np.array(m.levels)[np.abs(difficulty[:, None] - np.array(m.levels)).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n),
                    pa.array(n_hard),
                    pa.array([s.tolist() if k else None for s, k in zip(shares, n, strict=True)], pa.list_(pa.float64())),
                    pa.array(difficulty, mask=n == 0),
                    pa.array(nearest.astype(np.int32), mask=n < MIN_SENTENCES),
                ],
                schema.names,
            )

    return d.mapInArrow(run, schema)


def mostly_hard(levels: DataFrame) -> DataFrame:
    """Rows of reading_levels with enough sentences, most of them hard."""
    return levels.where((F.col("n_sentences") >= MIN_SENTENCES) & (F.col("n_hard") * 2 > F.col("n_sentences")))
