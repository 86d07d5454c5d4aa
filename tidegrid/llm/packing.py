"""Filling fixed-capacity containers: pattern packing by non-negative least squares.

1. Sizes are histogrammed per container kind: at most ``capacity`` numbers, however many documents.
2. Patterns of up to ``PATTERN_DOCS`` lengths (in ``UNITS``-ths of the capacity) that fill a
   container are enumerated, and repeat counts are fitted to the histogram by non-negative least
   squares, rounded down and limited to what is there.
3. What is left is packed by best fit, longest first, on counts of equal containers, first into the
   space left over by the patterns.
4. Documents are numbered within their (kind, size) by exact offsets and look up the container that
   the plan gives to their number.

The plan's size is bounded by the capacity, not by the corpus: it is made on the driver and sent to
the executors (``MAX_CAPACITY`` is checked).  Documents above the capacity are cut into full pieces
and a rest; no other document is divided.  Every document is placed.

Defined results for odd input: null or empty texts, and others without tokens, take no place and have
no rows; repeated ids are items of their own; a kind with a null or non-positive capacity has no
rows; empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.hot_keys import number_rows, tag_positions
from ..session import cut
from . import bpe
from .tokens import token_sizes

UNITS = 48
PATTERN_DOCS = 4
MAX_CAPACITY = 1 << 20
MAX_SPECS = 1000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 minimising |a x - b|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(w.argmax())
        if w[j] <= tol:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            neg = z <= 0
            step = (x[at][neg] / np.maximum(x[at][neg] - z[neg], 1e-300)).min()
            x[at] += step * (z - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(units: int = UNITS, docs: int = PATTERN_DOCS) -> list[tuple[int, ...]]:
    """Multisets of up to docs lengths that fill units but for at most one."""
    return [p for n in range(1, docs + 1) for p in combinations_with_replacement(range(1, units + 1), n) if units - 1 <= sum(p) <= units]


_patterns: dict[tuple[int, int], list[tuple[int, ...]]] = {}


@dataclass
class Group:
    """Equal containers: how many, the space left in each, and (size, first number, per container) of what they hold."""

    count: int
    left: int
    items: list[tuple[int, int, int]] = field(default_factory=list)


@dataclass
class Plan:
    """Intervals of item numbers per size: size, from, per container, first container."""

    size: np.ndarray
    start: np.ndarray
    per: np.ndarray
    base: np.ndarray
    containers: int


def _fit_patterns(hist: np.ndarray, capacity: int, units: int, docs: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns in units and how often to use each, within what the histogram has."""
    have = np.zeros(units + 1, np.int64)
    sizes = np.flatnonzero(hist)
    np.add.at(have, -(-sizes * units // capacity), hist[sizes])
    if (units, docs) not in _patterns:
        _patterns[units, docs] = patterns(units, docs)
    usable = [p for p in _patterns[units, docs] if all(have[u] > 0 for u in p)]
    if not usable:
        return []
    a = np.zeros((units, len(usable)))
    for j, p in enumerate(usable):
        for u in p:
            a[u - 1, j] += 1
    weight = np.sqrt(np.arange(1, units + 1) / units)  # long documents are the harder ones to place later
    x = nnls(a * weight[:, None], have[1:] * weight)
    out = []
    for j in np.argsort(-x, kind="stable"):
        p = usable[j]
        n = int(min([x[j] + 1e-6, *(have[u] // p.count(u) for u in set(p))]))
        if n > 0:
            for u in p:
                have[u] -= n
            out.append((p, n))
    return out


def make_plan(hist: np.ndarray, capacity: int, units: int = UNITS, docs: int = PATTERN_DOCS) -> Plan:
    """Containers for hist[size] items of each size up to capacity."""
    if capacity > MAX_CAPACITY:
        raise ValueError(f"capacity {capacity} is above {MAX_CAPACITY}, which bounds the plan")
    units = min(units, capacity)
    left = hist.astype(np.int64).copy()
    taken = np.zeros(capacity + 1, np.int64)
    groups: list[Group] = []

    def take(size: int, n: int) -> int:
        first = int(taken[size])
        taken[size] += n
        left[size] -= n
        return first

    unit_of = -(-np.arange(capacity + 1) * units // capacity)

    def longest(lo: int, hi: int, used: list[int]) -> int:
        """The longest size in lo ... hi of which an item is left besides those used; 0 if there is none."""
        have = left[lo : hi + 1] > 0
        for s in {x for x in used if lo <= x <= hi}:
            have[s - lo] = left[s] > used.count(s)
        at = np.flatnonzero(have)
        return lo + int(at[-1]) if len(at) else 0

    bounds = {u: (int(np.searchsorted(unit_of, u)), int(np.searchsorted(unit_of, u, "right")) - 1) for u in range(1, units + 1)}
    for pattern, n in _fit_patterns(left, capacity, units, docs):
        while n > 0:
            chosen: list[int] = []
            for u in pattern[:0:-1]:
                chosen.append(longest(*bounds[u], chosen))
            # the shortest length takes up what rounding to units left: the longest item that fits
            chosen.append(longest(1, capacity - sum(chosen), chosen))
            if 0 in chosen:
                break
            need = {s: chosen.count(s) for s in chosen}
            m = min(n, *(int(left[s]) // k for s, k in need.items()))
            groups.append(Group(m, capacity - sum(chosen), [(s, take(s, m * k), k) for s, k in need.items()]))
            n -= m

    spare: list[list[Group]] = [[] for _ in range(capacity + 1)]
    open_ = np.zeros(capacity + 1, bool)

    def put(g: Group) -> None:
        groups.append(g)
        spare[g.left].append(g)
        open_[g.left] = True

    patterned, groups = groups, []
    for g in patterned:
        put(g)
    for size in np.flatnonzero(left)[::-1].tolist():
        while left[size] > 0:
            n = int(left[size])
            room = size + int(open_[size:].argmax()) if open_[size:].any() else 0
            if room:
                g = spare[room].pop()
                open_[room] = bool(spare[room])
                if n < g.count:  # only some of these containers get one
                    rest = Group(g.count - n, g.left, [(s, f + n * k, k) for s, f, k in g.items])
                    put(rest)
                    g.count = n
                g.items.append((size, take(size, g.count), 1))
                g.left -= size
                spare[g.left].append(g)
                open_[g.left] = True
            else:
                k = capacity // size
                if n >= k:
                    put(Group(n // k, capacity - k * size, [(size, take(size, n // k * k), k)]))
                if n % k:
                    put(Group(1, capacity - n % k * size, [(size, take(size, n % k), n % k)]))
    rows, base = [], 0
    for g in groups:
        rows += [(s, f, k, base) for s, f, k in g.items]
        base += g.count
    t = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(t[:, 0], t[:, 1], t[:, 2], t[:, 3], base)


def pack(docs: DataFrame, specs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """spec_id, doc_id, part, first_token, n_tokens, container_id for every document and spec.

    specs: spec_id, tokenizer, capacity (a small table: at most MAX_SPECS rows).  ``part`` numbers
    the pieces of a divided document from 0; container ids are unique per spec.
    """
    kinds = sorted(tuple(r) for r in specs.select("spec_id", "tokenizer", "capacity").where("capacity > 0 and tokenizer is not null and spec_id is not null").limit(MAX_SPECS + 1).collect())
    if len(kinds) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    names = sorted({t for _, t, _ in kinds}) or ["byte_bpe_50k"]
    sizes = cut(token_sizes(docs, names, doc_id, text, folder))  # read twice: for the histogram and for placing
    kind = F.array(*(F.struct(F.lit(i).alias("spec"), F.lit(int(c)).cast("bigint").alias("capacity"), F.get("sizes", F.lit(names.index(t))).alias("n")) for i, (_, t, c) in enumerate(kinds))) if kinds else F.array().cast("array<struct<spec:int,capacity:bigint,n:bigint>>")
    items = tag_positions(sizes).select("_part", "_pos", "doc_id", F.explode(kind).alias("k")).select("_part", "_pos", "doc_id", "k.*").where("n > 0")
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("capacity")).cast("bigint"))
    items = items.select("*", F.explode(parts).alias("part"))
    items = items.withColumn("size", F.least(F.col("n") - F.col("part") * F.col("capacity"), F.col("capacity")))
    items = items.withColumn("class", F.col("spec").cast("bigint") * (2 * MAX_CAPACITY) + F.col("size"))

    counts = items.groupBy("_part", "class").agg(F.count(F.lit(1)).alias("_n"))
    # bounded by the sum of capacities; numbers of all documents, however many
    hist = counts.groupBy("class").agg(F.sum("_n").alias("n")).collect()
    keys, tables = [], []
    for i, (_, _, capacity) in enumerate(kinds):
        h = np.zeros(capacity + 1, np.int64)
        for r in hist:
            if r["class"] // (2 * MAX_CAPACITY) == i:
                h[r["class"] % (2 * MAX_CAPACITY)] = r["n"]
        p = make_plan(h, capacity)
        keys.append((i * 2 * MAX_CAPACITY + p.size, p.start))
        tables.append((p.per, p.base))
    klass, start = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*keys, strict=True)) or [(), ()]))
    per, base = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*tables, strict=True)) or [(), ()]))
    plan = docs.sparkSession.sparkContext.broadcast((klass, start, per, base))

    numbered = number_rows(items.withColumn("_pos", F.struct("_pos", "part")), "class", counts)
    spec_ids = F.array(*(F.lit(s) for s, _, _ in kinds)) if kinds else F.array().cast("array<int>")
    placed = numbered.select(F.get(spec_ids, F.col("spec")).alias("spec_id"), "doc_id", "part", (F.col("part") * F.col("capacity")).alias("first_token"), F.col("size").alias("n_tokens"), "class", F.col("_no").alias("no"))
    schema = T.StructType([*(f for f in placed.schema if f.name not in ("class", "no")), T.StructField("container_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        klass, start, per, base = plan.value
        for b in batches:
            c, no = (b.column(i).to_numpy() for i in (5, 6))
            at = _last_at_most(klass, start, c, no)
            out = base[at] + (no - start[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(out)], schema.names)

    return placed.mapInArrow(run, schema)


def _last_at_most(klass: np.ndarray, start: np.ndarray, c: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Place of the last (klass, start) that isn't after each (c, no); klass and start are sorted together."""
    lo, hi = np.searchsorted(klass, c, "left"), np.searchsorted(klass, c, "right")
    while (hi - lo > 1).any():
        mid = (lo + hi) // 2
        up = (start[np.minimum(mid, len(start) - 1)] <= no) & (hi - lo > 1)
        lo, hi = np.where(up, mid, lo), np.where(up | (hi - lo <= 1), hi, mid)
    return lo
