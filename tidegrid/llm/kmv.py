"""Distinct counts over huge identifier sets: k-minimum-values sketches.

A sketch of a group holds its k smallest distinct 60-bit hashes; with fewer than k it is exact.
The k smallest of a union are among the k smallest of its parts, so partial sketches (of files,
days, partitions) merge by keeping the smallest again, and any roll-up of groups is such a merge.

With U the k-th smallest hash as a fraction of the hash range, (k - 1) / U estimates the number of
distinct values without bias, with relative standard error 1 / sqrt(k - 2): 3.2 % for k = 1000, so
that 95 % of estimates lie within 6.2 %.

Plan: values are hashed where they are read; every task reduces its rows to one sketch per group
(numpy on Arrow batches) before anything is shuffled, so a group with a third of all rows costs its
reducer k hashes per task, never its rows, and identifiers themselves never travel.  Coarser groups
are merged from the sketches of the finest ones, again first within each task.

Defined results for odd input: null and empty values are not counted; null keys form groups of
their own (told from totals by ``level``); repeated rows change nothing; an empty table gives no
groups; values are compared as they are, however long; only named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import share_code

K = 1000
HASH_BITS = 60
Z = 1.96  # standard errors in a bound: 95 %
HELD = 1 << 20  # hashes that a task gathers before it reduces them, and hands on if that does not help


def value_hash(value: Column) -> Column:
    """60 uniform bits of a string: the first 15 hex digits of its MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("bigint")


def hashed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and h for every row with a value."""
    return df.where(F.col(value).isNotNull() & (F.col(value) != "")).select(*keys, value_hash(F.col(value)).alias("h"))


def k_smallest(g: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distinct h of every g, sorted by both."""
    order = np.lexsort((h, g))
    g, h = g[order], h[order]
    first = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])] if len(g) else np.zeros(0, bool)
    g, h = g[first], h[first]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
    return g[rank < k], h[rank < k]


class Groups:
    """Numbers of groups, which are tuples of key values."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}

    def of(self, columns: list[pa.Array], n: int) -> np.ndarray:
        local, kinds = np.zeros(n, np.int64), []
        for c in columns:
            d = c.dictionary_encode()
            kinds.append([None, *d.dictionary.to_pylist()])
            local = local * len(kinds[-1]) + d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            # numbers stay below the number of rows, however many keys there are
            used, local = np.unique(local, return_inverse=True)
            kinds[-1] = (kinds[-1], used)
        names = [()]
        for values, used in kinds:
            names = [(*names[u // len(values)], values[u % len(values)]) for u in used.tolist()]
        return np.array([self.number.setdefault(t, len(self.number)) for t in names], np.int64)[local]


def _reducer(schema: T.StructType, keys: list[str], sets: list[list[str]] | None, k: int, ordered: bool) -> Callable:
    """Batches of (keys, h) or (keys, hashes) as one sketch per group and task; with sets, of each set of keys.

    Where rows are ordered by keys, no more than HELD hashes and one group are held, and each group
    comes out once; else groups may come out several times.
    """
    types = [T_ARROW[type(schema[c].dataType)] for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, g, h, size = Groups(), [], [], 0

        def emit(gs: np.ndarray, hs: np.ndarray) -> pa.RecordBatch:
            names = list(groups.number)
            begin = np.flatnonzero(np.r_[True, gs[1:] != gs[:-1]]) if len(gs) else np.zeros(0, np.int64)
            own = [names[i] for i in gs[begin].tolist()]
            cols = [pa.array([t[j] for t in own], ty) for j, ty in enumerate(([pa.string()] if sets is not None else []) + types)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(gs)].astype(np.int32)), pa.array(hs))
            return pa.RecordBatch.from_arrays([*cols, lists], [*(["level"] if sets is not None else []), *keys, "hashes"])

        for b in batches:
            if not b.num_rows:
                continue
            last = b.column(b.num_columns - 1)
            if pa.types.is_list(last.type):
                values, lengths = last.flatten().to_numpy(), last.value_lengths().to_numpy(zero_copy_only=False)
            else:
                values, lengths = last.to_numpy(), None
            spread = (lambda x: x) if lengths is None else (lambda x, m=lengths: np.repeat(x, m))
            for s in [None] if sets is None else sets:
                cols = [b.column(i) if s is None or c in s else pa.nulls(b.num_rows, types[i]) for i, c in enumerate(keys)]
                level = [] if s is None else [pa.array(["+".join(s)] * b.num_rows)]
                g.append(spread(groups.of([*level, *cols], b.num_rows)))
                h.append(values)
                size += len(values)
                if size > HELD:
                    gs, hs = k_smallest(np.concatenate(g), np.concatenate(h), k)
                    g, h, size = [gs], [hs], len(gs)
                    if 2 * size > HELD:  # many small groups: hand them on instead of keeping them
                        done = gs < len(groups.number) - 1 if ordered else np.ones(len(gs), bool)
                        yield emit(gs[done], hs[done])
                        rest, last = hs[~done], list(groups.number)[-1]
                        groups, g, h, size = Groups(), [np.zeros(len(rest), np.int64)], [rest], len(rest)
                        if ordered:
                            groups.number[last] = 0
        if size:
            yield emit(*k_smallest(np.concatenate(g), np.concatenate(h), k))

    return run


T_ARROW = {T.StringType: pa.string(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DateType: pa.date32(), T.BooleanType: pa.bool_()}


def _within_tasks(d: DataFrame, keys: list[str], k: int, sets: list[list[str]] | None = None, ordered: bool = False) -> DataFrame:
    for c in keys:
        if type(d.schema[c].dataType) not in T_ARROW:
            raise TypeError(f"{c} cannot be a key: {d.schema[c].dataType.simpleString()}")
    share_code(d.sparkSession)
    out = T.StructType([*([T.StructField("level", T.StringType())] if sets is not None else []), *(T.StructField(c, d.schema[c].dataType) for c in keys), T.StructField("hashes", T.ArrayType(T.LongType()))])
    return d.mapInArrow(_reducer(d.schema, keys, sets, k, ordered), out)


def _across_tasks(parts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One sketch per group from those of tasks, taken one after the other: no group's parts are gathered."""
    together = parts.repartition(*keys) if keys else parts.repartition(1)  # without keys there is one sketch of each task
    return _within_tasks(together.sortWithinPartitions(*keys) if keys else together, keys, k, None, True)


def sketch(hashes: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One row per group: keys and ``hashes``, its k smallest in ascending order, from rows (keys, h)."""
    return _across_tasks(_within_tasks(hashes.select(*keys, "h"), keys, k), keys, k)


def merge(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Merge sketches into groups of keys (a subset of their columns)."""
    return _across_tasks(_within_tasks(sketches.select(*keys, "hashes"), keys, k), keys, k)


def roll_up(sketches: DataFrame, keys: list[str], sets: list[list[str]], fixed: list[str] | None = None, k: int = K) -> DataFrame:
    """fixed, level, keys, hashes for every set of keys (the others null), merged from sketches by fixed and keys."""
    fixed = fixed or []
    parts = _within_tasks(sketches.select(*fixed, *keys, "hashes"), [*fixed, *keys], k, [[*fixed, *s] for s in sets])
    names = F.create_map(*(F.lit(x) for s in sets for x in ("+".join([*fixed, *s]), "+".join(s))))
    return _across_tasks(parts, ["level", *fixed, *keys], k).select(*fixed, names[F.col("level")].alias("level"), *keys, "hashes")


def cube_sketches(df: DataFrame, keys: list[str], value: str, fixed: list[str] | None = None, k: int = K) -> DataFrame:
    """fixed, level, keys, hashes for every combination of keys (absent ones null), from one pass.

    ``level`` names the keys of the combination, joined by ``+``; it is empty for the total.  The
    finest sketches are made once and all others merged from them.
    """
    fixed = fixed or []
    finest = sketch(hashed(df, [*fixed, *keys], value), [*fixed, *keys], k)
    sets = [[c for i, c in enumerate(keys) if m >> i & 1] for m in range(2 ** len(keys) - 1)]
    own = finest.select(*fixed, F.lit("+".join(keys)).alias("level"), *keys, "hashes")
    # both read the one shuffle of the finest sketches
    return own.unionByName(roll_up(finest, keys, sets, fixed, k)) if keys else own


def edge(hashes: Column, k: int = K) -> Column:
    """The hash up to which, itself excluded, a sketch holds every one: the end of the range unless it is full."""
    return F.when(F.size(hashes) < k, F.lit(2**HASH_BITS)).otherwise(F.element_at(hashes, -1))


def estimate(hashes: Column, k: int = K) -> dict[str, Column]:
    """estimate, lower and upper of the number of distinct values; equal and exact unless full."""
    n, rse = F.size(hashes).cast("double"), 1 / math.sqrt(max(k - 2, 1))
    full = F.size(hashes) >= k
    est = F.when(full, (k - 1) / (F.element_at(hashes, -1) / float(2**HASH_BITS))).otherwise(n)
    return {"estimate": est, "lower": F.when(full, F.greatest(est * (1 - Z * rse), n)).otherwise(est), "upper": F.when(full, est * (1 + Z * rse)).otherwise(est)}


def set_estimates(a: Column, b: Column, k: int = K) -> dict[str, Column]:
    """Estimates with bounds of the union, the intersection and the difference a - b of two sketches.

    Below the smaller of the two edges both sketches are complete, so the counts there are a
    uniform sample of the sets; each has a binomial spread, bounded by Z standard errors.  The union
    of a sketch with itself is its own estimate.
    """
    cut = F.least(edge(a, k), edge(b, k))
    t = cut / float(2**HASH_BITS)
    low = lambda x: F.filter(x, lambda h: h < cut)
    parts = {"union": F.array_union(low(a), low(b)), "intersection": F.array_intersect(low(a), low(b)), "difference": F.array_except(low(a), low(b))}
    out = {}
    for name, hashes in parts.items():
        m = F.size(hashes).cast("double")
        spread = F.when(t < 1, Z * F.sqrt(m * (1 - t) + Z * Z / 4) + Z * Z / 2).otherwise(F.lit(0.0))
        out |= {name: m / t, f"{name}_lower": F.greatest(m - spread, F.lit(0.0)) / t, f"{name}_upper": (m + spread) / t}
    return out
