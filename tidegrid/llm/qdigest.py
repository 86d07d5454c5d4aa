"""Percentiles of very large numeric columns: q-digests with a deterministic rank error.

Values are quantised to 2**BITS ordered buckets (the leading bits of the IEEE double in its total
order, rounded to nearest: relative value error below 2**-20), the leaves of a dyadic tree.  A
digest holds counts of tree nodes (root 1, leaves 2**BITS ...); nodes whose count with sibling and
parent is at most n / K are merged into the parent.  Digests merge by adding the counts of equal
nodes.  Every value is counted at an ancestor of its leaf, and each of the BITS inner nodes over a
leaf holds at most n / K, so any quantile's rank is off by at most BITS * floor(n / K) of n rows:
1 % for BITS = 32 and K = 3200; groups of fewer than K values are exact up to quantisation.

Plan: each task reduces its rows to one digest per group (at most 3 K nodes beyond the last
batch), so a hot group leaves a task as one digest.  Merging adds and compresses first within
tasks, then by group and salt, then by group; a reducer takes the digests of its groups one after
the other and never holds more than a few, however many tasks there were.  Roll-ups start from
merged digests of the finest groups, not from those of tasks.

Defined results for odd input: null, NaN and infinite values do not count and a group without
finite values has no digest; null keys form groups of their own; negative zero is zero; ties and
repeated rows count each; an empty table gives no rows; only named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import share_code
from .kmv import Groups

BITS = 32
K = 3200
SALTS = 16  # tasks that share the first merge of a group's full digests
HELD_NODES = 1 << 20  # nodes that a task gathers before it compresses them, and hands on if that does not help


def leaf_of(values: np.ndarray) -> np.ndarray:
    """Leaf numbers of finite doubles, in their order."""
    b = (np.asarray(values, dtype=np.float64) + 0.0).view(np.int64)
    u = np.where(b < 0, ~b, b ^ np.int64(-(2**63))).view(np.uint64)
    top = np.uint64(64 - BITS)
    half = np.uint64(1) << (top - np.uint64(1))
    return (np.minimum(u, np.uint64(2**64 - 1) - half) + half) >> top


def value_of(leaf: np.ndarray) -> np.ndarray:
    """The double that a leaf stands for; leaves beyond the finite range give the largest finite one."""
    u = np.asarray(leaf, dtype=np.uint64) << np.uint64(64 - BITS)
    # rounding carried a negative number's complement, whose low bits are set, into this leaf
    bits = np.where(u < np.uint64(2**63), ~(u - np.uint64(1)), u ^ np.uint64(2**63))
    big = np.finfo(np.float64).max
    return np.clip(np.nan_to_num(bits.view(np.float64), nan=big), -big, big)


def _sum_pairs(g: np.ndarray, node: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Add the counts of equal (g, node); sorted by both."""
    if not len(g):
        return g, node, c
    order = np.lexsort((node, g))
    g, node, c = g[order], node[order], c[order]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (node[1:] != node[:-1])])
    return g[first], node[first], np.add.reduceat(c, first)


def compress(g: np.ndarray, node: np.ndarray, c: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compress the digests of many groups at once, from the leaves up."""
    g, node, c = _sum_pairs(g, node, c)
    if not len(g):
        return g, node, c
    # groups are numbered from 0 without holes by the callers' codes, so that this is no longer than they are many
    n = np.bincount(g, weights=c).astype(np.int64)
    limit = (n // k)[g]
    keep = [(g[limit < 1], node[limit < 1], c[limit < 1])]
    g, node, c = g[limit >= 1], node[limit >= 1], c[limit >= 1]
    depth = np.frexp(node.astype(np.float64))[1] - 1
    up = (np.empty(0, np.int64),) * 3
    for d in range(BITS, 0, -1):
        here = depth == d
        hg, hn, hc = _sum_pairs(np.r_[g[here], up[0]], np.r_[node[here], up[1]], np.r_[c[here], up[2]])
        if not len(hg):
            up = (hg, hn, hc)
            continue
        above = depth == d - 1
        pg, pn, pc = _sum_pairs(np.r_[hg, g[above]], np.r_[hn >> 1, node[above]], np.r_[hc, c[above]])
        key = lambda a, b: a * np.int64(2**34) + b
        total = pc[np.searchsorted(key(pg, pn), key(hg, hn >> 1))]
        small = total <= (n // k)[hg]
        keep.append((hg[~small], hn[~small], hc[~small]))
        up = (hg[small], hn[small] >> 1, hc[small])
    root = depth == 0
    keep.append((np.r_[g[root], up[0]], np.r_[node[root], up[1]], np.r_[c[root], up[2]]))
    return _sum_pairs(*(np.concatenate(x) for x in zip(*keep, strict=True)))


def _digests(batches: Iterator[pa.RecordBatch], names: list[str], nodes: Callable, k: int, ordered: bool = False) -> Iterator[pa.RecordBatch]:
    """One digest per group from the batches of a task; nodes gives row, node and count of a batch's entries.

    Where rows are ordered by names each group comes out once, else it may come out several times.
    """
    groups, g, node, c = Groups(), *((np.empty(0, np.int64),) * 3)
    for b in batches:
        if not b.num_rows:
            continue
        row, new_node, new_c = nodes(b)
        own = groups.of([b.column(i) for i in range(len(names))], b.num_rows)
        g, node, c = compress(np.r_[g, own[row]], np.r_[node, new_node], np.r_[c, new_c], k)
        if len(g) > HELD_NODES:  # many small groups: hand them on instead of keeping them
            done = g < len(groups.number) - 1 if ordered else np.ones(len(g), bool)
            if done.any():
                yield _batch(g[done], node[done], c[done], groups, names)
            last = list(groups.number)[-1]
            groups, g, node, c = Groups(), np.zeros(int((~done).sum()), np.int64), node[~done], c[~done]
            if ordered:
                groups.number[last] = 0
    if len(g):
        yield _batch(g, node, c, groups, names)


def _batch(g: np.ndarray, node: np.ndarray, c: np.ndarray, groups: Groups, names: list[str]) -> pa.RecordBatch:
    """A row per group: its key, nodes and counts."""
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    tuples = list(groups.number)
    own = [tuples[i] for i in g[begin].tolist()]
    at = pa.array(np.r_[begin, len(g)].astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (node, c)]
    return pa.RecordBatch.from_arrays([*(pa.array([t[j] for t in own], pa.string()) for j in range(len(names))), *lists], [*names, "nodes", "counts"])


def _schema(keys: list[str]) -> T.StructType:
    return T.StructType([*(T.StructField(c, T.StringType()) for c in keys), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("nodes", "counts"))])


def build(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """keys (as text), nodes, counts: one digest per group and task, to be merged."""
    share_code(df.sparkSession)
    d = df.select(*(F.col(c).cast("string").alias(c) for c in keys), F.col(value).cast("double").alias("_v"))
    d = d.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))

    def leaves(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaf = leaf_of(b.column(len(keys)).to_numpy(zero_copy_only=False)).astype(np.int64) + (np.int64(1) << BITS)
        return np.arange(b.num_rows), leaf, np.ones(b.num_rows, np.int64)

    return d.mapInArrow(lambda batches: _digests(batches, keys, leaves, k), _schema(keys))


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, node and count of the entries of a batch of digests."""
    nodes, counts = (b.column(b.num_columns - i) for i in (2, 1))
    return np.repeat(np.arange(b.num_rows), nodes.value_lengths().to_numpy(zero_copy_only=False)), nodes.flatten().to_numpy(), counts.flatten().to_numpy()


def merge(digests: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Add digests into groups of keys: keys, nodes, counts, one row per group."""
    share_code(digests.sparkSession)

    def squeezed(d: DataFrame, names: list[str], ordered: bool) -> DataFrame:
        return d.mapInArrow(lambda batches: _digests(batches, names, _entries, k, ordered), _schema(names))

    def by(d: DataFrame, names: list[str]) -> DataFrame:
        if not names:  # one digest of each salt
            return squeezed(d.repartition(1), names, True)
        return squeezed(d.repartition(*names).sortWithinPartitions(*names), names, True)

    parts = squeezed(digests.select(*keys, "nodes", "counts"), keys, False)
    # full digests are spread over the salts by the task that they come from, small ones stay together
    salt = F.when(F.size("nodes") < k, F.lit("0")).otherwise(F.pmod(F.spark_partition_id(), F.lit(SALTS)).cast("string"))
    salted = by(parts.select(salt.alias("_salt"), *keys, "nodes", "counts"), ["_salt", *keys])
    return by(salted.select(*keys, "nodes", "counts"), keys)


def roll_up(digests: DataFrame, keys: list[str], sets: list[list[str]], k: int = K) -> DataFrame:
    """level, keys, nodes, counts: the digests of every set of keys (others null), by merging the finest.

    The finest digests are merged first; those of coarser groups are added within tasks before they travel.
    """
    finest = merge(digests, keys, k)
    combos = F.array(*(F.struct(F.lit("+".join(s)).alias("level"), *((F.col(c) if c in s else F.lit(None).cast("string")).alias(c) for c in keys)) for s in sets if s != keys))
    rows = finest.select("nodes", "counts", F.explode(combos).alias("g")).select("g.*", "nodes", "counts")
    own = finest.select(F.lit("+".join(keys)).alias("level"), *keys, "nodes", "counts")
    coarse = merge(rows, ["level", *keys], k)
    return own.unionByName(coarse) if keys in sets else coarse


def quantiles(digests: DataFrame, keys: list[str], phis: list[float], k: int = K) -> DataFrame:
    """keys, n, rank_error, phi, value: the value at rank ceil(phi * n), off by at most rank_error ranks."""
    share_code(digests.sparkSession)
    phis = [float(p) for p in phis]
    out = T.StructType([*(T.StructField(c, T.StringType()) for c in keys), T.StructField("n", T.LongType()), T.StructField("rank_error", T.LongType()), T.StructField("phi", T.DoubleType()), T.StructField("value", T.DoubleType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, node, count = _entries(b)
            depth = np.frexp(node.astype(np.float64))[1] - 1
            high = ((node + 1) << (BITS - depth)) - 1 - (np.int64(1) << BITS)  # a node's largest leaf
            order = np.lexsort((-depth, high, row))
            row, high, upto = row[order], high[order], np.cumsum(count[order])
            n = np.bincount(row, weights=count[order], minlength=b.num_rows).astype(np.int64)
            before = np.r_[0, np.cumsum(n)[:-1]]
            wanted = before[:, None] + np.maximum(np.ceil(np.array(phis)[None, :] * n[:, None]), 1).astype(np.int64)
            leaf = high[np.searchsorted(upto, wanted.ravel())] if len(upto) else np.zeros(0, np.int64)
            each = np.repeat(np.arange(b.num_rows), len(phis))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(each)) for i in range(len(keys))), pa.array(n[each]), pa.array(BITS * (n[each] // k)), pa.array(phis * b.num_rows), pa.array(value_of(leaf))], out.names)

    return digests.select(*keys, "nodes", "counts").mapInArrow(read, out)
