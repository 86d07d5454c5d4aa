"""Samples, series keys and vectors.

Samples are rows (name, labels, ts_ms, value, is_stale).  A vector is long and sparse: one row
(sk, k, v) per series and grid point that is there; v is null where a point is known to be missing
(comparisons keep such points, so that ``default`` can fill them).  ``sk`` is the whole label set
in canonical order with the metric name under ``__name__``; labels are read back from it, so that
vectors carry one short string that hashes, joins and aggregates in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = "__name__"
ENTRY, PAIR = "\x01", "\x02"

SAMPLES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("is_stale", T.BooleanType()),
    ]
)


def key_of(labels: Column) -> Column:
    """The canonical key of a map of labels; empty values are absent labels."""
    entries = F.array_sort(F.filter(F.map_entries(labels), lambda e: e["value"].isNotNull() & (e["value"] != "")))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(PAIR), e["value"])), ENTRY)


def labels_of(sk: Column) -> Column:
    """The map of labels of a key."""
    none = F.create_map().cast("map<string,string>")
    return F.when(sk == "", none).otherwise(F.str_to_map(sk, F.lit(ENTRY), F.lit(PAIR)))


def keep_labels(sk: Column, labels: list[str] | tuple[str, ...]) -> Column:
    """The key with only the listed labels."""
    if not labels:
        return F.lit("")
    return _filter_entries(sk, lambda name: name.isin(list(labels)))


def drop_labels(sk: Column, labels: list[str] | tuple[str, ...]) -> Column:
    if not labels:
        return sk
    return _filter_entries(sk, lambda name: ~name.isin(list(labels)))


def _filter_entries(sk: Column, keep) -> Column:
    parts = F.split(sk, ENTRY, -1)
    return F.when(sk == "", "").otherwise(F.array_join(F.filter(parts, lambda p: keep(F.substring_index(p, PAIR, 1))), ENTRY))


def drop_name(sk: Column) -> Column:
    """The key without the metric name: its entry is cut out without touching the others."""
    return F.when(sk.contains(NAME + PAIR), drop_labels(sk, [NAME])).otherwise(sk)


def label(sk: Column, name: str) -> Column:
    """The value of a label, empty where it is absent."""
    return F.coalesce(F.try_element_at(labels_of(sk), F.lit(name)), F.lit(""))


def with_labels(sk: Column, changes: dict[str, Column]) -> Column:
    """The key with labels set; empty values remove them."""
    names = list(changes)
    rest = F.map_filter(labels_of(sk), lambda k, _: ~k.isin(names))
    new = F.create_map(*(x for n, c in changes.items() for x in (F.lit(n), F.coalesce(c, F.lit("")))))
    return key_of(F.map_concat(rest, new))


def missing_if_nan(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


@dataclass(frozen=True)
class Grid:
    """The evaluation times start, start + step, ... up to end, in milliseconds."""

    start: int
    end: int
    step: int

    @property
    def n(self) -> int:
        return (self.end - self.start) // self.step + 1 if self.end >= self.start else 0

    def time_ms(self, k: Column) -> Column:
        return F.lit(self.start) + k.cast("bigint") * self.step


@dataclass(frozen=True)
class Scalar:
    """A nameless series that is the same expression of k everywhere: literals, time() and the like."""

    expr: Column
    value: float | None = None


@dataclass(frozen=True)
class Vector:
    """df has sk, k and v.  ``single``: at most one series, nameless.  ``order``: how results are sorted."""

    df: DataFrame
    single: bool = False
    unique: bool = True  # no two series can share a key
    order: tuple | None = None


def finite_div(a: Column, b: Column) -> Column:
    """a / b with IEEE results where Spark would raise or give null; NaN is null."""
    quotient = F.try_divide(a, b)
    sign = F.when(b.cast("string") == "-0.0", -1.0).otherwise(1.0)
    by_zero = F.when(a > 0, sign * float("inf")).when(a < 0, sign * float("-inf"))
    return missing_if_nan(F.when(b == 0, by_zero).otherwise(quotient))
