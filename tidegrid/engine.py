"""The query engine: range and instant queries and listings over a table of samples."""

from __future__ import annotations

import re
import time
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .model import NAME, Grid, Scalar, Vector, key_of, labels_of
from .plans.compiler import Compiler, selector_condition
from .ql.rewrite import flip_comparisons, push_filters
from .ql.syntax import Binary, QueryError, Rollup, Selector, duration_ms, parse, unparse

C = F.col
DEFAULT_STEP_MS = 5 * 60 * 1000
MAX_QUERY_CHARS = 16 * 1024
EXEMPT_FROM_SORT = ("sort", "sort_desc", "sort_by_label", "sort_by_label_desc", "sort_by_label_numeric", "sort_by_label_numeric_desc")


def time_ms(t: str | int | float | datetime, now_ms: int | None = None) -> int:
    """Milliseconds of a time: seconds to nanoseconds by magnitude, RFC 3339, part of a calendar date, or now-1h."""
    if isinstance(t, datetime):
        return int(t.timestamp() * 1000)
    if isinstance(t, str):
        s = t.strip()
        now = int(time.time() * 1000) if now_ms is None else now_ms
        if s.startswith("now"):
            return now + (duration_ms(s[3:].lstrip("+"), 0) if s[3:] else 0)
        if re.fullmatch(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", s) and not re.fullmatch(r"\d{4}", s):
            t = float(s)
        elif s[:1] in "+-" or re.fullmatch(r"([\d.]+[smhdwyi]s?)+", s):
            return now + duration_ms(s.lstrip("+"), 0) if s[0] in "+-" else now - duration_ms(s, 0)
        else:
            return _calendar_ms(s)
    v = float(t)
    if abs(v) >= 2**32 * 1e6:
        return int(v / 1e6)
    if abs(v) >= 2**32 * 1e3:
        return int(v / 1e3)
    return int(v) if abs(v) >= 2**32 else int(v * 1000)


def _calendar_ms(s: str) -> int:
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[T ](\d\d)(?::(\d\d)(?::(\d\d)(\.\d+)?)?)?)?)?)?(Z|[+-]\d\d:?\d\d)?", s)
    if not m:
        raise QueryError(f"bad time {s!r}")
    y, mo, d, h, mi, sec = (int(x) if x else default for x, default in zip(m.groups()[:6], (1970, 1, 1, 0, 0, 0), strict=True))
    t = datetime(y, mo, d, h, mi, sec, tzinfo=UTC)
    zone = m[8]
    if zone and zone != "Z":
        sign = 1 if zone[0] == "+" else -1
        digits = zone[1:].replace(":", "")
        t -= sign * timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
    return int(t.timestamp()) * 1000 + int(float(m[7] or 0) * 1000)


class MetricsEngine:
    """Queries over samples (name, labels, ts_ms, value, is_stale), or over a stored table (sources.series.StoredSeries)."""

    def __init__(self, samples, lookback_ms: int = 0, extra_filters: str | None = None) -> None:
        self.source, self.lookback = samples, lookback_ms
        self.samples: DataFrame = samples if isinstance(samples, DataFrame) else samples.samples()
        self.enforced: tuple = ()
        if extra_filters:
            sel = parse(extra_filters)
            if not isinstance(sel, Selector):
                raise QueryError("extra filters must be a selector")
            self.enforced = sel.groups

    def plan(self, query: str, grid: Grid) -> Vector:
        if len(query) > MAX_QUERY_CHARS:
            raise QueryError("the query is too long")
        e = push_filters(flip_comparisons(parse(query)))
        c = Compiler(self.source, grid, self.lookback, self.enforced)
        x = c.compile(e)
        v = c.materialise(x)
        if isinstance(x, Scalar):
            return v
        first_wins = isinstance(e, Binary) and e.op == "or"
        if not v.unique:
            same = v.df.where(C("v").isNotNull()).groupBy("sk", "k").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("_n"))
            twice = F.raise_error(F.lit("duplicate output time series")).cast("double")
            v = Vector(same.select("sk", "k", F.when(C("_n") > 1, twice).otherwise(C("v")).alias("v")), v.single, True, v.order if not first_wins else None)
        return v

    def query_range(self, query: str, start, end, step="5m", round_digits: int | None = None) -> DataFrame:
        """name, labels, ts_ms, value of every point of the result; with sort functions also ord."""
        step_ms = step if isinstance(step, int) else duration_ms(str(step), DEFAULT_STEP_MS)
        grid = Grid(max(0, time_ms(start)), time_ms(end), step_ms)
        if grid.end < grid.start:
            raise QueryError("the end lies before the start")
        return self.result(self.plan(query, grid), grid, round_digits)

    def query(self, query: str, at, step="5m", round_digits: int | None = None) -> DataFrame:
        """An instant query; a bare ``selector[d]`` gives the raw samples of (t - d, t]."""
        t, step_ms = time_ms(at), step if isinstance(step, int) else duration_ms(str(step), DEFAULT_STEP_MS)
        e = parse(query)
        if isinstance(e, Rollup) and isinstance(e.expr, Selector) and e.window and not e.subquery:
            shift = e.offset.ms(step_ms) if e.offset else 0
            w = e.window.ms(step_ms)
            return self.export(e.expr, t - shift - w + 1, t - shift)
        if isinstance(e, Rollup) and e.subquery and e.window:
            inner = e.step.ms(step_ms) if e.step else step_ms
            shift = e.offset.ms(step_ms) if e.offset else 0
            lo = t - shift - e.window.ms(step_ms)
            first = lo - lo % inner + inner
            return self.query_range(unparse(e.expr), first / 1000, (t - shift) / 1000, inner, round_digits)
        grid = Grid(t, t, step_ms)
        return self.result(self.plan(query, grid), grid, round_digits)

    def result(self, v: Vector, grid: Grid, round_digits: int | None = None) -> DataFrame:
        d = v.df.where(C("v").isNotNull())
        value = F.round("v", round_digits) if round_digits is not None else C("v")
        labels = labels_of(C("sk"))
        cols = [F.coalesce(F.try_element_at(labels, F.lit(NAME)), F.lit("")).alias("name"), F.map_filter(labels, lambda k, _: k != NAME).alias("labels"), grid.time_ms(C("k")).alias("ts_ms"), value.alias("value")]
        if v.order and v.order[0] in EXEMPT_FROM_SORT:
            d = d.join(self.ranks(d, v.order), "sk")
            cols.append(C("ord"))
        return d.select(*cols)

    def ranks(self, d: DataFrame, order: tuple) -> DataFrame:
        """sk and ord, the place of each series: by its last points that differ, or by labels."""
        name, *labels = order
        desc = name.endswith("_desc")
        if name in ("sort", "sort_desc"):
            # points from the last one back (the grid is bounded): the first difference decides, a missing point comes first
            s = d.groupBy("sk").agg(F.sort_array(F.collect_list(F.struct("k", (-C("v") if desc else C("v")).alias("v"))), False).alias("x"))
            key = [F.asc("x"), F.asc("sk")]
        else:
            s = d.select("sk").distinct()
            pad = (lambda c: F.regexp_replace(F.regexp_replace(c, "([0-9]+)", "00000000000000000000$1"), "0*([0-9]{20})", "$1")) if "numeric" in name else (lambda c: c)
            get = [pad(F.coalesce(F.try_element_at(labels_of(C("sk")), F.lit(x)), F.lit(""))) for x in labels]
            key = [*(g.desc() if desc else g.asc() for g in get), F.asc("sk")]
        # one row per series: the order of the answer, which is sorted as a whole by its nature
        return s.withColumn("ord", F.row_number().over(Window.orderBy(*key))).select("sk", "ord")

    # listings
    def _matching(self, match, start, end) -> DataFrame:
        d = self.samples
        if start is not None:
            d = d.where(C("ts_ms") >= (start if isinstance(start, int) else time_ms(start)))
        if end is not None:
            d = d.where(C("ts_ms") <= (end if isinstance(end, int) else time_ms(end)))
        if match is not None:
            sels = [match] if isinstance(match, (str, Selector)) else list(match)
            cond = F.lit(False)
            for s in sels:
                sel = parse(s) if isinstance(s, str) else s
                if not isinstance(sel, Selector):
                    raise QueryError("a series selector is wanted")
                cond = cond | selector_condition(sel, self.enforced)
            d = d.where(cond)
        return d

    def series(self, match=None, start=None, end=None, limit: int | None = None) -> DataFrame:
        named = F.map_concat(F.create_map(F.lit(NAME), F.coalesce("name", F.lit(""))), F.coalesce("labels", F.create_map().cast("map<string,string>")))
        keys = self._matching(match, start, end).select(key_of(named).alias("sk")).distinct()
        out = keys.orderBy("sk").limit(limit) if limit else keys
        labels = labels_of(C("sk"))
        return out.select(F.coalesce(F.try_element_at(labels, F.lit(NAME)), F.lit("")).alias("name"), F.map_filter(labels, lambda k, _: k != NAME).alias("labels"))

    def labels(self, match=None, start=None, end=None, limit: int | None = None) -> DataFrame:
        d = self._matching(match, start, end)
        filled = F.map_filter("labels", lambda _, v: F.coalesce(v, F.lit("")) != "")
        names = d.select(F.explode(F.map_keys(filled)).alias("label")).unionByName(d.where(C("name") != "").select(F.lit(NAME).alias("label"))).distinct()
        return names.orderBy("label").limit(limit) if limit else names

    def label_values(self, name: str, match=None, start=None, end=None, limit: int | None = None) -> DataFrame:
        if name.startswith("U__"):
            name = re.sub(r"_([0-9a-fA-F]+)_|__", lambda m: chr(int(m[1], 16)) if m[1] else "_", name[3:])
        d = self._matching(match, start, end)
        value = C("name") if name == NAME else F.try_element_at("labels", F.lit(name))
        out = d.select(value.alias("value")).where("value is not null and value <> ''").distinct()
        return out.orderBy("value").limit(limit) if limit else out

    def export(self, match, start=None, end=None) -> DataFrame:
        """Raw samples: name, labels, ts_ms, value."""
        return self._matching(match, start, end).select("name", "labels", "ts_ms", "value")

    def delete_series(self, match) -> DataFrame:
        """The samples that remain when the matching series are deleted; write them to replace the table."""
        sel = parse(match) if isinstance(match, str) else match
        return self.samples.where(~selector_condition(sel, self.enforced))


