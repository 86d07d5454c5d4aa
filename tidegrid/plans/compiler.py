"""From expressions to DataFrame plans: one recursive function that only builds, never runs."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aggregates, histograms, rollups, transforms
from ..model import NAME, Grid, Scalar, Vector, drop_name, key_of, label, missing_if_nan, with_labels
from ..ql import names
from ..ql.syntax import COMPARISONS, SET_OPS, Aggregate, Binary, Call, Filter, Num, QueryError, Rollup, Selector, Span, Text
from . import matching

C = F.col
MAX_POINTS = 30_000


def anchored(pattern: str) -> str:
    return transforms.anchored(pattern)


def filter_condition(f: Filter) -> Column:
    """A label filter as a predicate on samples; a label that is absent reads as empty."""
    value = F.coalesce(C("name"), F.lit("")) if f.label == NAME else F.coalesce(C("labels")[f.label], F.lit(""))
    stored = C("name") if f.label == NAME else C("labels")[f.label]
    if f.op == "=":
        # plain equality on what is stored can be pushed into the scan
        return stored == f.value if f.value else value == f.value
    if f.op == "!=":
        return value != f.value
    if f.op in ("=~", "!~"):
        words = f.value.split("|")
        if f.value and all(w and w.replace("_", "").replace("-", "").replace(":", "").isalnum() for w in words):
            hit = stored.isin(words) if f.op == "=~" else value.isin(words)
        elif f.value in (".*", "") or f.value == ".+":
            hit = F.lit(True) if f.value == ".*" else value == "" if not f.value else value != ""
        else:
            hit = value.rlike(anchored(f.value))
        return hit if f.op == "=~" else ~hit
    raise QueryError(f"incomplete filter on {f.label!r}")


def selector_condition(s: Selector, enforced: tuple[tuple[Filter, ...], ...] = ()) -> Column:
    """AND within a group, OR between groups; enforced groups apply to every selector."""
    groups = [g + x for g in s.groups for x in (enforced or ((),))]
    cond = F.lit(False)
    for g in groups:
        c = F.lit(True)
        for f in g:
            c = c & filter_condition(f)
        cond = c if len(groups) == 1 else cond | c
    return cond


# An aggregate of rollups that is one aggregate of samples: the series in between need not be made. Some take a number.
COUNTS = tuple(f"count_{x}_over_time" for x in ("eq", "ne", "gt", "le"))
FUSED = {
    ("sum", "sum_over_time"): lambda: F.sum("v"),
    ("sum", "sum2_over_time"): lambda: F.sum(C("v") * C("v")),
    ("sum", "count_over_time"): lambda: F.count("v").cast("double"),
    ("max", "max_over_time"): lambda: F.max("v"),
    ("min", "min_over_time"): lambda: F.min("v"),
    ("group", "present_over_time"): lambda: F.max(F.lit(1.0)),
} | {("sum", f): lambda x, f=f: rollups.WITH_NUMBER[f](x).aggs["a"] for f in COUNTS}


class Compiler:
    """Compiles expressions over samples (name, labels, ts_ms, value, is_stale) on one grid."""

    def __init__(self, samples, grid: Grid, lookback_ms: int = 0, enforced: tuple = ()) -> None:
        """samples: a DataFrame, or a stored table of series and samples (sources.series)."""
        if grid.step <= 0:
            raise QueryError("step must be positive")
        if grid.n > MAX_POINTS:
            raise QueryError(f"more than {MAX_POINTS} points per series; increase the step")
        self.samples, self.grid, self.lookback, self.enforced = samples, grid, lookback_ms, enforced
        self.spark = samples.sparkSession if isinstance(samples, DataFrame) else samples.spark

    # scalars and constants
    def scalar(self, value: float) -> Scalar:
        return Scalar(F.lit(None).cast("double") if math.isnan(value) else F.lit(float(value)), value)

    def materialise(self, x: Scalar | Vector) -> Vector:
        """A scalar as a vector of one nameless series; the grid's size is bounded."""
        if isinstance(x, Vector):
            return x
        df = self.spark.range(self.grid.n).select(F.lit("").alias("sk"), C("id").cast("int").alias("k"))
        return Vector(df.select("sk", "k", x.expr.alias("v")), single=True)

    def compile(self, e) -> Scalar | Vector:
        match e:
            case Num():
                return self.scalar(e.value)
            case Span():
                return self.scalar(e.ms(self.grid.step) / 1000)
            case Text():
                raise QueryError(f"a string cannot be evaluated: {e.value!r}")
            case Selector() | Rollup():
                return self.rollup_call("default_rollup", (e,), False)
            case Call():
                return self.call(e)
            case Aggregate():
                return self.aggregate(e)
            case Binary():
                return self.binary(e)
        raise QueryError(f"cannot evaluate {e!r}")

    # selectors and rollups
    def select(self, s: Selector, start: int, end: int, key: Column | None = None) -> DataFrame:
        """sk, ts, v, is_stale of the samples of a selector in a time range; key: what is read as sk, if not the series' own key."""
        condition = selector_condition(s, self.enforced)
        stored = not isinstance(self.samples, DataFrame)
        d = self.samples.select(condition, start, end) if stored else self.samples.where(C("ts_ms").between(start, end)).where(condition)
        d = d.where(C("is_stale") | (C("value").isNotNull() & ~F.isnan("value")))
        if key is None and not stored:
            key = key_of(F.map_concat(F.create_map(F.lit(NAME), F.coalesce("name", F.lit(""))), F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, _: k != NAME)))
        return d.select(C("sk") if stored else key.alias("sk"), C("ts_ms").alias("ts"), C("value").alias("v"), F.coalesce("is_stale", F.lit(False)).alias("is_stale"))

    def rollup_call(self, name: str, args: tuple, keep: bool) -> Scalar | Vector:
        # a list of names in parentheses has become a union of texts
        args = tuple(x for a in args for x in (a.args if isinstance(a, Call) and a.name == "union" and a.args and all(isinstance(t, Text) for t in a.args) else (a,)))
        series = [a for a in args if not isinstance(a, (Num, Text, Span))]
        if len(series) > 1:  # a number may be given by an expression, as in time()
            series = [a for a in series if isinstance(a, (Selector, Rollup)) or isinstance(a, (Call, Aggregate)) and not self.is_scalar(a)] or series[-1:]
        if len(series) != 1:
            raise QueryError(f"{name} wants one series")
        target = series[0] if isinstance(series[0], Rollup) else Rollup(series[0])
        others = [a for a in args if a is not series[0]]
        if target.at is not None:
            return self.at(name, target, series[0], args, keep)
        if target.offset is not None:
            shift = target.offset.ms(self.grid.step)
            moved = Compiler(self.samples, Grid(self.grid.start - shift, self.grid.end - shift, self.grid.step), self.lookback, self.enforced)
            inner = replace(target, offset=None)
            return moved.rollup_call(name, tuple(inner if a is series[0] else a for a in args), keep)
        window = target.window.ms(self.grid.step) if target.window else 0
        if not isinstance(target.expr, Selector):
            if not (target.window or target.subquery) and name == "default_rollup":
                return self.compile(target.expr)
            return self.subquery(name, target, others, keep)
        sel = target.expr
        if not any(sel.groups):
            return Vector(self.materialise(self.scalar(math.nan)).df.where("false"), single=True)
        start = rollups.fetch_from(name, self.grid, window)
        samples = self.select(sel, start, self.grid.end)
        return self.rolled(name, samples, window, others, keep, sel)

    def rolled(self, name: str, samples: DataFrame, window: int, others: list, keep: bool, sel: Selector | None) -> Vector:
        keep_name = keep or name in names.ROLLUPS_KEEP_NAME
        one = sel is not None and all(any(f.label == NAME and f.op == "=" for f in g) for g in sel.groups) and len({f.value for g in sel.groups for f in g if f.label == NAME}) == 1
        if name == "quantiles_over_time":
            tag = self.text(others[0])
            parts = [self._one(name, samples, window, rollups.spec_of("quantile_over_time", self.compile(p))).select(with_labels(C("sk"), {tag: F.lit(aggregates_text(p))}).alias("sk"), "k", "v") for p in others[1:]]
            return self._named(_union(parts), keep_name, one)
        if name == "aggr_over_time":
            parts = [self._one(f, samples, window, rollups.spec_of(f)).select(with_labels(C("sk"), {"rollup": F.lit(f)}).alias("sk"), "k", "v") for f in (self.text(o) for o in others)]
            return self._named(_union(parts), keep_name, one)
        if name in ("count_values_over_time", "histogram_over_time"):
            d = rollups.fan_out(rollups._prepare(samples, name, False, self.grid, window, self.lookback), self.grid, False)
            tag, what = (self.text(others[0]), aggregates.number_text(C("v"))) if name == "count_values_over_time" else ("vmrange", aggregates.bucket_name(C("v")))
            g = d.groupBy("sk", "k", what.alias("x")).agg(F.count(F.lit(1)).cast("double").alias("v"))
            return self._named(g.select(with_labels(C("sk"), {tag: C("x")}).alias("sk"), "k", "v"), keep_name, one)
        if name == "holt_winters":
            sf, tf = (F.lit(self.number(o)) for o in others)
            return self._named(self._one(name, samples, window, rollups.smoothed(sf, tf)), keep_name, one)
        arg = None
        if others:
            arg = self.compile(others[0])
            if not isinstance(arg, Scalar):
                raise QueryError(f"{name} wants a number that does not depend on series")
        df = self._one(name, samples, window, rollups.spec_of(name, arg))
        if "tag" in df.columns:
            df = df.select(with_labels(C("sk"), {"rollup": C("tag")}).alias("sk"), "k", "v")
        if name == "absent_over_time":
            return self.absent(Vector(df), sel)
        return self._named(df, keep_name, one)

    def _one(self, name: str, samples: DataFrame, window: int, spec: rollups.Spec) -> DataFrame:
        return rollups.rollup(samples, name, self.grid, window, spec, self.lookback)

    def _named(self, df: DataFrame, keep: bool, one: bool) -> Vector:
        return Vector(df if keep else df.withColumn("sk", drop_name(C("sk"))), unique=keep or one)

    def subquery(self, name: str, target: Rollup, others: list, keep: bool) -> Vector:
        """A rollup over an expression: its points on an inner grid are the samples."""
        step = target.step.ms(self.grid.step) if target.step else self.grid.step
        window = target.window.ms(self.grid.step) if target.window else 0
        start = rollups.fetch_from(name, self.grid, window)
        inner_grid = Grid(start - start % step, self.grid.end + step - 1 - (self.grid.end - 1) % step, step)
        inner = Compiler(self.samples, inner_grid, self.lookback, self.enforced)
        v = inner.materialise(inner.compile(target.expr)).df.where(C("v").isNotNull())
        samples = v.select("sk", inner_grid.time_ms(C("k")).alias("ts"), "v", F.lit(False).alias("is_stale"))
        return self.rolled(name, samples, window, others, keep, None)

    def at(self, name: str, target: Rollup, series, args: tuple, keep: bool) -> Vector:
        """Evaluate at one time and repeat the value on the whole grid."""
        t = self.compile(target.at)
        if isinstance(t, Scalar) and t.value is not None:
            seconds = t.value
        else:
            rows = self.materialise(t).df.where(C("v").isNotNull()).orderBy("k").groupBy("sk").agg(F.first("v").alias("v")).limit(2).collect()
            if len(rows) != 1:
                raise QueryError("@ wants a single series")
            seconds = rows[0]["v"]
        if math.isnan(seconds):
            raise QueryError("@ wants a number")
        ms = int(seconds * 1000)
        inner = Compiler(self.samples, Grid(ms, ms, self.grid.step), self.lookback, self.enforced)
        bare = replace(target, at=None)
        v = inner.materialise(inner.rollup_call(name, tuple(bare if a is series else a for a in args), keep))
        return replace(v, df=v.df.select("sk", F.explode(F.sequence(F.lit(0), F.lit(self.grid.n - 1))).alias("k"), "v"))

    def absent(self, v: Vector, sel) -> Vector:
        """One series of ones where no series has a point, named after the equality filters."""
        fixed: dict[str, str] = {}
        if isinstance(sel, Rollup):
            sel = sel.expr
        if isinstance(sel, Selector) and len(sel.groups) == 1:
            fixed = {f.label: f.value for f in sel.groups[0] if f.op == "=" and f.label != NAME}
        sk = key_of(F.create_map(*(F.lit(x) for kv in fixed.items() for x in kv))) if fixed else F.lit("")
        grid = self.spark.range(self.grid.n).select(C("id").cast("int").alias("k"))
        seen = v.df.where(C("v").isNotNull()).select("k").distinct()
        return Vector(grid.join(seen, "k", "left_anti").select(sk.alias("sk"), "k", F.lit(1.0).alias("v")), single=not fixed)

    # functions
    def text(self, e) -> str:
        if not isinstance(e, Text):
            raise QueryError("a string is wanted")
        return e.value

    def number(self, e) -> float:
        x = self.compile(e)
        if not isinstance(x, Scalar) or x.value is None:
            raise QueryError("a constant number is wanted")
        return x.value

    def is_scalar(self, e) -> bool:
        try:
            return isinstance(e, (Num, Span)) or isinstance(e, Call) and e.name.lower() in ("time", "start", "end", "step", "now", "pi") or isinstance(e, Binary) and self.is_scalar(e.left) and self.is_scalar(e.right)
        except AttributeError:
            return False

    def call(self, e: Call) -> Scalar | Vector:
        name = e.name.lower()
        if name in names.ROLLUPS and name not in ("timestamp",) or name == "timestamp":
            if not e.args:
                raise QueryError(f"{name} wants arguments")
            return self.rollup_call(name, e.args, e.keep)
        g = self.grid
        match name:
            case "time":
                return Scalar(transforms.seconds(g, C("k")))
            case "start":
                return self.scalar(g.start / 1000)
            case "end":
                return self.scalar(g.end / 1000)
            case "step":
                return self.scalar(g.step / 1000)
            case "pi":
                return self.scalar(math.pi)
            case "timezone_offset":
                t = F.timestamp_millis(g.time_ms(C("k")))
                return Scalar((F.unix_seconds(F.from_utc_timestamp(t, self.text(e.args[0]))) - F.unix_seconds(t)).cast("double"))
            case "now":
                return Scalar(F.unix_millis(F.current_timestamp()) / 1000.0)
            case "" | "union":
                return self.union([self.compile(a) for a in e.args])
            case "vector":
                return self.compile(e.args[0])
            case "scalar":
                return self.to_scalar(e.args[0])
            case "absent":
                return self.absent(self.materialise(self.compile(e.args[0])), e.args[0])
            case "rand" | "rand_normal" | "rand_exponential":
                seed = int(self.number(e.args[0])) if e.args else None
                draw = {"rand": F.rand, "rand_normal": F.randn, "rand_exponential": F.rand}[name](seed)
                df = self.materialise(self.scalar(0.0)).df
                return Vector(df.withColumn("v", -F.ln(1 - draw) if name == "rand_exponential" else draw), single=True)
        if name in ("sort", "sort_desc") or name.startswith("sort_by_label"):
            v = self.materialise(self.compile(e.args[0]))
            return replace(v, order=(name, *(self.text(a) for a in e.args[1:])))
        if name in histograms.FUNCTIONS:
            return histograms.apply(self, name, e)
        if name in transforms.CLOCKS and not e.args:
            return self.elementwise(Call(name, (Call("time"),)), name)
        return self.elementwise(e, name)

    def to_scalar(self, arg) -> Scalar | Vector:
        if isinstance(arg, Text):
            try:
                return self.scalar(float(arg.value))
            except ValueError:
                return self.scalar(math.nan)
        x = self.compile(arg)
        if isinstance(x, Scalar) or x.single:
            return x
        n = x.df.groupBy("k").agg(F.count_distinct("sk").alias("_s"), F.max("v").alias("v"))
        lone = x.df.select("sk").distinct().limit(2).agg(F.count(F.lit(1)).alias("_series"))
        return Vector(n.join(F.broadcast(lone), C("_series") == 1).select(F.lit("").alias("sk"), "k", "v"), single=True)

    def union(self, parts: list) -> Vector:
        if not parts:
            raise QueryError("union wants arguments")
        if len(parts) == 1:
            return parts[0]
        if all(isinstance(p, Scalar) or p.single for p in parts):  # equal keys, all kept
            return Vector(_union([self.materialise(p).df.select(F.lit("" if i == 0 else f"{NAME}\x02#{i}").alias("sk"), "k", "v") for i, p in enumerate(parts)]))
        dfs = [self.materialise(p).df.select("sk", "k", "v", F.lit(i).alias("i")) for i, p in enumerate(parts)]
        # a window and not a join with an aggregate, for which every part would be computed again
        first = F.min("i").over(Window.partitionBy("sk"))
        return Vector(_union(dfs).withColumn("first", first).where(C("i") == C("first")).select("sk", "k", "v"))

    def elementwise(self, e: Call, name: str) -> Scalar | Vector:
        keep = e.keep or name in names.TRANSFORMS_KEEP_NAME
        if name in transforms.LABEL_KEYS or name in transforms.LABEL_TESTS:
            v = self.materialise(self.compile(e.args[0]))
            args = [self.text(a) if isinstance(a, Text) else aggregates_text(a) for a in e.args[1:]]
            key = transforms.label_function(name, C("sk"), args)
            if name in transforms.LABEL_TESTS:
                return replace(v, df=v.df.where(key))
            return Vector(v.df.select(key.alias("sk"), "k", "v"), unique=False)
        if name in ("range_quantile", "limit_offset", "smooth_exponential") or name.startswith("range_trim"):
            return self.with_arguments(e, name)
        if name == "drop_common_labels":
            return self.drop_common(e)
        if not e.args:
            raise QueryError(f"{name} wants arguments")
        if name == "range_normalize" and len(e.args) > 1:
            x, e = self.union([self.materialise(self.compile(a)) for a in e.args]), replace(e, args=e.args[:1])
        else:
            x = self.compile(e.args[0])
        extra = [self.compile(a) for a in e.args[1:] if not isinstance(a, Text)]
        if name in transforms.RANGE:
            v = self.materialise(x)
            df = aggregates.densify(v.df, self.grid)
            if name == "range_mad":
                df = df.withColumn("_dev", F.abs(C("v") - F.percentile("v", F.lit(0.5)).over(Window.partitionBy("sk"))))
            if name == "remove_resets":
                prev = F.last("v", True).over(Window.partitionBy("sk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
                df = df.withColumn("_drop", F.when(C("v") < prev, F.when((prev - C("v")) * 8 < prev, prev - C("v")).otherwise(prev)).otherwise(0.0))
            return self.renamed(df.withColumn("v", transforms.RANGE[name]()), v, keep)
        if name == "drop_empty_series":
            v = self.materialise(x)
            alive = v.df.where(C("v").isNotNull()).select("sk").distinct()
            return replace(v, df=v.df.join(alive, "sk", "left_semi"))
        if name == "label_value":
            v = self.materialise(x)
            return Vector(v.df.withColumn("v", F.when(C("v").isNotNull(), missing_if_nan(label(C("sk"), self.text(e.args[1])).try_cast("double")))), unique=False)
        fn = self.numeric(name, extra)
        if isinstance(x, Scalar) and all(isinstance(a, Scalar) for a in extra):
            return Scalar(missing_if_nan(fn(x.expr, *(a.expr for a in extra))))
        v = self.materialise(x)
        df, cols = v.df, []
        for i, a in enumerate(extra):
            if isinstance(a, Scalar):
                cols.append(a.expr)
            else:
                df = df.join(F.broadcast(self.single(a).df.select("k", C("v").alias(f"a{i}"))), "k", "left")
                cols.append(C(f"a{i}"))
        if name == "sgn":
            df = aggregates.densify(df, self.grid)
        return self.renamed(df.select("sk", "k", missing_if_nan(fn(C("v"), *cols)).alias("v")), v, keep)

    def single(self, v: Vector) -> Vector:
        if not v.single:
            raise QueryError("an argument must be a single series")
        return v

    def numeric(self, name: str, extra: list):
        if name in transforms.NUMERIC and not extra:
            return transforms.NUMERIC[name]
        n = len(extra)
        match name, n:
            case "clamp", 2:
                return lambda v, lo, hi: F.when(lo <= hi, transforms.clamp(v, lo, hi))
            case "clamp_min", 1:
                return lambda v, lo: transforms.clamp(v, lo, None)
            case "clamp_max", 1:
                return lambda v, hi: transforms.clamp(v, None, hi)
            case "round", 0 | 1:
                value = extra[0].value if extra and isinstance(extra[0], Scalar) else 1.0
                scale = transforms.decimal_scale(value) if value else 1.0
                cut = lambda r: F.when(F.abs(r * scale) < 2.0**62, (F.when(r < 0, F.ceil(r * scale)).otherwise(F.floor(r * scale))).cast("double") / scale).otherwise(r)
                tidy = lambda r: cut(r + F.signum(r) * 1e-9 / scale)
                return lambda v, *near: tidy(transforms.round_to(v, near[0] if near else F.lit(1.0)))
            case ("bitmap_and" | "bitmap_or" | "bitmap_xor"), 1:
                f = {"bitmap_and": lambda a, b: a.bitwiseAND(b), "bitmap_or": lambda a, b: a.bitwiseOR(b), "bitmap_xor": lambda a, b: a.bitwiseXOR(b)}[name]
                return lambda v, m: f(v.try_cast("bigint"), m.try_cast("bigint")).cast("double")
        raise QueryError(f"{name} is recognised but not supported with {n + 1} arguments")

    def renamed(self, df: DataFrame, v: Vector, keep: bool) -> Vector:
        d = df.select("sk", "k", "v")
        return Vector(d if keep else d.withColumn("sk", drop_name(C("sk"))), v.single, v.unique and keep)

    def with_arguments(self, e: Call, name: str) -> Vector:
        w = Window.partitionBy("sk")
        if name == "limit_offset":
            limit, offset, v = int(self.number(e.args[0])), int(self.number(e.args[1])), self.materialise(self.compile(e.args[2]))
            kept = v.df.select("sk").distinct().orderBy("sk").offset(offset).limit(limit)
            return replace(v, df=v.df.join(kept, "sk", "left_semi"))
        if name == "smooth_exponential":
            v, sf = self.materialise(self.compile(e.args[0])), self.compile(e.args[1])
            pts = v.df.where(C("v").isNotNull()).select("sk", F.struct("k", "v", (sf.expr if isinstance(sf, Scalar) else F.lit(0.5)).alias("s")).alias("p")).groupBy("sk").agg(F.array_sort(F.collect_list("p")).alias("ps"))
            start = F.struct(F.lit(None).cast("double").alias("avg"), F.array().cast("array<struct<k:int,v:double>>").alias("out"))

            def step(acc: Column, p: Column) -> Column:
                s = F.least(F.greatest(p["s"], F.lit(0.0)), F.lit(1.0))
                avg = F.coalesce(acc["avg"] * (1 - s) + p["v"] * s, p["v"])
                return F.struct(avg.alias("avg"), F.concat(acc["out"], F.array(F.struct(p["k"].alias("k"), avg.alias("v")))).alias("out"))

            out = pts.select("sk", F.explode(F.aggregate("ps", start, step)["out"]).alias("p")).select("sk", "p.k", "p.v")
            return replace(v, df=out)
        v = self.materialise(self.compile(e.args[1]))
        x = self.number(e.args[0])
        d = v.df.where(C("v").isNotNull())
        if name == "range_quantile":
            return replace(v, df=aggregates.densify(d, self.grid).withColumn("v", F.percentile("v", F.lit(x)).over(w)))
        if name == "range_trim_spikes":
            d = d.withColumn("q", F.percentile("v", F.array(F.lit(x / 2), F.lit(1 - x / 2))).over(w)).where(C("v").between(C("q")[0], C("q")[1]))
        elif name == "range_trim_zscore":
            d = d.withColumn("m", F.avg("v").over(w)).withColumn("s", F.stddev_pop("v").over(w)).where(F.abs(C("v") - C("m")) <= x * C("s"))
        else:
            d = d.withColumn("m", F.percentile("v", F.lit(0.5)).over(w)).withColumn("mad", F.percentile(F.abs(C("v") - C("m")), F.lit(0.5)).over(w)).where(F.abs(C("v") - C("m")) <= x * C("mad"))
        return replace(v, df=d.select("sk", "k", "v"))

    def drop_common(self, e: Call) -> Vector:
        v = self.union([self.compile(a) for a in e.args])
        series = v.df.select("sk").distinct()
        entry = series.select("sk", F.explode(F.split("sk", "\x01", -1)).alias("x"))
        total = series.agg(F.count(F.lit(1)).alias("n"))
        common = entry.groupBy("x").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(total), C("c") == C("n")).agg(F.collect_set("x").alias("drop"))
        d = v.df.join(F.broadcast(common)).select(F.array_join(F.array_except(F.split("sk", "\x01", -1), C("drop")), "\x01").alias("sk"), "k", "v")
        return Vector(d)

    # aggregates
    def fused(self, e: Aggregate) -> DataFrame | None:
        """sk, k, v of an aggregate straight from samples, if its rollup allows that: one shuffle of groups, none of series."""
        call = e.args[0]
        if len(e.args) != 1 or not isinstance(call, Call) or not call.args or not isinstance(call.args[0], Rollup):
            return None
        name, t, numbers = call.name.lower(), call.args[0], call.args[1:]
        if len(numbers) != (name in COUNTS) or not all(isinstance(x, Num) and not math.isnan(x.value) for x in numbers):
            return None
        agg = FUSED.get((e.name, name))
        if agg is None or t.window is None or t.subquery or t.at is not None or not isinstance(t.expr, Selector) or not any(t.expr.groups):
            return None
        shift = t.offset.ms(self.grid.step) if t.offset else 0
        grid = Grid(self.grid.start - shift, self.grid.end - shift, self.grid.step)
        window = t.window.ms(grid.step)
        if window <= 0:
            return None
        keep = call.keep or name in names.ROLLUPS_KEEP_NAME
        # groups by labels need only those labels of a sample, not its series' key
        direct = e.mod != "without" and isinstance(self.samples, DataFrame)
        key = aggregates.sample_key([x for x in e.labels if keep or x != NAME]) if direct else None
        d = self.select(t.expr, rollups.fetch_from(name, grid, window), grid.end, key).where(~C("is_stale"))
        if not direct:
            d = (d if keep else d.withColumn("sk", drop_name(C("sk")))).withColumn("sk", aggregates.group_key(e.mod, e.labels))
        d = d.select("sk", "ts", "v", F.lit(window).cast("bigint").alias("w"))
        out = rollups.fan_out(d, grid, False).groupBy("sk", "k").agg(agg(*(F.lit(float(x.value)) for x in numbers)).alias("v"))
        return out.select("sk", "k", missing_if_nan(C("v")).alias("v"))

    def aggregate(self, e: Aggregate) -> Vector:
        name = e.name
        if name not in aggregates.EXECUTABLE:
            raise QueryError(f"{name} is recognised but not supported")
        if not e.args:
            raise QueryError(f"{name} wants arguments")
        fused = self.fused(e)
        if fused is not None:
            return Vector(aggregates.limit_groups(fused, e.limit) if e.limit > 0 else fused, single=not e.mod)
        leading = {"quantile": 1, "topk": 1, "bottomk": 1, "limitk": 1, "count_values": 1, "outliers_mad": 1, "outliersk": 1}.get(name, 1 if "k_" in name else len(e.args) - 1 if name == "quantiles" else 0)
        head, rest = list(e.args[:leading]), e.args[leading:]
        if name in ("topk", "bottomk") or "k_" in name:
            head, rest = [e.args[0]], e.args[1:2]
        if not rest:
            raise QueryError(f"{name} wants a series")
        parts = [self.materialise(self.compile(a)).df for a in rest]
        df = _union(parts) if len(parts) > 1 else parts[0]
        m = (e.mod, e.labels)
        match name:
            case "any":
                out = aggregates.any_series(df, *m)
            case "quantile":
                out = aggregates.quantile(df, self.number(head[0]), *m)
            case "quantiles":
                tag = self.text(head[0])
                out = _union([aggregates.quantile(df, self.number(p), *m).select(with_labels(C("sk"), {tag: F.lit(aggregates_text(p))}).alias("sk"), "k", "v") for p in head[1:]])
            case "topk" | "bottomk":
                k = self.compile(head[0])
                if not isinstance(k, Scalar):
                    raise QueryError(f"{name} wants a number")
                out = aggregates.rank_points(df, k.expr, name == "topk", *m)
            case "limitk":
                out = aggregates.limitk(df, int(self.number(head[0])), *m)
            case "share":
                out = aggregates.share(df, *m)
            case "zscore":
                out = aggregates.zscore(df, *m)
            case "mad":
                out = aggregates.mad(df, *m)
            case "count_values":
                out = aggregates.count_values(df, self.text(head[0]), *m)
            case "histogram":
                out = aggregates.histogram(df, *m)
            case "outliers_iqr":
                out = aggregates.outliers(df, "iqr", 0.0, *m)
            case "outliers_mad":
                out = aggregates.outliers(df, "mad", self.number(head[0]), *m)
            case "outliersk":
                out = aggregates.outliersk(df, int(self.number(head[0])), *m)
            case _ if "k_" in name:
                out = aggregates.rank_series(df, int(self.number(head[0])), name[0] == "t", name.split("_")[1], *m)
            case _:
                out = aggregates.simple(df, name, *m)
        if e.limit > 0:
            out = aggregates.limit_groups(out, e.limit)
        return Vector(out, single=not e.mod and name in aggregates.SIMPLE)

    # binary operators
    def binary(self, e: Binary) -> Scalar | Vector:
        a, b = self.compile(e.left), self.compile(e.right)
        if e.op in SET_OPS:
            if isinstance(a, Scalar) and isinstance(b, Scalar):
                return Scalar(_scalar_set(e.op, a.expr, b.expr))
            return matching.set_op(e, self.materialise(a), self.materialise(b), self.grid)
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            return Scalar(matching.point_op(e, a.expr, b.expr))
        if not e.match and not e.join:
            if isinstance(b, Scalar) or b.single and not isinstance(a, Scalar):
                return matching.with_scalar(e, self.materialise(a), b, False)
            if isinstance(a, Scalar) or a.single:
                return matching.with_scalar(e, b, a, True)
        return matching.join_vectors(e, self.materialise(a), self.materialise(b))


def _scalar_set(op: str, a: Column, b: Column) -> Column:
    if op in ("and", "if"):
        return F.when(b.isNotNull(), a)
    if op in ("or", "default"):
        return F.coalesce(a, b)
    return F.when(b.isNull(), a)


def aggregates_text(e) -> str:
    """A constant as a label value."""
    if isinstance(e, Text):
        return e.value
    if isinstance(e, Num):
        return e.text or repr(e.value)
    raise QueryError("a constant is wanted")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["Compiler", "COMPARISONS", "selector_condition"]
