"""Rollups: functions of the samples of a series in a window (t - w, t] at every grid point.

Three plans, none with a range join:

* order-free functions fan each sample out to the grid points whose window holds it (one generate,
  then a hash aggregate with map-side partial sums);
* functions that look at neighbouring samples get lag and lead first, from one shuffle and sort of
  each series' time shards whose edges are exchanged, so that no series has to fit one task; windows
  without samples inside a gap are emitted by the sample before the gap;
* counters are made monotone on the way, by running sums within shards and over shards.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Grid, Scalar, missing_if_nan
from ..ql import names
from ..ql.syntax import QueryError

SILENCE_MS = 5 * 60 * 1000
C = F.col


@dataclass(frozen=True)
class Spec:
    """How a rollup is computed from the samples of each (series, k).

    ``aggs`` aggregate over samples (ts, v; with ordered also pts, pv, nts, nv of the neighbours);
    ``value`` reads them (and t, w, mpi, prev_ok); ``gap`` is the value in a window without samples
    whose previous sample is near enough.  Expressions are SQL text where they are the same for
    every query (parsed in one call each), columns where an argument is part of them.
    """

    aggs: dict[str, str | Column]
    value: str | Column
    ordered: bool = False
    gap: str | None = None
    tags: tuple[str, ...] = ()  # several series: the aggregates of these names, told apart by a label


def column(x: str | Column | Callable[[], Column]) -> Column:
    return F.expr(x) if isinstance(x, str) else x if isinstance(x, Column) else x()


def _simple(agg: str | Column) -> Spec:
    return Spec({"a": agg}, "a")


NAN, INF = "double('NaN')", "double('Infinity')"


def _div(a: str, b: str) -> str:
    """a / b with IEEE results; NaN is null."""
    return f"nullif(case when {b} = 0 then {a} * case when string({b}) = '-0.0' then -{INF} else {INF} end else try_divide({a}, {b}) end, {NAN})"


def _changed(a: str, b: str) -> str:
    """Whether a sample differs from the one before by more than rounding."""
    return f"({a} <> {b} and not abs({a} - {b}) < 1e-12D * abs({a}))"


SECONDS = 1000.0


def _median_of(a: str) -> str:
    return f"(array_sort({a})[int((size({a}) - 1) div 2)] + array_sort({a})[int(size({a}) div 2)]) / 2"


def _count_where(make: Callable[[Column], Column], share: bool = False) -> Callable[[Column], Spec]:
    return lambda x: _simple((F.avg if share else F.sum)(make(x).cast("double")))


def _sum_where(make: Callable[[Column], Column]) -> Callable[[Column], Spec]:
    return lambda x: _simple(F.sum(F.when(make(x), C("v"))))


def _quantile(phi: Column) -> Spec:
    inside = F.when((phi >= 0) & (phi <= 1), phi).otherwise(0.5)
    # the exact interpolated quantile at a rank that may differ from point to point
    a = F.array_sort("l")
    rank = inside * (F.size("l") - 1)
    lo, hi = F.floor(rank).cast("int"), F.ceil(rank).cast("int")
    mid = F.get(a, lo) * (1 - (rank - F.floor(rank))) + F.get(a, hi) * (rank - F.floor(rank))
    return Spec({"l": "collect_list(v)"}, F.when(phi < 0, F.lit(float("-inf"))).when(phi > 1, F.lit(float("inf"))).when(F.isnan(phi), None).otherwise(mid))


def _constant_quantile(phi: float) -> Spec:
    if phi != phi:
        return Spec({"n": "count(v)"}, "double(null)")
    if phi < 0 or phi > 1:
        return Spec({"n": "count(v)"}, f"-{INF}" if phi < 0 else INF)
    return _simple(F.percentile("v", F.lit(float(phi))))


def _hoeffding(sign: int) -> Callable[[Column], Spec]:
    bound = lambda phi: (C("mx") - C("mn")) * F.sqrt(F.ln(1 / (1 - phi)) / (2 * C("n")))
    return lambda phi: Spec({"n": "count(v)", "m": "avg(v)", "mn": "min(v)", "mx": "max(v)"}, C("m") + sign * F.when(C("n") > 1, bound(phi)).otherwise(0.0))


# Rollups whose number comes before the selector.
FIRST = frozenset(("quantile_over_time", "hoeffding_bound_lower", "hoeffding_bound_upper"))


_ENDS = {"n": "count(v)", "fv": "min_by(v, ts)", "ft": "min(ts)", "lv": "max_by(v, ts)", "lt": "max(ts)", "fpv": "min_by(pv, ts)", "fpt": "min_by(pts, ts)", "fnv": "min_by(nv, ts)"}
_BOTH_ENDS = _ENDS | {"lpv": "max_by(pv, ts)", "lpt": "max_by(pts, ts)"}
_FIRST_LAST = {"n": "count(v)", "fv": "min_by(v, ts)", "lv": "max_by(v, ts)"}
_AT = f"(ts - t) / {SECONDS}D"
_REGRESS = {"n": "count(v)", "slope": f"regr_slope(v, {_AT})", "icept": f"regr_intercept(v, {_AT})", "av": "avg(v)"}
# a counter's growth: from the sample before the window, else from zero if the first value is small next to its step
_DELTA = "case when fpv is not null then lv - fpv when abs(fv) < 10 * (abs(coalesce(fnv - fv, 0D)) + 1) then lv when n = 1 then 0D else lv - fv end"
_SLOPE = f"case when prev_ok then {_div('(lv - fpv)', f'((lt - fpt) / {SECONDS}D)')} when n > 1 then {_div('(lv - fv)', f'((lt - ft) / {SECONDS}D)')} end"
_LAST_SLOPE = f"case when n > 1 or prev_ok then {_div('(lv - lpv)', f'((lt - lpt) / {SECONDS}D)')} end"
_GROWTH = "case when n > 1 then lv - fv end"


def _summed(what: str) -> dict[str, str]:
    return _ENDS | {"c": f"sum({what})"}


def _per_sample(what: str) -> Spec:
    return Spec(_ENDS | {"min": f"min({what})", "max": f"max({what})", "avg": f"avg({what})"}, "avg", True, None, ("min", "max", "avg"))


# Order-free rollups and those on neighbouring samples, without arguments besides the selector.
PLAIN: dict[str, Spec] = {
    "avg_over_time": _simple("avg(v)"),
    "count_over_time": _simple("double(count(v))"),
    "sum_over_time": _simple("sum(v)"),
    "sum2_over_time": _simple("sum(v * v)"),
    "min_over_time": _simple("min(v)"),
    "max_over_time": _simple("max(v)"),
    "range_over_time": _simple("max(v) - min(v)"),
    "median_over_time": _simple("percentile(v, 0.5D)"),
    "present_over_time": Spec({"n": "count(v)"}, "1D"),
    "absent_over_time": Spec({"n": "count(v)"}, "1D"),
    "stddev_over_time": _simple("stddev_pop(v)"),
    "stdvar_over_time": _simple("var_pop(v)"),
    "first_over_time": _simple("min_by(v, ts)"),
    "last_over_time": _simple("max_by(v, ts)"),
    "tfirst_over_time": _simple(f"min(ts) / {SECONDS}D"),
    "tlast_over_time": _simple(f"max(ts) / {SECONDS}D"),
    "timestamp": _simple(f"max(ts) / {SECONDS}D"),
    "timestamp_with_name": _simple(f"max(ts) / {SECONDS}D"),
    "tmax_over_time": Spec({"a": "max(struct(v, ts))"}, f"a.ts / {SECONDS}D"),
    "tmin_over_time": Spec({"a": "max(struct(-v as v, ts))"}, f"a.ts / {SECONDS}D"),
    "default_rollup": Spec({"a": "max_by(case when not is_stale then v end, ts)"}, "a"),
    "delta_prometheus": Spec(_FIRST_LAST, _GROWTH),
    "increase_prometheus": Spec(_FIRST_LAST, _GROWTH),
    "rate_prometheus": Spec(_FIRST_LAST, f"case when n > 1 then {_div('(lv - fv)', f'(w / {SECONDS}D)')} end"),
    "delta": Spec(_ENDS, _DELTA, True, "0D"),
    "increase": Spec(_ENDS, _DELTA, True, "0D"),
    "increase_pure": Spec(_ENDS, "lv - coalesce(fpv, 0D)", True, "0D"),
    "deriv_fast": Spec(_ENDS, _SLOPE, True, "0D"),
    "rate": Spec(_ENDS, _SLOPE, True, "0D"),
    "ideriv": Spec(_BOTH_ENDS, _LAST_SLOPE, True),
    "irate": Spec(_BOTH_ENDS, _LAST_SLOPE, True),
    "idelta": Spec(_BOTH_ENDS, "case when n > 1 or prev_ok then lv - lpv else lv end", True, "0D"),
    "lag": Spec(_ENDS, f"(t - lt) / {SECONDS}D", True, f"(t - fpt) / {SECONDS}D"),
    "changes": Spec(_summed(f"case when pv is null then 1D else double({_changed('v', 'pv')}) end"), "c", True, "0D"),
    "changes_prometheus": Spec(_summed(f"coalesce(double({_changed('v', 'pv')}), 0D)") | {"c1": f"min_by(coalesce(double({_changed('v', 'pv')}), 0D), ts)"}, "c - c1", True),
    "resets": Spec(_summed(f"coalesce(double(v < pv and {_changed('v', 'pv')}), 0D)") | {"c1": f"min_by(coalesce(double(v < pv and {_changed('v', 'pv')}), 0D), ts)"}, "case when prev_ok then c else c - c1 end", True, "0D"),
    # recognised names beyond those
    "ascent_over_time": Spec(_summed("greatest(v - coalesce(pv, v), 0D)"), "c", True),
    "descent_over_time": Spec(_summed("greatest(coalesce(pv, v) - v, 0D)"), "c", True),
    "increases_over_time": Spec(_summed("coalesce(double(v > pv), 0D)"), "c", True),
    "decreases_over_time": Spec(_summed("coalesce(double(v < pv), 0D)"), "c", True),
    "deriv": Spec(_REGRESS, "case when n > 1 then slope end"),
    "distinct_over_time": _simple("double(count(distinct v))"),
    "geomean_over_time": Spec({"p": lambda: F.product("v"), "n": "count(v)"}, f"nullif(pow(p, 1D / n), {NAN})"),
    "integrate": Spec(_summed(f"coalesce(pv * (ts - greatest(pts, t - w)) / {SECONDS}D, 0D)"), "c", True),
    "lifetime": Spec(_ENDS, f"(lt - coalesce(case when prev_ok then fpt end, ft)) / {SECONDS}D", True),
    "mode_over_time": _simple("mode(v, true)"),
    "mad_over_time": Spec({"l": "collect_list(v)", "m": "percentile(v, 0.5D)"}, _median_of("transform(l, x -> abs(x - m))")),
    "rate_over_sum": Spec({"s": "sum(v)"}, _div("s", f"(w / {SECONDS}D)")),
    "scrape_interval": Spec(_ENDS, f"case when prev_ok then (lt - fpt) / {SECONDS}D / n when n > 1 then (lt - ft) / {SECONDS}D / (n - 1) end", True),
    "stale_samples_over_time": _simple("double(count_if(is_stale))"),
    "tlast_change_over_time": Spec(_ENDS | {"c": f"max(case when {_changed('v', 'pv')} then ts end)"}, f"c / {SECONDS}D", True),
    "zscore_over_time": Spec({"lv": "max_by(v, ts)", "m": "avg(v)", "d": "stddev_pop(v)"}, f"case when d = 0 then 0D else {_div('(lv - m)', 'd')} end"),
    "outlier_iqr_over_time": Spec({"lv": "max_by(v, ts)", "q": "percentile(v, array(0.25D, 0.75D))"}, "case when lv > q[1] + 1.5D * (q[1] - q[0]) or lv < q[0] - 1.5D * (q[1] - q[0]) then lv end"),
    # those that give several series, told apart by the label ``rollup``
    "rollup": _per_sample("v"),
    "rollup_delta": _per_sample("case when pv is not null then v - pv end"),
    "rollup_increase": _per_sample("case when pv is not null then v - pv end"),
    "rollup_rate": _per_sample(f"case when pv is not null then {_div('(v - pv)', f'((ts - pts) / {SECONDS}D)')} end"),
    "rollup_deriv": _per_sample(f"case when pv is not null then {_div('(v - pv)', f'((ts - pts) / {SECONDS}D)')} end"),
    "rollup_scrape_interval": _per_sample(f"(ts - pts) / {SECONDS}D"),
    "rollup_candlestick": Spec({"open": "min_by(v, ts)", "close": "max_by(v, ts)", "low": "min(v)", "high": "max(v)"}, "close", False, None, ("open", "close", "low", "high")),
}
# Rollups with one scalar argument.
WITH_NUMBER: dict[str, Callable[[Column], Spec]] = {
    "count_eq_over_time": _count_where(lambda x: x == C("v")),
    "count_ne_over_time": _count_where(lambda x: x != C("v")),
    "count_gt_over_time": _count_where(lambda x: x < C("v")),
    "count_le_over_time": _count_where(lambda x: x >= C("v")),
    "share_eq_over_time": _count_where(lambda x: x == C("v"), True),
    "share_gt_over_time": _count_where(lambda x: x < C("v"), True),
    "share_le_over_time": _count_where(lambda x: x >= C("v"), True),
    "sum_eq_over_time": _sum_where(lambda x: x == C("v")),
    "sum_gt_over_time": _sum_where(lambda x: x < C("v")),
    "sum_le_over_time": _sum_where(lambda x: x >= C("v")),
    "quantile_over_time": _quantile,
    "predict_linear": lambda x: Spec(_REGRESS, F.when(C("n") > 1, C("slope") * x + C("icept")).otherwise(C("av"))),
    "hoeffding_bound_lower": _hoeffding(-1),
    "hoeffding_bound_upper": _hoeffding(1),
    "duration_over_time": lambda x: Spec(_ENDS | {"c": F.sum(F.when((C("ts") - C("pts") <= x * SECONDS) & (C("pts") > C("t") - C("w")), (C("ts") - C("pts")) / SECONDS).otherwise(0.0))}, "c", True),
}


def smoothed(sf: Column, tf: Column) -> Spec:
    """Double exponential smoothing of level and trend over the samples in order."""
    ordered = F.transform(F.array_sort("l"), lambda x: x["v"])
    first, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))

    def step(acc: Column, v: Column) -> Column:
        level = sf * v + (1 - sf) * (acc["level"] + acc["trend"])
        return F.struct(level.alias("level"), (tf * (level - acc["level"]) + (1 - tf) * acc["trend"]).alias("trend"))

    start = F.struct(first.alias("level"), (second - first).alias("trend"))
    rest = F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0)))
    return Spec({"l": F.collect_list(F.struct("ts", "v"))}, F.when(F.size("l") < 2, first).otherwise(F.aggregate(rest, start, step)["level"]))


def spec_of(name: str, arg: Scalar | None = None) -> Spec:
    if name in PLAIN:
        return PLAIN[name]
    if name in WITH_NUMBER:
        if arg is None:
            raise QueryError(f"{name} wants a number")
        if name == "quantile_over_time" and arg.value is not None:
            return _constant_quantile(arg.value)
        return WITH_NUMBER[name](arg.expr)
    raise QueryError(f"{name} is recognised but not supported")


def fetch_from(name: str, grid: Grid, window: int) -> int:
    """The earliest sample time that the rollup reads."""
    return grid.start - max(window, grid.step) - (SILENCE_MS if name in names.ROLLUPS_LOOK_BACK else 0)


# How far back a previous sample may lie, as a part of the scrape interval by its length in milliseconds.
_WIDEST = "case when {i} <= 2000 then {i} * 5 when {i} <= 4000 then {i} * 3 when {i} <= 8000 then {i} * 2 when {i} <= 16000 then {i} + {i} div 2 when {i} <= 32000 then {i} + {i} div 4 else {i} + {i} div 8 end"
# The scrape interval is this quantile of the gaps between this many last samples.
INTERVAL_QUANTILE, INTERVAL_SAMPLES = 0.6, 21
# A counter that falls by less than this part of its value is corrected by the fall, else begins anew.
PARTIAL_RESET = 8

SHARD_MS = 24 * 3600 * 1000
_SHARD = "(partition by sk, shard order by ts, v, is_stale)"
_SERIES = "(partition by sk order by shard)"


def _fall(v: str, before: str, gap: str) -> str:
    """What a counter lost from one sample to the next; gap is the condition that they are too far apart."""
    return f"case when {gap} then 0D when {v} < {before} then case when ({before} - {v}) * {PARTIAL_RESET} < {before} then {before} - {v} else {before} end else 0D end"


def _interval(times: str) -> str:
    """The scrape interval of ascending times, 0 without two of them."""
    gaps = f"array_sort(transform(slice({times}, 2, size({times})), (x, i) -> double(x - {times}[i])))"
    at = f"({INTERVAL_QUANTILE}D * (size({times}) - 2))"
    pick = lambda n: f"get({gaps}, int({n}))"
    between = f"(floor({at}) + 1 - {at}) * {pick(f'floor({at})')} + ({at} - floor({at})) * {pick(f'floor({at}) + 1')}"
    return f"case when size({times}) < 2 then 0L when {at} = floor({at}) then bigint({pick(f'floor({at})')}) else bigint({between}) end"


def _neighbours(d: DataFrame, grid: Grid, resets: bool, longest_gap: int, shard_ms: int) -> DataFrame:
    """sk, ts, v, is_stale, mpi, pts, pv, nts, nv: every sample with those next to it, counters made monotone.

    A series is cut into time shards.  One shuffle by (series, shard) serves both the samples and
    the shards' edges (first and last sample, what was lost inside, the last times); only edges meet
    by series, and go back to the shards.  Samples of equal time follow in order of their values.

    A counter's sample and its neighbours are raised by all falls before them: falls are summed
    within shards and the shards' sums over the series.  With longest_gap > 0 the raising begins
    anew after a longer gap, whose first sample is as it is.
    """
    shard = F.expr(f"coalesce(bigint(floor(ts / {shard_ms})), 0L)")
    d = d.select(F.coalesce("sk", F.lit("")).alias("sk"), "ts", "v", "is_stale", shard.alias("shard")).repartition("sk", "shard")
    near = d.selectExpr("sk", "shard", "ts", "v", "is_stale", *(f"{f} over {_SHARD} as {n}" for n, f in {"pts": "lag(ts)", "pv": "lag(v)", "nts": "lead(ts)", "nv": "lead(v)", "no": "row_number()"}.items()), "count(1) over (partition by sk, shard) as size")
    far = lambda t, before: f"coalesce({t} - {before} > {longest_gap}, false)" if longest_gap else "false"
    run = "0D"
    if resets:
        near = near.withColumn("lost", F.expr(_fall("v", "pv", far("ts", "pts"))))
        near = near.withColumn("run", F.expr(f"sum(lost) over {_SHARD}")).withColumn("cut", F.expr(f"max(case when {far('ts', 'pts')} then run end) over {_SHARD}") if longest_gap else F.lit(None).cast("double"))
        run = "run"
    recent = f"array_sort(collect_list(case when no > size - {INTERVAL_SAMPLES} then ts end))"
    edges = near.groupBy("sk", "shard").agg(F.expr("min(struct(ts, v, is_stale))").alias("f"), F.expr(f"max(struct(ts, v, is_stale, {run} as run))").alias("l"), F.expr(recent).alias("recent"), *([F.expr("max(cut)").alias("cut")] if resets else []))
    edges = edges.selectExpr("*", *(f"{f} over {_SERIES} as {n}" for n, f in {"bpt": "lag(l.ts)", "bpv": "lag(l.v)", "bnt": "lead(f.ts)", "bnv": "lead(f.v)"}.items()), "row_number() over (partition by sk order by shard desc) as back")
    # a shard has a sample at least, so that the last ones of a series lie in as many shards at most
    times = f"array_sort(flatten(collect_list(case when back <= {INTERVAL_SAMPLES} then recent end) over (partition by sk)))"
    if grid.n > 1:
        edges = edges.selectExpr("*", f"{times} as many").selectExpr("*", f"slice(many, greatest(size(many) - {INTERVAL_SAMPLES - 1}, 1), {INTERVAL_SAMPLES}) as times")
        i = f"(case when {_interval('times')} > 0 then {_interval('times')} else {grid.step}L end)"
        edges = edges.selectExpr("*", f"{i} as i").selectExpr("*", f"bigint({_WIDEST.format(i='i')}) as mpi")
    else:
        edges = edges.selectExpr("*", f"{grid.step}L as mpi")
    if resets:
        edges = edges.selectExpr("*", f"{_fall('f.v', 'bpv', far('f.ts', 'bpt'))} as across", f"{far('f.ts', 'bpt')} as apart")
        edges = edges.selectExpr("*", f"sum(across) over {_SERIES} + coalesce(sum(l.run) over (partition by sk order by shard rows between unbounded preceding and 1 preceding), 0D) as off")
        edges = edges.selectExpr("*", "greatest(max(greatest(off + cut, case when apart then off end)) over (partition by sk order by shard rows between unbounded preceding and 1 preceding), case when apart then off end, 0D) as old")
    b = edges.selectExpr("sk", "shard", "bpt", "bpv", "bnt", "bnv", "mpi", *(["off", "old"] if resets else []))
    j = near.join(b, ["sk", "shard"]).selectExpr("sk", "ts", "v", "is_stale", "mpi", "coalesce(pts, bpt) as pts", "coalesce(pv, bpv) as pv", "coalesce(nts, bnt) as nts", "coalesce(nv, bnv) as nv", *(["off + run - greatest(old, coalesce(off + cut, 0D)) as up"] if resets else []))
    if not resets:
        return j
    gap = far("ts", "pts")
    j = j.selectExpr("*", f"case when {gap} then 0D else up - {_fall('v', 'pv', gap)} end as prev_up")
    return j.selectExpr("sk", "ts", "v + up as v", "is_stale", "mpi", "pts", "pv + prev_up as pv", "nts", f"nv + up + {_fall('nv', 'v', 'false')} as nv")


def _prepare(samples: DataFrame, name: str, ordered: bool, grid: Grid, window: int, lookback: int, shard_ms: int = SHARD_MS) -> DataFrame:
    """Samples (sk, ts, v, is_stale) with w, mpi and, if ordered, neighbours; counters made monotone."""
    d = samples if name in ("default_rollup", "stale_samples_over_time") else samples.where(~C("is_stale"))
    widen = window <= 0 and name in names.ROLLUPS_WIDEN
    resets = name in names.ROLLUPS_RESET
    if ordered or resets or widen and grid.n > 1:
        d = _neighbours(d, grid, resets, lookback + window if lookback else 0, shard_ms)
    else:
        d = d.withColumn("mpi", F.lit(grid.step).cast("bigint"))
    if lookback:
        d = d.withColumn("mpi", F.least("mpi", F.lit(lookback).cast("bigint")))
    w = F.lit(window).cast("bigint")
    if window <= 0:
        w = F.greatest(F.lit(grid.step).cast("bigint"), C("mpi")) if widen else F.lit(grid.step).cast("bigint")
        if lookback and name == "default_rollup":
            w = F.least(w, F.lit(lookback).cast("bigint"))
    near = ["pts", "pv", "nts", "nv"] if ordered else []
    return d.select("sk", "ts", "v", "is_stale", w.alias("w"), "mpi", *near)


def fan_out(d: DataFrame, grid: Grid, gaps: bool) -> DataFrame:
    """One row per sample and grid point whose window holds it; with gaps also the points whose window lies between it and the next."""
    last = F.lit(grid.n - 1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    at = lambda ms: F.ceil((ms - grid.start) / grid.step).cast("bigint")  # the first k at or after a time
    lo, hi = F.greatest(at(C("ts")), zero), F.least(at(C("ts") + C("w")) - 1, last)
    none = F.array().cast("array<bigint>")
    inside = F.when(lo <= hi, F.sequence(F.least(lo, last), F.greatest(hi, zero))).otherwise(none)
    if not gaps:
        points = d.where(lo <= hi).select("*", F.explode(F.sequence(lo, hi)).alias("_k"))
        return points.withColumn("k", C("_k").cast("int")).withColumn("t", grid.time_ms(C("k"))).drop("_k")
    until = F.least(C("nts"), C("ts") + C("w") + C("mpi"))
    glo, ghi = F.greatest(at(C("ts") + C("w")), zero), F.least(at(until) - 1, last)
    between = F.when(C("nts").isNotNull() & (glo <= ghi), F.sequence(F.least(glo, last), F.greatest(ghi, zero))).otherwise(none)
    both = F.concat(F.transform(inside, lambda k: F.struct(k.alias("k"), F.lit(False).alias("gap"))), F.transform(between, lambda k: F.struct(k.alias("k"), F.lit(True).alias("gap"))))
    return d.withColumn("_p", F.explode(both)).select(*d.columns, C("_p.k").cast("int").alias("k"), C("_p.gap").alias("gap")).withColumn("t", grid.time_ms(C("k")))


def rollup(samples: DataFrame, name: str, grid: Grid, window: int, spec: Spec, lookback: int = 0) -> DataFrame:
    """sk, k, v (and tag for several series): the rollup of samples (sk, ts, v, is_stale) at every grid point."""
    d = _prepare(samples, name, spec.ordered, grid, window, lookback)
    gaps = spec.ordered and spec.gap is not None
    rows = fan_out(d, grid, gaps)
    if gaps:
        # a point lies in windows or in one gap, never both: a gap's row counts no value and has itself as the previous sample
        rows = rows.withColumn("v", F.when(~C("gap"), C("v"))).withColumn("pts", F.when(C("gap"), C("ts")).otherwise(C("pts")))
    # w and mpi are the same for all samples of a series
    extra = {"w": F.max("w"), "t": F.max("t")} | ({"mpi": F.max("mpi")} if spec.ordered else {})
    g = rows.groupBy("sk", "k").agg(*(column(c).alias(a) for a, c in (spec.aggs | extra).items()))
    if spec.ordered:
        g = g.withColumn("prev_ok", F.coalesce(C("fpt") > C("t") - C("w") - C("mpi"), F.lit(False)))
    if spec.tags:
        return g.select("sk", "k", F.inline(F.array(*(F.struct(F.lit(x).alias("tag"), C(x).alias("v")) for x in spec.tags))))
    value = F.when(C("n") == 0, column(spec.gap)).otherwise(column(spec.value)) if gaps else column(spec.value)
    return g.select("sk", "k", missing_if_nan(value.cast("double")).alias("v"))
