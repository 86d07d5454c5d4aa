"""Interval aggregation of samples: on a stream with a watermark, or over a stored table.

A configuration has ``interval``, ``outputs``, ``by`` or ``without`` and the usual options.  Times
are event times: a result is stamped with the end of its interval, where a server that flushes by
the clock would use the time of the flush.

* Outputs that need no memory between intervals are one windowed aggregate, the same for streams
  and tables.  Distinct counts (count_series, unique_samples) are exact on both; on a stream they are
  two aggregates, one row per distinct value and then their number, which wants output mode append.
* Counter outputs (increase, total, rate) need each series' previous sample.  Over a table that is
  a sort of time shards; on a stream it is per-series state (``counter_stream``, ``rate_parts``) that
  emits deltas or rates to a table, whose stream the same windowed aggregates take (``increase_stream``,
  ``interval_sums``, ``rate_stream``).
* Running outputs (histogram_bucket, sum_samples_total, total) and sum_samples have a result at the
  end of every interval until ``staleness_interval`` after a group's last sample, also where it has
  none; after that the group is forgotten and its running values begin anew.  On a stream the sums of
  intervals (``interval_sums``) go to a table, and ``flush_stream`` reads it with a state per group that
  a timeout by event time wakes up.  Running values are not cut at 2^53.

Where a stream takes two queries, a table lies between them because rows that a state emits late
would fall behind one query's common watermark, and because Spark allows no state after an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import bucket_name
from ..model import NAME, drop_labels, keep_labels, key_of, labels_of
from ..operators.neighbours import with_previous
from ..operators.relabel import matches, relabel
from ..ql.syntax import duration_ms
from ..session import share_code

C = F.col
# The outputs of a configuration, besides quantiles(...).
STATELESS = ("avg", "count_samples", "count_series", "last", "max", "min", "stddev", "stdvar", "sum_samples", "unique_samples")
COUNTERS = ("increase", "increase_prometheus", "total", "total_prometheus", "rate_avg", "rate_sum")
RUNNING = ("histogram_bucket", "sum_samples_total")
FLUSHED = (*RUNNING, "sum_samples")  # with a result at the end of idle intervals too
SUMS = "g string, x string, ts timestamp, end_ms bigint, n double, last bigint"


@dataclass
class Config:
    interval: str
    outputs: list[str]
    by: list[str] = field(default_factory=list)
    without: list[str] = field(default_factory=list)
    name: str = ""
    match: str | list[str] | None = None
    dedup_interval: str = ""
    staleness_interval: str = ""
    keep_metric_names: bool = False
    drop_input_labels: list[str] = field(default_factory=list)
    input_relabel_configs: list[dict] = field(default_factory=list)
    output_relabel_configs: list[dict] = field(default_factory=list)
    ignore_old_samples: bool = False
    ignore_first_intervals: int = 0
    ignore_first_sample_interval: str = ""
    no_align_flush_to_interval: bool = False
    flush_on_shutdown: bool = False
    enable_windows: bool = False
    watermark: str = "1 minute"

    def __post_init__(self) -> None:
        if self.interval_ms < 1000:
            raise ValueError("interval must be a second or more")
        if self.by and self.without:
            raise ValueError("by and without exclude each other")
        if self.dedup_ms and self.interval_ms % self.dedup_ms:
            raise ValueError("interval must be a multiple of dedup_interval")
        if self.staleness_ms < self.interval_ms:
            raise ValueError("staleness_interval must not be below interval")
        for o in ("ignore_old_samples", "no_align_flush_to_interval", "flush_on_shutdown", "enable_windows"):
            if getattr(self, o):
                raise ValueError(f"{o} is not supported: results go by event time")
        if not self.outputs:
            raise ValueError("outputs are missing")
        if len(set(self.outputs)) != len(self.outputs):
            raise ValueError("outputs must differ")
        for o in self.outputs:
            if o not in STATELESS + COUNTERS + RUNNING and not o.startswith("quantiles("):
                raise ValueError(f"unknown output {o!r}")
            if o.startswith("quantiles(") and not all(0 <= p <= 1 for p in self.phis(o)):
                raise ValueError("quantiles must lie between 0 and 1")
        if self.keep_metric_names and (len(self.outputs) != 1 or self.outputs[0] == "histogram_bucket" or self.outputs[0].startswith("quantiles(") and len(self.phis(self.outputs[0])) > 1):
            raise ValueError("keep_metric_names wants one output of one series")
        if self.by:
            self.by = sorted({*self.by, NAME})

    @property
    def interval_ms(self) -> int:
        return duration_ms(self.interval, 0)

    @property
    def dedup_ms(self) -> int:
        return duration_ms(self.dedup_interval, 0) if self.dedup_interval else 0

    @property
    def staleness_ms(self) -> int:
        return duration_ms(self.staleness_interval, 0) if self.staleness_interval else 2 * self.interval_ms

    @staticmethod
    def phis(output: str) -> list[float]:
        return [float(x) for x in output[len("quantiles(") : -1].split(",")]

    def suffix(self) -> str:
        s = f":{self.interval}"
        by = [b for b in self.by if b != NAME]
        if by:
            s += "_by_" + "_".join(by)
        if self.without:
            s += "_without_" + "_".join(sorted(self.without))
        return s


def _prepared(samples: DataFrame, c: Config) -> DataFrame:
    """g (output key), sk (input key), ts_ms, v and the interval's end."""
    d = samples.where(C("value").isNotNull() & ~F.isnan("value"))
    if c.drop_input_labels:
        d = d.withColumn("labels", F.map_filter("labels", lambda k, _: ~k.isin(c.drop_input_labels)))
    if c.input_relabel_configs:
        d = relabel(d, c.input_relabel_configs)
    full = F.map_concat(F.create_map(F.lit(NAME), F.coalesce("name", F.lit(""))), F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, _: k != NAME))
    if c.match:
        d = d.where(matches(c.match, full))
    sk = key_of(full)
    if c.by:
        out = keep_labels(C("sk"), c.by)
    elif c.without:
        out = drop_labels(C("sk"), c.without)
    else:
        out = C("sk")
    d = d.select(sk.alias("sk"), "ts_ms", C("value").alias("v"), *(["ts"] if "ts" in d.columns else []))
    return d.withColumn("g", out).withColumn("end_ms", (F.floor(C("ts_ms") / c.interval_ms) + 1) * c.interval_ms)


def _named(d: DataFrame, c: Config, output: str) -> DataFrame:
    """name, labels, ts_ms, value from g, end_ms, value (and an extra label in x)."""
    m = labels_of(C("g"))
    name = F.coalesce(F.try_element_at(m, F.lit(NAME)), F.lit(""))
    labels = F.map_filter(m, lambda k, _: k != NAME)
    tag = {"histogram_bucket": "vmrange"}.get(output, "quantile" if output.startswith("quantiles(") else "")
    if tag:
        labels = F.map_concat(F.map_filter(labels, lambda k, _: k != tag), F.create_map(F.lit(tag), C("x")))
    base = output.split("(")[0]
    full = name if c.keep_metric_names else F.concat(name, F.lit(f"{c.suffix()}_{base}"))
    out = d.select(full.alias("name"), labels.alias("labels"), C("end_ms").cast("bigint").alias("ts_ms"), C("value").cast("double").alias("value"), F.lit(False).alias("is_stale"))
    return relabel(out, c.output_relabel_configs) if c.output_relabel_configs else out


def _deduplicated(d: DataFrame, c: Config) -> DataFrame:
    """The last sample of every series and dedup interval."""
    best = F.max(F.struct("ts_ms", "v"))
    keys = ["sk", "g", F.floor(C("ts_ms") / c.dedup_ms).alias("_b"), "end_ms"]
    return d.groupBy(*keys).agg(best.alias("s")).select("sk", "g", C("s.ts_ms").alias("ts_ms"), C("s.v").alias("v"), "end_ms")


def _deduplicated_stream(d: DataFrame, c: Config) -> DataFrame:
    """The same on a stream: a windowed aggregate whose event time goes on into the next one."""
    best = F.max(F.struct("ts_ms", "v"))
    g = d.groupBy("sk", "g", F.window("ts", f"{c.dedup_ms} milliseconds").alias("w")).agg(best.alias("s"))
    return g.select("sk", "g", C("s.ts_ms").alias("ts_ms"), C("s.v").alias("v"), F.window_time("w").alias("ts"))


SIMPLE = {
    "avg": lambda: F.avg("v"),
    "count_samples": lambda: F.count("v"),
    "last": lambda: F.max_by("v", "ts_ms"),
    "max": lambda: F.max("v"),
    "min": lambda: F.min("v"),
    "stddev": lambda: F.stddev_pop("v"),
    "stdvar": lambda: F.var_pop("v"),
    "sum_samples": lambda: F.sum("v"),
}
DISTINCT = {"count_series": "sk", "unique_samples": "v"}


def nearest_rank(values: Column, phi: float) -> Column:
    """The value at rank int(phi * (n - 1) + 0.5) of the sorted values."""
    return F.get(values, F.floor(F.lit(phi) * (F.size(values) - 1) + 0.5).cast("int"))


def aggregate(samples: DataFrame, c: Config) -> DataFrame:
    """All outputs of a configuration over a table of samples, or over a stream for outputs without memory."""
    streaming = samples.isStreaming
    if streaming:
        if any(o in COUNTERS for o in c.outputs):
            raise ValueError("on a stream, take counters through counter_stream or rate_parts")
        if any(o in FLUSHED for o in c.outputs):
            raise ValueError("on a stream, take sum_samples and running outputs through interval_sums and flush_stream")
        if c.ignore_first_intervals:
            raise ValueError("ignore_first_intervals is not supported on a stream")
        samples = samples.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", c.watermark)
    d = _prepared(samples, c)
    if c.dedup_ms:
        d = _deduplicated_stream(d, c) if streaming else _deduplicated(d, c)
    parts = [_output(d, c, o, streaming) for o in c.outputs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if c.ignore_first_intervals and not streaming:
        first = d.agg(F.min("end_ms").alias("_first"))
        out = out.join(F.broadcast(first), C("ts_ms") >= C("_first") + c.ignore_first_intervals * c.interval_ms).drop("_first")
    return out


def _output(d: DataFrame, c: Config, o: str, streaming: bool) -> DataFrame:
    if streaming:
        window = F.window("ts", f"{c.interval_ms} milliseconds")
        keys = ["g", window.alias("w")]
        end = F.unix_millis("w.end").alias("end_ms")
    else:
        keys, end = ["g", "end_ms"], C("end_ms")
    if o == "sum_samples":
        sums = d.groupBy("g", "end_ms").agg(F.sum("v").alias("n"), F.max("ts_ms").alias("last"))
        return _named(_flushes(sums, c).select("g", "end_ms", F.when(C("idle"), 0.0).otherwise(C("n")).alias("value")), c, o)
    if o in SIMPLE:
        return _named(d.groupBy(*keys).agg(SIMPLE[o]().alias("value")).select("g", end, "value"), c, o)
    if o in DISTINCT and streaming:
        once = d.groupBy(*keys, DISTINCT[o]).agg(F.count(F.lit(1)).alias("n")).select("g", F.window_time("w").alias("ts"))
        return _named(once.groupBy(*keys).agg(F.count(F.lit(1)).alias("value")).select("g", end, "value"), c, o)
    if o in DISTINCT:
        return _named(d.groupBy(*keys).agg(F.count_distinct(DISTINCT[o]).alias("value")), c, o)
    if o.startswith("quantiles("):
        a = d.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("vs")).select("g", end, "vs")
        qs = F.array(*(F.struct(F.lit(repr(p) if p != int(p) else str(int(p))).alias("x"), nearest_rank(C("vs"), p).alias("value")) for p in c.phis(o)))
        return _named(a.select("g", "end_ms", F.explode(qs).alias("q")).select("g", "end_ms", "q.x", "q.value"), c, o)
    if o == "histogram_bucket":
        f = _flushes(d.groupBy("g", "end_ms").agg(F.max("ts_ms").alias("last")), c).select("g", "run", "end_ms")
        b = d.where(C("v") >= 0).groupBy("g", "end_ms", bucket_name(C("v")).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        b = b.join(f, ["g", "end_ms"])
        # every bucket seen so far is given at every later end of its run; buckets are a bounded set
        seen = b.groupBy("g", "run", "x").agg(F.min("end_ms").alias("since"))
        every = seen.join(f, ["g", "run"]).where(C("end_ms") >= C("since")).select("g", "run", "x", "end_ms")
        run = Window.partitionBy("g", "run", "x").orderBy("end_ms").rowsBetween(Window.unboundedPreceding, 0)
        total = every.join(b, ["g", "run", "x", "end_ms"], "left").withColumn("value", F.sum("n").over(run))
        return _named(total.select("g", "end_ms", "x", "value"), c, o)
    if o == "sum_samples_total":
        return _named(_running(d.groupBy("g", "end_ms").agg(F.sum("v").alias("n"), F.max("ts_ms").alias("last")), c), c, o)
    deltas = counter_deltas(d, c, keep_first=not o.endswith("_prometheus"))
    if o in ("increase", "increase_prometheus"):
        return _named(deltas.groupBy("g", "end_ms").agg(F.sum("delta").alias("value")), c, o)
    if o in ("total", "total_prometheus"):
        return _named(_running(deltas.groupBy("g", "end_ms").agg(F.sum("delta").alias("n"), F.max("ts_ms").alias("last")), c), c, o)
    # rates: each series' increase over the time since its last sample of the interval before
    s = counter_deltas(d, c, keep_first=False).groupBy("g", "sk", "end_ms").agg(F.sum("delta").alias("inc"), F.max("ts_ms").alias("t"), F.min("ts_ms").alias("t0"))
    prev = F.lag("t").over(Window.partitionBy("g", "sk").orderBy("end_ms"))
    fresh = F.lag("end_ms").over(Window.partitionBy("g", "sk").orderBy("end_ms")) + c.staleness_ms >= C("end_ms")
    s = s.withColumn("dt", (C("t") - F.when(fresh, prev).otherwise(C("t0"))) / 1000.0).where(C("dt") > 0)
    rate = C("inc") / C("dt")
    return _named(s.groupBy("g", "end_ms").agg((F.avg(rate) if o == "rate_avg" else F.sum(rate)).alias("value")), c, o)


def counter_deltas(d: DataFrame, c: Config, keep_first: bool) -> DataFrame:
    """Every sample with what its counter grew by: a fall is a reset, a stale or missing predecessor a first sample."""
    d = with_previous(d, "sk", "ts_ms", "v")
    p, pt = C("prev_value"), C("prev_ts")
    known = F.coalesce(pt + c.staleness_ms >= C("ts_ms"), F.lit(False))
    delta = F.when(known, F.when(C("v") >= p, C("v") - p).otherwise(C("v"))).otherwise(C("v") if keep_first else F.lit(0.0))
    if keep_first and c.ignore_first_sample_interval:
        # first samples do not count until so long after the start
        start = d.agg(F.min("ts_ms").alias("_start"))
        wait = duration_ms(c.ignore_first_sample_interval, 0)
        d = d.join(F.broadcast(start))
        delta = F.when(~known & (C("ts_ms") < C("_start") + wait), F.lit(0.0)).otherwise(delta)
    return d.select("g", "sk", "ts_ms", "end_ms", delta.alias("delta"))


def _flushes(sums: DataFrame, c: Config) -> DataFrame:
    """The ends of intervals at which each group has a result: sums with run and idle.

    sums has g, end_ms, last (the last sample's time) and more, a row per interval with samples.
    An idle row repeats its interval's columns at a later end, until staleness; ``run`` changes
    where a group had been forgotten.
    """
    i, stale = c.interval_ms, c.staleness_ms
    w = Window.partitionBy("g").orderBy("end_ms")
    gone = (F.floor((F.lag("last").over(w) + stale) / i) + 1) * i  # the end at which the group is forgotten
    d = sums.withColumn("_new", F.coalesce((gone <= C("end_ms") - i).cast("int"), F.lit(0))).withColumn("_next", F.lead("end_ms").over(w))
    d = d.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    until = F.least(F.coalesce(C("_next") - i, F.floor((C("last") + stale) / i) * i), F.floor((C("last") + stale) / i) * i)
    ends = F.sequence(C("end_ms").cast("bigint"), F.greatest(until, C("end_ms")).cast("bigint"), F.lit(i).cast("bigint"))
    rest = [x for x in sums.columns if x != "end_ms"]
    return d.select(*rest, "run", F.posexplode(ends).alias("_i", "end_ms")).select(*rest, "run", "end_ms", (C("_i") > 0).alias("idle"))


def _running(sums: DataFrame, c: Config) -> DataFrame:
    """Running totals of n at every end at which a group has a result."""
    run = Window.partitionBy("g", "run").orderBy("end_ms").rowsBetween(Window.unboundedPreceding, 0)
    return _flushes(sums, c).select("g", "end_ms", F.sum(F.when(C("idle"), 0.0).otherwise(C("n"))).over(run).alias("value"))


def interval_sums(d: DataFrame, c: Config, output: str) -> DataFrame:
    """On a stream: SUMS of every group and interval with samples (histogram_bucket: and bucket), to be written to a table.

    d has samples, or for total and total_prometheus the stored deltas of counter_stream.
    """
    if "delta" in d.columns:
        d = d.withWatermark("ts", c.watermark).select("g", "ts", F.unix_millis("ts").alias("ts_ms"), C("delta").alias("v"))
    else:
        d = _prepared(d.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", c.watermark), c)
        d = _deduplicated_stream(d, c) if c.dedup_ms else d
    what = [bucket_name(C("v")).alias("x"), F.lit(1.0).alias("n")] if output == "histogram_bucket" else [F.lit("").alias("x"), C("v").alias("n")]
    d = (d.where("v >= 0") if output == "histogram_bucket" else d).select("g", "ts", "ts_ms", *what)
    w = d.groupBy("g", "x", F.window("ts", f"{c.interval_ms} milliseconds").alias("w")).agg(F.sum("n").alias("n"), F.max("ts_ms").alias("last"))
    return w.select("g", "x", F.window_time("w").alias("ts"), F.unix_millis("w.end").alias("end_ms"), "n", "last")


def flush_stream(sums: DataFrame, c: Config, output: str) -> DataFrame:
    """On a stream of stored SUMS: the output of every group at the end of every interval until it is stale."""
    share_code(sums.sparkSession)
    i, stale, anew = c.interval_ms, c.staleness_ms, output == "sum_samples"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names, counts, last, done = state.get if state.exists else ([], [], 0, 0)
        # what is held per bucket ("" without buckets): running counts or sums, or nothing between intervals
        held, out = dict(zip(names, counts, strict=True)), []

        def flush(end: int) -> None:
            out.extend((end, x, n) for x, n in held.items())

        rows = []
        if not state.hasTimedOut:
            b = pd.concat(list(batches))
            rows = sorted(zip(b["end_ms"].tolist(), b["x"].tolist(), b["n"].tolist(), b["last"].tolist(), strict=True))
        ends = sorted({r[0] for r in rows})
        for end in ends:
            while done and done + i < end and done + i <= last + stale:
                done += i
                flush(done)
            if done and (last + stale) // i * i + i <= end - i:
                held.clear()
            for _, x, n, t in (r for r in rows if r[0] == end):
                held[x] = held.get(x, 0.0) + n
                last = max(last, t)
            done = end
            flush(end)
            if anew:
                held = dict.fromkeys(held, 0.0)
        now = state.getCurrentWatermarkMs()
        while done + i <= now and done + i <= last + stale:
            done += i
            flush(done)
        if done + i <= now or done + i > last + stale and state.hasTimedOut:
            state.remove()
        else:
            state.update((list(held), list(held.values()), int(last), int(done)))
            state.setTimeoutTimestamp(max(done + i, now + 1))
        if out:
            yield pd.DataFrame({"g": key[0], "end_ms": [x[0] for x in out], "x": [x[1] for x in out], "value": [float(x[2]) for x in out]})

    d = sums.withWatermark("ts", c.watermark).groupBy("g").applyInPandasWithState(step, "g string, end_ms bigint, x string, value double", "names array<string>, counts array<double>, last bigint, done bigint", "append", "EventTimeTimeout")
    return _named(d, c, output)


def counter_stream(samples: DataFrame, c: Config, keep_first: bool = True) -> DataFrame:
    """On a stream: g, sk, ts, delta of every sample, from per-series state that expires with staleness.

    Samples older than the series' last one are skipped, as are those behind the watermark.
    """
    share_code(samples.sparkSession)
    d = _prepared(samples.withColumn("ts", F.timestamp_millis("ts_ms")), c).withWatermark("ts", c.watermark).select("g", "sk", "ts", "ts_ms", "v")
    stale = c.staleness_ms

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_v, last_t = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("ts_ms", kind="stable")
        out = []
        for t, v, ts in zip(rows["ts_ms"], rows["v"], rows["ts"], strict=True):
            if last_t is not None and t < last_t:
                continue
            known = last_t is not None and last_t + stale >= t
            out.append((ts, (v - last_v if v >= last_v else v) if known else (v if keep_first else 0.0)))
            last_v, last_t = v, t
        state.update((float(last_v), int(last_t)))
        state.setTimeoutTimestamp(max(int(last_t) + stale, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"g": key[0], "sk": key[1], "ts": [o[0] for o in out], "delta": [float(o[1]) for o in out]})

    return d.groupBy("g", "sk").applyInPandasWithState(step, "g string, sk string, ts timestamp, delta double", "v double, t bigint", "append", "EventTimeTimeout")


def increase_stream(deltas: DataFrame, c: Config, output: str = "increase") -> DataFrame:
    """On a stream of stored deltas: the increase of every group and interval.

    ``deltas`` reads the table that counter_stream was written to.  Two queries with a table between
    them, because rows that a state emits late would fall behind one query's common watermark.
    """
    d = deltas.withWatermark("ts", c.watermark)
    w = F.window("ts", f"{c.interval_ms} milliseconds")
    g = d.groupBy("g", w.alias("w")).agg(F.sum("delta").alias("value"))
    return _named(g.select("g", F.unix_millis("w.end").alias("end_ms"), "value"), c, output)


def rate_parts(samples: DataFrame, c: Config) -> DataFrame:
    """On a stream: g, sk, ts, rate of every series and interval, from per-series state; to be written to a table.

    A series' rate is what it grew by in the interval over the time since its last sample before
    it, or since its first one in it where that is stale.
    """
    share_code(samples.sparkSession)
    d = _prepared(samples.withColumn("ts", F.timestamp_millis("ts_ms")), c).withWatermark("ts", c.watermark).select("g", "sk", "ts_ms", "end_ms", "v", "ts")
    stale = c.staleness_ms

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        none = -1
        last_v, last_t, end, grown, first, before, before_end = state.get if state.exists else (0.0, none, none, 0.0, none, none, none)
        out = []

        def close() -> None:
            nonlocal end, before, before_end
            base = before if before_end != none and before_end + stale >= end else first
            if last_t > base:
                out.append((end - 1, grown / ((last_t - base) / 1000.0)))
            before, before_end, end = last_t, end, none

        if not state.hasTimedOut:
            b = pd.concat(list(batches)).sort_values(["ts_ms", "v"], kind="stable")
            for t, e, v in zip(b["ts_ms"].tolist(), b["end_ms"].tolist(), b["v"].tolist(), strict=True):
                if last_t != none and t < last_t:
                    continue
                if end != none and e != end:
                    close()
                delta = (v - last_v if v >= last_v else v) if last_t != none and last_t + stale >= t else 0.0
                if end == none:
                    end, grown, first = e, 0.0, t
                grown, last_v, last_t = grown + delta, v, t
        now = state.getCurrentWatermarkMs()
        if end != none and end <= now:
            close()
        if end == none and last_t + stale <= now:
            state.remove()
        else:
            state.update((float(last_v), int(last_t), int(end), float(grown), int(first), int(before), int(before_end)))
            state.setTimeoutTimestamp(max(end if end != none else last_t + stale, now + 1))
        if out:
            yield pd.DataFrame({"g": key[0], "sk": key[1], "ts": pd.to_datetime([x[0] for x in out], unit="ms"), "rate": [x[1] for x in out]})

    return d.groupBy("g", "sk").applyInPandasWithState(step, "g string, sk string, ts timestamp, rate double", "last_v double, last_t bigint, end bigint, grown double, first bigint, before bigint, before_end bigint", "append", "EventTimeTimeout")


def rate_stream(parts: DataFrame, c: Config, output: str = "rate_sum") -> DataFrame:
    """On a stream of stored rates: the sum or the mean of every group and interval."""
    g = parts.withWatermark("ts", c.watermark).groupBy("g", F.window("ts", f"{c.interval_ms} milliseconds").alias("w"))
    value = F.avg("rate") if output == "rate_avg" else F.sum("rate")
    return _named(g.agg(value.alias("value")).select("g", F.unix_millis("w.end").alias("end_ms"), "value"), c, output)
