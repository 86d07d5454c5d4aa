"""Recording and alerting rules over a range of evaluation times.

A rule is evaluated at every tick as one range query, not one query per tick; alert states follow
from gaps and islands of ticks per alert, with window functions.
"""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, field
from urllib.parse import quote, quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..engine import MetricsEngine
from ..model import NAME, SAMPLES, key_of
from ..ql.syntax import duration_ms, parse
from ..session import share_code

C = F.col


@dataclass
class Rule:
    expr: str
    record: str = ""
    alert: str = ""
    for_: str = "0s"
    keep_firing_for: str = "0s"
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if bool(self.record) == bool(self.alert):
            raise ValueError("a rule has either record or alert")
        parse(self.expr)


@dataclass
class Group:
    name: str
    rules: list[Rule]
    interval: str = "1m"
    limit: int = 0
    eval_offset: str = ""
    eval_delay: str = "0s"
    labels: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a group wants a name")
        if duration_ms(self.interval, 0) <= 0:
            raise ValueError("interval must be positive")
        if self.eval_offset and duration_ms(self.eval_offset, 0) >= duration_ms(self.interval, 0):
            raise ValueError("eval_offset must be below interval")


def load_groups(config: dict) -> list[Group]:
    """Groups from a parsed rule file; unknown keys are errors."""
    out = []
    for g in config.get("groups", []):
        unknown = set(g) - {"name", "rules", "interval", "limit", "eval_offset", "eval_delay", "labels", "concurrency"}
        if unknown:
            raise ValueError(f"unknown keys {sorted(unknown)}")
        rules = []
        for r in g.get("rules", []):
            unknown = set(r) - {"record", "alert", "expr", "for", "keep_firing_for", "labels", "annotations", "debug", "update_entries_limit"}
            if unknown:
                raise ValueError(f"unknown keys {sorted(unknown)}")
            rules.append(Rule(str(r["expr"]), r.get("record", ""), r.get("alert", ""), str(r.get("for", "0s")), str(r.get("keep_firing_for", "0s")), r.get("labels") or {}, r.get("annotations") or {}))
        out.append(Group(g.get("name", ""), rules, str(g.get("interval", "1m")), int(g.get("limit", 0)), str(g.get("eval_offset", "")), str(g.get("eval_delay", "0s")), g.get("labels") or {}))
    if len({g.name for g in out}) != len(out):
        raise ValueError("group names must differ")
    return out


def eval_time(group: Group, tick_ms: int) -> int:
    """The time a tick evaluates at: as it is with an offset, else delayed and cut to the interval."""
    if group.eval_offset:
        return tick_ms
    step = duration_ms(group.interval, 0)
    t = tick_ms - duration_ms(group.eval_delay, 0)
    return t - t % step


def overlay(labels: Column, extra: dict[str, str]) -> Column:
    """Rule labels over those of the result; a label in the way is kept as exported_<label>; empty ones delete."""
    if not extra:
        return labels
    put = {k: v for k, v in extra.items() if v != ""}
    gone = [k for k, v in extra.items() if v == ""]
    names = list(put)
    moved = F.transform_keys(F.map_filter(labels, lambda k, _: ~k.isin(gone) if gone else F.lit(True)), lambda k, v: F.when(k.isin(names) & (v != F.coalesce(_lookup(put, k), F.lit(""))), F.concat(F.lit("exported_"), k)).otherwise(k))
    rest = F.map_filter(moved, lambda k, _: ~k.isin(names))
    return F.map_concat(rest, F.create_map(*(F.lit(x) for kv in put.items() for x in kv))) if put else moved


def _lookup(d: dict[str, str], k: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, v in d.items():
        out = F.when(k == name, F.lit(v)).otherwise(out)
    return out


def _ticks(engine: MetricsEngine, group: Group, rule: Rule, start: int, end: int) -> DataFrame:
    step = duration_ms(group.interval, 0)
    first = eval_time(group, start + step - 1 if not group.eval_offset else start)
    d = engine.query_range(rule.expr, first / 1000, end / 1000, step)
    if group.limit:
        n = d.groupBy("ts_ms").agg(F.count(F.lit(1)).alias("_n"))
        over = F.raise_error(F.lit(f"a rule of {group.name} gives more than {group.limit} series")).cast("double")
        d = d.join(n, "ts_ms").withColumn("value", F.when(C("_n") > group.limit, over).otherwise(C("value"))).drop("_n")
    return d


def record(engine: MetricsEngine, group: Group, rule: Rule, start_ms: int, end_ms: int) -> DataFrame:
    """Samples of a recording rule at every tick."""
    d = _ticks(engine, group, rule, start_ms, end_ms)
    return d.select(F.lit(rule.record).alias("name"), overlay(C("labels"), group.labels | rule.labels).alias("labels"), "ts_ms", "value", F.lit(False).alias("is_stale"))


def active_before(samples: DataFrame, rule: Rule, start_ms: int, lookback_ms: int = 3_600_000) -> DataFrame:
    """id and active_at of a rule's alerts by the last ALERTS_FOR_STATE samples stored up to a second before start.

    A series that ended with a stale sample is not restored.
    """
    until = start_ms - 1000
    d = samples.where((C("name") == "ALERTS_FOR_STATE") & (C("labels")["alertname"] == rule.alert) & (C("ts_ms") > until - lookback_ms) & (C("ts_ms") <= until))
    last = d.groupBy(key_of(C("labels")).alias("id")).agg(F.max_by(F.struct("value", "is_stale"), "ts_ms").alias("s"))
    return last.where(~F.coalesce("s.is_stale", F.lit(False)) & C("s.value").isNotNull()).select("id", (F.floor("s.value") * 1000).alias("active_at"))


def alert_states(engine: MetricsEngine, group: Group, rule: Rule, start_ms: int, end_ms: int, restored: DataFrame | None = None) -> DataFrame:
    """labels, ts_ms, value, active_at, state (pending or firing) of every alert at every tick it exists.

    An alert is pending from its first tick and fires once it has lasted ``for``; a firing alert whose
    expression has no value any more stays so for ``keep_firing_for`` after its last value.  With
    ``restored`` (see active_before) an alert of the first tick has been active since the time there.
    """
    step = duration_ms(group.interval, 0)
    wait, hold = duration_ms(rule.for_, 0), duration_ms(rule.keep_firing_for, 0)
    d = _ticks(engine, group, rule, start_ms, end_ms)
    named = overlay(C("labels"), group.labels | rule.labels | {"alertname": rule.alert})
    d = d.select(named.alias("labels"), "ts_ms", "value").withColumn("id", key_of(C("labels")))
    w = Window.partitionBy("id").orderBy("ts_ms")
    gap = C("ts_ms") - F.lag("ts_ms").over(w)
    # first islands without holding, to know where an alert fired; then a held alert bridges the gap after it
    d = d.withColumn("_gap", gap).withColumn("_new", F.when(C("_gap").isNull() | (C("_gap") > step), 1).otherwise(0))
    d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("id", "_island")
    d = d.withColumn("_from", F.min("ts_ms").over(island)).withColumn("_to", F.max("ts_ms").over(island))
    if restored is not None:
        first = eval_time(group, start_ms + step - 1 if not group.eval_offset else start_ms)
        d = d.join(restored.select("id", C("active_at").alias("_since")), "id", "left")
        d = d.withColumn("_from", F.when(C("_from") == first, F.coalesce("_since", "_from")).otherwise(C("_from"))).drop("_since")
    if hold:
        islands = d.select("id", "_island", "_from", "_to").distinct()
        wi = Window.partitionBy("id").orderBy("_island")
        fired = C("_to") - C("_from") >= wait
        islands = islands.withColumn("_fired", fired)
        joins = F.coalesce(F.lag("_fired").over(wi) & (C("_from") - F.lag("_to").over(wi) - step <= hold), F.lit(False))
        islands = islands.withColumn("_run", F.sum(F.when(joins, 0).otherwise(1)).over(wi.rowsBetween(Window.unboundedPreceding, 0)))
        run = Window.partitionBy("id", "_run")
        islands = islands.withColumn("_start", F.min("_from").over(run)).withColumn("_next", F.lead("_from").over(wi))
        d = d.join(islands.select("id", "_island", "_start", "_next", "_fired"), ["id", "_island"])
        # ticks at which a fired alert is held without a value
        last = d.where((C("ts_ms") == C("_to")) & (C("_to") - C("_start") >= wait))
        until = F.least(C("_to") + hold, F.coalesce(C("_next") - step, F.lit(end_ms)), F.lit(end_ms))
        held = last.where(until >= C("_to") + step).withColumn("ts_ms", F.explode(F.sequence(C("_to") + step, until, F.lit(step).cast("bigint"))))
        d = d.unionByName(held)
        start = C("_start")
    else:
        start = C("_from")
    return d.select("labels", "ts_ms", "value", start.alias("active_at"), F.when(C("ts_ms") - start >= wait, "firing").otherwise("pending").alias("state"))


def alert_samples(states: DataFrame, step_ms: int) -> DataFrame:
    """The series ALERTS{alertstate} and ALERTS_FOR_STATE, with a stale sample where one ends."""
    base = C("labels")
    with_state = F.map_concat(F.map_filter(base, lambda k, _: k != "alertstate"), F.create_map(F.lit("alertstate"), C("state")))
    a = states.select(F.lit("ALERTS").alias("name"), with_state.alias("labels"), "ts_ms", F.lit(1.0).alias("value"))
    f = states.select(F.lit("ALERTS_FOR_STATE").alias("name"), base.alias("labels"), "ts_ms", (C("active_at") / 1000.0).alias("value"))
    d = a.unionByName(f).withColumn("is_stale", F.lit(False))
    sk = key_of(F.map_concat(F.create_map(F.lit(NAME), C("name")), C("labels")))
    nxt = F.lead("ts_ms").over(Window.partitionBy("_k").orderBy("ts_ms"))
    ends = d.withColumn("_k", sk).withColumn("_next", nxt).where(C("_next").isNull() | (C("_next") > C("ts_ms") + step_ms))
    stale = ends.select("name", "labels", (C("ts_ms") + step_ms).alias("ts_ms"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("is_stale"))
    return d.unionByName(stale)


def annotated(states: DataFrame, rule: Rule) -> DataFrame:
    """The alerts of alert_states with their annotations, a map of rendered templates; few rows, as alerts are."""
    share_code(states.sparkSession)
    templates, expr = dict(rule.annotations), rule.expr

    @F.pandas_udf("map<string,string>")
    def render_all(labels: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([{k: render(t, dict(m), float(v), expr) for k, t in templates.items()} for m, v in zip(labels, value, strict=True)])

    return states.withColumn("annotations", render_all("labels", "value") if templates else F.create_map().cast("map<string,string>"))


def notifications(alerts: DataFrame, step_ms: int, generator_url: str = "") -> DataFrame:
    """ts_ms and payload: the JSON array that a notifier gets at every tick, of alerts with annotations.

    Firing alerts have no endsAt; an alert that fired has one more entry, with endsAt, at the tick after its last.
    """
    rfc = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    firing = alerts.where("state = 'firing'").withColumn("_id", key_of(C("labels")))
    nxt = F.lead("ts_ms").over(Window.partitionBy("_id", "active_at").orderBy("ts_ms"))
    ended = firing.withColumn("_next", nxt).where("_next is null").select(*firing.columns, (C("ts_ms") + step_ms).alias("_end"))
    rows = firing.withColumn("_end", F.lit(None).cast("bigint")).unionByName(ended.withColumn("ts_ms", C("_end")))
    entry = F.to_json(F.struct("labels", "annotations", rfc(C("active_at")).alias("startsAt"), F.lit(generator_url).alias("generatorURL"), rfc(C("_end")).alias("endsAt")))
    g = rows.select("ts_ms", F.struct("_id", entry.alias("j")).alias("e")).groupBy("ts_ms").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return g.select("ts_ms", F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["j"]), ","), F.lit("]")).alias("payload"))


# annotation templates: the part of the usual language that reads labels and formats values
def humanize(v: float) -> str:
    """A number with a metric prefix, in four digits."""
    import math

    if v == 0 or math.isnan(v) or math.isinf(v):
        return f"{v:.4g}"
    up, down = "kMGTPEZY", "munpfazy"
    p, a = "", abs(v)
    if a >= 1:
        for x in up:
            if a < 1000:
                break
            p, a, v = x, a / 1000, v / 1000
    else:
        for x in down:
            if a >= 1:
                break
            p, a, v = x, a * 1000, v * 1000
    return f"{v:.4g}{p}"


def humanize1024(v: float) -> str:
    p = ""
    for x in ("ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"):
        if abs(v) < 1024:
            break
        p, v = x, v / 1024
    return f"{v:.4g}{p}"


def humanize_duration(v: float) -> str:
    if abs(v) < 1:
        return humanize(v) + "s"
    sign, s = ("-" if v < 0 else ""), abs(v)
    d, h, m = int(s // 86400), int(s % 86400 // 3600), int(s % 3600 // 60)
    parts = [f"{d}d"] * bool(d) + [f"{h}h"] * bool(d or h) + [f"{m}m"] * bool(d or h or m) + [f"{int(s % 60)}s" if d or h or m else f"{s % 60:.4g}s"]
    return sign + " ".join(parts)


def humanize_percentage(v: float) -> str:
    return f"{v * 100:.4g}%"


FUNCTIONS = {
    "humanize": humanize,
    "humanize1024": humanize1024,
    "humanizeDuration": humanize_duration,
    "humanizePercentage": humanize_percentage,
    "toUpper": lambda s: str(s).upper(),
    "toLower": lambda s: str(s).lower(),
    "title": lambda s: str(s).title(),
    "stripPort": lambda s: re.sub(r":\d+$", "", str(s)),
    "stripDomain": lambda s: str(s) if re.fullmatch(r"[\d.]+(:\d+)?", str(s)) else re.sub(r"\.[^:]*", "", str(s)),
    "pathEscape": lambda s: quote(str(s), safe=""),
    "queryEscape": lambda s: quote_plus(str(s)),
    "jsonEscape": lambda s: json.dumps(str(s), ensure_ascii=False),
    "htmlEscape": lambda s: html.escape(str(s)),
    "trimSpace": lambda s: str(s).strip(),
    "len": lambda s: len(s),
    "quotesEscape": lambda s: str(s).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n"),
}


def render(template: str, labels: dict[str, str], value: float, expr: str = "") -> str:
    """An annotation: {{ $labels.x }}, {{ $value }}, {{ $expr }}, printf and functions joined by pipes."""

    def atom(text: str):
        text = text.strip()
        if m := re.fullmatch(r'\$labels\.(\w+)|index \$labels "([^"]*)"|\.Labels\.(\w+)', text):
            return labels.get(m[1] or m[2] or m[3], "")
        if text in ("$value", ".Value"):
            return value
        if text in ("$expr", ".Expr"):
            return expr
        if m := re.fullmatch(r'printf "([^"]*)" (.*)', text):
            return m[1].replace("%v", "%s") % (atom(m[2]),)
        if m := re.fullmatch(r'"([^"]*)"', text):
            return m[1]
        if m := re.fullmatch(r"(\w+) (.*)", text):
            if m[1] in FUNCTIONS:
                return FUNCTIONS[m[1]](atom(m[2]))
        raise ValueError(f"cannot render {text!r}")

    def one(m: re.Match) -> str:
        head, *pipes = m[1].split("|")
        v = atom(head)
        for p in pipes:
            p = p.strip()
            if q := re.fullmatch(r'printf "([^"]*)"', p):
                v = q[1].replace("%v", "%s") % (v,)
            elif p in FUNCTIONS:
                v = FUNCTIONS[p](v)
            else:
                raise ValueError(f"unknown function {p!r}")
        return f"{v:g}" if isinstance(v, float) else str(v)

    return re.sub(r"\{\{-?(.*?)-?\}\}", one, template)


# input series of rule unit tests
def series_values(text: str) -> list[float | str | None]:
    """Values of a series: numbers, _ for gaps, stale, a+bxN and a-bxN (N + 1 points), axN, _xN."""
    out: list[float | str | None] = []
    for word in text.split():
        if m := re.fullmatch(r"_(?:x(\d+))?", word):
            out += [None] * int(m[1] or 1)
        elif word == "stale":
            out.append("stale")
        elif m := re.fullmatch(r"([+-]?[\d.]+(?:e[+-]?\d+)?)([+-][\d.]+(?:e[+-]?\d+)?)?x(\d+)", word, re.I):
            a, b = float(m[1]), float(m[2] or 0)
            out += [a + b * i for i in range(int(m[3]) + 1)]
        else:
            out.append(float(word))
    return out


def input_samples(spark, series: list[dict], interval_ms: int, start_ms: int = 0) -> DataFrame:
    """Samples of the input series of a unit test: point i at start + i * interval."""
    rows = []
    for s in series:
        sel = parse(s["series"])
        labels = {f.label: f.value for f in sel.groups[0]}
        name = labels.pop(NAME, "")
        for i, v in enumerate(series_values(str(s["values"]))):
            if v is not None:
                rows.append((name, labels, start_ms + i * interval_ms, None if v == "stale" else float(v), v == "stale"))
    return spark.createDataFrame(rows, SAMPLES)
