"""Wire formats as samples (name, labels, ts_ms, value, is_stale).

Text formats are parsed with built-in expressions, line by line; the two protobuf formats are
decoded from whole messages in Arrow batches (see protobuf.py).  Lines that do not parse are left
out; operators.wire_rows keeps them apart with their reasons.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NAME, SAMPLES
from ..operators import wire_rows
from ..operators.relabel import relabel

C = F.col
NONE = "map<string,string>"


def _empty() -> Column:
    return F.create_map().cast(NONE)


def as_samples(d: DataFrame) -> DataFrame:
    """The sample columns in order; missing times and null values are dropped, NaN and stale markers kept (queries skip NaN)."""
    stale = F.coalesce(C("is_stale"), F.lit(False)) if "is_stale" in d.columns else F.lit(False)
    labels = F.map_filter(F.coalesce("labels", _empty()), lambda k, v: (k != "") & F.coalesce(v != "", F.lit(False)))
    d = d.select(F.coalesce("name", F.lit("")).alias("name"), labels.alias("labels"), C("ts_ms").cast("bigint").alias("ts_ms"), C("value").cast("double").alias("value"), stale.alias("is_stale"))
    return d.where("ts_ms is not null and (is_stale or value is not null)")


def number(s: Column) -> Column:
    """A decimal number, or an infinity or NaN by name; null otherwise."""
    low = F.lower(s)
    inf = F.when(low.isin("+inf", "inf", "infinity", "+infinity"), float("inf")).when(low.isin("-inf", "-infinity"), float("-inf")).when(low == "nan", float("nan"))
    return F.coalesce(inf, F.when(s.rlike(wire_rows.NUMBER), s.try_cast("double")))


# Divisors to milliseconds of the precision argument.
PRECISIONS = {"ns": 1e6, "n": 1e6, "u": 1e3, "us": 1e3, "µ": 1e3, "ms": 1.0, "s": 1e-3, "m": 1 / 60_000, "h": 1 / 3_600_000}


def influx(lines: DataFrame, line: str = "value", db: str = "", precision: str = "", now_ms: int = 0, separator: str = "_", extra: dict[str, str] | None = None) -> DataFrame:
    """Line protocol: one sample per field, named measurement_field; strings are skipped."""
    d = lines.select(F.lit(0).alias("line_id"), F.lit("influx").alias("fmt"), C(line).alias("line"))
    rows = wire_rows.loaded_rows(d)
    if precision:
        ts = F.floor(C("ts") / PRECISIONS[precision])
    else:  # by magnitude: nanoseconds, microseconds, milliseconds or seconds
        a = F.abs("ts")
        ts = F.when(a >= 10**17, F.floor(C("ts") / 1e6)).when(a >= 10**14, F.floor(C("ts") / 1e3)).when(a >= 10**11, C("ts")).otherwise(C("ts") * 1000)
    f = rows.select("measurement", "tags", F.coalesce(ts, F.lit(now_ms)).alias("ts_ms"), F.explode("fields").alias("f")).where(C("f.number").isNotNull())
    name = F.when(C("measurement") == "", C("f.key")).otherwise(F.concat("measurement", F.lit(separator), "f.key"))
    tags = C("tags")
    if db:
        tags = F.when(F.map_contains_key("tags", F.lit("db")), C("tags")).otherwise(F.map_concat("tags", F.create_map(F.lit("db"), F.lit(db))))
    return with_extra(as_samples(f.select(name.alias("name"), tags.alias("labels"), "ts_ms", C("f.number").alias("value"))), extra)


_MASK = {"\\\\": "\ufdd5", '\\"': "\ufdd6", "\\n": "\ufdd7"}


def prometheus(lines: DataFrame, line: str = "value", now_ms: int = 0, extra: dict[str, str] | None = None) -> DataFrame:
    """Exposition text: name{labels} value [time in ms]; comments and blank lines are skipped."""
    s = wire_rows.guard(F.trim(C(line)))
    for raw, masked in _MASK.items():
        s = F.replace(s, F.lit(raw), F.lit(masked))
    d = lines.select(s.alias("s")).where((C("s") != "") & ~C("s").startswith("#"))
    # the braces that count are outside quotes: mask the ones inside
    s = wire_rows._mask_quoted(C("s"), "{},= \t", "\ufdd8\ufdd9\ufdda\ufddb\ufddc\ufddd")
    d = d.select(s.alias("s"))
    has = C("s").contains("{")
    head = F.when(has, F.substring_index("s", "{", 1)).otherwise(F.regexp_extract("s", r"^[^ \t]+", 0))
    body = F.when(has, F.regexp_extract("s", r"\{([^}]*)\}", 1)).otherwise("")
    rest = F.trim(F.when(has, F.regexp_extract("s", r"\}(.*)$", 1)).otherwise(F.regexp_extract("s", r"^[^ \t]+(.*)$", 1)))
    rest = F.trim(F.regexp_replace(rest, r" # \ufdd8?.*$", ""))
    words = F.split(rest, r"[ \t]+")
    clean = lambda x: wire_rows.unguard(F.translate(x, "\ufdd5\ufdd6\ufdd7\ufdd8\ufdd9\ufdda\ufddb\ufddc\ufddd", '\\"\n{},= \t'))
    pairs = F.filter(F.split(body, ","), lambda p: F.trim(p) != "")
    entries = F.transform(pairs, lambda p: F.struct(wire_rows.unguard(F.trim(F.substring_index(p, "=", 1))).alias("key"), clean(F.regexp_extract(p, '"([^"]*)"', 1)).alias("value")))
    bad = F.exists(pairs, lambda p: ~p.rlike(r'^\s*[^="]+\s*=\s*"[^"]*"\s*$'))
    ts = F.when(F.size(words) >= 2, F.get(words, F.lit(1)).try_cast("bigint")).otherwise(F.lit(now_ms).cast("bigint"))
    d = d.where(~bad & (F.size(words) <= 2)).select(wire_rows.unguard(F.trim(head)).alias("name"), F.map_from_entries(_last_of(entries)).alias("labels"), ts.alias("ts_ms"), number(F.get(words, F.lit(0))).alias("value"))
    return with_extra(as_samples(d.where("name <> ''")), extra)


def _last_of(entries: Column) -> Column:
    """Of entries with one key the last."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))


def json_lines(lines: DataFrame, line: str = "value", extra: dict[str, str] | None = None) -> DataFrame:
    """{"metric":{...},"values":[...],"timestamps":[...]}; values may be null or named infinities."""
    j = F.from_json(C(line), "metric map<string,string>, values array<string>, timestamps array<bigint>")
    d = lines.select(j.alias("j")).where(C("j.metric").isNotNull() & (F.size("j.values") == F.size("j.timestamps")))
    d = d.select("j.metric", F.explode(F.arrays_zip("j.values", "j.timestamps")).alias("p"))
    return with_extra(as_samples(d.select(F.try_element_at("metric", F.lit(NAME)).alias("name"), F.map_filter("metric", lambda k, _: k != NAME).alias("labels"), C("p.timestamps").alias("ts_ms"), number(C("p.values")).alias("value"))), extra)


def csv(lines: DataFrame, columns: str, line: str = "value", now_ms: int = 0, extra: dict[str, str] | None = None) -> DataFrame:
    """Delimited text by a descriptor ``pos:time:format,pos:label:name,pos:metric:name``, 1-based."""
    specs = [tuple(c.split(":", 2)) for c in columns.split(",")]
    for s in specs:
        if len(s) != 3 or s[1] not in ("time", "label", "metric"):
            raise ValueError(f"bad column {':'.join(s)!r}")
    if not any(s[1] == "metric" for s in specs):
        raise ValueError("no metric column")
    masked = wire_rows._mask_quoted(wire_rows.guard(F.rtrim(C(line))), ",", "\ufdda")
    cells = F.transform(F.split(masked, ",", -1), lambda c: wire_rows.unguard(F.translate(F.replace(F.regexp_replace(c, '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')), "\ufdda", ",")))
    d = lines.select(cells.alias("c"))
    cell = lambda pos: F.get("c", F.lit(int(pos) - 1))
    ts = F.lit(now_ms).cast("bigint")
    for pos, kind, fmt in specs:
        if kind == "time":
            v = cell(pos)
            ts = {"unix_s": (v.try_cast("double") * 1000).cast("bigint"), "unix_ms": v.try_cast("bigint"), "unix_ns": F.floor(v.try_cast("bigint") / 10**6).cast("bigint"), "rfc3339": F.unix_millis(v.try_cast("timestamp"))}.get(fmt)
            if ts is None:
                layout = fmt.partition(":")[2] if fmt.startswith("custom:") else None
                if not layout:
                    raise ValueError(f"bad time format {fmt!r}")
                ts = F.unix_millis(F.try_to_timestamp(v, F.lit(layout)))
    labels = [x for pos, kind, n in specs if kind == "label" for x in (F.lit(n), F.coalesce(cell(pos), F.lit("")))]
    metrics = F.array(*(F.struct(F.lit(n).alias("name"), number(F.trim(cell(pos))).alias("value")) for pos, kind, n in specs if kind == "metric"))
    d = d.select(ts.alias("ts_ms"), (F.create_map(*labels) if labels else _empty()).alias("labels"), F.explode(metrics).alias("m"))
    return with_extra(as_samples(d.select("m.name", "labels", "ts_ms", "m.value")), extra)


def graphite(lines: DataFrame, line: str = "value", now_ms: int = 0, extra: dict[str, str] | None = None) -> DataFrame:
    """path[;key=value...] value [time in seconds]; -1 means now."""
    words = F.split(F.trim(C(line)), r"[ \t]+")
    d = lines.select(words.alias("w")).where(F.size("w").between(2, 3) & (F.get("w", F.lit(0)) != ""))
    path = F.split(F.get("w", F.lit(0)), ";")
    tags = F.transform(F.filter(F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda p: p.contains("=")), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))
    sec = F.get("w", F.lit(2)).try_cast("double")
    ts = F.when(sec.isNull() | (sec == -1), F.lit(now_ms)).otherwise((sec * 1000).cast("bigint"))
    d = d.where((F.size("w") == 2) | sec.isNotNull())
    return with_extra(as_samples(d.select(F.get(path, F.lit(0)).alias("name"), F.map_from_entries(_last_of(tags)).alias("labels"), ts.alias("ts_ms"), number(F.get("w", F.lit(1))).alias("value"))), extra)


def _seconds_or_ms(t: Column) -> Column:
    """Times of 32 bits are seconds, larger ones milliseconds."""
    return F.when(F.abs(t) >= 2**32, t).otherwise(t * 1000).cast("bigint")


def opentsdb(lines: DataFrame, line: str = "value", extra: dict[str, str] | None = None) -> DataFrame:
    """put name time value [key=value...]"""
    words = F.split(F.trim(C(line)), r"[ \t]+")
    d = lines.select(words.alias("w")).where((F.size("w") >= 4) & (F.get("w", F.lit(0)) == "put"))
    pairs = F.slice("w", 5, F.greatest(F.size("w") - 4, F.lit(0)))
    tags = F.transform(F.filter(pairs, lambda p: p.contains("=")), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))
    return with_extra(as_samples(d.where(~F.exists(pairs, lambda p: ~p.contains("="))).select(F.get("w", F.lit(1)).alias("name"), F.map_from_entries(_last_of(tags)).alias("labels"), _seconds_or_ms(F.get("w", F.lit(2)).try_cast("double")).alias("ts_ms"), number(F.get("w", F.lit(3))).alias("value"))), extra)


def opentsdb_json(bodies: DataFrame, body: str = "value", now_ms: int = 0, extra: dict[str, str] | None = None) -> DataFrame:
    """An object or an array of {"metric","timestamp","value","tags"}."""
    text = F.when(F.ltrim(C(body)).startswith("["), C(body)).otherwise(F.concat(F.lit("["), C(body), F.lit("]")))
    rows = F.from_json(text, "array<struct<metric:string,timestamp:double,value:string,tags:map<string,string>>>")
    d = bodies.select(F.explode(rows).alias("r"))
    t = C("r.timestamp")
    ts = F.when(t.isNull() | (t == 0), F.lit(now_ms)).otherwise(_seconds_or_ms(t))
    return with_extra(as_samples(d.where("r.metric is not null").select(C("r.metric").alias("name"), C("r.tags").alias("labels"), ts.alias("ts_ms"), number(C("r.value")).alias("value"))), extra)


def _split_tags(tags: Column) -> Column:
    """key:value tags; a tag without a colon gets the value no_label_value, and the tag host another name."""
    key = lambda t: F.when(F.substring_index(t, ":", 1) == "host", "exported_host").otherwise(F.substring_index(t, ":", 1))
    value = lambda t: F.when(t.contains(":"), F.regexp_replace(t, "^[^:]*:", "")).otherwise("no_label_value")
    return F.map_from_entries(_last_of(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.named_struct(F.lit("key"), key(t), F.lit("value"), value(t)))))


def sanitize(name: Column) -> Column:
    """Characters that a metric name cannot have become underscores, runs of them and those beside dots one."""
    s = F.regexp_replace(name, "[^0-9a-zA-Z.]", "_")
    s = F.regexp_replace(s, "_+", "_")
    return F.regexp_replace(s, r"_?\._?", ".")


def datadog_v1(bodies: DataFrame, body: str = "value", now_ms: int = 0, extra: dict[str, str] | None = None) -> DataFrame:
    schema = "series array<struct<metric:string,host:string,device:string,points:array<array<double>>,tags:array<string>>>"
    d = bodies.select(F.explode(F.from_json(C(body), schema)["series"]).alias("s"))
    fixed = F.map_filter(F.create_map(F.lit("host"), F.coalesce("s.host", F.lit("")), F.lit("device"), F.coalesce("s.device", F.lit(""))), lambda _, v: v != "")
    tags = F.map_filter(_split_tags(C("s.tags")), lambda k, _: k != "device")
    d = d.select(sanitize(C("s.metric")).alias("name"), F.map_concat(fixed, tags).alias("labels"), F.explode("s.points").alias("p"))
    return with_extra(as_samples(d.select("name", "labels", (F.get("p", F.lit(0)) * 1000).cast("bigint").alias("ts_ms"), F.get("p", F.lit(1)).alias("value"))), extra)


def datadog_v2(bodies: DataFrame, body: str = "value", now_ms: int = 0, extra: dict[str, str] | None = None) -> DataFrame:
    schema = "series array<struct<metric:string,points:array<struct<timestamp:bigint,value:double>>,resources:array<struct<name:string,type:string>>,source_type_name:string,tags:array<string>>>"
    d = bodies.select(F.explode(F.from_json(C(body), schema)["series"]).alias("s"))
    res = F.map_from_entries(_last_of(F.transform(F.coalesce("s.resources", F.array().cast("array<struct<name:string,type:string>>")), lambda r: F.named_struct(F.lit("key"), r["type"], F.lit("value"), r["name"]))))
    tags = F.map_filter(_split_tags(C("s.tags")), lambda k, _: ~F.map_contains_key(res, k) & (k != "source_type_name"))
    src = F.map_filter(F.create_map(F.lit("source_type_name"), F.coalesce("s.source_type_name", F.lit(""))), lambda _, v: v != "")
    d = d.select(sanitize(C("s.metric")).alias("name"), F.map_concat(F.map_filter(res, lambda k, _: k != "source_type_name"), src, tags).alias("labels"), F.explode("s.points").alias("p"))
    return with_extra(as_samples(d.select("name", "labels", (C("p.timestamp") * 1000).alias("ts_ms"), "p.value")), extra)


def with_extra(samples: DataFrame, extra: dict[str, str] | None) -> DataFrame:
    """Labels that an import adds to every sample, over those that are there."""
    if not extra:
        return samples
    rest = F.map_filter("labels", lambda k, _: ~k.isin([k2 for k2 in extra if k2 != NAME]))
    add = F.create_map(*(F.lit(x) for k, v in extra.items() if k != NAME and v for x in (k, v))) if any(k != NAME and v for k, v in extra.items()) else _empty()
    d = samples.withColumn("labels", F.map_concat(rest, add))
    return d.withColumn("name", F.lit(extra[NAME])) if extra.get(NAME) else d


def path_labels(path: str) -> dict[str, str]:
    """Labels in a push path /metrics/job/<v>/<label>/<v>, values optionally in base64."""
    parts = path.split("/metrics/", 1)[1].split("/") if "/metrics/" in path else []
    out = {}
    for k, v in zip(parts[::2], parts[1::2], strict=False):
        if k.endswith("@base64"):
            k, v = k[: -len("@base64")], base64.urlsafe_b64decode(v + "=" * (-len(v) % 4)).decode()
        out[k] = v
    return out


def scrape(text: DataFrame, target_labels: dict[str, str], at_ms: int, honor_labels: bool = False, rules: list[dict] | None = None, body: str = "value") -> DataFrame:
    """One scrape of exposition text: metric rules, target labels and the automatic metric ``up``.

    Without honor_labels a label of the sample that a target label would overwrite is kept as exported_<label>.
    """
    d = prometheus(text, body, at_ms)
    if rules:
        d = relabel(d, rules)
    if target_labels:
        names = list(target_labels)
        target = F.create_map(*(F.lit(x) for kv in target_labels.items() for x in kv))
        if honor_labels:
            labels = F.map_concat(F.map_filter(target, lambda k, _: ~F.map_contains_key("labels", k)), C("labels"))
        else:
            labels = F.map_concat(F.transform_keys("labels", lambda k, _: F.when(k.isin(names), F.concat(F.lit("exported_"), k)).otherwise(k)), target)
        d = d.withColumn("labels", labels)
    count = d.agg(F.count(F.lit(1)).cast("double").alias("n"))
    labels = F.create_map(*(F.lit(x) for kv in target_labels.items() for x in kv)) if target_labels else _empty()
    auto = count.select(F.explode(F.array(F.struct(F.lit("up").alias("name"), F.lit(1.0).alias("value")), F.struct(F.lit("scrape_samples_scraped").alias("name"), C("n").alias("value")))).alias("a"))
    return d.unionByName(auto.select("a.name", labels.alias("labels"), F.lit(at_ms).cast("bigint").alias("ts_ms"), "a.value", F.lit(False).alias("is_stale")))


READERS = {"influx": influx, "prometheus": prometheus, "json": json_lines, "csv": csv, "graphite": graphite, "opentsdb": opentsdb, "opentsdb_json": opentsdb_json, "datadog_v1": datadog_v1, "datadog_v2": datadog_v2}
SCHEMA = SAMPLES
