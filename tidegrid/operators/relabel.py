"""Relabeling: rules that rewrite, keep or drop samples by their labels.

A rule is a mapping with the keys of the usual configuration (action, source_labels, separator,
target_label, regex, replacement, modulus, if, match, labels).  Rules become column expressions on
the label map (the metric name under __name__), applied in order; dropping rules become one filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import java_replacement
from ..model import NAME
from ..ql.syntax import Filter, QueryError, Selector, parse
from ..session import share_code

C = F.col
# The actions of relabeling rules.
ACTIONS = frozenset(
    """replace replace_all keep drop keepequal dropequal keep_if_equal drop_if_equal keep_if_contains
    drop_if_contains keep_metrics drop_metrics labelmap labelmap_all labeldrop labelkeep hashmod lowercase uppercase
    graphite""".split()
)
DEFAULT_REGEX = "(.*)"
_DEFAULTS = {"", ".*", "(.*)", "^.*$", "^(.*)$", "(?s:.*)", "(?s)(.*)", "(?s:(.*))"}

# The constants of the 64-bit hash whose value the hashmod action takes.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _list(x) -> list[str]:
    return [] if x is None else [str(i) for i in x] if isinstance(x, (list, tuple)) else [str(x)]


def _get(m: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(name)), F.lit(""))


def _set(m: Column, name: Column | str, value: Column) -> Column:
    key = F.lit(name) if isinstance(name, str) else name
    rest = F.map_filter(m, lambda k, _: k != key)
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(key, value)))


def matches(selector: str | list[str] | Selector, m: Column) -> Column:
    """Whether a map of labels satisfies a selector, or any of several."""
    if isinstance(selector, (list, tuple)):
        out = F.lit(False)
        for s in selector:
            out = out | matches(s, m)
        return out
    sel = parse(selector) if isinstance(selector, str) else selector
    if not isinstance(sel, Selector):
        raise QueryError(f"a selector is wanted, not {selector!r}")

    def one(f: Filter) -> Column:
        v = _get(m, f.label)
        hit = v == f.value if f.op in ("=", "!=") else v.rlike(_anchored(f.value))
        return ~hit if f.op in ("!=", "!~") else hit

    out = F.lit(False)
    for g in sel.groups:
        c = F.lit(True)
        for f in g:
            c = c & one(f)
        out = out | c
    return out


def _anchored(regex: str) -> str:
    return f"^(?s:(?:{regex}))\\z"


def validate(rule: dict) -> dict:
    """The rule with its defaults; an error for what cannot be meant."""
    r = dict(rule)
    action = str(r.get("action", "replace")).lower()
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    known = {"action", "source_labels", "separator", "target_label", "regex", "replacement", "modulus", "if", "match", "labels"}
    if set(r) - known:
        raise ValueError(f"unknown keys {sorted(set(r) - known)}")
    source, regex = _list(r.get("source_labels")), r.get("regex")
    if isinstance(regex, (list, tuple)):
        regex = "|".join(str(x) for x in regex)
    target = r.get("target_label") or ""
    wants_target = {"replace_all", "hashmod", "lowercase", "uppercase", "keepequal", "dropequal", "keep_if_contains", "drop_if_contains"}
    if action in wants_target and not target or action == "replace" and not target:
        raise ValueError(f"{action} wants target_label")
    if action in {"replace_all", "hashmod", "lowercase", "uppercase", "keep_if_equal", "drop_if_equal", "keepequal", "dropequal", "keep_if_contains", "drop_if_contains"} and not source:
        raise ValueError(f"{action} wants source_labels")
    if action in {"keep", "drop"} and not source and "if" not in r:
        raise ValueError(f"{action} wants source_labels or if")
    if action in {"keep_metrics", "drop_metrics"} and (not regex and "if" not in r or source):
        raise ValueError(f"{action} wants a regex and no source_labels")
    if action == "hashmod" and int(r.get("modulus", 0)) < 1:
        raise ValueError("hashmod wants a modulus")
    if action == "graphite" and not (r.get("match") and r.get("labels")):
        raise ValueError("graphite wants match and labels")
    pattern = DEFAULT_REGEX if regex is None or str(regex) in _DEFAULTS else str(regex)
    return {"action": action, "source": source, "separator": r.get("separator", ";"), "target": target, "regex": pattern, "replacement": str(r.get("replacement", "$1")), "modulus": int(r.get("modulus", 0)), "if": r.get("if"), "match": r.get("match"), "labels": r.get("labels") or {}}


def _xxh64(data: bytes) -> int:
    """The 64-bit xxHash of data with seed 0, as its public specification has it."""
    m64 = (1 << 64) - 1
    rot = lambda x, r: (x << r | x >> (64 - r)) & m64
    word = lambda i, n: int.from_bytes(data[i : i + n], "little")
    mix = lambda acc, w: rot((acc + w * P2) & m64, 31) * P1 & m64
    n, i = len(data), 0
    if n >= 32:
        lanes = [(P1 + P2) & m64, P2, 0, -P1 & m64]
        while i + 32 <= n:
            lanes = [mix(a, word(i + 8 * j, 8)) for j, a in enumerate(lanes)]
            i += 32
        h = sum(rot(a, r) for a, r in zip(lanes, (1, 7, 12, 18), strict=True)) & m64
        for a in lanes:
            h = ((h ^ mix(0, a)) * P1 + P4) & m64
    else:
        h = P5
    h = (h + n) & m64
    while i + 8 <= n:
        h, i = (rot(h ^ mix(0, word(i, 8)), 27) * P1 + P4) & m64, i + 8
    if i + 4 <= n:
        h, i = (rot(h ^ word(i, 4) * P1 & m64, 23) * P2 + P3) & m64, i + 4
    for b in data[i:]:
        h = rot(h ^ b * P5 & m64, 11) * P1 & m64
    h = (h ^ h >> 33) * P2 & m64
    h = (h ^ h >> 29) * P3 & m64
    return h ^ h >> 32


def hash_mod(value: Column, modulus: int) -> Column:
    """The hash of a string modulo a number, as text; vectorised over Arrow batches, distinct strings once."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            import xxhash

            digest = lambda s: xxhash.xxh64_intdigest(s.encode(), 0)
        except ImportError:
            digest = lambda s: _xxh64(s.encode())
        for s in batches:
            codes, uniq = pd.factorize(s)
            out = np.array([str(digest(u) % modulus) for u in uniq] or [""], dtype=object)
            yield pd.Series(out[codes])

    return run(value)


def graphite_regex(template: str) -> str:
    """A template such as a.*.b as a pattern: a star is one part without dots."""
    return "^" + "([^.]*)".join(re.escape(p) for p in template.split("*")) + r"\z"


def apply_rule(m: Column, rule: dict) -> tuple[Column, Column | None]:
    """The new map and, for rules that drop, the condition to keep a sample."""
    action = rule["action"]
    cond = matches(rule["if"], m) if rule["if"] else None
    joined = F.concat_ws(rule["separator"], *(_get(m, s) for s in rule["source"])) if rule["source"] else F.lit("")
    hit = joined.rlike(_anchored(rule["regex"]))
    keep: Column | None = None
    out = m
    match action:
        case "replace":
            text = rule["replacement"]
            parts = re.split(r"\{\{([^}]*)\}\}", text)
            if len(parts) > 1:
                # labels are spliced in first; what they say can refer to groups as well
                value = F.lit("")
                for i, p in enumerate(parts):
                    value = F.concat(value, _get(m, p) if i % 2 else F.lit(p))
                groups = len(re.compile(rule["regex"]).groupindex) or re.compile(rule["regex"]).groups
                for g in range(groups + 1):
                    got = F.regexp_extract(joined, _anchored(rule["regex"]), g)
                    value = F.replace(F.replace(value, F.lit("${" + str(g) + "}"), got), F.lit(f"${g}"), got)
            else:
                value = F.regexp_replace(joined, _anchored(rule["regex"]), java_replacement(text))
            target: Column | str = rule["target"]
            if "$" in rule["target"]:
                target = F.regexp_replace(joined, _anchored(rule["regex"]), java_replacement(rule["target"]))
            out = F.when(hit, _set(m, target, value)).otherwise(m)
        case "replace_all":
            value = F.regexp_replace(joined, rule["regex"], java_replacement(rule["replacement"]))
            out = F.when(value != joined, _set(m, rule["target"], value)).otherwise(m)
        case "keep" | "drop":
            keep = hit if action == "keep" else ~hit
        case "keepequal" | "dropequal":
            same = joined == _get(m, rule["target"])
            keep = same if action == "keepequal" else ~same
        case "keep_if_equal" | "drop_if_equal":
            same = F.lit(True)
            for s in rule["source"][1:]:
                same = same & (_get(m, s) == _get(m, rule["source"][0]))
            keep = same if action == "keep_if_equal" else ~same
        case "keep_if_contains" | "drop_if_contains":
            all_in = F.lit(True)
            for s in rule["source"]:
                all_in = all_in & F.contains(_get(m, rule["target"]), _get(m, s))
            keep = all_in if action == "keep_if_contains" else ~all_in
        case "keep_metrics" | "drop_metrics":
            named = _get(m, NAME).rlike(_anchored(rule["regex"]))
            keep = named if action == "keep_metrics" else ~named
        case "labeldrop":
            out = F.map_filter(m, lambda k, _: ~k.rlike(_anchored(rule["regex"])))
        case "labelkeep":
            out = F.map_filter(m, lambda k, _: k.rlike(_anchored(rule["regex"])))
        case "labelmap":
            new = lambda k: F.regexp_replace(k, _anchored(rule["regex"]), java_replacement(rule["replacement"]))
            copies = F.transform(F.filter(F.map_entries(m), lambda e: e["key"].rlike(_anchored(rule["regex"])) & (new(e["key"]) != e["key"])), lambda e: F.struct(new(e["key"]).alias("key"), e["value"].alias("value")))
            out = _merge(m, copies)
        case "labelmap_all":
            renamed = F.transform(F.map_entries(m), lambda e: F.struct(F.regexp_replace(e["key"], rule["regex"], java_replacement(rule["replacement"])).alias("key"), e["value"].alias("value")))
            out = _merge(F.map_filter(m, lambda k, _: F.lit(False)), renamed)
        case "hashmod":
            out = _set(m, rule["target"], hash_mod(joined, rule["modulus"]))
        case "lowercase" | "uppercase":
            out = _set(m, rule["target"], F.lower(joined) if action == "lowercase" else F.upper(joined))
        case "graphite":
            pattern = graphite_regex(rule["match"])
            stars = rule["match"].count("*")
            new = m
            for name, template in rule["labels"].items():
                value = F.lit("")
                for i, p in enumerate(re.split(r"\$\{?(\d+)\}?", str(template))):
                    value = F.concat(value, (F.regexp_extract(_get(m, NAME), pattern, int(p)) if int(p) <= stars else F.lit("")) if i % 2 else F.lit(p))
                new = _set(new, name, value)
            out = F.when(_get(m, NAME).rlike(pattern), new).otherwise(m)
    if cond is not None:
        if keep is not None:
            keep = (cond & keep) if action == "keep" else (~cond | keep)
        else:
            out = F.when(cond, out).otherwise(m)
    return out, keep


def _merge(m: Column, entries: Column) -> Column:
    """m with entries set; of equal names the last one stays."""
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    rest = F.map_filter(m, lambda k, _: ~F.exists(entries, lambda e: e["key"] == k))
    return F.map_concat(rest, F.map_from_entries(last))


def relabel(samples: DataFrame, rules: list[dict]) -> DataFrame:
    """Samples after the rules; other columns than name and labels pass through."""
    share_code(samples.sparkSession)
    checked = [validate(r) for r in rules]
    labels = F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, v: (k != NAME) & F.coalesce(v != "", F.lit(False)))
    d = samples.withColumn("_m", F.when(F.coalesce("name", F.lit("")) == "", labels).otherwise(F.map_concat(F.create_map(F.lit(NAME), C("name")), labels)))
    for r in checked:
        out, keep = apply_rule(C("_m"), r)
        if keep is not None:
            d = d.where(F.coalesce(keep, F.lit(False)))
        else:
            d = d.withColumn("_m", out)
    clean = F.map_filter("_m", lambda k, v: (k != NAME) & (v != ""))
    return d.withColumn("name", _get(C("_m"), NAME)).withColumn("labels", clean).drop("_m")
