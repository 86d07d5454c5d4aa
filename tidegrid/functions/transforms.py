"""Functions of the points of a vector: numbers, times, labels, whole ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..model import NAME, Grid, drop_labels, keep_labels, label, missing_if_nan, with_labels

C = F.col


def _whole(f, v: Column) -> Column:
    """ceil or floor as a double, leaving numbers too large for a bigint alone."""
    return F.when(F.abs(v) < 2.0**62, f(v).cast("double")).otherwise(v)


def _log(f, v: Column) -> Column:
    return F.when(v == 0, float("-inf")).when(v > 0, f(v))


def _clock(unit: str, v: Column) -> Column:
    t = F.timestamp_seconds(F.floor(v))
    return {
        "minute": F.minute(t),
        "hour": F.hour(t),
        "day_of_month": F.dayofmonth(t),
        "day_of_week": F.dayofweek(t) - 1,
        "day_of_year": F.dayofyear(t),
        "days_in_month": F.dayofmonth(F.last_day(t)),
        "month": F.month(t),
        "year": F.year(t),
    }[unit].cast("double")


CLOCKS = ("minute", "hour", "day_of_month", "day_of_week", "day_of_year", "days_in_month", "month", "year")

# Functions of one number.
NUMERIC: dict[str, object] = {
    "abs": lambda v: F.abs(v),
    "ceil": lambda v: _whole(F.ceil, v),
    "floor": lambda v: _whole(F.floor, v),
    "exp": lambda v: F.exp(v),
    "ln": lambda v: _log(F.ln, v),
    "log2": lambda v: _log(F.log2, v),
    "log10": lambda v: _log(F.log10, v),
    "sqrt": lambda v: F.when(v >= 0, F.sqrt(v)),
    "sgn": lambda v: F.coalesce(F.signum(v), F.lit(0.0)),
    "acos": lambda v: F.acos(v),
    "acosh": lambda v: F.acosh(v),
    "asin": lambda v: F.asin(v),
    "asinh": lambda v: F.asinh(v),
    "atan": lambda v: F.atan(v),
    "atanh": lambda v: F.atanh(v),
    "cos": lambda v: F.cos(v),
    "cosh": lambda v: F.cosh(v),
    "sin": lambda v: F.sin(v),
    "sinh": lambda v: F.sinh(v),
    "tan": lambda v: F.tan(v),
    "tanh": lambda v: F.tanh(v),
    "deg": lambda v: F.degrees(v),
    "rad": lambda v: F.radians(v),
} | {u: (lambda v, u=u: _clock(u, v)) for u in CLOCKS}


def round_to(v: Column, nearest: Column) -> Column:
    """Half away from zero, to a multiple of nearest, cut to nearest's decimal places."""
    up = v + F.when(v < 0, -F.abs(nearest)).otherwise(F.abs(nearest)) / 2
    return missing_if_nan(up - up % F.when(nearest != 0, nearest))


def decimal_scale(nearest: float) -> float:
    """The power of ten that makes nearest a whole number."""
    for e in range(0, 18):
        if nearest * 10**e == math.floor(nearest * 10**e):
            return float(10**e)
    return 1.0


def clamp(v: Column, low: Column | None, high: Column | None) -> Column:
    if high is not None:
        v = F.when(v > high, high).otherwise(v)
    if low is not None:
        v = F.when(v < low, low).otherwise(v)
    return v


def _series() -> object:
    return Window.partitionBy("sk")


def _range_quantile(phi: float) -> Column:
    return F.percentile("v", F.lit(float(phi))).over(_series())


def _trend() -> Column:
    return F.regr_slope("v", C("k").cast("double")).over(_series()) * C("k") + F.regr_intercept("v", C("k").cast("double")).over(_series())


# Functions of a series' points over the whole range, on dense vectors.
RANGE: dict[str, object] = {
    "range_avg": lambda: F.avg("v").over(_series()),
    "range_min": lambda: F.min("v").over(_series()),
    "range_max": lambda: F.max("v").over(_series()),
    "range_sum": lambda: F.sum("v").over(_series()),
    "range_stddev": lambda: F.stddev_pop("v").over(_series()),
    "range_stdvar": lambda: F.var_pop("v").over(_series()),
    "range_first": lambda: F.first("v", True).over(_series().orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    "range_last": lambda: F.last("v", True).over(_series().orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    "range_linear_regression": _trend,
    "range_mad": lambda: F.percentile("_dev", F.lit(0.5)).over(_series()),
    "range_zscore": lambda: F.when(F.stddev_pop("v").over(_series()) != 0, (C("v") - F.avg("v").over(_series())) / F.stddev_pop("v").over(_series())).otherwise(0.0),
    "range_normalize": lambda: F.when(F.max("v").over(_series()) > F.min("v").over(_series()), (C("v") - F.min("v").over(_series())) / (F.max("v").over(_series()) - F.min("v").over(_series()))),
    "running_avg": lambda: F.avg("v").over(_run()),
    "running_min": lambda: F.min("v").over(_run()),
    "running_max": lambda: F.max("v").over(_run()),
    "running_sum": lambda: F.sum("v").over(_run()),
    "keep_last_value": lambda: F.last("v", True).over(_run()),
    "keep_next_value": lambda: F.first("v", True).over(_series().orderBy("k").rowsBetween(0, Window.unboundedFollowing)),
    "interpolate": lambda: _interpolate(),
    "remove_resets": lambda: C("v") + F.sum("_drop").over(_run()),
}


def _run() -> object:
    return _series().orderBy("k").rowsBetween(Window.unboundedPreceding, 0)


def _interpolate() -> Column:
    at = F.when(C("v").isNotNull(), F.struct("k", "v"))
    ahead = _series().orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    a, b = F.last(at, True).over(_run()), F.first(at, True).over(ahead)
    return F.coalesce(C("v"), a["v"] + (b["v"] - a["v"]) * (C("k") - a["k"]) / F.nullif(b["k"] - a["k"], F.lit(0)))


def java_replacement(text: str) -> str:
    """$1 and ${1} of the query language as the regex engine writes them; a backslash is itself."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            out.append("\\\\")
        elif c == "$" and text[i + 1 : i + 2] == "{" and "}" in text[i:]:
            j = text.index("}", i)
            ref = text[i + 2 : j]
            out.append("$" + ref if ref.isdigit() else "${" + ref + "}")
            i = j
        elif c == "$" and not text[i + 1 : i + 2].isdigit():
            out.append("\\$" if text[i + 1 : i + 2] != "$" else "\\$")
            i += text[i + 1 : i + 2] == "$"
        else:
            out.append(c)
        i += 1
    return "".join(out)


def anchored(pattern: str) -> str:
    return f"^(?s:(?:{pattern}))\\z"


def label_function(name: str, sk: Column, args: list[str]) -> Column | None:
    """The new key, or for matching functions a condition; None if name isn't a label function."""
    get = lambda n: label(sk, n)
    pairs = list(zip(args[::2], args[1::2], strict=False))
    match name:
        case "label_set":
            return with_labels(sk, {k: F.lit(v) for k, v in pairs})
        case "label_del":
            return drop_labels(sk, args)
        case "label_keep":
            return keep_labels(sk, args)
        case "label_copy" | "label_move":
            for src, dst in pairs:
                moved = {dst: get(src)} | ({src: F.lit("")} if name == "label_move" else {})
                sk = F.when(label(sk, src) != "", with_labels(sk, {k: (label(sk, src) if k == dst else F.lit("")) for k in moved})).otherwise(sk)
            return sk
        case "label_join":
            return with_labels(sk, {args[0]: F.concat_ws(args[1], *(get(a) for a in args[2:]))})
        case "label_replace":
            dst, replacement, src, pattern = args
            hit = get(src).rlike(anchored(pattern))
            new = F.regexp_replace(get(src), anchored(pattern), java_replacement(replacement))
            return F.when(hit, with_labels(sk, {dst: new})).otherwise(sk)
        case "label_transform":
            src, pattern, replacement = args
            return with_labels(sk, {src: F.regexp_replace(get(src), pattern, java_replacement(replacement))})
        case "label_map":
            src, *rest = args
            value = get(src)
            new = value
            for k, v in reversed(list(zip(rest[::2], rest[1::2], strict=False))):
                new = F.when(value == k, v).otherwise(new)
            return with_labels(sk, {src: new})
        case "label_lowercase" | "label_uppercase":
            f = F.lower if name == "label_lowercase" else F.upper
            return with_labels(sk, {a: f(get(a)) for a in args})
        case "label_graphite_group":
            parts = F.split(get(NAME), "\\.", -1)
            return with_labels(sk, {NAME: F.concat_ws(".", *(F.coalesce(F.get(parts, F.lit(int(a))), F.lit("")) for a in args))})
        case "label_match":
            return get(args[0]).rlike(anchored(args[1]))
        case "label_mismatch":
            return ~get(args[0]).rlike(anchored(args[1]))
        case "labels_equal":
            same = F.lit(True)
            for a in args[1:]:
                same = same & (get(args[0]) == get(a))
            return same
    return None


LABEL_KEYS = frozenset("label_set label_del label_keep label_copy label_move label_join label_replace label_transform label_map label_lowercase label_uppercase label_graphite_group".split())
LABEL_TESTS = frozenset("label_match label_mismatch labels_equal".split())


def seconds(grid: Grid, k: Column) -> Column:
    return grid.time_ms(k) / 1000.0
