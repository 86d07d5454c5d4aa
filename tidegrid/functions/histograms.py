"""Functions of bucketed histograms: cumulative ``le`` buckets, or ``vmrange`` ones converted first.

Buckets of one histogram are few, so they are gathered per (histogram, point) into a sorted array
and evaluated with array expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import NAME, Vector, drop_labels, finite_div, label, with_labels
from ..ql.syntax import Call, QueryError

C = F.col
FUNCTIONS = frozenset("histogram_quantile histogram_quantiles histogram_avg histogram_stdvar histogram_stddev histogram_share histogram_fraction prometheus_buckets buckets_limit".split())


def to_le(df: DataFrame) -> DataFrame:
    """vmrange buckets as cumulative le buckets; other series as they are."""
    ends = F.split("vm", "\\.\\.\\.")
    r = df.select(drop_labels(C("sk"), ["vmrange"]).alias("g"), "k", label(C("sk"), "vmrange").alias("vm"), "v")
    r = r.select("g", "k", "vm", F.get(ends, F.lit(0)).try_cast("double").alias("lo"), F.replace(F.get(ends, F.lit(1)), F.lit("+Inf"), F.lit("Infinity")).try_cast("double").alias("hi"), F.get(ends, F.lit(1)).alias("le"), "v")
    # both kinds in one aggregate, as two filters of df would compute it twice
    b = r.groupBy("g", "k").agg(F.array_sort(F.collect_list(F.when(C("vm") != "", F.struct("hi", "le", "lo", "v")))).alias("bs"), F.collect_list(F.when(C("vm") == "", F.struct(F.lit(None).cast("string").alias("le"), "v"))).alias("plain"))
    total = F.aggregate("bs", F.lit(0.0), lambda a, x: a + x["v"])
    upper = F.transform("bs", lambda x: F.struct(F.coalesce(x["le"], F.lit("")).alias("le"), F.aggregate(F.filter("bs", lambda y: y["hi"] <= x["hi"]), F.lit(0.0), lambda a, y: a + y["v"]).alias("v")))
    lower = F.filter(F.transform("bs", lambda x: F.struct(F.regexp_replace(F.format_string("%.3e", x["lo"]), "^0.000e\\+00$", "0").alias("le"), F.aggregate(F.filter("bs", lambda y: y["hi"] <= x["lo"]), F.lit(0.0), lambda a, y: a + y["v"]).alias("v"))), lambda x: ~F.exists("bs", lambda y: y["le"] == x["le"]))
    inf = F.when((F.size("bs") == 0) | F.exists("bs", lambda x: x["le"] == "+Inf"), F.array().cast("array<struct<le:string,v:double>>")).otherwise(F.array(F.struct(F.lit("+Inf").alias("le"), total.alias("v"))))
    out = b.select("g", "k", F.explode(F.concat("plain", F.array_distinct(lower), upper, inf)).alias("x"))
    return out.select(F.when(C("x.le").isNull(), C("g")).otherwise(with_labels(C("g"), {"le": C("x.le")})).alias("sk"), "k", C("x.v").alias("v"))


def gathered(df: DataFrame) -> DataFrame:
    """g, k, bs: per histogram and point the sorted (le, cumulative count), made monotone."""
    d = to_le(df.where(C("v").isNotNull()))
    le = label(C("sk"), "le")
    num = F.when(F.lower(le).isin("+inf", "inf"), float("inf")).otherwise(le.try_cast("double"))
    d = d.select(drop_labels(C("sk"), ["le", NAME]).alias("g"), "k", num.alias("le"), "v").where(C("le").isNotNull())
    d = d.groupBy("g", "k", "le").agg(F.sum("v").alias("v"))
    b = d.groupBy("g", "k").agg(F.array_sort(F.collect_list(F.struct("le", "v"))).alias("bs"))
    mono = F.transform("bs", lambda x, i: F.struct(x["le"].alias("le"), F.array_max(F.transform(F.slice("bs", 1, i + 1), lambda y: y["v"])).alias("v")))
    return b.withColumn("bs", mono)


def _le(i: Column) -> Column:
    return F.get("bs", i)["le"]


def _count(i: Column) -> Column:
    return F.coalesce(F.get("bs", i)["v"], F.lit(0.0))


def quantile(phi: Column) -> Column:
    """Linear interpolation in the bucket that holds rank phi * total."""
    n = F.size("bs")
    total = _count(n - 1)
    rank = phi * total
    at = F.size(F.filter("bs", lambda x: x["v"] < rank)).cast("int")
    below, upto = F.when(at > 0, _count(at - 1)).otherwise(0.0), _count(at)
    lo, hi = F.when(at > 0, _le(at - 1)).otherwise(F.least(_le(F.lit(0)), F.lit(0.0))), _le(at)
    inside = F.when(upto > below, lo + (hi - lo) * (rank - below) / F.when(upto > below, upto - below)).otherwise(hi)
    value = F.when(hi == float("inf"), F.when(at > 0, _le(at - 1))).otherwise(inside)
    return F.when(total <= 0, None).when(phi < 0, float("-inf")).when(phi > 1, float("inf")).otherwise(value)


def share(x: Column) -> Column:
    """The part of the histogram at or below x."""
    total = _count(F.size("bs") - 1)
    at = F.size(F.filter("bs", lambda b: b["le"] <= x)).cast("int")
    below, upto = F.when(at > 0, _count(at - 1)).otherwise(0.0), F.coalesce(F.get("bs", at)["v"], total)
    lo, hi = F.when(at > 0, _le(at - 1)).otherwise(F.lit(0.0)), F.coalesce(_le(at), F.lit(float("inf")))
    part = F.when((hi == float("inf")) | (x < lo), below).otherwise(below + (upto - below) * (x - lo) / F.when(hi > lo, hi - lo))
    return F.when(total <= 0, None).when(x < 0, 0.0).otherwise(part / F.when(total > 0, total))


def _moments() -> tuple[Column, Column]:
    """Mean and mean square of the buckets' middles, weighted by their counts."""
    mids = F.transform("bs", lambda b, i: F.struct(((F.when(i > 0, F.get("bs", i - 1)["le"]).otherwise(0.0) + F.when(b["le"] == float("inf"), F.get("bs", i - 1)["le"]).otherwise(b["le"])) / 2).alias("m"), (b["v"] - F.when(i > 0, F.get("bs", i - 1)["v"]).otherwise(0.0)).alias("n")))
    n = F.aggregate(mids, F.lit(0.0), lambda a, x: a + x["n"])
    s = F.aggregate(mids, F.lit(0.0), lambda a, x: a + F.coalesce(x["n"] * x["m"], F.lit(0.0)))
    q = F.aggregate(mids, F.lit(0.0), lambda a, x: a + F.coalesce(x["n"] * x["m"] * x["m"], F.lit(0.0)))
    return finite_div(s, n), finite_div(q, n)


def apply(comp, name: str, e: Call) -> Vector:
    series = comp.materialise(comp.compile(e.args[-1]))
    if name == "prometheus_buckets":
        return Vector(to_le(series.df))
    if name == "buckets_limit":
        limit = max(3, int(comp.number(e.args[0])))
        d = to_le(series.df)
        le = label(C("sk"), "le")
        num = F.when(F.lower(le).isin("+inf", "inf"), float("inf")).otherwise(le.try_cast("double"))
        b = d.select(drop_labels(C("sk"), ["le"]).alias("g"), "k", num.alias("n"), le.alias("le"), "v").groupBy("g", "k").agg(F.array_sort(F.collect_list(F.struct("n", "le", "v"))).alias("bs"))
        size = F.size("bs")
        kept = F.filter("bs", lambda x, i: (size <= limit) | (i == 0) | (i == size - 1) | (F.floor(i * (limit - 1) / (size - 1)) != F.floor((i - 1) * (limit - 1) / (size - 1))))
        out = b.select("g", "k", F.explode(kept).alias("x"))
        return Vector(out.select(with_labels(C("g"), {"le": C("x.le")}).alias("sk"), "k", C("x.v").alias("v")))
    g = gathered(series.df)
    if name == "histogram_quantiles":
        tag = comp.text(e.args[0])
        phis = [comp.number(a) for a in e.args[1:-1]]
        rows = g.select("g", "k", F.explode(F.array(*(F.struct(F.lit(repr(p)).alias("t"), quantile(F.lit(p)).alias("v")) for p in phis))).alias("x"))
        return Vector(rows.select(with_labels(C("g"), {tag: C("x.t")}).alias("sk"), "k", C("x.v").alias("v")))
    if name in ("histogram_quantile", "histogram_share"):
        x = comp.compile(e.args[0])
        if not hasattr(x, "expr"):
            raise QueryError(f"{name} wants a number")
        value = (quantile if name == "histogram_quantile" else share)(x.expr)
    elif name == "histogram_fraction":
        lo, hi = (F.lit(comp.number(a)) for a in e.args[:2])
        value = share(hi) - share(lo)
    else:
        mean, square = _moments()
        var = F.greatest(square - mean * mean, F.lit(0.0))
        value = {"histogram_avg": mean, "histogram_stdvar": var, "histogram_stddev": F.sqrt(var)}[name]
    return Vector(g.select(C("g").alias("sk"), "k", value.alias("v")))
