"""Aggregations across series: per grid point, grouped by a new key; missing points are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ENTRY, NAME, PAIR, Grid, drop_labels, finite_div, keep_labels, missing_if_nan, with_labels

C = F.col


def group_key(mod: str, labels: tuple[str, ...]) -> Column:
    if mod == "without":
        return drop_labels(C("sk"), [*labels, NAME])
    return keep_labels(C("sk"), labels)


def sample_key(labels: list[str]) -> Column:
    """The key with only the listed labels, straight from the name and labels of a sample and all in generated code."""
    values = ((x, C("name") if x == NAME else C("labels")[x]) for x in sorted(set(labels)))
    return F.concat_ws(ENTRY, *(F.when(v != "", F.concat(F.lit(x + PAIR), v)) for x, v in values))


def geomean(v: Column) -> Column:
    """pow(product, 1 / n) through a sum of logarithms, as the product of many series overflows.

    A zero makes it zero, an odd number of negative values missing; one value alone stays as it is.
    """
    n, logs = F.count(v), F.coalesce(F.sum(F.when(v != 0, F.ln(F.abs(v)))), F.lit(0.0))
    finite = logs < float("inf")
    root = F.when(F.count_if(v == 0) > 0, F.when(finite, 0.0).otherwise(float("nan"))).when((F.count_if(v < 0) % 2 == 1) & finite, float("nan")).otherwise(F.exp(logs / n))
    return F.when(n == 1, F.max(v)).otherwise(root)


# Each gives one value per group and point.
SIMPLE = {
    "sum": lambda: F.sum("v"),
    "sum2": lambda: F.sum(C("v") * C("v")),
    "min": lambda: F.min("v"),
    "max": lambda: F.max("v"),
    "avg": lambda: F.avg("v"),
    "count": lambda: F.count("v").cast("double"),
    "group": lambda: F.max(F.when(C("v").isNotNull(), 1.0)),
    "stddev": lambda: F.stddev_pop("v"),
    "stdvar": lambda: F.var_pop("v"),
    "geomean": lambda: geomean(C("v")),
    "median": lambda: F.percentile("v", F.lit(0.5)),
    "mode": lambda: F.mode("v", True),
    "distinct": lambda: F.count_distinct("v").cast("double"),
}
# Each ranks whole series by one number.
SERIES_RANK = {"avg": lambda: F.avg("v"), "min": lambda: F.min("v"), "max": lambda: F.max("v"), "median": lambda: F.percentile("v", F.lit(0.5)), "last": lambda: F.max_by("v", "k")}
EXECUTABLE = frozenset(SIMPLE) | {"any", "quantile", "quantiles", "topk", "bottomk", "limitk", "share", "zscore", "mad", "count_values", "outliers_iqr", "outliers_mad", "outliersk", "histogram"} | {f"{a}k_{b}" for a in ("top", "bottom") for b in SERIES_RANK}
KEEPS_SERIES = EXECUTABLE - frozenset(SIMPLE) - {"quantile", "quantiles", "mad", "count_values", "histogram"}


def limit_groups(df: DataFrame, n: int) -> DataFrame:
    """Only the n groups with the smallest keys: which ones is arbitrary in the language, this makes it definite."""
    kept = df.select("sk").distinct().orderBy("sk").limit(n)
    return df.join(kept, "sk", "left_semi")


def simple(df: DataFrame, name: str, mod: str, labels: tuple[str, ...]) -> DataFrame:
    g = df.where(C("v").isNotNull()).select(group_key(mod, labels).alias("sk"), "k", "v").groupBy("sk", "k").agg(SIMPLE[name]().alias("v"))
    return g.select("sk", "k", missing_if_nan(C("v")).alias("v"))


def quantile(df: DataFrame, phi: float, mod: str, labels: tuple[str, ...]) -> DataFrame:
    g = df.where(C("v").isNotNull()).select(group_key(mod, labels).alias("sk"), "k", "v").groupBy("sk", "k")
    if phi != phi:
        return g.agg(F.lit(None).cast("double").alias("v"))
    if phi < 0 or phi > 1:
        return g.agg(F.lit(float("-inf" if phi < 0 else "inf")).alias("v"))
    return g.agg(F.percentile("v", F.lit(float(phi))).alias("v"))


def _grouped(df: DataFrame, mod: str, labels: tuple[str, ...]) -> DataFrame:
    return df.where(C("v").isNotNull()).select(group_key(mod, labels).alias("g"), "sk", "k", "v")


def any_series(df: DataFrame, mod: str, labels: tuple[str, ...]) -> DataFrame:
    """One series of each group with its own labels: the one with the smallest key."""
    d = _grouped(df, mod, labels)
    first = d.groupBy("g").agg(F.min("sk").alias("sk"))
    return d.join(first, ["g", "sk"]).select("sk", "k", "v")


def rank_points(df: DataFrame, k: Column, top: bool, mod: str, labels: tuple[str, ...]) -> DataFrame:
    """The k largest or smallest values of each group at each point; ties go to the smaller key."""
    order = [F.desc("v") if top else F.asc("v"), F.asc("sk")]
    d = _grouped(df, mod, labels).withColumn("r", F.row_number().over(Window.partitionBy("g", "k").orderBy(*order)))
    return d.where(C("r") <= k).select("sk", "k", "v")


def rank_series(df: DataFrame, k: int, top: bool, by: str, mod: str, labels: tuple[str, ...]) -> DataFrame:
    """The whole series whose average (or minimum ...) is among the k largest or smallest of its group."""
    d = _grouped(df, mod, labels)
    s = d.groupBy("g", "sk").agg(SERIES_RANK[by]().alias("x"))
    order = [F.desc("x") if top else F.asc("x"), F.asc("sk")]
    kept = s.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(C("r") <= k).select("sk")
    return d.join(kept, "sk", "left_semi").select("sk", "k", "v")


def limitk(df: DataFrame, k: int, mod: str, labels: tuple[str, ...]) -> DataFrame:
    """The k series of each group whose keys have the smallest hashes: the same ones in every query."""
    d = _grouped(df, mod, labels)
    s = d.select("g", "sk").distinct().withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.md5("sk"), "sk")))
    return d.join(s.where(C("r") <= k).select("sk"), "sk", "left_semi").select("sk", "k", "v")


def with_stats(df: DataFrame, mod: str, labels: tuple[str, ...], **stats: Column) -> DataFrame:
    """The points of all series with statistics of their group and point, joined from an aggregate."""
    d = _grouped(df, mod, labels)
    s = d.groupBy("g", "k").agg(*(c.alias(n) for n, c in stats.items()))
    return d.join(s, ["g", "k"])


def share(df: DataFrame, mod: str, labels: tuple[str, ...]) -> DataFrame:
    d = with_stats(df.where(C("v") >= 0), mod, labels, s=F.sum("v"))
    return d.select("sk", "k", finite_div(C("v"), C("s")).alias("v"))


def zscore(df: DataFrame, mod: str, labels: tuple[str, ...]) -> DataFrame:
    d = with_stats(df, mod, labels, m=F.avg("v"), d=F.stddev_pop("v"))
    return d.select("sk", "k", F.when(C("d") == 0, 0.0).otherwise(finite_div(C("v") - C("m"), C("d"))).alias("v"))


def _with_mad(df: DataFrame, mod: str, labels: tuple[str, ...]) -> DataFrame:
    d = with_stats(df, mod, labels, m=F.percentile("v", F.lit(0.5)))
    s = d.groupBy("g", "k").agg(F.percentile(F.abs(C("v") - C("m")), F.lit(0.5)).alias("mad"))
    return d.join(s, ["g", "k"])


def mad(df: DataFrame, mod: str, labels: tuple[str, ...]) -> DataFrame:
    return _with_mad(df, mod, labels).groupBy("g", "k").agg(F.max("mad").alias("v")).select(C("g").alias("sk"), "k", "v")


def outliers(df: DataFrame, how: str, x: float, mod: str, labels: tuple[str, ...]) -> DataFrame:
    """Whole series with any point outside its group's usual range."""
    if how == "iqr":
        d = with_stats(df, mod, labels, q=F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))))
        q1, q3 = C("q")[0], C("q")[1]
        out = (C("v") > q3 + 1.5 * (q3 - q1)) | (C("v") < q1 - 1.5 * (q3 - q1))
    else:
        d = _with_mad(df, mod, labels)
        out = F.abs(C("v") - C("m")) > x * C("mad")
    return df.join(d.where(out).select("sk").distinct(), "sk", "left_semi").select("sk", "k", "v")


def outliersk(df: DataFrame, k: int, mod: str, labels: tuple[str, ...]) -> DataFrame:
    """The k series of each group that stray furthest from its median."""
    d = with_stats(df, mod, labels, m=F.percentile("v", F.lit(0.5)))
    s = d.groupBy("g", "sk").agg(F.sum((C("v") - C("m")) * (C("v") - C("m"))).alias("x"))
    kept = s.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("x"), F.asc("sk")))).where(C("r") <= k).select("sk")
    return d.join(kept, "sk", "left_semi").select("sk", "k", "v")


def number_text(v: Column) -> Column:
    """A number as a label: whole numbers without a fraction."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, F.floor(v).cast("string")).otherwise(v.cast("string"))


def count_values(df: DataFrame, name: str, mod: str, labels: tuple[str, ...]) -> DataFrame:
    g = df.where(C("v").isNotNull()).select(group_key(mod, labels).alias("g"), "k", "v").groupBy("g", "k", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return g.select(with_labels(C("g"), {name: number_text(C("v"))}).alias("sk"), "k", C("n").alias("v"))


# Logarithmic buckets, 18 per decade from 1e-9 to 1e18, named by their ends.
BUCKETS_PER_DECADE, LOWEST, HIGHEST = 18, -9, 18


def bucket_name(v: Column) -> Column:
    """The vmrange label of a value: lower...upper of its bucket, in three digits."""
    edge = lambda i: F.regexp_replace(F.format_string("%.3e", F.pow(F.lit(10.0), i / BUCKETS_PER_DECADE + LOWEST)), "e([+-])([0-9])$", "e$10$2")
    i = F.ceil((F.log10(v) - LOWEST) * BUCKETS_PER_DECADE - 1e-9) - 1
    top = (HIGHEST - LOWEST) * BUCKETS_PER_DECADE
    return F.when(v == 0, "0...1.000e-09").when(i < 0, "0...1.000e-09").when(i >= top, "1.000e+18...+Inf").otherwise(F.concat(edge(i), F.lit("..."), edge(i + 1)))


def histogram(df: DataFrame, mod: str, labels: tuple[str, ...]) -> DataFrame:
    g = df.where(C("v") >= 0).select(group_key(mod, labels).alias("g"), "k", bucket_name(C("v")).alias("b")).groupBy("g", "k", "b").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return g.select(with_labels(C("g"), {"vmrange": C("b")}).alias("sk"), "k", "v")


def densify(df: DataFrame, grid: Grid) -> DataFrame:
    """A row for every series and grid point (the grid is bounded): missing ones with v null."""
    full = df.select("sk").distinct().select("sk", F.explode(F.sequence(F.lit(0), F.lit(grid.n - 1))).alias("k"))
    return full.join(df, ["sk", "k"], "left")


