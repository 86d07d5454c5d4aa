"""The stored table of samples, and results written out.

Samples are kept as Parquet under ``month=YYYY_MM``, sorted by (name, key, time) within files, so
that time ranges prune folders and names prune row groups.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import NAME, key_of
from ..operators.dedup import deduplicate

C = F.col


def month_of(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy_MM")


def month_text(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, UTC).strftime("%Y_%m")


def write_samples(samples: DataFrame, path: str, mode: str = "append", salts: int = 16) -> None:
    """Append samples; rows are spread by month and series, with salts so that no series fills one file alone."""
    d = samples.withColumn("month", month_of(C("ts_ms"))).withColumn("sk", key_of(F.map_concat(F.create_map(F.lit(NAME), F.coalesce("name", F.lit(""))), F.coalesce("labels", F.create_map().cast("map<string,string>")))))
    d = d.repartition("month", F.pmod(F.xxhash64("sk", F.floor(C("ts_ms") / 86_400_000)), F.lit(salts)))
    d.sortWithinPartitions("month", "name", "sk", "ts_ms").drop("sk").write.mode(mode).partitionBy("month").parquet(path)


def read_samples(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """The samples of a time range; whole months outside it are not listed."""
    d = spark.read.parquet(path)
    if start_ms is not None:
        d = d.where((C("month") >= month_text(start_ms)) & (C("ts_ms") >= start_ms))
    if end_ms is not None:
        d = d.where((C("month") <= month_text(end_ms)) & (C("ts_ms") <= end_ms))
    return d.drop("month")


def compact_month(spark: SparkSession, path: str, month: str, out_path: str, dedup_interval_ms: int = 0, target_rows: int = 20_000_000) -> None:
    """Rewrite one month into fewer sorted files under out_path, optionally deduplicated; swap the folders afterwards."""
    d = spark.read.parquet(path).where(C("month") == month).drop("month")
    if dedup_interval_ms:
        d = deduplicate(d, dedup_interval_ms)
    files = max(1, -(-d.count() // target_rows))
    d = d.withColumn("sk", key_of(F.map_concat(F.create_map(F.lit(NAME), F.coalesce("name", F.lit(""))), "labels")))
    d.repartitionByRange(files, "name", "sk", "ts_ms").sortWithinPartitions("name", "sk", "ts_ms").drop("sk").write.mode("overwrite").parquet(out_path)


def file_targets(spark: SparkSession, path: str) -> DataFrame:
    """Scrape targets of discovery files: address and labels, from JSON arrays of {"targets":[...],"labels":{...}}."""
    d = spark.read.schema("targets array<string>, labels map<string,string>").json(path, multiLine=True)
    return d.select(F.explode("targets").alias("address"), F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"))


def expired_months(months: list[str], now_ms: int, retention_ms: int) -> list[str]:
    """Months that end before the retention's start, whose folders can be dropped."""
    oldest = month_text(now_ms - retention_ms)
    return [m for m in months if m < oldest]


def matrix_json(result: DataFrame) -> DataFrame:
    """One JSON line per series: {"metric":{...},"values":[[seconds,"value"],...]}."""
    metric = F.map_concat(F.when(C("name") != "", F.create_map(F.lit(NAME), C("name"))).otherwise(F.create_map().cast("map<string,string>")), C("labels"))
    d = result.select(key_of(metric).alias("sk"), F.to_json(metric).alias("m"), "ts_ms", F.concat(F.lit("["), F.regexp_replace(F.format_string("%.3f", C("ts_ms") / 1000.0), r"\.?0+$", ""), F.lit(',"'), value_text(C("value")), F.lit('"]')).alias("p"))
    g = d.groupBy("sk").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("ts_ms", "p"))).alias("ps"))
    return g.select(F.concat(F.lit('{"metric":'), "m", F.lit(',"values":['), F.array_join(F.transform("ps", lambda x: x["p"]), ","), F.lit("]}")).alias("value"))


def value_text(v: Column) -> Column:
    """A number as the query interface prints it."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(whole, F.floor(v).cast("string")).otherwise(v.cast("string"))


def export_json(samples: DataFrame, max_rows_per_line: int = 10_000) -> DataFrame:
    """Lines {"metric":{...},"values":[...],"timestamps":[...]} of at most so many samples each.

    The rows of a series are numbered within days, so a long series is never gathered whole.
    """
    metric = F.map_concat(F.when(C("name") != "", F.create_map(F.lit(NAME), C("name"))).otherwise(F.create_map().cast("map<string,string>")), C("labels"))
    day = F.floor(C("ts_ms") / 86_400_000)
    d = samples.select(key_of(metric).alias("sk"), F.to_json(metric).alias("m"), day.alias("day"), "ts_ms", "value")
    d = d.withColumn("line", F.floor((F.row_number().over(Window.partitionBy("sk", "day").orderBy("ts_ms")) - 1) / max_rows_per_line))
    g = d.groupBy("sk", "day", "line").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("ps"))
    num = lambda v: F.when(F.isnan(v), '"NaN"').when(v == float("inf"), '"Infinity"').when(v == float("-inf"), '"-Infinity"').otherwise(value_text(v))
    return g.select(F.concat(F.lit('{"metric":'), "m", F.lit(',"values":['), F.array_join(F.transform("ps", lambda x: num(x["value"])), ","), F.lit('],"timestamps":['), F.array_join(F.transform("ps", lambda x: x["ts_ms"].cast("string")), ","), F.lit("]}")).alias("value"))


def export_prometheus(samples: DataFrame) -> DataFrame:
    """Exposition lines: name{label="value"} value time."""
    esc = lambda s: F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    entries = F.array_sort(F.map_entries("labels"))
    body = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), esc(e["value"]), F.lit('"'))), ",")
    return samples.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), body, F.lit("}"))).otherwise(""), F.lit(" "), value_text(C("value")), F.lit(" "), C("ts_ms").cast("string")).alias("value"))
