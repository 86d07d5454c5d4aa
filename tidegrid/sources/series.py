"""The stored table in two parts: series (sid, name, labels, sk) and samples (sid, ts_ms, value, is_stale).

Label filters are resolved on the series, of which there are few, before samples are touched: up to
``MAX_IDS`` matching series become a list of ids that is pushed into the scan of the samples, whose
files are sorted by id; more of them are joined.  Keys of series are stored, not built per query.

``sid`` is a 64-bit hash of the key; two keys of one hash are an error when series are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NAME, key_of
from .store import month_of, month_text

C = F.col
MAX_IDS = 10_000
_DAY_MS = 86_400_000


def with_key(samples: DataFrame) -> DataFrame:
    """Samples with their series' key and id."""
    labels = F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, v: (k != NAME) & F.coalesce(v != "", F.lit(False)))
    d = samples.select(F.coalesce("name", F.lit("")).alias("name"), labels.alias("labels"), "ts_ms", "value", F.coalesce("is_stale", F.lit(False)).alias("is_stale"))
    sk = key_of(F.map_concat(F.create_map(F.lit(NAME), C("name")), C("labels")))
    return d.withColumn("sk", sk).withColumn("sid", F.xxhash64("sk"))


def write(samples: DataFrame, path: str, salts: int = 16) -> None:
    """Append samples to the table at path; series that it has already are not written again.

    Samples are spread by month, id and day, so that no series fills one file alone.
    """
    spark = samples.sparkSession
    d = with_key(samples.where("ts_ms is not null"))
    new = d.groupBy("sid").agg(F.min("sk").alias("sk"), F.max("sk").alias("_other"), F.min_by("name", "sk").alias("name"), F.min_by("labels", "sk").alias("labels"))
    clash = F.raise_error(F.lit("two series have the same id")).cast("string")
    new = new.select("sid", F.when(C("_other") == C("sk"), C("sk")).otherwise(clash).alias("sk"), "name", "labels")
    if _exists(spark, f"{path}/series"):
        old = spark.read.parquet(f"{path}/series").select("sid", C("sk").alias("_old"))
        j = new.join(old, "sid", "left")
        new = j.where(C("_old").isNull() | (F.when(C("_old") == C("sk"), C("sk")).otherwise(clash) != C("sk"))).drop("_old")
    new.sortWithinPartitions("name", "sid").write.mode("append").parquet(f"{path}/series")
    s = d.select("sid", "ts_ms", "value", "is_stale", month_of(C("ts_ms")).alias("month"))
    s = s.repartition("month", F.pmod(F.xxhash64("sid", F.floor(C("ts_ms") / _DAY_MS)), F.lit(salts)))
    s.sortWithinPartitions("month", "sid", "ts_ms").write.mode("append").partitionBy("month").parquet(f"{path}/samples")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@dataclass
class StoredSeries:
    """A table written by ``write``, for MetricsEngine in place of a DataFrame of samples."""

    spark: SparkSession
    path: str
    max_ids: int = MAX_IDS

    def series(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/series")

    def between(self, start: int | None, end: int | None) -> DataFrame:
        """sid, ts_ms, value, is_stale of a time range; whole months outside it are not listed."""
        d = self.spark.read.parquet(f"{self.path}/samples")
        if start is not None:
            d = d.where((C("month") >= month_text(start)) & (C("ts_ms") >= start))
        if end is not None:
            d = d.where((C("month") <= month_text(end)) & (C("ts_ms") <= end))
        return d.drop("month")

    def select(self, condition: Column, start: int | None, end: int | None) -> DataFrame:
        """The samples of the series that satisfy a condition on name and labels, with sk, name and labels."""
        hit = self.series().where(condition)
        samples = self.between(start, end)
        ids = [r[0] for r in hit.select("sid").limit(self.max_ids + 1).collect()]
        if len(ids) <= self.max_ids:
            samples = samples.where(C("sid").isin(ids) if ids else F.lit(False))
        return samples.join(hit, "sid").drop("sid")

    def samples(self) -> DataFrame:
        """All samples with name and labels."""
        return self.between(None, None).join(self.series(), "sid").select("name", "labels", "ts_ms", "value", "is_stale")
