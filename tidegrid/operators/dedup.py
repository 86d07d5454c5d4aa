"""Deduplication of samples: the last one of every series and interval (b - i, b].

Equal times prefer a number over a staleness marker, then the larger number.  One map-side combined
aggregate; no sort.  Defined results: null times are dropped, null values lose to any number, an
interval of 0 keeps all samples, empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NAME, key_of, labels_of

C = F.col


def deduplicate(samples: DataFrame, interval_ms: int, drop: tuple[str, ...] = ()) -> DataFrame:
    """Samples (name, labels, ts_ms, value, is_stale) with at most one per series and interval; labels in drop are removed first."""
    d = samples.where("ts_ms is not null")
    labels = F.map_filter(F.coalesce("labels", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin([NAME, *drop]))
    if interval_ms <= 0:
        return d.withColumn("labels", labels) if drop else d
    sk = key_of(F.map_concat(F.create_map(F.lit(NAME), F.coalesce("name", F.lit(""))), labels))
    stale = F.coalesce("is_stale", F.lit(False))
    number = ~stale & C("value").isNotNull()
    best = F.max(F.struct("ts_ms", number.cast("int").alias("num"), C("value").alias("v"), (~stale).cast("int").alias("live")))
    g = d.groupBy(sk.alias("sk"), F.ceil(C("ts_ms") / interval_ms).alias("b")).agg(best.alias("s"))
    m = labels_of(C("sk"))
    return g.select(F.coalesce(F.try_element_at(m, F.lit(NAME)), F.lit("")).alias("name"), F.map_filter(m, lambda k, _: k != NAME).alias("labels"), C("s.ts_ms").alias("ts_ms"), C("s.v").alias("value"), (C("s.live") == 0).alias("is_stale"))
