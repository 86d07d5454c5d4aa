"""The sample before each sample of a series, without gathering a series in one task.

Series are cut into time shards; within a shard the previous sample is a lag, and a shard's first
sample takes it from a table of the shards' last ones.  Rows and last ones come from one shuffle by
(series, shard).  Defined results: samples of equal time follow in order of their values (then of
the other columns), null times are left out, the first sample of a series has nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_MS = 24 * 3600 * 1000


def with_previous(d: DataFrame, key: str, ts: str, value: str, shard_ms: int = SHARD_MS) -> DataFrame:
    """d, whose columns must have an order, with prev_ts and prev_value."""
    order = [ts, value, *(c for c in d.columns if c not in (ts, value))]
    s = d.where(F.col(ts).isNotNull()).withColumn("_shard", F.coalesce(F.floor(F.col(ts) / shard_ms), F.lit(0)))
    s = s.withColumn("_key", F.coalesce(F.col(key), F.lit(""))).repartition("_key", "_shard")
    # the last row as a whole, so that both uses of the shuffle read the same columns
    ends = s.groupBy("_key", "_shard").agg(F.max(F.struct(*order)).alias("_e"))
    w = Window.partitionBy("_key").orderBy("_shard")
    before = ends.select("_key", "_shard", F.lag("_e").over(w).alias("_b")).select("_key", "_shard", F.col(f"_b.{ts}").alias("_bt"), F.col(f"_b.{value}").alias("_bv"))
    inside = Window.partitionBy("_key", "_shard").orderBy(*order)
    near = s.select("*", F.lag(ts).over(inside).alias("_lt"), F.lag(value).over(inside).alias("_lv"))
    return near.join(before, ["_key", "_shard"]).select(*d.columns, F.coalesce("_lt", "_bt").alias("prev_ts"), F.coalesce("_lv", "_bv").alias("prev_value"))
