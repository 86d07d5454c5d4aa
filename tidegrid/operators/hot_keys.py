"""A few keys holding most records: exact per-key results by exact offset chunking.

1. count the keys of each input partition (map-side combined, so only partitions x keys travel);
2. prefix-sum those counts over the partitions, giving the offset of each (partition, key);
3. number the rows of each (partition, key) and add the offset: an exact 0-based number per key;
4. cut every key into chunks of ``chunk_rows`` consecutive numbers and reduce each chunk to a state;
5. merge the states of a key, in chunk order at the boundaries (row numbers are contiguous).

Rows are placed by (partition, key), so a key with a third of all rows is spread over as many
tasks as it has input partitions, and no task ever holds more of it than one input partition does.

Defined results for odd input: null keys form one group of their own; null times and null or
non-finite values count as rows but not towards times and sums (a key without any has nulls);
repeated rows count each time; ties do not matter; an empty table gives no rows; only the named
columns are read, so clashing extra ones are harmless.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

CHUNK_ROWS = 1 << 16


def tag_positions(df: DataFrame) -> DataFrame:
    """Add the input partition and the position in it; df must be a plain scan, or be cut first."""
    return df.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())


def number_rows(df: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """Add ``_no``, the exact 0-based number of each row within its key, from per-partition counts.

    df has _part, _pos and key; counts has _part, key and _n.  No key is gathered in one task.
    """
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_opart"), F.col(key).alias("_okey"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part", key).orderBy("_pos")
    ranked = df.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(offsets, (F.col("_part") == F.col("_opart")) & F.col(key).eqNullSafe(F.col("_okey")))
    return joined.withColumn("_no", F.col("_offset") + F.col("_rank")).drop("_opart", "_okey", "_offset", "_rank")


def finite(value: Column) -> Column:
    """value where it is a finite number, else null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def chunk_states(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """States of equal-sized chunks: rows has _key, _time, _value and _no."""
    return rows.groupBy("_key", F.floor(F.col("_no") / chunk_rows).alias("_chunk")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_no").alias("no_first"),
        F.max("_no").alias("no_last"),
        F.min("_time").alias("t_first"),
        F.max("_time").alias("t_last"),
        F.sum("_value").alias("v_sum"),
        F.count("_value").alias("n_values"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One row per key, its chunks' states merged in order: each chunk must begin where the one before ended."""
    in_order = Window.partitionBy("_key").orderBy("_chunk")
    s = states.withColumn("_follows", F.col("no_first") == F.coalesce(F.lag("no_last").over(in_order) + 1, F.lit(0)))
    # sums are added in the order of chunks, so that they do not change from run to run
    s = s.withColumn("_sum", F.sum("v_sum").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    out = s.groupBy("_key").agg(
        F.sum("n").alias("n_rows"),
        F.min("t_first").alias("first_time"),
        F.max("t_last").alias("last_time"),
        F.max_by("_sum", "_chunk").alias("value_sum"),
        F.sum("n_values").alias("n_values"),
        F.bool_and("_follows").alias("_whole"),
        F.max("no_last").alias("_hi"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    whole = F.col("_whole") & (F.col("_hi") == F.col("n_rows") - 1)
    return out.withColumn("n_rows", F.when(whole, F.col("n_rows")).otherwise(F.raise_error(F.lit("chunks of a key do not join up: the input partitions changed between passes")).cast("bigint"))).drop("_whole", "_hi")


def key_stats(df: DataFrame, key: str, time: str, value: DataFrame | str | None = None, row_id: str | None = None, stable_input: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """key, n_rows, first_time, last_time, value_sum (of finite values), n_values, n_chunks of every key.

    ``value`` is a column of df, or a table (row_id, value) with at most one row per row_id that is
    joined after the rows have their positions.  ``stable_input`` says that df is a plain scan of
    stored files, whose partitions are the same in every pass; anything else is cut first.
    """
    d = df.select(F.col(key).alias("_key"), F.col(time).alias("_time"), *([F.col(row_id).alias("_id")] if row_id else []), *([finite(F.col(value).cast("double")).alias("_value")] if isinstance(value, str) else []))
    d = tag_positions(d if stable_input else cut(d))
    counts = d.groupBy("_part", "_key").agg(F.count(F.lit(1)).alias("_n"))
    if isinstance(value, DataFrame):
        d = d.join(value.select(F.col(value.columns[0]).alias("_vid"), F.col(value.columns[1]).alias("_value")), F.col("_id") == F.col("_vid"), "left").drop("_vid", "_id")
    elif value is None:
        d = d.withColumn("_value", F.lit(None).cast("double"))
    states = chunk_states(number_rows(d, "_key", counts), chunk_rows)
    return merge_states(states).select(F.col("_key").alias("key"), "n_rows", "first_time", "last_time", "value_sum", "n_values", "n_chunks")


def hot_keys(stats: DataFrame, rows: DataFrame, share: float = 0.03) -> DataFrame:
    """Non-null keys with at least share of the rows of the table, from its key_stats.

    The table's size comes from the row counts of its files, not from a second run of the chunks.
    """
    total = rows.agg(F.count(F.lit(1)).alias("_total"))  # one row, so the join has no more rows than stats
    return stats.join(F.broadcast(total)).where(F.col("key").isNotNull() & (F.col("n_rows").cast("decimal(19,0)") >= F.lit(Decimal(str(share))) * F.col("_total").cast("decimal(19,0)"))).drop("_total")
