"""Queries of this subpackage on the test tables, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kinds, kmv, packing, qdigest, reading

DAY_MS = 86_400_000
PHIS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return _table(spark, sf_dir, "influx_tags").where(F.col("tag_key") == key).select("row_id", F.col("tag_value").alias(key))


def _clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, day (days since 1970), grp, zone, client of both tables."""
    g = _table(spark, sf_dir, "got_rows")
    got = g.select(F.lit("got_rows").alias("tbl"), F.floor(F.col("ts_ms") / DAY_MS).cast("int").alias("day"), F.col("metric_group").alias("grp"), F.col("tags")["zone"].alias("zone"), F.col("tags")["client"].alias("client"))
    r = _table(spark, sf_dir, "influx_rows").select("row_id", "measurement", "row_ts")
    joined = _tag(spark, sf_dir, "client").join(r, "row_id").join(_tag(spark, sf_dir, "zone"), "row_id", "left")
    day = F.floor(F.unix_micros(F.col("row_ts").cast("timestamp")) / (DAY_MS * 1000)).cast("int")
    return got.unionByName(joined.select(F.lit("influx_rows").alias("tbl"), day.alias("day"), F.col("measurement").alias("grp"), "zone", "client"))


def p3_distinct_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = kmv.cube_sketches(_clients(spark, sf_dir), ["day", "grp", "zone"], "client", ["tbl"])
    e = kmv.estimate(F.col("hashes"))
    return s.select("tbl", "level", "day", "grp", "zone", F.size("hashes").alias("n_kept"), *(F.round(c, 3).alias(n) for n, c in e.items()))


def p3_day_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of each day and of the day after it: union, intersection and those who did not return."""
    hashes = kmv.hashed(_clients(spark, sf_dir).where("day is not null"), ["tbl", "day"], "client")
    days = kmv.sketch(hashes, ["tbl", "day"])
    nxt = days.select("tbl", (F.col("day") - 1).alias("day"), F.col("hashes").alias("next_hashes"))
    e = kmv.set_estimates(F.col("hashes"), F.col("next_hashes"))
    return days.join(nxt, ["tbl", "day"]).select("tbl", "day", *(F.round(c, 3).alias(n) for n, c in e.items()))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _table(spark, sf_dir, "influx_fields")
    r = _table(spark, sf_dir, "influx_rows").select("row_id", "measurement")
    return f.join(r, "row_id").join(_tag(spark, sf_dir, "zone"), "row_id", "left").select("field_key", "measurement", "zone", F.col("field_value").alias("value"))


_VALUE_KEYS = ["field_key", "measurement", "zone"]
_VALUE_SETS = [_VALUE_KEYS, ["field_key", "measurement"], ["field_key", "zone"], ["field_key"]]


def _value_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qdigest.roll_up(qdigest.build(_values(spark, sf_dir), _VALUE_KEYS, "value"), _VALUE_KEYS, _VALUE_SETS)


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qdigest.quantiles(_value_digests(spark, sf_dir), ["level", *_VALUE_KEYS], PHIS)


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the digests hold of every group: as many values as it has, with the stated error of ranks."""
    d = _value_digests(spark, sf_dir)
    n = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select("level", *_VALUE_KEYS, n.alias("n"), (qdigest.BITS * F.floor(n / qdigest.K)).alias("rank_error"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(_table(spark, sf_dir, "documents"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pack_specs"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = reading.train(reading.labelled_passages(_table(spark, sf_dir, "level_items")), kinds.licence_texts(docs))
    return reading.reading_levels(docs, model)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.mostly_hard(_levels(spark, sf_dir)).select("doc_id")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "n_sentences", "n_hard", F.round("difficulty", 4).alias("difficulty"), "level")


QUERIES = {f.__name__: f for f in (p3_distinct_clients, p3_day_overlap, p5_percentiles, p5_counts, p6_ids, p7_pack, p8_found, p8_levels)}

_CLIENTS = f"""
  clients AS (
    SELECT 'got_rows' AS tbl, CAST(ts_ms // {DAY_MS} AS INTEGER) AS day, metric_group AS grp, tags['zone'] AS zone, tags['client'] AS client FROM got_rows
    UNION ALL
    SELECT 'influx_rows', CAST(epoch_us(r.row_ts) // {DAY_MS * 1000} AS INTEGER), r.measurement, z.tag_value, c.tag_value
    FROM influx_tags c JOIN influx_rows r ON r.row_id = c.row_id AND c.tag_key = 'client' LEFT JOIN influx_tags z ON z.row_id = r.row_id AND z.tag_key = 'zone'),
  hashed AS (SELECT DISTINCT tbl, day, grp, zone, CAST('0x' || left(md5(client), 15) AS BIGINT) AS h FROM clients WHERE client <> '')"""
_T = f"(max(h) / {2.0**kmv.HASH_BITS!r})"
_FULL = f"count(*) >= {kmv.K}"
_EST = f"CASE WHEN {_FULL} THEN {kmv.K - 1} / {_T} ELSE count(*) END"
_RSE = kmv.Z / (kmv.K - 2) ** 0.5
_LEVEL = "concat_ws('+', CASE WHEN grouping(day) = 0 THEN 'day' END, CASE WHEN grouping(grp) = 0 THEN 'grp' END, CASE WHEN grouping(zone) = 0 THEN 'zone' END)"



def _overlap(name: str) -> dict[str, str]:
    m = f"m_{name}"
    spread = f"CASE WHEN t < 1 THEN {kmv.Z} * sqrt({m} * (1 - t) + {kmv.Z * kmv.Z / 4!r}) + {kmv.Z * kmv.Z / 2!r} ELSE 0 END"
    return {name: f"{m} / t", f"{name}_lower": f"greatest({m} - ({spread}), 0) / t", f"{name}_upper": f"({m} + ({spread})) / t"}


ORACLE = {
    "p3_distinct_clients": f"""
        WITH {_CLIENTS},
        sets AS (SELECT tbl, {_LEVEL} AS level, day, grp, zone, h FROM hashed GROUP BY tbl, h, CUBE (day, grp, zone)),
        kept AS (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY tbl, level, day, grp, zone ORDER BY h) <= {kmv.K})
        SELECT tbl, level, day, grp, zone, count(*) AS n_kept, round({_EST}, 3) AS estimate,
               round(CASE WHEN {_FULL} THEN greatest(({_EST}) * {1 - _RSE!r}, count(*)) ELSE count(*) END, 3) AS lower,
               round(CASE WHEN {_FULL} THEN ({_EST}) * {1 + _RSE!r} ELSE count(*) END, 3) AS upper
        FROM kept GROUP BY tbl, level, day, grp, zone""",
    "p5_counts": f"""
        WITH vals AS (SELECT f.field_key, r.measurement, z.tag_value AS zone FROM influx_fields f JOIN influx_rows r USING (row_id) LEFT JOIN influx_tags z ON z.row_id = r.row_id AND z.tag_key = 'zone' WHERE isfinite(f.field_value))
        SELECT concat_ws('+', 'field_key', CASE WHEN grouping(measurement) = 0 THEN 'measurement' END, CASE WHEN grouping(zone) = 0 THEN 'zone' END) AS level,
               field_key, measurement, zone, count(*) AS n, {qdigest.BITS} * (count(*) // {qdigest.K}) AS rank_error
        FROM vals GROUP BY field_key, CUBE (measurement, zone)""",
    "p3_day_overlap": f"""
        WITH {_CLIENTS},
        days AS (SELECT tbl, day, list_sort(list(DISTINCT h))[:{kmv.K}] AS hs FROM hashed WHERE day IS NOT NULL GROUP BY tbl, day),
        pairs AS (SELECT a.tbl, a.day, a.hs AS a, b.hs AS b, least(CASE WHEN len(a.hs) < {kmv.K} THEN {2**kmv.HASH_BITS} ELSE a.hs[-1] END, CASE WHEN len(b.hs) < {kmv.K} THEN {2**kmv.HASH_BITS} ELSE b.hs[-1] END) AS cut
                  FROM days a JOIN days b ON b.tbl = a.tbl AND b.day = a.day + 1),
        held AS (SELECT tbl, day, cut, unnest(a) AS h, 1 AS side FROM pairs UNION ALL SELECT tbl, day, cut, unnest(b), 2 FROM pairs),
        sides AS (SELECT tbl, day, cut, h, sum(side) AS side FROM held WHERE h < cut GROUP BY ALL),
        n AS (SELECT tbl, day, cut / {2.0**kmv.HASH_BITS!r} AS t, count(*) AS m_union, count(*) FILTER (side = 3) AS m_intersection, count(*) FILTER (side = 1) AS m_difference FROM sides GROUP BY ALL)
        SELECT tbl, day, {", ".join(f"round({e}, 3) AS {n}" for s in ("union", "intersection", "difference") for n, e in _overlap(s).items())} FROM n""",
}
