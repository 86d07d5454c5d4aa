"""Queries on the wire, key and reading tables: rejected lines, skewed keys, regular grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hot_keys, regular_grid, wire_rows

C = F.col
FAR_MS = 10**14  # times beyond this many milliseconds cannot be held in microseconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros_of_ms(ms: Column) -> Column:
    return F.when(ms.between(-FAR_MS, FAR_MS), ms * 1000)


def micros_of_ts(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def significant(value: Column, digits: int = 12) -> Column:
    """value rounded to so many significant digits, for results that depend on the order of addition."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits - 1}e", value).try_cast("double"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire_rows.rejected_lines(table(spark, sf_dir, "raw_lines")).select("line_id")


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wire_rows.rejected_lines(table(spark, sf_dir, "raw_lines")).select("line_id", "fmt", F.array_join("errors", ",").alias("reasons"))


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every valid line with its line's time and tags; integers exact, as text."""
    rows = wire_rows.loaded_rows(table(spark, sf_dir, "raw_lines"))
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat(t["key"], F.lit("="), t["value"])), ",")
    return rows.select("line_id", "fmt", "measurement", "ts", tags.alias("tags"), F.posexplode("fields").alias("field_no", "f")).select(
        "line_id", "fmt", "measurement", "ts", "tags", "field_no", C("f.key").alias("field_key"), C("f.kind").alias("kind"), C("f.number").alias("number"), C("f.exact").cast("string").alias("exact"), C("f.text").alias("text")
    )


def key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = hot_keys.key_stats(table(spark, sf_dir, "got_rows"), "metric_group", "ts_ms", "value", stable_input=True)
    fields = table(spark, sf_dir, "influx_fields").groupBy("row_id").agg(F.sum(hot_keys.finite(F.col("field_value"))).alias("v"))
    rows = table(spark, sf_dir, "influx_rows").withColumn("t", micros_of_ts(F.col("row_ts")))
    influx = hot_keys.key_stats(rows, "measurement", "t", fields, row_id="row_id", stable_input=True)
    return got.withColumn("tbl", F.lit("got_rows")).unionByName(influx.withColumn("tbl", F.lit("influx_rows")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = key_stats(spark, sf_dir)
    parts = [hot_keys.hot_keys(stats.where(F.col("tbl") == t), table(spark, sf_dir, t)) for t in ("got_rows", "influx_rows")]
    return parts[0].unionByName(parts[1]).select("tbl", F.col("key").alias("hot_key"))


def p2_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = key_stats(spark, sf_dir)
    return s.select("tbl", "key", "n_rows", "first_time", "last_time", significant(F.col("value_sum")).alias("value_sum"))


def grid_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "input_samples")
    us = micros_of_ms(F.col("timestamp_ms"))
    samples = s.where(regular_grid.usable(us, F.col("value"), F.col("is_stale"))).select(F.lit("input_samples").alias("origin"), F.col("labels")["device"].alias("device"), us.alias("t_us"), F.col("value").alias("v"))
    tags = table(spark, sf_dir, "influx_tags").where("tag_key = 'device'").select("row_id", F.col("tag_value").alias("device"))
    reading = table(spark, sf_dir, "influx_fields").where("field_key = 'reading'").select("row_id", F.col("field_value").alias("v"))
    rows = table(spark, sf_dir, "influx_rows").select("row_id", micros_of_ts(F.col("row_ts")).alias("t_us"))
    joined = reading.join(tags, "row_id").join(rows, "row_id").where(regular_grid.usable(F.col("t_us"), F.col("v")))
    influx = joined.select(F.lit("influx_rows").alias("origin"), "device", "t_us", "v")
    return samples.unionByName(influx).where("device is not null"), table(spark, sf_dir, "series_defs")


def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = regular_grid.regular_grid(*grid_inputs(spark, sf_dir))
    return g.select("device", "slot_ms", "status", significant(F.col("value")).alias("value"), "t_us")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = regular_grid.regular_grid(*grid_inputs(spark, sf_dir))
    return g.where("status <> 'observed'").select("device", "slot_ms")


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_loaded, p2_found, p2_key_stats, p4_found, p4_grid)}

_NUM = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# The oracle states the two line formats as whole-line patterns; only the size of numbers is checked apart.
_FIELD_KEY = r"""(?:\\.|"(?:\\.|[^"\\])*"|[^\\",= ])+"""
_VALUE = r"""(?:[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?[0-9]+i|[0-9]+u|t|T|true|True|TRUE|f|F|false|False|FALSE|"(?:\\.|[^"\\])*")"""
_INFLUX = rf"""(?s)(?:\\.|[^\\, ])+(?:,(?:\\.|[^\\,= ])+=(?:\\.|[^\\,= ])+)* +{_FIELD_KEY}={_VALUE}(?:,{_FIELD_KEY}={_VALUE})*(?: +[+-]?[0-9]+)? *"""
_CELL = r"""(?:[^",]*|"(?:[^"]|"")*")"""
_FULL = r"""(?:[^",]+|"(?:[^"]|"")+")"""
_CSV = rf"""(?s)(?:[+-]?[0-9]+|"[+-]?[0-9]+"),{_FULL},{_CELL},{_CELL},{_FULL},"?([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"?"""

_LINES = f"""
  base AS (SELECT line_id, fmt, line, CASE WHEN line LIKE '%' || chr(13) THEN left(line, -1) ELSE line END AS t FROM raw_lines),
  lines AS (SELECT * FROM base WHERE line IS NOT NULL AND NOT regexp_full_match(t, '(?s)[ \\t\\n\\r\\f\\v]*') AND NOT (fmt = 'influx' AND line LIKE '#%')),
  marked AS (SELECT *, regexp_replace(regexp_replace(t, '(?s)\\\\.', 'x', 'g'), '(?s)"[^"]*"', '""', 'g') AS m FROM lines),
  sized AS (SELECT *, regexp_extract_all(m, '=([^,= ]+)', 1) AS vs FROM marked),
  judged AS (SELECT *, CASE fmt
    WHEN 'influx' THEN regexp_full_match(t, '{_INFLUX}')
      AND len(list_filter(vs, lambda v: regexp_full_match(v, '{_NUM}') AND coalesce(isinf(TRY_CAST(v AS DOUBLE)), false))) = 0
      AND len(list_filter(vs, lambda v: regexp_full_match(v, '[+-]?[0-9]+i') AND TRY_CAST(left(v, -1) AS BIGINT) IS NULL)) = 0
      AND len(list_filter(vs, lambda v: regexp_full_match(v, '[0-9]+u') AND TRY_CAST(left(v, -1) AS UBIGINT) IS NULL)) = 0
    WHEN 'csv' THEN regexp_full_match(t, '{_CSV}') AND NOT coalesce(isinf(TRY_CAST(regexp_extract(t, ',"?([^",]*)"?$', 1) AS DOUBLE)), false)
      AND (t LIKE '%"') = regexp_full_match(t, '(?s).*,"[^",]*"')
    ELSE false END AS ok FROM sized)"""


# Why lines are rejected, from their pieces: e has no escapes, q no quoted text; BLANK stands for what was ordinary there.
_BLANK = "§"
_PAIR_BAD = "len(kv) <> 2 OR kv[1] = '' OR kv[2] = ''"
_KIND_OK = f"""(regexp_full_match(v, '{_NUM}') AND NOT coalesce(isinf(TRY_CAST(v AS DOUBLE)), false) OR regexp_full_match(v, '[+-]?[0-9]+i') AND TRY_CAST(left(v, -1) AS BIGINT) IS NOT NULL
    OR regexp_full_match(v, '[0-9]+u') AND TRY_CAST(left(v, -1) AS UBIGINT) IS NOT NULL OR regexp_full_match(v, 't|T|true|True|TRUE|f|F|false|False|FALSE') OR regexp_full_match(v, '"[^"]*"'))"""
_REASONS = rf"""
  bad AS (SELECT * FROM judged WHERE NOT ok),
  i1 AS (SELECT line_id, fmt, regexp_replace(t, '\\[\\, ="]', '{_BLANK}', 'g') AS e FROM bad WHERE fmt = 'influx'),
  i2 AS (SELECT *, regexp_extract(e, '^[^ ]*', 0) AS head, ltrim(substr(e, length(regexp_extract(e, '^[^ ]*', 0)) + 1), ' ') AS rest FROM i1),
  i3 AS (SELECT *, (length(rest) - length(replace(rest, '"', ''))) % 2 = 1 AS odd, regexp_replace(rest, '"[^"]*"', '"{_BLANK}"', 'g') AS q FROM i2),
  i4 AS (SELECT *, rtrim(CASE WHEN odd THEN regexp_replace(q, '"[^"]*$', '"{_BLANK}') ELSE q END, ' ') AS tail FROM i3),
  i5 AS (SELECT *, string_split(head, ',') AS heads, regexp_split_to_array(tail, ' +') AS sections FROM i4),
  i6 AS (SELECT *, list_transform(heads[2:], lambda p: string_split(p, '=')) AS tags, list_transform(string_split(sections[1], ','), lambda p: string_split(p, '=')) AS fields FROM i5),
  influx_why AS (SELECT line_id, fmt, [CASE WHEN heads[1] = '' THEN 'empty_measurement' END, CASE WHEN len(list_filter(tags, lambda kv: {_PAIR_BAD})) > 0 THEN 'bad_tag' END, CASE WHEN tail = '' THEN 'no_fields' END,
    CASE WHEN odd THEN 'unbalanced_quotes' END, CASE WHEN len(sections) > 2 THEN 'too_many_sections' END, CASE WHEN tail <> '' AND len(list_filter(fields, lambda kv: {_PAIR_BAD})) > 0 THEN 'bad_field' END,
    CASE WHEN tail <> '' AND len(list_filter(fields, lambda kv: len(kv) = 2 AND NOT {_KIND_OK.replace("(v", "(kv[2]").replace("left(v", "left(kv[2]")})) > 0 THEN 'bad_field_value' END,
    CASE WHEN len(sections) = 2 AND NOT regexp_full_match(sections[2], '[+-]?[0-9]+') THEN 'bad_time' END] AS why FROM i6),
  c1 AS (SELECT line_id, fmt, t, string_split(t, '"') AS pieces FROM bad WHERE fmt = 'csv'),
  c2 AS (SELECT *, string_split(array_to_string(list_transform(pieces, lambda p, i: CASE WHEN i % 2 = 0 THEN replace(p, ',', '{_BLANK}') ELSE p END), '"'), ',') AS cells FROM c1),
  c3 AS (SELECT *, list_transform(cells, lambda c: CASE WHEN regexp_full_match(c, '(?s)".*"') THEN replace(c[2:-2], '""', '"') ELSE c END) AS plain,
    len(list_filter(cells, lambda c: contains(c, '"') AND NOT (regexp_full_match(c, '(?s)".*"') AND NOT contains(replace(c[2:-2], '""', ''), '"')))) > 0 AS cell_bad FROM c2),
  csv_why AS (SELECT line_id, fmt, [CASE WHEN len(cells) <> 6 THEN 'column_count' END, CASE WHEN len(pieces) % 2 = 0 OR cell_bad THEN 'bad_quoting' END,
    CASE WHEN len(cells) = 6 AND NOT regexp_full_match(plain[1], '[+-]?[0-9]+') THEN 'bad_time' END, CASE WHEN len(cells) = 6 AND plain[2] = '' THEN 'empty_measurement' END,
    CASE WHEN len(cells) = 6 AND plain[5] = '' THEN 'empty_field' END,
    CASE WHEN len(cells) = 6 AND NOT (regexp_full_match(plain[6], '{_NUM}') AND NOT coalesce(isinf(TRY_CAST(plain[6] AS DOUBLE)), false)) THEN 'bad_field_value' END] AS why FROM c2 JOIN c3 USING (line_id, fmt, t, pieces, cells)),
  other_why AS (SELECT line_id, fmt, ['unknown_format'] AS why FROM bad WHERE fmt IS NULL OR fmt NOT IN ('influx', 'csv'))"""
# What valid lines hold: whole-line patterns are taken apart by the same pieces they are made of.
_HEAD = r"^((?:\\.|[^\\, ])+)((?:,(?:\\.|[^\\,= ])+=(?:\\.|[^\\,= ])+)*)"
_FIELDS = rf"{_FIELD_KEY}={_VALUE}(?:,{_FIELD_KEY}={_VALUE})*"
_ONE_TAG, _ONE_FIELD = r",((?:\\.|[^\\,= ])+)=((?:\\.|[^\\,= ])+)", rf"""(?:^|,)({_FIELD_KEY})=("(?:\\.|[^"\\])*"|[^",= ]+)"""


def _plain(x: str) -> str:
    """Text without its escapes."""
    return rf"""regexp_replace({x}, '\\([\\, ="])', '\1', 'g')"""


_LOADED = rf"""
  good AS (SELECT * FROM judged WHERE ok),
  g1 AS (SELECT line_id, regexp_extract(t, '(?s){_HEAD}', 1) AS m, regexp_extract(t, '(?s){_HEAD}', 2) AS tags, ltrim(regexp_replace(t, '(?s){_HEAD}', ''), ' ') AS rest FROM good WHERE fmt = 'influx'),
  g2 AS (SELECT *, regexp_extract(rest, '(?s)^({_FIELDS})(?: +([+-]?[0-9]+))? *$', 1) AS fields, nullif(regexp_extract(rest, '(?s)^({_FIELDS})(?: +([+-]?[0-9]+))? *$', 2), '') AS time FROM g1),
  h1 AS (SELECT line_id, list_transform(regexp_extract_all(t, '(?s)(?:^|,)("(?:[^"]|"")*"|[^",]*)', 1), lambda c: CASE WHEN c LIKE '"%' THEN replace(c[2:-2], '""', '"') ELSE c END) AS c FROM good WHERE fmt = 'csv'),
  tag AS (SELECT line_id, i, {_plain("k[i]")} AS key, {_plain("v[i]")} AS val FROM
      (SELECT line_id, regexp_extract_all(tags, '(?s){_ONE_TAG}', 1) AS k, regexp_extract_all(tags, '(?s){_ONE_TAG}', 2) AS v, unnest(range(1, len(k) + 1)) AS i FROM g2)
    UNION ALL SELECT line_id, 1, 'host', c[3] FROM h1 WHERE c[3] <> '' UNION ALL SELECT line_id, 2, 'zone', c[4] FROM h1 WHERE c[4] <> ''),
  tags1 AS (SELECT line_id, string_agg(key || '=' || val, ',' ORDER BY key) AS tags FROM (SELECT line_id, key, arg_max(val, i) AS val FROM tag GROUP BY line_id, key) GROUP BY line_id),
  field AS (SELECT line_id, i - 1 AS field_no, {_plain("k[i]")} AS field_key, v[i] AS v FROM
      (SELECT line_id, regexp_extract_all(fields, '(?s){_ONE_FIELD}', 1) AS k, regexp_extract_all(fields, '(?s){_ONE_FIELD}', 2) AS v, unnest(range(1, len(k) + 1)) AS i FROM g2)),
  typed AS (SELECT *, CASE WHEN v LIKE '"%' THEN 'string' WHEN regexp_full_match(v, '[+-]?[0-9]+i') THEN 'int' WHEN regexp_full_match(v, '[0-9]+u') THEN 'uint' WHEN regexp_full_match(v, '{_NUM}') THEN 'float' ELSE 'bool' END AS kind FROM field),
  whole AS (SELECT line_id, 'influx' AS fmt, {_plain("m")} AS measurement, TRY_CAST(time AS BIGINT) AS ts, CAST(field_no AS INTEGER) AS field_no, field_key, kind,
      CASE kind WHEN 'float' THEN TRY_CAST(v AS DOUBLE) WHEN 'bool' THEN CAST(lower(left(v, 1)) = 't' AS DOUBLE) WHEN 'string' THEN NULL ELSE TRY_CAST(left(v, -1) AS DOUBLE) END AS number,
      CASE WHEN kind IN ('int', 'uint') THEN CAST(TRY_CAST(left(v, -1) AS HUGEINT) AS VARCHAR) END AS exact, CASE WHEN kind = 'string' THEN {_plain("v[2:-2]")} END AS text FROM typed JOIN g2 USING (line_id)
    UNION ALL SELECT line_id, 'csv', c[2], TRY_CAST(c[1] AS BIGINT), 0, c[5], 'float', TRY_CAST(c[6] AS DOUBLE), NULL, NULL FROM h1)"""


def _knot_sql() -> str:
    return """
  readings AS (
    SELECT 'input_samples' AS origin, labels['device'] AS device, timestamp_ms * 1000 AS t, value AS v FROM input_samples
    WHERE NOT is_stale AND isfinite(value) AND timestamp_ms BETWEEN -100000000000000 AND 100000000000000
    UNION ALL
    SELECT 'influx_rows', g.tag_value, epoch_us(r.row_ts), f.field_value FROM influx_rows r
    JOIN influx_tags g ON g.row_id = r.row_id AND g.tag_key = 'device'
    JOIN influx_fields f ON f.row_id = r.row_id AND f.field_key = 'reading'
    WHERE r.row_ts IS NOT NULL AND isfinite(f.field_value)),
  slots AS (
    SELECT origin, device, k, start_ms + k * step_ms AS slot_ms
    FROM (SELECT *, unnest(range((end_ms - start_ms) // step_ms)) AS k FROM series_defs)),
  knots AS (
    SELECT d.origin, d.device, (t - start_ms * 1000) // (step_ms * 1000) AS k, max({'t': t, 'v': v}) AS q
    FROM readings r JOIN series_defs d ON d.origin = r.origin AND d.device = r.device AND t >= start_ms * 1000 AND t < end_ms * 1000
    GROUP BY ALL)"""


ORACLE = {
    "p1_found": f"WITH {_LINES} SELECT line_id FROM judged WHERE NOT ok",
    "p1_rejects": f"""WITH {_LINES}, {_REASONS} SELECT line_id, fmt, array_to_string(list_filter(why, lambda w: w IS NOT NULL), ',') AS reasons
        FROM (SELECT * FROM influx_why UNION ALL SELECT * FROM csv_why UNION ALL SELECT * FROM other_why)""",
    "p1_loaded": f"WITH {_LINES}, {_LOADED} SELECT w.*, coalesce(tags, '') AS tags FROM whole w LEFT JOIN tags1 USING (line_id)",
    "p2_found": """
        WITH k AS (SELECT 'got_rows' AS tbl, metric_group AS hot_key FROM got_rows UNION ALL SELECT 'influx_rows', measurement FROM influx_rows),
        n AS (SELECT tbl, hot_key, count(*) AS c, sum(count(*)) OVER (PARTITION BY tbl) AS total FROM k GROUP BY tbl, hot_key)
        SELECT tbl, hot_key FROM n WHERE hot_key IS NOT NULL AND c * 100 >= total * 3""",
    "p2_key_stats": """
        WITH f AS (SELECT row_id, sum(field_value) FILTER (isfinite(field_value)) AS v FROM influx_fields GROUP BY row_id)
        SELECT 'got_rows' AS tbl, metric_group AS key, count(*) AS n_rows, min(ts_ms) AS first_time, max(ts_ms) AS last_time,
               CAST(printf('%.11e', sum(value) FILTER (isfinite(value))) AS DOUBLE) AS value_sum FROM got_rows GROUP BY metric_group
        UNION ALL
        SELECT 'influx_rows', measurement, count(*), epoch_us(min(row_ts)), epoch_us(max(row_ts)), CAST(printf('%.11e', sum(v)) AS DOUBLE)
        FROM influx_rows LEFT JOIN f USING (row_id) GROUP BY measurement""",
    "p4_found": f"WITH {_knot_sql()} SELECT s.device, slot_ms FROM slots s ANTI JOIN knots n ON n.origin = s.origin AND n.device = s.device AND n.k = s.k",
    "p4_grid": f"""
        WITH {_knot_sql()},
        ctx AS (SELECT origin, device, k, q, lag(k) OVER w AS ka, lag(q) OVER w AS qa, lead(k) OVER w AS kc, lead(q) OVER w AS qc, lead(q, 2) OVER w AS qd
                FROM knots WINDOW w AS (PARTITION BY origin, device ORDER BY k)),
        near AS (SELECT s.device, s.slot_ms, s.k, c.k AS kb, c.q AS qb, c.kc, c.qa, c.qc, c.qd
                 FROM slots s ASOF LEFT JOIN ctx c ON s.origin = c.origin AND s.device = c.device AND s.k >= c.k),
        h AS (SELECT *, qb.t - qa.t AS h0, qc.t - qb.t AS h1, qd.t - qc.t AS h2,
                (qb.v - qa.v) / (qb.t - qa.t) AS d0, (qc.v - qb.v) / (qc.t - qb.t) AS d1, (qd.v - qc.v) / (qd.t - qc.t) AS d2 FROM near),
        e AS (SELECT *, ((2 * h1 + h2) * d1 - h1 * d2) / (h1 + h2) AS e1, ((2 * h1 + h0) * d1 - h1 * d0) / (h1 + h0) AS e2 FROM h),
        m AS (SELECT *,
            CASE WHEN qa IS NOT NULL THEN CASE WHEN d0 * d1 > 0 THEN 3 * (h0 + h1) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) ELSE 0 END
                 WHEN qd IS NOT NULL THEN CASE WHEN e1 * d1 <= 0 THEN 0 WHEN d1 * d2 < 0 AND abs(e1) > 3 * abs(d1) THEN 3 * d1 ELSE e1 END ELSE d1 END AS m1,
            CASE WHEN qd IS NOT NULL THEN CASE WHEN d1 * d2 > 0 THEN 3 * (h1 + h2) / ((2 * h2 + h1) / d1 + (h2 + 2 * h1) / d2) ELSE 0 END
                 WHEN qa IS NOT NULL THEN CASE WHEN e2 * d1 <= 0 THEN 0 WHEN d0 * d1 < 0 AND abs(e2) > 3 * abs(d1) THEN 3 * d1 ELSE e2 END ELSE d1 END AS m2,
            (slot_ms * 1000 - qb.t) / h1 AS s FROM e),
        r AS (SELECT *, CASE WHEN kb = k THEN 'observed' WHEN qb IS NULL OR qc IS NULL THEN 'edge' WHEN kc - kb - 1 <= 12 THEN 'filled' ELSE 'gap' END AS status FROM m)
        SELECT device, slot_ms, status, CASE WHEN status = 'observed' THEN qb.t END AS t_us, CAST(printf('%.11e', CASE status WHEN 'observed' THEN qb.v
            WHEN 'filled' THEN qb.v * (1 + 2 * s) * (1 - s) * (1 - s) + h1 * m1 * s * (1 - s) * (1 - s) + qc.v * s * s * (3 - 2 * s) + h1 * m2 * s * s * (s - 1) END) AS DOUBLE) AS value FROM r""",
}
