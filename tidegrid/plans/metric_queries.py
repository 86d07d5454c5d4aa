"""Queries of the metric engine on the test tables, with equivalent SQL.

Samples come from three tables: events_value{event_type,user_id}, orders_totalprice{status,priority}
and lineitem_quantity{returnflag,linestatus} (daily sums of the latter two).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import MetricsEngine
from ..functions import rollups
from ..operators.dedup import deduplicate
from ..operators.relabel import relabel
from ..rules import rules
from ..sources import formats, store
from ..streaming import aggregation

C = F.col
HOUR, DAY = 3_600_000, 86_400_000
NUDGE = 3e-8  # moves exact decimals off the ties of rounding, where the last bit would decide
# 2024-01-01 to 2024-01-31 in steps of six hours: windows that end on this grid hold all events
START, END, STEP = 1704067200000, 1706659200000, 6 * HOUR
DAY0, DAY1 = 788918400000, 1009756800000  # 1995 to 2001: the same for orders and lineitem


def millis(ts: str) -> Column:
    return F.floor(F.unix_micros(C(ts).cast("timestamp")) / 1000).cast("bigint")


def _samples(name: str, labels: dict[str, Column], ts: Column, value: Column, df: DataFrame) -> DataFrame:
    m = F.create_map(*(x for k, c in labels.items() for x in (F.lit(k), c.cast("string"))))
    return df.select(F.lit(name).alias("name"), m.alias("labels"), ts.alias("ts_ms"), value.cast("double").alias("value"), F.lit(False).alias("is_stale"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _samples("events_value", {"event_type": C("event_type"), "user_id": C("user_id")}, millis("ts"), C("value"), d)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus", "o_orderpriority", "o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    return _samples("orders_totalprice", {"status": C("o_orderstatus"), "priority": C("o_orderpriority")}, millis("o_orderdate"), C("v"), d)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus", "l_shipdate").agg(F.sum("l_quantity").alias("v"))
    return _samples("lineitem_quantity", {"returnflag": C("l_returnflag"), "linestatus": C("l_linestatus")}, millis("l_shipdate"), C("v"), d)


TABLES = {"events": events, "orders": orders, "lineitem": lineitem}


def flat(result: DataFrame, labels: list[str]) -> DataFrame:
    """Labels as columns (null where absent), the value rounded for comparison."""
    cols = [F.try_element_at("labels", F.lit(x)).alias(x) for x in labels]
    return result.select("name", *cols, "ts_ms", (F.round(C("value") + NUDGE, 4) + 0.0).alias("value"), *(["ord"] if "ord" in result.columns else []))


def at_once(query: str, labels: list[str], t: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(MetricsEngine(events(spark, sf_dir)).query(query, t / 1000), labels)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def adder(queries: dict, oracle: dict) -> Callable:
    """A function that adds a query and its SQL."""

    def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
        if name in queries:
            raise ValueError(f"{name} is there already")
        queries[name] = run
        if sql:
            sql = rounded_alike(sql)
            # decimal literals make decimals in SQL: results are doubles
            oracle[name] = f"SELECT * REPLACE (CAST(value AS DOUBLE) AS value) FROM ({sql})" if " AS value" in sql and not name.startswith("list_") else sql

    return add


add = adder(QUERIES, ORACLE)


def rounded_alike(sql: str) -> str:
    """SQL whose round(x, 4) adds NUDGE and makes negative zeros positive, as flat() does."""
    out, at = "", 0
    while (i := sql.find("round(", at)) >= 0:
        depth, j = 1, i + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        inner = sql[i + len("round(") : j - 1]
        body = rounded_alike(inner[: -len(", 4")]) if inner.endswith(", 4") else None
        out += sql[at:i] + (f"(round(({body}) + {NUDGE}, 4) + 0.0)" if body is not None else f"round({inner})")
        at = j
    return out + sql[at:]


EL = ["event_type", "user_id"]
W2 = 2 * DAY
_GROUP = rules.Group("g", [], "6h")



def ranged(query: str, labels: list[str], table: str = "events", first: int = START, last: int = END, step: int = STEP) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = MetricsEngine(TABLES[table](spark, sf_dir))
        return flat(e.query_range(query, first / 1000, last / 1000, step), labels)

    return run

# SQL building blocks
S = "s AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t, value AS v FROM events WHERE value IS NOT NULL)"

def grid_sql(first: int = START, last: int = END, step: int = STEP) -> str:
    return f"grid AS (SELECT {first} + {step} * unnest(range({(last - first) // step + 1})) AS g)"

def rolled(agg: str, w: int, where: str = "true", name: str = "r", step: int = STEP) -> str:
    """CTEs giving r(event_type, user_id, g, v): an aggregate of the samples in (g - w, g]."""
    return f"{S}, {grid_sql(step=step)}, {name} AS (SELECT event_type, user_id, g, {agg} AS v FROM s JOIN grid ON t > g - {w} AND t <= g WHERE {where} GROUP BY event_type, user_id, g)"

def series_out(name: str, cte: str, value: str = "v", where: str = "v IS NOT NULL") -> str:
    return f"WITH {cte} SELECT '{name}' AS name, event_type, user_id, g AS ts_ms, round({value}, 4) AS value FROM r WHERE {where}"

# rollups whose windows need no neighbouring samples
_PLAIN_SQL = {
    "avg_over_time": "avg(v)",
    "count_over_time": "CAST(count(v) AS DOUBLE)",
    "sum_over_time": "sum(v)",
    "sum2_over_time": "sum(v * v)",
    "min_over_time": "min(v)",
    "max_over_time": "max(v)",
    "range_over_time": "max(v) - min(v)",
    "median_over_time": "quantile_cont(v, 0.5)",
    "present_over_time": "1.0",
    "stddev_over_time": "stddev_pop(v)",
    "stdvar_over_time": "var_pop(v)",
    "first_over_time": "arg_min(v, t)",
    "last_over_time": "arg_max(v, t)",
    "tfirst_over_time": "min(t) / 1000.0",
    "tlast_over_time": "max(t) / 1000.0",
    "timestamp": "max(t) / 1000.0",
    "timestamp_with_name": "max(t) / 1000.0",
    "tmax_over_time": "arg_max(t, {'v': v, 't': t}) / 1000.0",
    "tmin_over_time": "arg_max(t, {'v': -v, 't': t}) / 1000.0",
    "delta_prometheus": "CASE WHEN count(v) > 1 THEN arg_max(v, t) - arg_min(v, t) END",
    "distinct_over_time": "CAST(count(DISTINCT v) AS DOUBLE)",
    "geomean_over_time": "pow(product(v), 1.0 / count(v))",
    "rate_over_sum": f"sum(v) / {W2 / 1000}",
    "zscore_over_time": "CASE WHEN stddev_pop(v) = 0 THEN 0 ELSE (arg_max(v, t) - avg(v)) / stddev_pop(v) END",
    "deriv": "CASE WHEN count(v) > 1 THEN regr_slope(v, t / 1000.0) END",
}
_KEEPS = rollups.names.ROLLUPS_KEEP_NAME
for _f, _sql in _PLAIN_SQL.items():
    add(f"rollup_{_f}", ranged(f"{_f}(events_value[2d])", EL), series_out("events_value" if _f in _KEEPS else "", rolled(_sql, W2)))

for _f, _arg, _sql in (
    ("quantile_over_time", "0.9", "quantile_cont(v, 0.9)"),
    ("count_gt_over_time", "50", "CAST(count(*) FILTER (v > 50) AS DOUBLE)"),
    ("count_le_over_time", "50", "CAST(count(*) FILTER (v <= 50) AS DOUBLE)"),
    ("share_gt_over_time", "50", "avg(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END)"),
    ("sum_gt_over_time", "50", "sum(v) FILTER (v > 50)"),
):
    _q = f"{_f}({_arg}, events_value[2d])" if _f in rollups.FIRST else f"{_f}(events_value[2d], {_arg})"
    add(f"rollup_{_f}", ranged(_q, EL), series_out("events_value" if _f in _KEEPS else "", rolled(_sql, W2)))

# rollups that read neighbouring samples: lag and lead in SQL, gaps by the sample before them
_MPI = "CASE WHEN i <= 2000 THEN i * 5 WHEN i <= 4000 THEN i * 3 WHEN i <= 8000 THEN i * 2 WHEN i <= 16000 THEN i + i // 2 WHEN i <= 32000 THEN i + i // 4 ELSE i + i // 8 END"

def ordered_cte(resets: bool = False, w: int = W2, where: str = "true") -> str:
    """CTE x(event_type, user_id, g, ...) with what the neighbour-reading rollups need."""
    lo = START - max(w, STEP) - rollups.SILENCE_MS
    base = f"{S}, {grid_sql()}, f AS (SELECT * FROM s WHERE {where} AND t BETWEEN {lo} AND {END})"
    if resets:
        drop = "CASE WHEN v < p THEN CASE WHEN (p - v) * 8 < p THEN p - v ELSE p END ELSE 0 END"
        base += f""", f1 AS (SELECT *, lag(v) OVER (PARTITION BY event_type, user_id ORDER BY t) AS p FROM f),
      f2 AS (SELECT event_type, user_id, t, v + sum({drop}) OVER (PARTITION BY event_type, user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS u FROM f1),
      f3 AS (SELECT event_type, user_id, t, max(u) OVER (PARTITION BY event_type, user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM f2)"""
    src = "f3" if resets else "f"
    return f"""{base},
  n AS (SELECT *, lag(t) OVER o AS pt, lag(v) OVER o AS pv, lead(t) OVER o AS nt, lead(v) OVER o AS nv, row_number() OVER (PARTITION BY event_type, user_id ORDER BY t DESC) AS rn
        FROM {src} WINDOW o AS (PARTITION BY event_type, user_id ORDER BY t)),
  iv AS (SELECT event_type, user_id, coalesce(CAST(floor(quantile_cont(t - pt, 0.6) FILTER (rn <= 20)) AS BIGINT), 0) AS i0 FROM n GROUP BY event_type, user_id),
  m AS (SELECT event_type, user_id, {_MPI} AS mpi FROM (SELECT event_type, user_id, CASE WHEN i0 > 0 THEN i0 ELSE {STEP} END AS i FROM iv)),
  ch AS (SELECT n.*, mpi, CASE WHEN pv IS NULL THEN NULL WHEN v <> pv AND NOT abs(v - pv) < 1e-12 * abs(v) THEN 1.0 ELSE 0.0 END AS c, CASE WHEN v < pv AND NOT abs(v - pv) < 1e-12 * abs(v) THEN 1.0 ELSE 0.0 END AS d FROM n JOIN m USING (event_type, user_id)),
  inside AS (SELECT event_type, user_id, g, count(*) AS n, arg_min(v, t) AS fv, min(t) AS ft, arg_max(v, t) AS lv, max(t) AS lt, arg_min(coalesce(pv, 'nan'), t) AS fpv0, arg_min(coalesce(pt, 0), t) AS fpt,
               arg_min(coalesce(nv - v, 0), t) AS fd, arg_max(coalesce(pv, 'nan'), t) AS lpv0, arg_max(coalesce(pt, 0), t) AS lpt, sum(coalesce(c, 1)) AS changes, sum(coalesce(c, 0)) AS c_all, arg_min(coalesce(c, 0), t) AS c_1, sum(d) AS d_all, arg_min(d, t) AS d_1, max(mpi) AS mpi
             FROM ch JOIN grid ON t > g - {w} AND t <= g GROUP BY event_type, user_id, g),
  x AS (SELECT *, CASE WHEN isnan(fpv0) THEN NULL ELSE fpv0 END AS fpv, CASE WHEN isnan(lpv0) THEN NULL ELSE lpv0 END AS lpv, NOT isnan(fpv0) AND fpt > g - {w} - mpi AS ok FROM inside),
  gap AS (SELECT event_type, user_id, g, t FROM ch JOIN grid ON t <= g - {w} AND nt > g AND t > g - {w} - mpi)"""

def ordered_sql(value: str, gap: str | None, resets: bool = False) -> str:
    sql = f"WITH {ordered_cte(resets)} SELECT '' AS name, event_type, user_id, g AS ts_ms, round({value}, 4) AS value FROM x WHERE ({value}) IS NOT NULL"
    return sql + (f" UNION ALL SELECT '', event_type, user_id, g, round({gap}, 4) FROM gap" if gap else "")

_DELTA = "CASE WHEN fpv IS NOT NULL THEN lv - fpv WHEN abs(fv) < 10 * (abs(fd) + 1) THEN lv WHEN n = 1 THEN 0 ELSE lv - fv END"
_FAST = "CASE WHEN ok THEN (lv - fpv) / ((lt - fpt) / 1000.0) WHEN n > 1 THEN (lv - fv) / ((lt - ft) / 1000.0) END"
_LAST2 = "CASE WHEN n > 1 OR ok THEN (lv - lpv) / ((lt - lpt) / 1000.0) END"
for _f, _v, _g, _r in (
    ("delta", _DELTA, "0.0", False),
    ("increase", _DELTA, "0.0", True),
    ("increase_pure", "lv - coalesce(fpv, 0)", "0.0", True),
    ("increase_prometheus", "CASE WHEN n > 1 THEN lv - fv END", None, True),
    ("deriv_fast", _FAST, "0.0", False),
    ("rate", _FAST, "0.0", True),
    ("rate_prometheus", f"CASE WHEN n > 1 THEN (lv - fv) / {W2 / 1000} END", None, True),
    ("ideriv", _LAST2, None, False),
    ("irate", _LAST2, None, True),
    ("idelta", "CASE WHEN n > 1 OR ok THEN lv - lpv ELSE lv END", "0.0", False),
    ("lag", "(g - lt) / 1000.0", "(g - t) / 1000.0", False),
    ("changes", "changes", "0.0", False),
    ("changes_prometheus", "c_all - c_1", None, False),
    ("resets", "CASE WHEN ok THEN d_all ELSE d_all - d_1 END", "0.0", False),
):
    _sql = ordered_sql(_v, _g, _r)
    if _f in ("increase_prometheus", "rate_prometheus", "changes_prometheus"):
        _sql = _sql.replace(f"BETWEEN {START - W2 - rollups.SILENCE_MS}", f"BETWEEN {START - W2}")
    add(f"rollup_{_f}", ranged(f"{_f}(events_value[2d])", EL), _sql)

add("selector_default_rollup", ranged('events_value{event_type="click"}[12h]', EL), series_out("events_value", rolled("arg_max(v, t)", 12 * HOUR, "event_type = 'click'")))
add(
    "selector_windowless",
    ranged('events_value{event_type="click"}', EL),
    f"""WITH {ordered_cte(w=STEP, where="event_type = 'click'")}, y AS (SELECT event_type, user_id, g, arg_max(v, t) AS v FROM ch JOIN grid ON t > g - greatest({STEP}, mpi) AND t <= g GROUP BY event_type, user_id, g)
    SELECT 'events_value' AS name, event_type, user_id, g AS ts_ms, round(v, 4) AS value FROM y""",
)
add("selector_regex_or", ranged('sum_over_time(events_value{event_type=~"cl.*|view", user_id!~"1.*" or event_type="purchase"}[1d])', EL), series_out("", rolled("sum(v)", DAY, "(regexp_full_match(event_type, 'cl.*|view') AND NOT regexp_full_match(user_id, '1.*')) OR event_type = 'purchase'")))
add("selector_absent_label", ranged('count_over_time(events_value{nope="", event_type!=""}[1d])', EL), series_out("", rolled("CAST(count(v) AS DOUBLE)", DAY)))
add("offset_at", ranged(f"sum(count_over_time(events_value[1d] offset 3d)) - sum(count_over_time(events_value[1d] @ {END // 1000 - 864000}))", []), f"""WITH {S}, {grid_sql()}, a AS (SELECT g, count(*) AS n FROM s JOIN grid ON t > g - {4 * DAY} AND t <= g - {3 * DAY} GROUP BY g), b AS (SELECT count(*) AS n FROM s WHERE t > {END - 864000000 - DAY} AND t <= {END - 864000000})
SELECT '' AS name, g AS ts_ms, round(CAST(a.n - b.n AS DOUBLE), 4) AS value FROM a, b""")
add("absent_over_time", ranged('absent_over_time(events_value{event_type="click",user_id="1"}[12h])', EL), f"WITH {S}, {grid_sql()} SELECT '' AS name, 'click' AS event_type, '1' AS user_id, g AS ts_ms, 1.0 AS value FROM grid WHERE NOT EXISTS (SELECT 1 FROM s WHERE event_type = 'click' AND user_id = '1' AND t > g - {12 * HOUR} AND t <= g)")
add("subquery_max", ranged("max_over_time(sum(count_over_time(events_value[1d]))[2d:6h])", []), f"""WITH {S}, gi AS (SELECT {START - 3 * DAY} + {STEP} * unnest(range({(END - START + 3 * DAY) // STEP + 1})) AS gi), {grid_sql()},
i AS (SELECT gi, count(*) AS v FROM s JOIN gi ON t > gi - {DAY} AND t <= gi GROUP BY gi) SELECT '' AS name, g AS ts_ms, CAST(max(v) AS DOUBLE) AS value FROM i JOIN grid ON gi > g - {W2} AND gi <= g GROUP BY g""")

# aggregations across series
_DAILY = rolled("sum(v)", DAY)
_GEO = rolled("sum(v * v) + 1", DAY, "user_id < '2'")

def grouped(agg: str, by: str | None, cte: str = _DAILY) -> str:
    keys = f"{by}, " if by else ""
    return f"WITH {cte} SELECT '' AS name, {keys}g AS ts_ms, round({agg}, 4) AS value FROM r GROUP BY {keys}g HAVING ({agg}) IS NOT NULL"

for _f, _sql in {
    "sum": "sum(v)",
    "sum2": "sum(v * v)",
    "min": "min(v)",
    "max": "max(v)",
    "avg": "avg(v)",
    "count": "CAST(count(v) AS DOUBLE)",
    "group": "1.0",
    "stddev": "stddev_pop(v)",
    "stdvar": "var_pop(v)",
    "median": "quantile_cont(v, 0.5)",
    "distinct": "CAST(count(DISTINCT v) AS DOUBLE)",
}.items():
    add(f"aggr_{_f}", ranged(f"{_f}(sum_over_time(events_value[1d])) by (event_type)", ["event_type"]), grouped(_sql, "event_type"))
add("aggr_geomean", ranged("geomean(sum2_over_time(events_value[1d]) + 1) by (event_type)", ["event_type"]), grouped("exp(avg(ln(v)))", "event_type", rolled("sum(v * v) + 1", DAY)))
add("aggr_without", ranged("max(sum_over_time(events_value[1d])) without (user_id)", ["event_type"]), grouped("max(v)", "event_type"))
add("aggr_all", ranged("sum(sum_over_time(events_value[1d]))", []), grouped("sum(v)", None))
add("aggr_quantile", ranged("quantile(0.25, sum_over_time(events_value[1d])) by (event_type)", ["event_type"]), grouped("quantile_cont(v, 0.25)", "event_type"))
add("aggr_limit", ranged("count(sum_over_time(events_value[1d])) by (event_type) limit 2", ["event_type"]), grouped("CAST(count(v) AS DOUBLE)", "event_type", _DAILY.replace("WHERE true", "WHERE event_type IN (SELECT event_type FROM s GROUP BY event_type ORDER BY event_type LIMIT 2)")))
add("aggr_any", ranged("any(count_over_time(events_value[20d])) by (event_type)", EL), f"""WITH {rolled('CAST(count(v) AS DOUBLE)', 20 * DAY)}, f AS (SELECT event_type, min(user_id) AS user_id FROM r GROUP BY event_type)
SELECT '' AS name, event_type, user_id, g AS ts_ms, v AS value FROM r JOIN f USING (event_type, user_id)""")
add("aggr_topk", ranged("topk(3, sum_over_time(events_value[1d])) by (event_type)", EL), f"WITH {_DAILY} SELECT '' AS name, event_type, user_id, g AS ts_ms, round(v, 4) AS value FROM r QUALIFY row_number() OVER (PARTITION BY event_type, g ORDER BY v DESC, user_id) <= 3")
add("aggr_share", ranged("share(count_over_time(events_value[1d])) by (event_type)", EL), f"WITH {rolled('CAST(count(v) AS DOUBLE)', DAY)} SELECT '' AS name, event_type, user_id, g AS ts_ms, round(v / sum(v) OVER (PARTITION BY event_type, g), 4) AS value FROM r")
add("aggr_count_values", ranged('count_values("n", count_over_time(events_value[1d])) by (event_type)', ["event_type", "n"]), f"WITH {rolled('count(v)', DAY)} SELECT '' AS name, event_type, CAST(v AS VARCHAR) AS n, g AS ts_ms, CAST(count(*) AS DOUBLE) AS value FROM r GROUP BY event_type, v, g")
add("flagship_max_by", ranged('max(max_over_time(events_value{event_type=~"click|view"}[1d])) by (event_type)', ["event_type"]), grouped("max(v)", "event_type", rolled("max(v)", DAY, "event_type IN ('click', 'view')")))
add("double_groupby", ranged("avg(avg_over_time(events_value[1d])) by (__name__, event_type)", ["event_type"]), grouped("avg(v)", "event_type", rolled("avg(v)", DAY)).replace("'' AS name", "'events_value' AS name"))

# binary operators
_TWO = f"{S}, {grid_sql()}, a AS (SELECT event_type, user_id, g, sum(v) AS v FROM s JOIN grid ON t > g - {DAY} AND t <= g GROUP BY ALL), b AS (SELECT event_type, user_id, g, CAST(count(v) AS DOUBLE) AS v FROM s JOIN grid ON t > g - {W2} AND t <= g WHERE event_type <> 'click' GROUP BY ALL)"
_A, _B = "sum_over_time(events_value[1d])", 'count_over_time(events_value{event_type!="click"}[2d])'

def paired(value: str, where: str = "true") -> str:
    return f"WITH {_TWO} SELECT '' AS name, event_type, user_id, a.g AS ts_ms, round({value}, 4) AS value FROM a JOIN b USING (event_type, user_id, g) WHERE {where}"

for _f, _op, _sql in (("add", "+", "a.v + b.v"), ("sub", "-", "a.v - b.v"), ("mul", "*", "a.v * b.v"), ("div", "/", "a.v / b.v"), ("mod", "%", "fmod(a.v, b.v)"), ("atan2", "atan2", "atan2(a.v, b.v)")):
    add(f"binary_{_f}", ranged(f"{_A} {_op} {_B}", EL), paired(_sql))
add("binary_pow", ranged(f"({_B} / 100) ^ 2", EL), f"WITH {_TWO} SELECT '' AS name, event_type, user_id, g AS ts_ms, round(pow(v / 100, 2), 4) AS value FROM b")
for _f, _op in (("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<="), ("eq", "=="), ("ne", "!=")):
    _s = {"==": "=", "!=": "<>"}.get(_op, _op)
    add(f"compare_{_f}", ranged(f"{_B} {_op} 3", EL), f"WITH {_TWO} SELECT '' AS name, event_type, user_id, g AS ts_ms, v AS value FROM b WHERE v {_s} 3")
add("compare_bool", ranged(f"{_A} > bool {_B}", EL), paired("CASE WHEN a.v > b.v THEN 1.0 ELSE 0.0 END"))
add("compare_default", ranged(f"({_B} > 3) default -1", EL), f"WITH {_TWO}, ss AS (SELECT DISTINCT event_type, user_id FROM b) SELECT '' AS name, event_type, user_id, grid.g AS ts_ms, CASE WHEN b.v > 3 THEN b.v ELSE -1.0 END AS value FROM ss CROSS JOIN grid LEFT JOIN b USING (event_type, user_id, g)")
add("set_and", ranged(f"{_A} and {_B}", EL), paired("a.v"))
add("set_if", ranged(f"{_A} if {_B}", EL), paired("a.v"))
_ANTI = f"WITH {_TWO} SELECT '' AS name, event_type, user_id, g AS ts_ms, round(v, 4) AS value FROM a ANTI JOIN b USING (event_type, user_id, g)"
add("set_unless", ranged(f"{_A} unless {_B}", EL), _ANTI)
add("set_ifnot", ranged(f"{_A} ifnot {_B}", EL), _ANTI)
add("set_or", ranged(f"({_B} > 4) or ({_B} < 2)", EL), f"WITH {_TWO} SELECT '' AS name, event_type, user_id, g AS ts_ms, v AS value FROM b WHERE v > 4 OR v < 2")
add("set_union", ranged(f"union({_B} > 4, {_B})", EL), f"WITH {_TWO} , big AS (SELECT DISTINCT event_type, user_id FROM b) SELECT '' AS name, event_type, user_id, g AS ts_ms, v AS value FROM b WHERE v > 4")
add("join_group_left", ranged("sum_over_time(events_value[1d]) / on(event_type) group_left sum(sum_over_time(events_value[1d])) by (event_type)", EL), f"WITH {_DAILY} SELECT '' AS name, event_type, user_id, g AS ts_ms, round(v / sum(v) OVER (PARTITION BY event_type, g), 4) AS value FROM r")
add("join_group_right", ranged("sum(count_over_time(events_value[1d])) by (event_type) * on(event_type) group_right count_over_time(events_value[1d])", EL), f"WITH {rolled('CAST(count(v) AS DOUBLE)', DAY)} SELECT '' AS name, event_type, user_id, g AS ts_ms, round(v * sum(v) OVER (PARTITION BY event_type, g), 4) AS value FROM r")
add("join_ignoring", ranged("sum(sum_over_time(events_value[1d])) by (event_type) - ignoring(x) count(count_over_time(events_value[1d])) by (event_type)", ["event_type"]), grouped("sum(v) - count(v)", "event_type"))

# transforms
_MEAN = f"avg_over_time(events_value[1d])"
_VIEW = rolled("avg(v)", DAY)
for _f, _q, _sql, _keep in (
    ("abs", f"abs({_MEAN} - 50)", "abs(v - 50)", False),
    ("ceil", f"ceil({_MEAN})", "ceil(v)", True),
    ("floor", f"floor({_MEAN})", "floor(v)", True),
    ("sqrt", f"sqrt({_MEAN})", "CASE WHEN v >= 0 THEN sqrt(v) END", False),
    ("exp", f"exp({_MEAN} / 100)", "exp(v / 100)", False),
    ("ln", f"ln({_MEAN})", "CASE WHEN v > 0 THEN ln(v) END", False),
    ("log2", f"log2({_MEAN})", "CASE WHEN v > 0 THEN log2(v) END", False),
    ("log10", f"log10({_MEAN})", "CASE WHEN v > 0 THEN log10(v) END", False),
    ("clamp", f"clamp({_MEAN}, 20, 60)", "least(greatest(v, 20), 60)", True),
    ("clamp_min", f"clamp_min({_MEAN}, 20)", "greatest(v, 20)", True),
    ("clamp_max", f"clamp_max({_MEAN}, 60)", "least(v, 60)", True),
    ("round", f"round({_MEAN}, 5)", "CASE WHEN v >= 0 THEN floor((v + 2.5) / 5) * 5 ELSE -floor((-v + 2.5) / 5) * 5 END", True),
    ("sin", f"sin({_MEAN})", "sin(v)", False),
    ("deg", f"deg({_MEAN})", "degrees(v)", False),
    ("keep_metric_names", f"abs({_MEAN}) keep_metric_names", "abs(v)", True),
    ("time", f"time() - {_MEAN}", "g / 1000 - v", False),
):
    add(f"transform_{_f}", ranged(_q, EL), series_out("events_value" if _keep else "", _VIEW, _sql, f"({_sql}) IS NOT NULL"))
add("transform_start_end_step", ranged("end() - start() + step()", []), f"WITH {grid_sql()} SELECT '' AS name, g AS ts_ms, {(END - START + STEP) / 1000} AS value FROM grid")
add("transform_absent", ranged('absent(count_over_time(events_value{event_type="click",user_id="1"}[12h]))', EL), f"WITH {S}, {grid_sql()} SELECT '' AS name, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS user_id, g AS ts_ms, 1.0 AS value FROM grid WHERE NOT EXISTS (SELECT 1 FROM s WHERE event_type = 'click' AND user_id = '1' AND t > g - {12 * HOUR} AND t <= g)")
add("transform_scalar", ranged("sum(count_over_time(events_value[1d])) by (event_type) / scalar(sum(count_over_time(events_value[1d])))", ["event_type"]), f"WITH {rolled('count(v)', DAY)} SELECT '' AS name, event_type, g AS ts_ms, round(sum(v) / sum(sum(v)) OVER (PARTITION BY g), 4) AS value FROM r GROUP BY event_type, g")
add("transform_label_set", ranged('label_set(avg(avg_over_time(events_value[1d])) by (user_id, event_type), "kind", "mean", "user", "x")', ["event_type", "user_id", "kind", "user"]), f"WITH {rolled('avg(v)', DAY)} SELECT '' AS name, event_type, user_id, 'mean' AS kind, 'x' AS user, g AS ts_ms, round(v, 4) AS value FROM r")
add("transform_label_replace", ranged('label_replace(sum(count_over_time(events_value[1d])) by (event_type), "short", "$1", "event_type", "(..).*")', ["event_type", "short"]), f"WITH {rolled('count(v)', DAY)} SELECT '' AS name, event_type, left(event_type, 2) AS short, g AS ts_ms, CAST(sum(v) AS DOUBLE) AS value FROM r GROUP BY event_type, g")
add("transform_running_sum", ranged("running_sum(sum(count_over_time(events_value[6h])) by (event_type))", ["event_type"]), f"WITH {rolled('count(v)', STEP)}, q AS (SELECT event_type, g, sum(v) AS v FROM r GROUP BY event_type, g), d AS (SELECT e.event_type, grid.g, q.v FROM (SELECT DISTINCT event_type FROM q) e CROSS JOIN grid LEFT JOIN q ON q.event_type = e.event_type AND q.g = grid.g), w AS (SELECT event_type, g, sum(v) OVER (PARTITION BY event_type ORDER BY g) AS v FROM d) SELECT '' AS name, event_type, g AS ts_ms, CAST(v AS DOUBLE) AS value FROM w WHERE v IS NOT NULL")
add("transform_sort_desc_groups", ranged("sort_desc(sum(sum_over_time(events_value[1d])) by (event_type))", ["event_type"]), f"WITH {_DAILY}, q AS (SELECT event_type, g, sum(v) AS v FROM r GROUP BY event_type, g), o AS (SELECT event_type, row_number() OVER (ORDER BY arg_max(v, g) DESC, event_type) AS ord FROM q GROUP BY event_type) SELECT '' AS name, event_type, g AS ts_ms, round(v, 4) AS value, ord FROM q JOIN o USING (event_type)")
add("orders_monthly_rate", ranged("sum(sum_over_time(orders_totalprice[30d])) by (status)", ["status"], "orders", DAY0, DAY1, 30 * DAY), f"WITH {grid_sql(DAY0, DAY1, 30 * DAY)} SELECT '' AS name, o_orderstatus AS status, g AS ts_ms, round(sum(o_totalprice), 4) AS value FROM orders JOIN grid ON epoch_us(o_orderdate) // 1000 > g - {30 * DAY} AND epoch_us(o_orderdate) // 1000 <= g GROUP BY o_orderstatus, g")
add("lineitem_quantity_max", ranged("max(max_over_time(lineitem_quantity[90d])) by (returnflag)", ["returnflag"], "lineitem", DAY0, DAY1, 30 * DAY), f"WITH {grid_sql(DAY0, DAY1, 30 * DAY)}, d AS (SELECT l_returnflag AS returnflag, l_linestatus, epoch_us(l_shipdate) // 1000 AS t, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT '' AS name, returnflag, g AS ts_ms, round(CAST(max(v) AS DOUBLE), 4) AS value FROM d JOIN grid ON t > g - {90 * DAY} AND t <= g GROUP BY returnflag, g")

add("export_samples", lambda spark, d: MetricsEngine(events(spark, d)).export('events_value{event_type!="view"}', START, END).select(C("labels")["event_type"].alias("event_type"), C("labels")["user_id"].alias("user_id"), "ts_ms", "value"), f"SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events WHERE event_type <> 'view' AND epoch_us(ts) // 1000 BETWEEN {START} AND {END}")
def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.Rule("sum(count_over_time(events_value[1d])) by (event_type)", record="events:daily", labels={"team": "a", "event_type": "all"})
    d = rules.record(MetricsEngine(events(spark, sf_dir)), _GROUP, r, START, END)
    return flat(d, ["team", "event_type", "exported_event_type"])

def alerted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.Rule("sum(count_over_time(events_value[6h])) by (event_type) > 18", alert="Busy", for_="12h")
    d = rules.alert_states(MetricsEngine(events(spark, sf_dir)), _GROUP, r, START, END)
    return d.select(C("labels")["event_type"].alias("event_type"), "ts_ms", "value", "active_at", "state")

add("rule_recording", recorded, f"WITH {rolled('count(v)', DAY)} SELECT 'events:daily' AS name, 'a' AS team, 'all' AS event_type, event_type AS exported_event_type, g AS ts_ms, CAST(sum(v) AS DOUBLE) AS value FROM r GROUP BY event_type, g")
add("rule_alerting", alerted, f"""WITH {rolled('count(v)', STEP)}, q AS (SELECT event_type, g, CAST(sum(v) AS DOUBLE) AS v FROM r GROUP BY event_type, g HAVING sum(v) > 18),
  i AS (SELECT *, g - {STEP} * row_number() OVER (PARTITION BY event_type ORDER BY g) AS isl FROM q), a AS (SELECT *, min(g) OVER (PARTITION BY event_type, isl) AS active_at FROM i)
  SELECT event_type, g AS ts_ms, v AS value, active_at, CASE WHEN g - active_at >= {12 * HOUR} THEN 'firing' ELSE 'pending' END AS state FROM a""")




add("instant_query", at_once("sum(count_over_time(events_value[31d])) by (event_type)", ["event_type"], END), f"SELECT '' AS name, event_type, {END} AS ts_ms, CAST(count(*) AS DOUBLE) AS value FROM events WHERE epoch_us(ts) // 1000 > {END - 31 * DAY} AND epoch_us(ts) // 1000 <= {END} GROUP BY event_type")
add("instant_raw", lambda spark, d: MetricsEngine(events(spark, d)).query("events_value[31d]", END / 1000).select(C("labels")["user_id"].alias("user_id"), "ts_ms", "value"), f"SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events WHERE epoch_us(ts) // 1000 > {END - 31 * DAY} AND epoch_us(ts) // 1000 <= {END}")

# listings
add("list_series", lambda spark, d: MetricsEngine(events(spark, d)).series('events_value{event_type="click"}').select("name", C("labels")["user_id"].alias("user_id")), "SELECT DISTINCT 'events_value' AS name, CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'click'")
add("list_labels", lambda spark, d: MetricsEngine(events(spark, d)).labels(), "SELECT unnest(['__name__', 'event_type', 'user_id']) AS label")
add("list_label_values", lambda spark, d: MetricsEngine(events(spark, d)).label_values("event_type", limit=3), "SELECT DISTINCT event_type AS value FROM events ORDER BY 1 LIMIT 3")
add("delete_series", lambda spark, d: MetricsEngine(events(spark, d)).delete_series('{event_type="click"}').groupBy(C("labels")["event_type"].alias("event_type")).count(), "SELECT event_type, count(*) AS count FROM events WHERE event_type <> 'click' GROUP BY event_type")

# deduplication, relabeling
add("dedup_daily", lambda spark, d: deduplicate(events(spark, d), DAY).select(C("labels")["event_type"].alias("event_type"), C("labels")["user_id"].alias("user_id"), "ts_ms", "value"), f"SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id, -((-epoch_us(ts) // 1000) // {DAY}) ORDER BY epoch_us(ts) // 1000 DESC, value DESC) = 1".replace("-((-epoch_us(ts) // 1000) // ", "ceil(epoch_us(ts) // 1000 / ").replace(f"{DAY} ORDER", f"{DAY}) ORDER"))
_RULES = [
    {"action": "drop", "source_labels": ["event_type"], "regex": "view"},
    {"action": "replace", "source_labels": ["event_type", "user_id"], "separator": "-", "regex": "(.)[^-]*-(.*)", "target_label": "short", "replacement": "$1_$2"},
    {"action": "uppercase", "source_labels": ["event_type"], "target_label": "upper"},
    {"action": "labelmap", "regex": "user_(.+)", "replacement": "u_$1"},
    {"action": "labeldrop", "regex": "user_id"},
    {"action": "replace", "target_label": "__name__", "replacement": "renamed"},
]
add("relabel_rules", lambda spark, d: relabel(events(spark, d), _RULES).select("name", *(C("labels")[x].alias(x) for x in ("short", "upper", "u_id")), F.map_contains_key("labels", F.lit("user_id")).alias("has_user"), "ts_ms"), "SELECT 'renamed' AS name, left(event_type, 1) || '_' || CAST(user_id AS VARCHAR) AS short, upper(event_type) AS upper, CAST(user_id AS VARCHAR) AS u_id, false AS has_user, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE event_type <> 'view'")

# interval aggregation
_H = 6 * HOUR


def interval(output: str, labels: list[str], **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(aggregation.aggregate(events(spark, sf_dir), aggregation.Config("6h", [output], **options)), labels)

    return run


for _f, _sql in {
    "avg": "avg(value)",
    "count_samples": "CAST(count(value) AS DOUBLE)",
    "count_series": "CAST(count(DISTINCT user_id) AS DOUBLE)",
    "last": "arg_max(value, ts)",
    "max": "max(value)",
    "min": "min(value)",
    "stddev": "stddev_pop(value)",
    "stdvar": "var_pop(value)",
    "unique_samples": "CAST(count(DISTINCT value) AS DOUBLE)",
}.items():
    add(f"interval_{_f}", interval(_f, ["event_type"], by=["event_type"]), f"SELECT 'events_value:6h_by_event_type_{_f}' AS name, event_type, (epoch_us(ts) // 1000 // {_H} + 1) * {_H} AS ts_ms, round({_sql}, 4) AS value FROM events GROUP BY event_type, epoch_us(ts) // 1000 // {_H}")
add("interval_quantiles", interval("quantiles(0.5, 0.9)", ["event_type", "quantile"], by=["event_type"]), f"WITH a AS (SELECT event_type, epoch_us(ts) // 1000 // {_H} AS b, list_sort(list(value)) AS vs FROM events GROUP BY ALL) SELECT 'events_value:6h_by_event_type_quantiles' AS name, event_type, CAST(p AS VARCHAR) AS quantile, (b + 1) * {_H} AS ts_ms, round(vs[CAST(floor(p * (len(vs) - 1) + 0.5) AS BIGINT) + 1], 4) AS value FROM a, (SELECT unnest([0.5, 0.9]::DOUBLE[]) AS p)")


def flushed(output: str, value: str, idle: str) -> str:
    """SQL of an output that has results until a group is stale, from a(event_type, b, s, last): b numbers the intervals."""
    gone = f"((pl + {2 * _H}) // {_H} + 1) * {_H}"
    return f"""f AS (SELECT *, (b + 1) * {_H} AS e, lag(last) OVER w AS pl, lead(b) OVER w AS nb FROM a WINDOW w AS (PARTITION BY event_type ORDER BY b)),
      rn AS (SELECT *, sum(CASE WHEN {gone} <= e - {_H} THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY b) AS run FROM f),
      tot AS (SELECT *, sum(s) OVER (PARTITION BY event_type, run ORDER BY b) AS total FROM rn),
      fl AS (SELECT event_type, run, e, {value} AS v FROM tot UNION ALL SELECT event_type, run, unnest(range(e + {_H}, least(coalesce(nb * {_H}, e + {9 * _H}), (last + {2 * _H}) // {_H} * {_H}) + 1, {_H})), {idle} FROM tot)
      SELECT 'events_value:6h_by_event_type_{output}' AS name, event_type, e AS ts_ms, round(v, 4) AS value FROM fl"""


_SUMS = f"a AS (SELECT event_type, epoch_us(ts) // 1000 // {_H} AS b, sum(value) AS s, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY ALL)"
add("interval_sum_samples", interval("sum_samples", ["event_type"], by=["event_type"]), f"WITH {_SUMS}, {flushed('sum_samples', 's', '0')}")
add("interval_sum_samples_total", interval("sum_samples_total", ["event_type"], by=["event_type"]), f"WITH {_SUMS}, {flushed('sum_samples_total', 'total', 'total')}")
_DELTAS = f"""l AS (SELECT event_type, user_id, epoch_us(ts) // 1000 AS t, value AS v, lag(value) OVER w AS p, lag(epoch_us(ts) // 1000) OVER w AS pt FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)),
  dd AS (SELECT event_type, user_id, t, t // {_H} AS b, CASE WHEN pt + {2 * _H} >= t THEN CASE WHEN v >= p THEN v - p ELSE v END ELSE FIRST END AS d FROM l)"""
for _f, _first in (("increase", "v"), ("increase_prometheus", "0")):
    add(f"interval_{_f}", interval(_f, ["event_type"], by=["event_type"]), f"WITH {_DELTAS.replace('FIRST', _first)} SELECT 'events_value:6h_by_event_type_{_f}' AS name, event_type, (b + 1) * {_H} AS ts_ms, round(sum(d), 4) AS value FROM dd GROUP BY event_type, b")
for _f, _first in (("total", "v"), ("total_prometheus", "0")):
    add(f"interval_{_f}", interval(_f, ["event_type"], by=["event_type"]), f"WITH {_DELTAS.replace('FIRST', _first)}, a AS (SELECT event_type, b, sum(d) AS s, max(t) AS last FROM dd GROUP BY ALL), {flushed(_f, 'total', 'total')}")
for _f, _agg in (("rate_sum", "sum"), ("rate_avg", "avg")):
    add(f"interval_{_f}", interval(_f, ["event_type"], by=["event_type"]), f"""WITH {_DELTAS.replace('FIRST', '0')}, q AS (SELECT event_type, user_id, b, sum(d) AS inc, max(t) AS t, min(t) AS t0 FROM dd GROUP BY ALL),
        z AS (SELECT *, (t - CASE WHEN lag(b) OVER w + 2 >= b THEN lag(t) OVER w ELSE t0 END) / 1000.0 AS dt FROM q WINDOW w AS (PARTITION BY event_type, user_id ORDER BY b))
        SELECT 'events_value:6h_by_event_type_{_f}' AS name, event_type, (b + 1) * {_H} AS ts_ms, round({_agg}(inc / dt), 4) AS value FROM z WHERE dt > 0 GROUP BY event_type, b""")
_EDGE = "printf('%.3e', pow(10.0, ({i}) / 18.0 - 9))"
add("interval_histogram_bucket", interval("histogram_bucket", ["event_type", "vmrange"], by=["event_type"]), f"""WITH q AS (SELECT event_type, epoch_us(ts) // 1000 // {_H} AS b, CASE WHEN value <= 1e-9 THEN -1 ELSE ceil((log10(value) + 9) * 18 - 1e-9) - 1 END AS i FROM events WHERE value >= 0),
  x AS (SELECT event_type, b, CASE WHEN i < 0 THEN '0...1.000e-09' ELSE {_EDGE.format(i="i")} || '...' || {_EDGE.format(i="i + 1")} END AS vmrange, count(*) AS n FROM q GROUP BY ALL),
  {_SUMS}, {flushed("", "s", "s").split("SELECT 'events")[0]}, y AS (SELECT x.*, run FROM x JOIN rn USING (event_type, b)),
  ev AS (SELECT y.event_type, y.run, vmrange, fl.e, sum(n) AS value FROM y JOIN fl ON fl.event_type = y.event_type AND fl.run = y.run AND fl.e >= (y.b + 1) * {_H} GROUP BY ALL)
  SELECT 'events_value:6h_by_event_type_histogram_bucket' AS name, event_type, vmrange, e AS ts_ms, CAST(value AS DOUBLE) AS value FROM ev""")
add("interval_dedup_without", interval("sum_samples", ["event_type"], without=["user_id"], dedup_interval="1h"), f"WITH x AS (SELECT event_type, user_id, epoch_us(ts) // 1000 AS t, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id, epoch_us(ts) // 1000 // {HOUR} ORDER BY ts DESC, value DESC) = 1), a AS (SELECT event_type, t // {_H} AS b, sum(value) AS s, max(t) AS last FROM x GROUP BY ALL), {flushed('sum_samples', 's', '0').replace('6h_by_event_type', '6h_without_user_id')}")

# sources: the samples of a table written in a format and read back
def round_trip(write: Callable[[], Column], read: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = events(spark, sf_dir).select("*", C("labels")["event_type"].alias("e"), C("labels")["user_id"].alias("u"))
        return flat(read(d.select(write().alias("value"))), EL)

    return run


def _text() -> Column:
    return C("value").cast("string")


_cat = lambda *xs: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in xs))
_BACK = "SELECT 'events_value' AS name, event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts_ms, round(value, 4) AS value FROM events"
_SECONDS = _BACK.replace("epoch_us(ts) // 1000", "epoch_us(ts) // 1000 // 1000 * 1000")
add("source_influx", round_trip(lambda: _cat("events,event_type=", C("e"), ",user_id=", C("u"), " value=", _text(), ",note=\"x, y=z\" ", C("ts_ms").cast("string")), formats.influx), _BACK)
add("source_prometheus", round_trip(lambda: _cat('events_value{event_type="', C("e"), '", user_id="', C("u"), '"} ', _text(), " ", C("ts_ms").cast("string")), formats.prometheus), _BACK)
add("source_json_lines", round_trip(lambda: _cat('{"metric":{"__name__":"events_value","event_type":"', C("e"), '","user_id":"', C("u"), '"},"values":[', _text(), ',null],"timestamps":[', C("ts_ms").cast("string"), ",1]}"), formats.json_lines), _BACK)
add("source_csv", round_trip(lambda: _cat(C("ts_ms").cast("string"), ',"', C("e"), '",', C("u"), ",", _text()), lambda d: formats.csv(d, "1:time:unix_ms,2:label:event_type,3:label:user_id,4:metric:events_value")), _BACK)
add("source_graphite", round_trip(lambda: _cat("events_value;event_type=", C("e"), ";user_id=", C("u"), " ", _text(), " ", F.floor(C("ts_ms") / 1000).cast("string")), formats.graphite), _SECONDS)
add("source_opentsdb", round_trip(lambda: _cat("put events_value ", C("ts_ms").cast("string"), " ", _text(), " event_type=", C("e"), " user_id=", C("u")), formats.opentsdb), _BACK)
add("source_opentsdb_json", round_trip(lambda: _cat('{"metric":"events_value","timestamp":', C("ts_ms").cast("string"), ',"value":', _text(), ',"tags":{"event_type":"', C("e"), '","user_id":"', C("u"), '"}}'), formats.opentsdb_json), _BACK)
add("source_datadog_v1", round_trip(lambda: _cat('{"series":[{"metric":"events_value","points":[[', F.floor(C("ts_ms") / 1000).cast("string"), ",", _text(), ']],"tags":["event_type:', C("e"), '","user_id:', C("u"), '"]}]}'), formats.datadog_v1), _SECONDS)
add("source_datadog_v2", round_trip(lambda: _cat('{"series":[{"metric":"events_value","points":[{"timestamp":', F.floor(C("ts_ms") / 1000).cast("string"), ',"value":', _text(), '}],"tags":["event_type:', C("e"), '","user_id:', C("u"), '"]}]}'), formats.datadog_v2), _SECONDS)
add("sink_export_json", lambda spark, d: flat(formats.json_lines(store.export_json(events(spark, d), 5)), EL), _BACK)
add("sink_export_prometheus", lambda spark, d: flat(formats.prometheus(store.export_prometheus(events(spark, d))), EL), _BACK)
