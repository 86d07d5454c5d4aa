"""One query with SQL for every function, aggregate and relabeling action that metric_queries does not have.

All read whole tables.  Transforms take few series (sums by event type, or maxima by user where gaps
matter), so that what is compared is the function and not the size of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import MetricsEngine
from ..functions import rollups
from ..operators import relabel as relabeling
from ..operators.relabel import relabel
from ..rules import rules
from ..session import new_folder
from ..sources import formats, protobuf, series, store, wire_out
from .metric_queries import DAY, EL, END, START, STEP, W2, C, S, adder, events, flat, grid_sql, ordered_cte, ranged, rolled, series_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
add = adder(QUERIES, ORACLE)

# inputs: sums and counts by event type, the greatest value of each user in six hours (with gaps)
Q, N = "sum(sum_over_time(events_value[1d])) by (event_type)", "sum(count_over_time(events_value[1d])) by (event_type)"
U = "max(max_over_time(events_value[6h])) by (user_id)"
Q_CTE = f"{rolled('sum(v)', DAY)}, q AS (SELECT event_type, g, sum(v) AS v FROM r GROUP BY event_type, g)"
N_CTE = f"{rolled('count(v)', DAY)}, q AS (SELECT event_type, g, CAST(sum(v) AS DOUBLE) AS v FROM r GROUP BY event_type, g)"
U_CTE = f"{rolled('max(v)', STEP)}, u AS (SELECT user_id, g, max(v) AS v FROM r GROUP BY user_id, g), du AS (SELECT a.user_id, grid.g, (grid.g - {START}) // {STEP} AS k, u.v FROM (SELECT DISTINCT user_id FROM u) a CROSS JOIN grid LEFT JOIN u USING (user_id, g))"


def over_types(name: str, query: str, value: str, cte: str = Q_CTE, where: str = "true", out_name: str = "", extra: dict[str, str] | None = None) -> None:
    """A query on series by event type; extra maps further labels to their SQL."""
    labels = ["event_type", *(extra or {})]
    cols = "".join(f"{sql} AS {n}, " for n, sql in (extra or {}).items())
    event_type = "event_type, " if "event_type" not in (extra or {}) else ""
    add(name, ranged(query, list(dict.fromkeys(labels))), f"WITH {cte} SELECT '{out_name}' AS name, {event_type}{cols}g AS ts_ms, round({value}, 4) AS value FROM q WHERE {where}")


def over_users(name: str, query: str, source: str = "SELECT user_id, g, VALUE AS v FROM du", value: str = "v", cte: str = U_CTE) -> None:
    add(name, ranged(query, ["user_id"]), f"WITH {cte}, o AS ({source.replace('VALUE', value)}) SELECT '' AS name, user_id, g AS ts_ms, round(v, 4) AS value FROM o WHERE v IS NOT NULL")


# functions of one number
for _f, _q, _sql in (
    ("acos", f"acos({Q} / 1e6)", "acos(v / 1e6)"),
    ("acosh", f"acosh({Q} + 1)", "acosh(v + 1)"),
    ("asin", f"asin({Q} / 1e6)", "asin(v / 1e6)"),
    ("asinh", f"asinh({Q})", "asinh(v)"),
    ("atan", f"atan({Q} / 1000)", "atan(v / 1000)"),
    ("atanh", f"atanh({Q} / 1e6)", "atanh(v / 1e6)"),
    ("cos", f"cos({Q})", "cos(v)"),
    ("cosh", f"cosh({Q} / 1e5)", "(exp(v / 1e5) + exp(-v / 1e5)) / 2"),
    ("sinh", f"sinh({Q} / 1e5)", "(exp(v / 1e5) - exp(-v / 1e5)) / 2"),
    ("tan", f"tan({Q} / 1e6)", "tan(v / 1e6)"),
    ("tanh", f"tanh({Q} / 1e5)", "1 - 2 / (exp(2 * v / 1e5) + 1)"),
    ("rad", f"rad({Q})", "radians(v)"),
    ("pi", f"{Q} / pi()", "v / pi()"),
):
    over_types(f"transform_{_f}", _q, _sql)
for _f, _q, _sql in (("bitmap_and", f"bitmap_and({N}, 13)", "& 13"), ("bitmap_or", f"bitmap_or({N}, 13)", "| 13"), ("bitmap_xor", f"bitmap_xor({N}, 13)", None)):
    over_types(f"transform_{_f}", _q, f"CAST(CAST(v AS BIGINT) {_sql} AS DOUBLE)" if _sql else "CAST(xor(CAST(v AS BIGINT), 13) AS DOUBLE)", N_CTE)
add("transform_sgn", ranged(f"sgn({U} - 50)", ["user_id"]), f"WITH {U_CTE} SELECT '' AS name, user_id, g AS ts_ms, CAST(coalesce(sign(v - 50), 0) AS DOUBLE) AS value FROM du")
over_types("transform_vector", f"vector({Q})", "v")
add("transform_empty_union", ranged(f"({N}, label_set({Q}, \"kind\", \"sum\"))", ["event_type", "kind"]), f"WITH {Q_CTE}, c AS (SELECT event_type, g, count(*) AS v FROM s JOIN grid ON t > g - {DAY} AND t <= g GROUP BY event_type, g) SELECT '' AS name, event_type, 'sum' AS kind, g AS ts_ms, round(v, 4) AS value FROM q UNION ALL SELECT '', event_type, NULL, g, round(CAST(v AS DOUBLE), 4) FROM c")

# functions of times: the last sample of every event type
LAST = "max(tlast_over_time(events_value[1d])) by (event_type)"
LAST_CTE = f"{rolled('max(t)', DAY)}, q AS (SELECT event_type, g, make_timestamp(max(v) // 1000 * 1000000) AS d FROM r GROUP BY event_type, g)"
for _f, _sql in {"minute": "minute(d)", "hour": "hour(d)", "day_of_month": "day(d)", "day_of_week": "dayofweek(d)", "day_of_year": "dayofyear(d)", "days_in_month": "day(last_day(d))", "month": "month(d)", "year": "year(d)"}.items():
    over_types(f"transform_{_f}", f"{_f}({LAST})", f"CAST({_sql} AS DOUBLE)", LAST_CTE)
for _f, _q, _v in (("now", "now() > bool 1704067200", 1.0), ("timezone_offset", 'timezone_offset("America/New_York")', -18000.0), ("rand", "rand(1) >= bool 0", 1.0), ("rand_normal", "abs(rand_normal(1)) < bool 100", 1.0), ("rand_exponential", "rand_exponential(1) >= bool 0", 1.0)):
    add(f"transform_{_f}", ranged(_q, []), f"WITH {grid_sql()} SELECT '' AS name, g AS ts_ms, CAST({_v} AS DOUBLE) AS value FROM grid")

# functions of labels
for _f, _q, _where, _name, _extra in (
    ("label_copy", f'label_copy({Q}, "event_type", "kind")', "true", "", {"kind": "event_type"}),
    ("label_move", f'label_move({Q}, "event_type", "kind")', "true", "", {"event_type": "CAST(NULL AS VARCHAR)", "kind": "q.event_type"}),
    ("label_del", f'label_del(label_set({Q}, "x", "y", "z", "w"), "x")', "true", "", {"x": "CAST(NULL AS VARCHAR)", "z": "'w'"}),
    ("label_keep", f'label_keep(label_set({Q}, "x", "y", "z", "w"), "event_type", "z")', "true", "", {"x": "CAST(NULL AS VARCHAR)", "z": "'w'"}),
    ("label_join", f'label_join({Q}, "both", "-", "event_type", "nope", "event_type")', "true", "", {"both": "event_type || '--' || event_type"}),
    ("label_lowercase", f'label_lowercase(label_set({Q}, "x", "ABc"), "x")', "true", "", {"x": "'abc'"}),
    ("label_uppercase", f'label_uppercase({Q}, "event_type")', "true", "", {"event_type": "upper(q.event_type)"}),
    ("label_map", f'label_map({Q}, "event_type", "click", "C", "view", "V")', "true", "", {"event_type": "CASE q.event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE q.event_type END"}),
    ("label_match", f'label_match({Q}, "event_type", "cl.*|view")', "regexp_full_match(event_type, 'cl.*|view')", "", None),
    ("label_mismatch", f'label_mismatch({Q}, "event_type", "cl.*|view")', "NOT regexp_full_match(event_type, 'cl.*|view')", "", None),
    ("label_transform", f'label_transform({Q}, "event_type", "[ie]", "_$0")', "true", "", {"event_type": "regexp_replace(q.event_type, '([ie])', '_\\1', 'g')"}),
    ("labels_equal", f'labels_equal(label_set({Q}, "x", "click"), "event_type", "x")', "event_type = 'click'", "", {"x": "'click'"}),
    ("label_graphite_group", f'label_graphite_group(label_set({Q}, "__name__", "a.b.c"), 2, 0)', "true", "c.a", None),
    ("drop_common_labels", f'drop_common_labels(label_set({Q}, "x", "y"))', "true", "", {"x": "CAST(NULL AS VARCHAR)"}),
):
    over_types(f"transform_{_f}", _q, "v", where=_where, out_name=_name, extra=_extra)
over_users("transform_label_value", f'label_value({U}, "user_id")', "SELECT user_id, g, CAST(user_id AS DOUBLE) AS v FROM u")
over_users("transform_drop_empty_series", f"drop_empty_series({U} > 200)", "SELECT user_id, g, v FROM u WHERE v > 200")
over_types("transform_limit_offset", f"limit_offset(2, 1, {Q})", "v", where="event_type IN (SELECT event_type FROM s GROUP BY event_type ORDER BY event_type LIMIT 2 OFFSET 1)")

# functions of the points of a series
_RUN = "OVER (PARTITION BY user_id ORDER BY g)"
_ALL = "OVER (PARTITION BY user_id)"
for _f, _sql in {
    "running_avg": f"avg(v) {_RUN}",
    "running_min": f"min(v) {_RUN}",
    "running_max": f"max(v) {_RUN}",
    "range_avg": f"avg(v) {_ALL}",
    "range_min": f"min(v) {_ALL}",
    "range_max": f"max(v) {_ALL}",
    "range_sum": f"sum(v) {_ALL}",
    "range_stddev": f"stddev_pop(v) {_ALL}",
    "range_stdvar": f"var_pop(v) {_ALL}",
    "range_first": f"arg_min(v, g) {_ALL}",
    "range_last": f"arg_max(v, g) {_ALL}",
    "range_linear_regression": f"regr_slope(v, k) {_ALL} * k + regr_intercept(v, k) {_ALL}",
    "range_mad": f"mad(v) {_ALL}",
    "range_normalize": f"(v - min(v) {_ALL}) / nullif(max(v) {_ALL} - min(v) {_ALL}, 0)",
    "range_zscore": f"CASE WHEN stddev_pop(v) {_ALL} <> 0 THEN (v - avg(v) {_ALL}) / stddev_pop(v) {_ALL} ELSE 0 END",
    "keep_last_value": f"last_value(v IGNORE NULLS) {_RUN}",
    "keep_next_value": "first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}.items():
    over_users(f"transform_{_f}", f"{_f}({U})", value=_sql)
over_users("transform_range_quantile", f"range_quantile(0.3, {U})", value=f"quantile_cont(v, 0.3) {_ALL}")
_P = "first_value(CASE WHEN v IS NOT NULL THEN {'k': k, 'v': v} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
over_users("transform_interpolate", f"interpolate({U})", "SELECT user_id, g, CASE WHEN v IS NOT NULL THEN v ELSE a.v + (b.v - a.v) * (k - a.k) / (b.k - a.k) END AS v FROM (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'k': k, 'v': v} END IGNORE NULLS) " + _RUN + f" AS a, {_P} AS b FROM du)")
_DROP = f"CASE WHEN v < p THEN CASE WHEN (p - v) * {rollups.PARTIAL_RESET} < p THEN p - v ELSE p END ELSE 0 END"
over_users("transform_remove_resets", f"remove_resets({U})", f"SELECT user_id, g, v + sum({_DROP}) {_RUN} AS v FROM (SELECT user_id, g, v, lag(v) {_RUN} AS p FROM u)")
over_users("transform_range_trim_outliers", f"range_trim_outliers(2, {U})", f"SELECT user_id, g, v FROM (SELECT *, median(v) {_ALL} AS m, mad(v) {_ALL} AS d FROM u) WHERE abs(v - m) <= 2 * d")
over_users("transform_range_trim_spikes", f"range_trim_spikes(0.2, {U})", f"SELECT user_id, g, v FROM (SELECT *, quantile_cont(v, 0.1) {_ALL} AS a, quantile_cont(v, 0.9) {_ALL} AS b FROM u) WHERE v BETWEEN a AND b")
over_users("transform_range_trim_zscore", f"range_trim_zscore(1.5, {U})", f"SELECT user_id, g, v FROM (SELECT *, avg(v) {_ALL} AS m, stddev_pop(v) {_ALL} AS d FROM u) WHERE abs(v - m) <= 1.5 * d")
over_users("transform_smooth_exponential", f"smooth_exponential({U}, 0.3)", f"SELECT user_id, g, list_reduce(list(v) {_RUN}, lambda a, x: a * 0.7 + x * 0.3) AS v FROM u")

# orders
_LASTS = "list({'g': g, 'v': SIGNv} ORDER BY g DESC)"
for _f, _sign in (("sort", ""), ("sort_desc", "-")):
    add(f"transform_{_f}", ranged(f"{_f}({U})", ["user_id"]), f"WITH {U_CTE}, o AS (SELECT user_id, row_number() OVER (ORDER BY {_LASTS.replace('SIGN', _sign)}, user_id) AS ord FROM u GROUP BY user_id) SELECT '' AS name, user_id, g AS ts_ms, round(v, 4) AS value, ord FROM u JOIN o USING (user_id)")
for _f, _key in (("sort_by_label", "user_id"), ("sort_by_label_desc", "user_id DESC"), ("sort_by_label_numeric", "CAST(user_id AS INTEGER)"), ("sort_by_label_numeric_desc", "CAST(user_id AS INTEGER) DESC")):
    add(f"transform_{_f}", ranged(f'{_f}({U}, "user_id")', ["user_id"]), f"WITH {U_CTE}, o AS (SELECT user_id, row_number() OVER (ORDER BY {_key}) AS ord FROM u GROUP BY user_id) SELECT '' AS name, user_id, g AS ts_ms, round(v, 4) AS value, ord FROM u JOIN o USING (user_id)")

# histograms: cumulative buckets of the values of every event type
_LES = ("10", "50", "200")
BUCKETS = ", ".join([*(f'label_set(sum(count_le_over_time(events_value[1d], {x})) by (event_type), "le", "{x}")' for x in _LES), f'label_set({N}, "le", "+Inf")'])
_AT = {"0": "0.0"} | {x: f"CAST(count(*) FILTER (v <= {x}) AS DOUBLE)" for x in _LES} | {"inf": "CAST(count(*) AS DOUBLE)"}
B_CTE = f"{S}, {grid_sql()}, q AS (SELECT event_type, g, {', '.join(f'{e} AS c{n}' for n, e in _AT.items())} FROM s JOIN grid ON t > g - {DAY} AND t <= g GROUP BY event_type, g)"
_STEPS = list(zip(["0", *_LES[:-1]], _LES, strict=True))


def _quantile_sql(phi: float) -> str:
    whens = " ".join(f"WHEN c{b} >= {phi} * cinf THEN CASE WHEN c{b} > c{a} THEN {a} + ({b} - {a}) * ({phi} * cinf - c{a}) / (c{b} - c{a}) ELSE {b} END" for a, b in _STEPS)
    return f"CASE {whens} ELSE {_LES[-1]} END"


def _share_sql(x: float) -> str:
    whens = " ".join(f"WHEN {x} < {b} THEN c{a} + (c{b} - c{a}) * ({x} - {a}) / ({b} - {a})" for a, b in _STEPS)
    return f"(CASE {whens} ELSE c{_LES[-1]} END) / cinf"


_MIDS = [(f"({a} + {b}) / 2.0", f"(c{b} - c{a})") for a, b in _STEPS] + [(_LES[-1], f"(cinf - c{_LES[-1]})")]
_MEAN_SQL = "(" + " + ".join(f"{m} * {n}" for m, n in _MIDS) + ") / cinf"
_VAR_SQL = "greatest((" + " + ".join(f"({m}) * ({m}) * {n}" for m, n in _MIDS) + f") / cinf - ({_MEAN_SQL}) * ({_MEAN_SQL}), 0)"
for _f, _q, _sql in (
    ("histogram_quantile", f"histogram_quantile(0.6, union({BUCKETS}))", _quantile_sql(0.6)),
    ("histogram_share", f"histogram_share(40, union({BUCKETS}))", _share_sql(40)),
    ("histogram_fraction", f"histogram_fraction(20, 120, union({BUCKETS}))", f"{_share_sql(120)} - {_share_sql(20)}"),
    ("histogram_avg", f"histogram_avg(union({BUCKETS}))", _MEAN_SQL),
    ("histogram_stdvar", f"histogram_stdvar(union({BUCKETS}))", _VAR_SQL),
    ("histogram_stddev", f"histogram_stddev(union({BUCKETS}))", f"sqrt({_VAR_SQL})"),
):
    over_types(f"transform_{_f}", _q, _sql, B_CTE)
add("transform_histogram_quantiles", ranged(f'histogram_quantiles("phi", 0.2, 0.8, union({BUCKETS}))', ["event_type", "phi"]), f"WITH {B_CTE} " + " UNION ALL ".join(f"SELECT '' AS name, event_type, '{p}' AS phi, g AS ts_ms, round({_quantile_sql(p)}, 4) AS value FROM q" for p in (0.2, 0.8)))
add("transform_buckets_limit", ranged(f"buckets_limit(3, union({BUCKETS}))", ["event_type", "le"]), f"WITH {B_CTE} " + " UNION ALL ".join(f"SELECT '' AS name, event_type, '{le}' AS le, g AS ts_ms, c{c} AS value FROM q" for le, c in (("10", "10"), ("200", "200"), ("+Inf", "inf"))))
_EDGE = "printf('%.3e', pow(10.0, ({i}) / 18.0 - 9))"
_RANGE = f"CASE WHEN i < 0 THEN '0...1.000e-09' ELSE {_EDGE.format(i='i')} || '...' || {_EDGE.format(i='i + 1')} END"
_BUCKET = "CASE WHEN v <= 1e-9 THEN -1 ELSE ceil((log10(v) + 9) * 18 - 1e-9) - 1 END"
add("aggr_histogram", ranged("histogram(sum_over_time(events_value[1d])) by (event_type)", ["event_type", "vmrange"]), f"WITH {rolled('sum(v)', DAY)}, b AS (SELECT event_type, g, {_BUCKET} AS i FROM r WHERE v >= 0) SELECT '' AS name, event_type, {_RANGE} AS vmrange, g AS ts_ms, CAST(count(*) AS DOUBLE) AS value FROM b GROUP BY event_type, i, g")
add("rollup_histogram_over_time", ranged("histogram_over_time(events_value[2d])", [*EL, "vmrange"]), f"WITH {S}, {grid_sql()}, b AS (SELECT event_type, user_id, g, {_BUCKET} AS i FROM s JOIN grid ON t > g - {W2} AND t <= g) SELECT '' AS name, event_type, user_id, {_RANGE} AS vmrange, g AS ts_ms, CAST(count(*) AS DOUBLE) AS value FROM b GROUP BY event_type, user_id, i, g")
add("transform_prometheus_buckets", ranged("prometheus_buckets(histogram(sum_over_time(events_value[1d])) by (event_type))", ["event_type", "le"]), f"""WITH {rolled('sum(v)', DAY)}, b AS (SELECT event_type, g, {_BUCKET} AS i, count(*) AS n FROM r WHERE v >= 0 GROUP BY ALL),
  ends AS (SELECT event_type, g, i + 1 AS e FROM b UNION SELECT event_type, g, i FROM b WHERE i >= 0 UNION SELECT event_type, g, NULL FROM b WHERE i < 0)
  SELECT '' AS name, event_type, CASE WHEN e IS NULL THEN '0' ELSE {_EDGE.format(i='e')} END AS le, ends.g AS ts_ms, CAST(coalesce((SELECT sum(n) FROM b WHERE b.event_type = ends.event_type AND b.g = ends.g AND b.i + 1 <= e), 0) AS DOUBLE) AS value FROM ends
  UNION ALL SELECT '', event_type, '+Inf', g, CAST(sum(n) AS DOUBLE) FROM b GROUP BY event_type, g""")

# rollups that need no neighbouring samples
_KEEPS = rollups.names.ROLLUPS_KEEP_NAME


def rolled_up(name: str, query: str, sql: str, where: str = "v IS NOT NULL") -> None:
    f = query.split("(")[0]
    add(f"rollup_{name}", ranged(query, EL), series_out("events_value" if f in _KEEPS else "", rolled(sql, W2), where=where))


_SPREAD = "CASE WHEN count(v) > 1 THEN (max(v) - min(v)) * sqrt(ln(1 / (1 - 0.9)) / (2 * count(v))) ELSE 0 END"
_SLOPE = "(t - g) / 1000.0"
for _f, _q, _sql in (
    ("mad_over_time", "mad_over_time(events_value[2d])", "mad(v)"),
    ("outlier_iqr_over_time", "outlier_iqr_over_time(events_value[2d])", "CASE WHEN arg_max(v, t) > quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) OR arg_max(v, t) < quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) THEN arg_max(v, t) END"),
    ("predict_linear", "predict_linear(events_value[2d], 3600)", f"CASE WHEN count(v) > 1 THEN regr_slope(v, {_SLOPE}) * 3600 + regr_intercept(v, {_SLOPE}) ELSE avg(v) END"),
    ("hoeffding_bound_lower", "hoeffding_bound_lower(0.9, events_value[2d])", f"avg(v) - {_SPREAD}"),
    ("hoeffding_bound_upper", "hoeffding_bound_upper(0.9, events_value[2d])", f"avg(v) + {_SPREAD}"),
    ("share_le_over_time", "share_le_over_time(events_value[2d], 50)", "avg(CASE WHEN v <= 50 THEN 1.0 ELSE 0.0 END)"),
    ("sum_le_over_time", "sum_le_over_time(events_value[2d], 50)", "sum(v) FILTER (v <= 50)"),
    (
        "holt_winters",
        "holt_winters(events_value[2d], 0.5, 0.3)",
        "list_reduce(list_transform(list(v ORDER BY t), lambda x, i: {'l': x, 't': CASE WHEN i = 1 THEN coalesce((list(v ORDER BY t))[2] - x, 0) ELSE 0 END, 'v': x}), lambda a, x: {'l': 0.5 * x.v + 0.5 * (a.l + a.t), 't': 0.3 * ((0.5 * x.v + 0.5 * (a.l + a.t)) - a.l) + 0.7 * a.t, 'v': x.v}).l",
    ),
):
    rolled_up(_f, _q, _sql)
# equality wants values that repeat: counts of each user in six hours
_SUB = f"{S}, gi AS (SELECT {START - 4 * DAY} + {STEP} * unnest(range({(END - START) // STEP + 17})) AS gi), {grid_sql()}, i AS (SELECT user_id, gi, CAST(count(*) AS DOUBLE) AS v FROM s JOIN gi ON t > gi - {STEP} AND t <= gi GROUP BY user_id, gi), u AS (SELECT user_id, g, AGG AS v FROM i JOIN grid ON gi > g - {W2} AND gi <= g GROUP BY user_id, g)"
_COUNTS = "sum(count_over_time(events_value[6h])) by (user_id)"
for _f, _arg, _sql in (
    ("count_eq_over_time", ", 1", "CAST(count(*) FILTER (v = 1) AS DOUBLE)"),
    ("count_ne_over_time", ", 1", "CAST(count(*) FILTER (v <> 1) AS DOUBLE)"),
    ("share_eq_over_time", ", 1", "avg(CASE WHEN v = 1 THEN 1.0 ELSE 0.0 END)"),
    ("sum_eq_over_time", ", 1", "sum(v) FILTER (v = 1)"),
    ("mode_over_time", "", "(list_sort(list_transform(list_distinct(list(v)), lambda x: {'n': -len(list_filter(list(v), lambda y: y = x)), 'v': x})))[1].v"),
):
    over_users(f"rollup_{_f}", f"{_f}(({_COUNTS})[2d:6h]{_arg})", "SELECT user_id, g, v FROM u", cte=_SUB.replace("AGG", _sql))
_NUMBER = "CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END"
add("rollup_count_values_over_time", ranged('count_values_over_time("n", events_value[2d])', [*EL, "n"]), f"WITH {S}, {grid_sql()} SELECT '' AS name, event_type, user_id, {_NUMBER} AS n, g AS ts_ms, CAST(count(*) AS DOUBLE) AS value FROM s JOIN grid ON t > g - {W2} AND t <= g GROUP BY event_type, user_id, v, g")


def several(name: str, query: str, label: str, parts: dict[str, str], out_name: str = "", cte: Callable[[str], str] = lambda agg: rolled(agg, W2)) -> None:
    """A query whose series are told apart by a label; parts maps its values to aggregates."""
    aggs = ", ".join(f"{sql} AS x{i}" for i, sql in enumerate(parts.values()))
    rows = " UNION ALL ".join(f"SELECT '{out_name}' AS name, event_type, user_id, '{tag}' AS {label}, g AS ts_ms, round(x{i}, 4) AS value FROM r WHERE x{i} IS NOT NULL" for i, tag in enumerate(parts))
    add(f"rollup_{name}", ranged(query, [*EL, label]), f"WITH {cte(aggs).replace(' AS v FROM s JOIN', ' FROM s JOIN')} {rows}")


several("quantiles_over_time", 'quantiles_over_time("phi", 0.25, 0.75, events_value[2d])', "phi", {"0.25": "quantile_cont(v, 0.25)", "0.75": "quantile_cont(v, 0.75)"}, "events_value")
several("aggr_over_time", 'aggr_over_time(("min_over_time", "sum_over_time", "count_over_time"), events_value[2d])', "rollup", {"min_over_time": "min(v)", "sum_over_time": "sum(v)", "count_over_time": "CAST(count(v) AS DOUBLE)"})
several("rollup_candlestick", "rollup_candlestick(events_value[2d])", "rollup", {"open": "arg_min(v, t)", "close": "arg_max(v, t)", "low": "min(v)", "high": "max(v)"}, "events_value" if "rollup_candlestick" in _KEEPS else "")

# rollups that read neighbouring samples
_CHANGED = "v <> pv AND NOT abs(v - pv) < 1e-12 * abs(v)"


def beside(name: str, query: str, agg: str) -> None:
    add(f"rollup_{name}", ranged(query, EL), f"WITH {ordered_cte()}, r AS (SELECT event_type, user_id, g, {agg} AS v FROM ch JOIN grid ON t > g - {W2} AND t <= g GROUP BY event_type, user_id, g) SELECT '' AS name, event_type, user_id, g AS ts_ms, round(v, 4) AS value FROM r WHERE v IS NOT NULL")


for _f, _sql in {
    "ascent_over_time": "sum(greatest(v - coalesce(pv, v), 0))",
    "descent_over_time": "sum(greatest(coalesce(pv, v) - v, 0))",
    "increases_over_time": "CAST(count(*) FILTER (v > pv) AS DOUBLE)",
    "decreases_over_time": "CAST(count(*) FILTER (v < pv) AS DOUBLE)",
    "integrate": f"sum(coalesce(pv * (t - greatest(pt, g - {W2})) / 1000.0, 0))",
    "tlast_change_over_time": f"max(t) FILTER ({_CHANGED}) / 1000.0",
}.items():
    beside(_f, f"{_f}(events_value[2d])", _sql)
beside("duration_over_time", "duration_over_time(events_value[2d], 36000)", f"sum(CASE WHEN t - pt <= 36000000 AND pt > g - {W2} THEN (t - pt) / 1000.0 ELSE 0 END)")
for _f, _sql in {"lifetime": "(lt - coalesce(CASE WHEN ok THEN fpt END, ft)) / 1000.0", "scrape_interval": "CASE WHEN ok THEN (lt - fpt) / 1000.0 / n WHEN n > 1 THEN (lt - ft) / 1000.0 / (n - 1) END"}.items():
    add(f"rollup_{_f}", ranged(f"{_f}(events_value[2d])", EL), f"WITH {ordered_cte()} SELECT '' AS name, event_type, user_id, g AS ts_ms, round({_sql}, 4) AS value FROM x WHERE ({_sql}) IS NOT NULL")
for _f, _sql, _resets in (
    ("rollup", "v", False),
    ("rollup_delta", "v - pv", False),
    ("rollup_increase", "v - pv", True),
    ("rollup_rate", "(v - pv) / ((t - pt) / 1000.0)", True),
    ("rollup_deriv", "(v - pv) / ((t - pt) / 1000.0)", False),
    ("rollup_scrape_interval", "(t - pt) / 1000.0", False),
):
    several(f"{_f}", f"{_f}(events_value[2d])", "rollup", {x: f"{x}({_sql})" for x in ("min", "max", "avg")}, "events_value" if _f in _KEEPS else "", lambda aggs, r=_resets: f"{ordered_cte(r)}, r AS (SELECT event_type, user_id, g, {aggs} FROM ch JOIN grid ON t > g - {W2} AND t <= g GROUP BY event_type, user_id, g)")


def stale_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = events(spark, sf_dir).withColumn("is_stale", C("value") < 10)
    return flat(MetricsEngine(marked).query_range("stale_samples_over_time(events_value[2d])", START / 1000, END / 1000, STEP), EL)


add("rollup_stale_samples_over_time", stale_samples, series_out("", rolled("CAST(count(*) FILTER (v < 10) AS DOUBLE)", W2)))

# aggregates across series
R, _R = "sum_over_time(events_value[1d])", rolled("sum(v)", DAY)
_SERIES_OUT = "SELECT '' AS name, event_type, user_id, g AS ts_ms, round(v, 4) AS value FROM r"
add("aggr_bottomk", ranged(f"bottomk(3, {R}) by (event_type)", EL), f"WITH {_R} {_SERIES_OUT} QUALIFY row_number() OVER (PARTITION BY event_type, g ORDER BY v, user_id) <= 3")
for _by, _sql in {"avg": "avg(v)", "min": "min(v)", "max": "max(v)", "median": "median(v)", "last": "arg_max(v, g)"}.items():
    for _side, _order in (("topk", "DESC"), ("bottomk", "ASC")):
        add(f"aggr_{_side}_{_by}", ranged(f"{_side}_{_by}(3, {R}) by (event_type)", EL), f"WITH {_R}, k AS (SELECT event_type, user_id FROM r GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round({_sql}, 6) {_order}, user_id) <= 3) {_SERIES_OUT} SEMI JOIN k USING (event_type, user_id)")
add("aggr_limitk", ranged(f"limitk(2, {R}) by (event_type)", EL), f"WITH {_R}, k AS (SELECT event_type, user_id FROM r GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('event_type' || chr(2) || event_type || chr(1) || 'user_id' || chr(2) || user_id)) <= 2) {_SERIES_OUT} SEMI JOIN k USING (event_type, user_id)")
over_types("aggr_mad", f"mad({R}) by (event_type)", "v", f"{_R}, q AS (SELECT event_type, g, mad(v) AS v FROM r GROUP BY event_type, g)")
_C = rolled("CAST(count(v) AS DOUBLE)", DAY)
over_types("aggr_mode", "mode(count_over_time(events_value[1d])) by (event_type)", "v", f"{_C}, q AS (SELECT event_type, g, v FROM r GROUP BY event_type, g, v QUALIFY row_number() OVER (PARTITION BY event_type, g ORDER BY count(*) DESC, v) = 1)")
_STATS = "avg(v) OVER w AS m, stddev_pop(v) OVER w AS d, median(v) OVER w AS md, mad(v) OVER w AS mad, quantile_cont(v, 0.25) OVER w AS q1, quantile_cont(v, 0.75) OVER w AS q3"
_WITH_STATS = f"{_R}, z AS (SELECT *, {_STATS} FROM r WINDOW w AS (PARTITION BY event_type, g))"
add("aggr_zscore", ranged(f"zscore({R}) by (event_type)", EL), f"WITH {_WITH_STATS} SELECT '' AS name, event_type, user_id, g AS ts_ms, round(CASE WHEN d = 0 THEN 0 ELSE (v - m) / d END, 4) AS value FROM z")
for _f, _q, _where in (("outliers_iqr", f"outliers_iqr({R}) by (event_type)", "v > q3 + 1.5 * (q3 - q1) OR v < q1 - 1.5 * (q3 - q1)"), ("outliers_mad", f"outliers_mad(4, {R}) by (event_type)", "abs(v - md) > 4 * mad")):
    add(f"aggr_{_f}", ranged(_q, EL), f"WITH {_WITH_STATS}, k AS (SELECT DISTINCT event_type, user_id FROM z WHERE {_where}) {_SERIES_OUT} SEMI JOIN k USING (event_type, user_id)")
add("aggr_outliersk", ranged(f"outliersk(2, {R}) by (event_type)", EL), f"WITH {_WITH_STATS}, k AS (SELECT event_type, user_id FROM z GROUP BY event_type, user_id QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sum((v - md) * (v - md)) DESC, user_id) <= 2) {_SERIES_OUT} SEMI JOIN k USING (event_type, user_id)")
add("aggr_quantiles", ranged(f'quantiles("phi", 0.1, 0.9, {R}) by (event_type)', ["event_type", "phi"]), f"WITH {_R} " + " UNION ALL ".join(f"SELECT '' AS name, event_type, '{p}' AS phi, g AS ts_ms, round(quantile_cont(v, {p}), 4) AS value FROM r GROUP BY event_type, g" for p in (0.1, 0.9)))

# queries as a whole
over_types("query_with_templates", f"WITH (day(m) = sum_over_time(m[1d]), by_type(x) = sum(x) by (event_type)) by_type(day(events_value)) / 2", "v / 2")
over_types("query_join_prefix", f'{Q} * on(event_type) group_left(x) prefix "one_" label_set({N} * 0 + 2, "x", "y")', "v * 2", extra={"one_x": "'y'"})
over_types("query_join_all_labels", f'{Q} * on(event_type) group_left(*) label_set({N} * 0 + 2, "x", "y")', "v * 2", extra={"x": "'y'"})


def _answer(query: str, labels: list[str], round_digits: int | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: flat(MetricsEngine(events(spark, sf_dir), **options).query_range(query, START / 1000, END / 1000, STEP, round_digits), labels)


add("query_enforced_filters", _answer(Q, ["event_type"], extra_filters='{event_type=~"click|view"}'), f"WITH {Q_CTE} SELECT '' AS name, event_type, g AS ts_ms, round(v, 4) AS value FROM q WHERE event_type IN ('click', 'view')")
add("query_round_digits", _answer(N + " / 7", ["event_type"], 2), f"WITH {N_CTE} SELECT '' AS name, event_type, g AS ts_ms, round(round(v / 7 + 1e-9, 2), 4) AS value FROM q")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as the lines of the query interface, read back."""
    lines = store.matrix_json(MetricsEngine(events(spark, sf_dir)).query_range(Q, START / 1000, END / 1000, STEP))
    j = lines.select(F.from_json("value", "metric map<string,string>, values array<array<string>>").alias("j")).select(C("j.metric")["event_type"].alias("event_type"), F.explode("j.values").alias("p"))
    return j.select(F.lit("").alias("name"), "event_type", (C("p")[0].cast("double") * 1000).cast("bigint").alias("ts_ms"), C("p")[1].cast("double").alias("value")).withColumn("value", F.round(C("value") + 3e-8, 4) + 0.0)


add("sink_matrix_json", matrix, f"WITH {Q_CTE} SELECT '' AS name, event_type, g AS ts_ms, round(v, 4) AS value FROM q")

# relabeling: one rule each, on samples with the labels event_type (e) and user_id (u)
_E, _U = "event_type", "CAST(user_id AS VARCHAR)"


def relabeled(action: str, rule: dict, where: str = "true", name: str = "'events_value'", labels: dict[str, str] | None = None, before: tuple[dict, ...] = ()) -> None:
    cols = {"event_type": _E, "user_id": _U} | (labels or {})
    run = lambda spark, sf_dir: relabel(events(spark, sf_dir), [*before, {"action": action, **rule}]).select("name", *(C("labels")[x].alias(x) for x in cols), "ts_ms")
    add(f"relabel_{action}", run, f"SELECT {name} AS name, {', '.join(f'{sql} AS {x}' for x, sql in cols.items())}, epoch_us(ts) // 1000 AS ts_ms FROM (SELECT *, CAST(NULL AS VARCHAR) AS none FROM events) WHERE {where}")


relabeled("replace_all", {"source_labels": ["event_type"], "regex": "[ie]", "replacement": "_", "target_label": "event_type"}, labels={"event_type": f"regexp_replace({_E}, '[ie]', '_', 'g')"})
relabeled("keep", {"source_labels": ["event_type", "user_id"], "regex": "view;.*1"}, f"event_type = 'view' AND {_U} LIKE '%1'")
_CLICK = ({"target_label": "x", "replacement": "click"},)
relabeled("keepequal", {"source_labels": ["event_type"], "target_label": "x"}, "event_type = 'click'", before=_CLICK)
relabeled("dropequal", {"source_labels": ["event_type"], "target_label": "x"}, "event_type <> 'click'", before=_CLICK)
relabeled("keep_if_equal", {"source_labels": ["event_type", "x"]}, "event_type = 'click'", before=_CLICK)
relabeled("drop_if_equal", {"source_labels": ["event_type", "x"]}, "event_type <> 'click'", before=_CLICK)
relabeled("keep_if_contains", {"target_label": "event_type", "source_labels": ["x"]}, "contains(event_type, 'i')", before=({"target_label": "x", "replacement": "i"},))
relabeled("drop_if_contains", {"target_label": "user_id", "source_labels": ["user_id"], "if": '{event_type="click"}'}, "event_type <> 'click'")
relabeled("keep_metrics", {"regex": "events_.*"})
relabeled("drop_metrics", {"regex": "events_.*", "if": '{event_type!="click"}'}, "event_type = 'click'")
relabeled("labelmap_all", {"regex": "_", "replacement": "X"}, name="''", labels={"event_type": "none", "user_id": "none", "eventXtype": _E, "userXid": _U})
relabeled("labelkeep", {"regex": "user_.*"}, name="''", labels={"event_type": "none"})
relabeled("lowercase", {"source_labels": ["event_type", "user_id"], "separator": "-X-", "target_label": "low"}, labels={"low": f"{_E} || '-x-' || {_U}"})
relabeled("graphite", {"match": "events_*", "labels": {"rest": "${1}!", "__name__": "g_$1"}}, name="'g_value'", labels={"rest": "'value!'"})


def _xxh64_sql(text: str) -> str:
    """The hash of a text of one to four ASCII characters, step by step as the specification has it."""
    p1, p2, p3, _, p5 = (f"{p}::UHUGEINT" for p in (relabeling.P1, relabeling.P2, relabeling.P3, relabeling.P4, relabeling.P5))
    cut = lambda x: f"(({x}) % 18446744073709551616::UHUGEINT)"
    xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
    rot = lambda c, n: cut(f"{c} * {2**n}::UHUGEINT + {c} // {2 ** (64 - n)}::UHUGEINT")
    byte = lambda i: f"ascii(x[{i}])::UHUGEINT"
    steps = [f"h0 AS (SELECT x, length(x) AS n, {p5} + length(x)::UHUGEINT AS h FROM (SELECT DISTINCT {text} AS x FROM events))"]
    for i in range(1, 4):
        steps.append(f"m{i} AS (SELECT *, CASE WHEN n < 4 AND n >= {i} THEN {xor('h', cut(f'{byte(i)} * {p5}'))} ELSE h END AS c FROM {'h0' if i == 1 else f'h{i - 1}'}), h{i} AS (SELECT x, n, CASE WHEN n < 4 AND n >= {i} THEN {cut(rot('c', 11) + f' * {p1}')} ELSE h END AS h FROM m{i})")
    word = " + ".join(f"{byte(i + 1)} * {256**i}::UHUGEINT" for i in range(4))
    steps.append(f"m4 AS (SELECT *, CASE WHEN n = 4 THEN {xor('h', cut(f'({word}) * {p1}'))} ELSE h END AS c FROM h3), h4 AS (SELECT x, CASE WHEN n = 4 THEN {cut(rot('c', 23) + f' * {p2} + {p3}')} ELSE h END AS h FROM m4)")
    mix = lambda n: xor("h", f"h // {2**n}::UHUGEINT")
    steps += [f"h5 AS (SELECT x, {cut(mix(33) + f' * {p2}')} AS h FROM h4)", f"h6 AS (SELECT x, {cut(mix(29) + f' * {p3}')} AS h FROM h5)", f"hash AS (SELECT x, {mix(32)} AS h FROM h6)"]
    return ", ".join(steps)


add("relabel_hashmod", lambda spark, d: relabel(events(spark, d), [{"action": "hashmod", "source_labels": ["user_id"], "modulus": 97, "target_label": "part"}]).select(C("labels")["user_id"].alias("user_id"), C("labels")["part"].alias("part"), "ts_ms"), f"WITH {_xxh64_sql(_U)} SELECT x AS user_id, CAST(h % 97 AS VARCHAR) AS part, epoch_us(ts) // 1000 AS ts_ms FROM events JOIN hash ON x = {_U}")

# formats that SQL cannot write: written by this library, read back by its other half
_BACK = "SELECT 'events_value' AS name, event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts_ms, round(value, 4) AS value FROM events"
add("source_remote_write", lambda spark, d: flat(protobuf.remote_write(wire_out.messages(events(spark, d), "remote_write")), EL), _BACK)
add("source_otlp", lambda spark, d: flat(protobuf.otlp(wire_out.messages(events(spark, d), "otlp"), encoding="gzip"), EL), _BACK)
for _enc in ("gzip", "deflate", "zstd"):
    add(f"source_compressed_{_enc}", lambda spark, d, e=_enc: flat(formats.prometheus(wire_out.text_lines(wire_out.text_bodies(store.export_prometheus(events(spark, d)), encoding=e), encoding=e)), EL), _BACK)
add("source_extra_labels", lambda spark, d: flat(formats.prometheus(store.export_prometheus(events(spark, d)), extra={"job": "x", "event_type": "all"}), [*EL, "job"]), _BACK.replace(" event_type,", " 'all' AS event_type, 'x' AS job,"))



def stored_series(spark: SparkSession, sf_dir: str) -> MetricsEngine:
    """An engine on the events as a stored table of series and samples."""
    path = new_folder(spark, "events")
    series.write(events(spark, sf_dir), path)
    return MetricsEngine(series.StoredSeries(spark, path))


def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "samples")
    store.write_samples(events(spark, sf_dir), path)
    return flat(store.read_samples(spark, path, START, END), EL)


add("store_samples", stored_samples, _BACK)
add("store_series_export", lambda spark, d: flat(stored_series(spark, d).export('{__name__="events_value"}'), EL), _BACK)
add("store_series_query", lambda spark, d: flat(stored_series(spark, d).query_range('sum(sum_over_time(events_value{event_type=~"click|view"}[1d])) by (event_type)', START / 1000, END / 1000, STEP), ["event_type"]), f"WITH {Q_CTE} SELECT '' AS name, event_type, g AS ts_ms, round(v, 4) AS value FROM q WHERE event_type IN ('click', 'view')")

# alerts as series
_BUSY = rules.Rule("sum(count_over_time(events_value[6h])) by (event_type) > 18", alert="Busy", for_="12h")


def alert_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = rules.alert_states(MetricsEngine(events(spark, sf_dir)), rules.Group("g", [], "6h"), _BUSY, START, END)
    a = rules.alert_samples(states, STEP)
    return a.select("name", *(C("labels")[x].alias(x) for x in ("alertname", "event_type", "alertstate")), "ts_ms", "value", "is_stale")


_RUNS = f"""{rolled('count(v)', STEP)}, q AS (SELECT event_type, g FROM r GROUP BY event_type, g HAVING sum(v) > 18),
  i AS (SELECT *, g - {STEP} * row_number() OVER (PARTITION BY event_type ORDER BY g) AS isl FROM q), a AS (SELECT *, min(g) OVER (PARTITION BY event_type, isl) AS active_at FROM i),
  st AS (SELECT *, CASE WHEN g - active_at >= {12 * 3_600_000} THEN 'firing' ELSE 'pending' END AS state FROM a),
  live AS (SELECT 'ALERTS' AS name, event_type, state AS alertstate, g, CAST(1 AS DOUBLE) AS v FROM st UNION ALL SELECT 'ALERTS_FOR_STATE', event_type, NULL, g, active_at / 1000 FROM st),
  ends AS (SELECT name, event_type, alertstate, g + {STEP} AS g FROM live QUALIFY coalesce(lead(g) OVER (PARTITION BY name, event_type, alertstate ORDER BY g) > g + {STEP}, true))"""
add("rule_alert_series", alert_series, f"WITH {_RUNS} SELECT name, 'Busy' AS alertname, event_type, alertstate, g AS ts_ms, v AS value, false AS is_stale FROM live UNION ALL SELECT name, 'Busy', event_type, alertstate, g, NULL, true FROM ends")


def restored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from the middle of the range on, with the times since which alerts were active from the samples before."""
    engine, group, middle = MetricsEngine(events(spark, sf_dir)), rules.Group("g", [], "6h"), START + 15 * DAY
    stored = rules.alert_samples(rules.alert_states(engine, group, _BUSY, START, middle - STEP), STEP)
    # what was stale at the new start had not been written when it came
    known = rules.active_before(stored.where(C("ts_ms") < middle), _BUSY, middle, 12 * 3_600_000)
    d = rules.alert_states(engine, group, _BUSY, middle, END, known)
    return d.select(C("labels")["event_type"].alias("event_type"), "ts_ms", "value", "active_at", "state")


add("rule_restored_alerts", restored_alerts, f"WITH {_RUNS.split('st AS')[0].rstrip().rstrip(',').replace('SELECT event_type, g FROM r', 'SELECT event_type, g, CAST(sum(v) AS DOUBLE) AS v FROM r')} SELECT event_type, g AS ts_ms, v AS value, active_at, CASE WHEN g - active_at >= {12 * 3_600_000} THEN 'firing' ELSE 'pending' END AS state FROM a WHERE g >= {START + 15 * DAY}")


def notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads of a rule with annotations, read back."""
    rule = rules.Rule(_BUSY.expr, alert="Busy", for_="12h", annotations={"summary": "{{ $labels.event_type }} has {{ $value }}"})
    states = rules.alert_states(MetricsEngine(events(spark, sf_dir)), rules.Group("g", [], "6h"), rule, START, END)
    sent = rules.notifications(rules.annotated(states, rule), STEP, "http://here")
    rows = F.from_json("payload", "array<struct<labels:map<string,string>,annotations:map<string,string>,startsAt:timestamp,endsAt:timestamp,generatorURL:string>>")
    d = sent.select("ts_ms", F.explode(rows).alias("a"))
    return d.select("ts_ms", C("a.labels")["event_type"].alias("event_type"), C("a.annotations")["summary"].alias("summary"), F.unix_millis("a.startsAt").alias("starts_ms"), F.unix_millis("a.endsAt").alias("ends_ms"), C("a.generatorURL").alias("url"))


_FIRING = f"{_RUNS.split('st AS')[0].rstrip().rstrip(',').replace('SELECT event_type, g FROM r', 'SELECT event_type, g, sum(v) AS v FROM r')}, fi AS (SELECT * FROM a WHERE g - active_at >= {12 * 3_600_000})"
add("rule_notifications", notified, f"""WITH {_FIRING}
  SELECT g AS ts_ms, event_type, event_type || ' has ' || CAST(v AS VARCHAR) AS summary, active_at AS starts_ms, CAST(NULL AS BIGINT) AS ends_ms, 'http://here' AS url FROM fi
  UNION ALL SELECT g + {STEP}, event_type, event_type || ' has ' || CAST(v AS VARCHAR), active_at, g + {STEP}, 'http://here' FROM fi QUALIFY row_number() OVER (PARTITION BY event_type, active_at ORDER BY g DESC) = 1""")
