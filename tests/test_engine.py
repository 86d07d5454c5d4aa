import math

import pytest
from pyspark.sql import functions as F

from tidegrid.engine import MetricsEngine, time_ms
from tidegrid.model import SAMPLES, Grid
from tidegrid.plans.compiler import Compiler
from tidegrid.ql.syntax import QueryError, parse

TIMES = [5, 15, 24, 36, 49, 60, 78, 80, 97, 115, 120, 130]
VALUES = [123.0, 34, 44, 21, 54, 34, 99, 12, 44, 32, 34, 34]
START = 1_000_000


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("foo", {"a": "1"}, t, float(v), False) for t, v in zip(TIMES, VALUES, strict=True)]
    rows += [("cpu", {"host": f"h{h}"}, START + s * 1000, s / 10 + h * 1000.0, False) for h in range(3) for s in range(0, 3600, 10)]
    rows += [("gone", {}, START + s * 1000, 1.0, False) for s in range(0, 600, 60)] + [("gone", {}, START + 600_000, None, True)]
    rows += [("nan", {}, START, math.nan, False), (None, None, START, 1.0, None)]
    return MetricsEngine(spark.createDataFrame(rows, SAMPLES).cache())


def points(df):
    return sorted((r.name, tuple(sorted(r.labels.items())), r.ts_ms, round(r.value, 6)) for r in df.collect())


def values(engine, q, start=1000, end=4600, step="5m"):
    return [p[3] for p in sorted(points(engine.query_range(q, start, end, step)), key=lambda p: (p[1], p[2]))]


# one window (0, 130 ms] over all twelve samples
KERNELS = {
    "avg_over_time": sum(VALUES) / 12,
    "sum_over_time": sum(VALUES),
    "sum2_over_time": sum(v * v for v in VALUES),
    "count_over_time": 12,
    "min_over_time": 12,
    "max_over_time": 123,
    "range_over_time": 111,
    "first_over_time": 123,
    "last_over_time": 34,
    "median_over_time": 34,
    "present_over_time": 1,
    "changes": 11,
    "changes_prometheus": 10,
    "resets": 5,
    "delta": 34,
    "delta_prometheus": -89,
    "increase": 398,
    "increase_prometheus": 275,
    "increase_pure": 398,
    "idelta": 0,
    "ideriv": 0,
    "irate": 0,
    "deriv_fast": -712,
    "rate": 2200,
    "lag": 0,
    "tfirst_over_time": 0.005,
    "tlast_over_time": 0.13,
    "tmax_over_time": 0.005,
    "tmin_over_time": 0.08,
    "timestamp": 0.13,
}


@pytest.mark.parametrize("name", KERNELS)
def test_rollup_kernels(engine, name):
    got = points(engine.query(f"{name}(foo[130ms])", 0.130, 0.13))
    want = KERNELS[name]
    if name == "resets":
        want = sum(b < a for a, b in zip(VALUES, VALUES[1:], strict=False))
    if name == "changes":
        want = 1 + sum(a != b for a, b in zip(VALUES, VALUES[1:], strict=False))
    if name == "changes_prometheus":
        want = sum(a != b for a, b in zip(VALUES, VALUES[1:], strict=False))
    assert [p[3] for p in got] == [pytest.approx(want)]


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("1", [1.0] * 3),
        ("time()", [1000.0, 1200.0, 1400.0]),
        ("-2 ^ 2", [-4.0] * 3),
        ("7 % 4 + 10 / 4", [5.5] * 3),
        ("1 / 0", [math.inf] * 3),
        ("0 / 0", []),
        ("time() > 1100", [1200.0, 1400.0]),
        ("time() > bool 1100", [0.0, 1.0, 1.0]),
        ("(time() > 1100) default 5", [5.0, 1200.0, 1400.0]),
        ("clamp(time(), 1100, 1300)", [1100.0, 1200.0, 1300.0]),
        ("round(time() / 300, 0.5)", [3.5, 4.0, 4.5]),
        ("round(-2.5)", [-3.0] * 3),
        ("sgn(time() - 1200)", [-1.0, 0.0, 1.0]),
        ("ln(0)", [-math.inf] * 3),
        ("abs(-3)", [3.0] * 3),
        ("ceil(1.2) + floor(1.8)", [3.0] * 3),
        ("step() + start() + end()", [2600.0] * 3),
        ('scalar("12")', [12.0] * 3),
        ("absent(nope)", [1.0] * 3),
        ("timezone_offset('Europe/Berlin')", [3600.0] * 3),
        ("holt_winters(vector(time())[10m:200s], 0.5, 0.5)", [1000.0, 1200.0, 1400.0]),
        ("range_mad(time())", [200.0] * 3),
        ("range_linear_regression(time())", [1000.0, 1200.0, 1400.0]),
        ("smooth_exponential(time(), 0.5)", [1000.0, 1100.0, 1250.0]),
        ("NaN", []),
        ("2 atan2 2", [pytest.approx(math.pi / 4, abs=1e-6)] * 3),
    ],
)
def test_expressions_without_data(engine, q, want):
    assert values(engine, q, 1000, 1400, "200s") == want


@pytest.mark.parametrize(
    ("q", "series", "first"),
    [
        ("sum(cpu)", 1, 3000.0),
        ("avg(cpu) by (host)", 3, 0.0),
        ("max(cpu) without (host)", 1, 2000.0),
        ("count(cpu)", 1, 3.0),
        ("topk(1, cpu)", 1, 2000.0),
        ("bottomk(1, cpu)", 1, 0.0),
        ("quantile(0.5, cpu)", 1, 1000.0),
        ("any(cpu)", 1, 0.0),
        ("count(cpu) by (host) limit 2", 2, 1.0),
        ("cpu + on(host) cpu", 3, 0.0),
        ("cpu * 2", 3, 0.0),
        ("cpu unless cpu{host='h1'}", 2, 0.0),
        ("cpu and cpu{host='h1'}", 1, 1000.0),
        ("cpu{host='h1'} or cpu{host='h2'}", 2, 1000.0),
        ("cpu / on(host) group_left sum(cpu) by (host)", 3, 1.0),
        ("union(cpu, cpu)", 3, 0.0),
        ("label_replace(cpu, 'n', '$1', 'host', 'h(.)')", 3, 0.0),
        ("max_over_time(cpu[10m:1m])", 3, 0.0),
        ("running_sum(cpu)", 3, 0.0),
    ],
)
def test_series_counts(engine, q, series, first):
    got = points(engine.query_range(q, 1000, 4600, "5m"))
    assert len({p[:2] for p in got}) == series
    assert min(got, key=lambda p: (p[2], p[1]))[3] == pytest.approx(first)


def test_rate_needs_two_samples(engine):
    assert values(engine, "rate(cpu{host='h1'}[5m])")[0] == pytest.approx(0.1)
    assert len(values(engine, "rate(cpu{host='h1'}[5m])")) == 12


def test_stale_marker_ends_a_series(engine):
    assert len(values(engine, "gone", 1000, 2200, "1m")) == 10
    assert len(values(engine, "last_over_time(gone[5m])", 1000, 2200, "1m")) == 14


def test_missing_series_stay_alive_for_default(engine):
    got = values(engine, "(cpu > 9999) default 7")
    assert got == [7.0] * 39


def test_offset_and_at(engine):
    assert values(engine, "cpu{host='h0'} offset 5m")[0] == 0.0
    assert set(values(engine, "cpu{host='h0'} @ 2000")) == {100.0}


def test_duplicates_are_errors(engine):
    for q in ("label_set(cpu, 'host', 'x')", "sum(cpu) by (host) + on() cpu"):
        with pytest.raises(Exception, match="duplicate"):
            engine.query_range(q, 1000, 2000, "5m").collect()


def test_unsupported_and_limits(engine):
    with pytest.raises(QueryError):
        engine.query_range("rate(cpu, foo)", 1000, 2000)
    with pytest.raises(QueryError):
        engine.query_range("cpu", 0, 40_000, "1s")


def test_sorting(engine):
    got = engine.query_range("sort_desc(cpu)", 1000, 4600, "5m").collect()
    assert {r.labels["host"]: r.ord for r in got} == {"h2": 1, "h1": 2, "h0": 3}


def test_listings(engine):
    assert engine.query("cpu{host='h1'}[1m]", 2000).count() == 6
    assert {r.label for r in engine.labels("cpu").collect()} == {"__name__", "host"}
    assert {r.value for r in engine.label_values("host").collect()} == {"h0", "h1", "h2"}
    assert engine.series('cpu{host!="h0"}').count() == 2
    assert engine.delete_series("cpu").where("name = 'cpu'").count() == 0


def test_times():
    assert time_ms("2024-01") == 1704067200000
    assert time_ms("2024-01-01T00:00:00Z") == 1704067200000
    assert time_ms(1704067200) == time_ms(1704067200000) == time_ms(1704067200000000) == 1704067200000
    assert time_ms("now-1h", 7_200_000) == 3_600_000


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("q", ["rate(events_value[2d])", "increase(events_value[2d])", "delta(events_value[2d])", "lag(events_value[2d])"])
def test_neighbours_need_one_scan_and_one_shuffle_of_samples(spark, q, tmp_path):
    rows = [("events_value", {"u": str(u)}, 1_000_000 * i, float(i * u % 7), False) for u in range(5) for i in range(200)]
    spark.createDataFrame(rows, SAMPLES).write.parquet(str(tmp_path / "s"))
    plan = executed(MetricsEngine(spark.read.parquet(str(tmp_path / "s"))).query_range(q, 0, 190_000, "6h"))
    assert plan.count("FileScan") == 1
    assert plan.count("ReusedExchange") == 1
    # one by series and shard, one of the shards' edges by series (and maybe back), one of the result
    assert plan.count("Exchange hashpartitioning") <= 5


def test_equal_times_follow_in_order_of_value(spark):
    rows = [("c", {}, t, float(v), False) for t, v in ((0, 1), (60_000, 5), (60_000, 3), (120_000, 9))]
    for seed in range(3):
        e = MetricsEngine(spark.createDataFrame(rows, SAMPLES).orderBy(F.rand(seed)))
        assert [r.value for r in e.query_range("changes(c[10m])", 120, 120).collect()] == [4.0]
        assert [r.value for r in e.query_range("resets(c[10m])", 120, 120).collect()] == [0.0]


def test_aggr_over_time_takes_a_list(engine):
    for q in ('aggr_over_time(("min_over_time", "max_over_time"), cpu{host="h1"}[10m])', 'aggr_over_time("min_over_time", cpu{host="h1"}[10m])'):
        got = {r.labels["rollup"]: r.value for r in engine.query_range(q, 2000, 2000).collect()}
        assert got["min_over_time"] < 2000
    assert set(got) == {"min_over_time"}


def test_empty_table(spark):
    e = MetricsEngine(spark.createDataFrame([], SAMPLES))
    assert e.query_range("sum(rate(x[5m]))", 0, 600, "1m").count() == 0
    assert e.query_range("x default 1", 0, 600, "1m").count() == 11


def test_metamorphic_scalar_paths(engine):
    """The projection for constants and the general join agree."""
    a = values(engine, "cpu * 3")
    b = values(engine, "cpu * on() group_left label_set(vector(3), 'z', '1')")
    assert a == b


@pytest.mark.parametrize("q", ["sum(sum_over_time(cpu[10m])) by (host)", "max(max_over_time(cpu[10m] offset 5m))", "min(min_over_time(cpu[7m])) without (host)", "sum(count_over_time(cpu[10m]))", "sum(sum2_over_time(cpu[10m])) by (__name__)", "group(present_over_time(cpu[10m])) by (host) limit 2"])
def test_metamorphic_fused_aggregates(engine, q, monkeypatch):
    """Aggregating samples at once and by way of their series agree."""
    at_once = points(engine.query_range(q, 1000, 4600, "5m"))
    monkeypatch.setattr("tidegrid.plans.compiler.FUSED", {})
    assert points(engine.query_range(q, 1000, 4600, "5m")) == at_once
    assert at_once


def test_geomean_of_many_series(spark):
    # the product of the first group is 1e1500, that of the second 1e-1500
    rows = [(n, {"i": str(i)}, 1_000_000, x, False) for n, x in (("big", 1e3), ("small", 1e-3)) for i in range(500)]
    cases = {"zero": [0.0, 1e300, 1e300], "odd": [-2.0, 8.0, 4.0], "even": [-2.0, -8.0], "one": [-3.0], "inf": [math.inf, 0.0], "mixed": [2.0, 8.0]}
    rows += [(n, {"i": str(i)}, 1_000_000, x, False) for n, xs in cases.items() for i, x in enumerate(xs)]
    df = MetricsEngine(spark.createDataFrame(rows, SAMPLES)).query('geomean(last_over_time({__name__!=""}[1m]) keep_metric_names) by (__name__)', 1000)
    got = {r.name: r.value for r in df.collect() if r.value is not None}
    assert got == pytest.approx({"big": 1e3, "small": 1e-3, "zero": 0.0, "even": 4.0, "one": -3.0, "mixed": 4.0})


@pytest.mark.parametrize("q", ["sum(count_le_over_time(cpu[10m], 1100)) by (host)", "sum(count_gt_over_time(cpu[10m] offset 5m, 1100))", "sum(count_eq_over_time(cpu[10m], 1100)) by (__name__, host)", "sum(count_ne_over_time(cpu[10m], 1100)) without (host)", 'sum(count_le_over_time({__name__=~"cpu|gone"}[10m], 100) keep_metric_names) by (none, __name__, host)'])
def test_metamorphic_fused_counts(engine, q, monkeypatch):
    """Counting samples at once makes no series; by way of their series the counts agree."""
    e = parse(q)
    assert Compiler(engine.samples, Grid(1_000_000, 4_600_000, 300_000)).fused(e) is not None
    at_once = points(engine.query_range(q, 1000, 4600, "5m"))
    monkeypatch.setattr("tidegrid.plans.compiler.FUSED", {})
    assert points(engine.query_range(q, 1000, 4600, "5m")) == at_once
    assert at_once


def test_fused_groups_of_odd_labels(spark):
    """Groups by labels that are null, empty, absent or named like the metric's name."""
    odd = [(None, None), ("m", {}), ("m", None), ("m", {"a": ""}), ("m", {"a": None}), ("m", {"a": "1", "b": "2"}), ("m", {"b": "2", "a": "1", "c": "3"}), ("m", {"__name__": "x", "b": ""}), ("", {"b": "2"})]
    e = MetricsEngine(spark.createDataFrame([(n, x, 1_000_000 + i, float(2**i), False) for i, (n, x) in enumerate(odd)], SAMPLES))
    of = lambda q: {(r.name, *sorted(r.labels.items())): r.value for r in e.query(q, 1001).collect()}
    every = '{a!="none"}[1m]'
    assert of(f"sum(sum_over_time({every})) by (b, a, b)") == {("",): 159.0, ("", ("a", "1"), ("b", "2")): 96.0, ("", ("b", "2")): 256.0}
    assert of(f"sum(sum_over_time({every}) keep_metric_names) by (__name__)") == {("",): 257.0, ("m",): 254.0}
    assert of(f"sum(sum_over_time({every})) by (__name__)") == {("",): 511.0}


def test_union_takes_series_of_the_first_part(engine):
    both = 'union(sum(count_over_time(cpu[10m])) by (host), label_set(sum(sum_over_time(cpu[10m])), "host", "h1"), label_set(vector(7), "host", "new"))'
    got = points(engine.query_range(both, 1000, 4600, "5m"))
    alone = points(engine.query_range("sum(count_over_time(cpu[10m])) by (host)", 1000, 4600, "5m"))
    assert [p for p in got if p[1] != (("host", "new"),)] == alone
    assert [p[3] for p in got if p[1] == (("host", "new"),)] == [7.0] * 13


def test_buckets_of_both_kinds(spark):
    """Ranges become cumulative buckets, other series pass, also those without a value or with the same other labels."""
    rows = [("m", {"a": "1", "vmrange": "0...1.000e+00"}, 1.0), ("m", {"a": "1", "vmrange": "1.000e+00...2.000e+00"}, 2.0), ("m", {"a": "1"}, 5.0), ("m", {"a": "1", "le": "8"}, 6.0), ("m", {"b": "1"}, 7.0)]
    e = MetricsEngine(spark.createDataFrame([(n, x, 1_000_000, v, False) for n, x, v in rows], SAMPLES))
    got = sorted((tuple(sorted(r.labels.items())), r.value) for r in e.query("prometheus_buckets(m)", 1000).collect())
    a = ("a", "1")
    assert got == sorted([((a,), 5.0), ((("b", "1"),), 7.0), ((a, ("le", "8")), 6.0), ((a, ("le", "0")), 0.0), ((a, ("le", "1.000e+00")), 1.0), ((a, ("le", "2.000e+00")), 3.0), ((a, ("le", "+Inf")), 3.0)])
