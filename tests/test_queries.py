import collections
import glob
import math
import os

import pytest

from tidegrid.plans import registry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
# one or two of each kind; all of them are compared in the same way outside of the tests
NAMES = """p1_found p1_rejects p1_loaded p2_found p2_key_stats p4_found p4_grid flagship_max_by double_groupby selector_windowless selector_regex_or
    rollup_rate rollup_increase rollup_delta rollup_integrate rollup_rollup_rate rollup_holt_winters transform_histogram_quantile transform_interpolate transform_sort aggr_topk_avg aggr_limitk aggr_outliers_mad relabel_keep_if_contains query_with_templates rollup_changes rollup_lag rollup_irate rollup_resets rollup_quantile_over_time offset_at
    absent_over_time subquery_max aggr_any aggr_topk aggr_limit binary_mod compare_default set_or set_unless join_group_left
    transform_round transform_scalar transform_sort_desc instant_query dedup_daily relabel_rules interval_rate_avg interval_total
    interval_quantiles rule_alerting rule_recording source_csv source_datadog_v2 sink_export_json""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = collections.Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    got = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == want


def test_entry_works_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


def test_grids_cover_the_tables(spark, con):
    # windows as wide as the step share no sample: they add up to the whole table
    run = lambda name: registry.queries()[name](spark, DATA)
    total = con.execute("SELECT CAST(sum(o_totalprice) AS DOUBLE) FROM orders").fetchone()[0]
    assert sum(r.value for r in run("orders_monthly_rate").collect()) == pytest.approx(total)
    counts = run("transform_running_sum").groupBy("event_type").max("value").collect()
    assert sum(r[1] for r in counts) == con.execute("SELECT count(value) FROM events").fetchone()[0]
    assert run("export_samples").count() == con.execute("SELECT count(*) FROM events WHERE event_type <> 'view'").fetchone()[0]
    last = con.execute("SELECT epoch_ms(max(l_shipdate)) FROM lineitem").fetchone()[0]
    assert max(r.ts_ms for r in run("lineitem_quantity_max").collect()) >= last


@pytest.mark.parametrize("name", ["rollup_count_over_time", "rollup_quantile_over_time", "rollup_lag", "transform_abs"])
def test_rollups_and_transforms_read_all_series(spark, con, name):
    series = {(r.event_type, r.user_id) for r in registry.queries()[name](spark, DATA).select("event_type", "user_id").distinct().collect()}
    assert series == set(con.execute("SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) FROM events WHERE value IS NOT NULL").fetchall())


def scans(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in line]


@pytest.mark.parametrize("name", ["transform_histogram_quantile", "transform_histogram_stdvar", "transform_histogram_share", "transform_histogram_fraction"])
def test_histograms_read_the_samples_of_a_bucket_once(spark, name):
    # four buckets, each straight from the samples: no series of users in between
    read = scans(registry.queries()[name](spark, DATA))
    assert len(read) == 4
    assert not any("user_id" in line for line in read)
