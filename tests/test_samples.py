import json
import struct

import pytest
from pyspark.sql import functions as F

from tidegrid.engine import MetricsEngine
from tidegrid.model import SAMPLES
from tidegrid.operators.relabel import _xxh64, relabel, validate
from tidegrid.rules import rules
from tidegrid.sources import formats, protobuf, store
from tidegrid.streaming import aggregation


def flat(df):
    return sorted((r.name, tuple(sorted(r.labels.items())), r.ts_ms, r.value) for r in df.collect())


def lines(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "value string")


RELABEL = [
    ({"action": "replace", "source_labels": ["a"], "target_label": "b", "regex": "(.+)x", "replacement": "$1-y"}, {"a": "1x"}, {"a": "1x", "b": "1-y"}),
    ({"target_label": "b", "replacement": "{{a}}/{{__name__}}"}, {"a": "1"}, {"a": "1", "b": "1/m"}),
    ({"action": "replace_all", "source_labels": ["a"], "target_label": "a", "regex": "-", "replacement": "_"}, {"a": "1-2-3"}, {"a": "1_2_3"}),
    ({"action": "keep", "source_labels": ["a"], "regex": "1|2"}, {"a": "1"}, {"a": "1"}),
    ({"action": "keep", "source_labels": ["a"], "regex": "1|2"}, {"a": "12"}, None),
    ({"action": "drop", "source_labels": ["a", "b"], "regex": "1;2"}, {"a": "1", "b": "2"}, None),
    ({"action": "keepequal", "source_labels": ["a"], "target_label": "b"}, {"a": "1", "b": "1"}, {"a": "1", "b": "1"}),
    ({"action": "dropequal", "source_labels": ["a"], "target_label": "b"}, {"a": "1", "b": "1"}, None),
    ({"action": "keep_if_equal", "source_labels": ["a", "b"]}, {"a": "1", "b": "2"}, None),
    ({"action": "drop_if_equal", "source_labels": ["a", "b"]}, {"a": "1", "b": "2"}, {"a": "1", "b": "2"}),
    ({"action": "keep_if_contains", "source_labels": ["a"], "target_label": "b"}, {"a": "1", "b": "012"}, {"a": "1", "b": "012"}),
    ({"action": "drop_if_contains", "source_labels": ["a"], "target_label": "b"}, {"a": "1", "b": "012"}, None),
    ({"action": "keep_metrics", "regex": ["m", "n"]}, {"a": "1"}, {"a": "1"}),
    ({"action": "drop_metrics", "regex": "m"}, {"a": "1"}, None),
    ({"action": "labelmap", "regex": "x_(.+)", "replacement": "$1"}, {"x_a": "1"}, {"x_a": "1", "a": "1"}),
    ({"action": "labelmap_all", "regex": "-", "replacement": "_"}, {"x-a-b": "1"}, {"x_a_b": "1"}),
    ({"action": "labeldrop", "regex": "x.*"}, {"xa": "1", "b": "2"}, {"b": "2"}),
    ({"action": "labelkeep", "regex": "__name__|b"}, {"xa": "1", "b": "2"}, {"b": "2"}),
    ({"action": "lowercase", "source_labels": ["a"], "target_label": "b"}, {"a": "ABC"}, {"a": "ABC", "b": "abc"}),
    ({"action": "uppercase", "source_labels": ["a"], "target_label": "b"}, {"a": "abc"}, {"a": "abc", "b": "ABC"}),
    ({"action": "hashmod", "source_labels": ["a"], "target_label": "h", "modulus": 123}, {"a": "x"}, {"a": "x", "h": str(_xxh64(b"x") % 123)}),
    ({"action": "labeldrop", "regex": "a", "if": '{b="2"}'}, {"a": "1"}, {"a": "1"}),
    ({"action": "keep", "if": '{a="1"}'}, {"a": "2"}, None),
    ({"target_label": "a", "replacement": ""}, {"a": "1"}, {}),
]


@pytest.mark.parametrize(("rule", "labels", "want"), RELABEL)
def test_relabel(spark, rule, labels, want):
    df = spark.createDataFrame([("m", labels, 1, 1.0, False)], SAMPLES)
    got = relabel(df, [rule]).collect()
    assert [dict(r.labels) for r in got] == ([] if want is None else [want])


def test_relabel_graphite_and_errors(spark):
    df = spark.createDataFrame([("a.b.c", {}, 1, 1.0, False)], SAMPLES)
    r = relabel(df, [{"action": "graphite", "match": "a.*.*", "labels": {"x": "$1-$2", "__name__": "z"}}]).first()
    assert (r.name, r.labels) == ("z", {"x": "b-c"})
    for bad in ({"action": "nope"}, {"action": "hashmod", "source_labels": ["a"], "target_label": "b"}, {"action": "keep_metrics"}, {"unknown": 1}, {"action": "replace"}):
        with pytest.raises(ValueError, match=r".+"):
            validate(bad)
    assert relabel(df.where("false"), [{"action": "drop_metrics", "regex": "a"}]).count() == 0


def test_hash_reference_values():
    xxhash = pytest.importorskip("xxhash")
    for n in (0, 1, 3, 4, 7, 8, 31, 32, 33, 100):
        data = bytes(range(n % 256)) * 1
        assert _xxh64(data) == xxhash.xxh64_intdigest(data, 0)


def test_text_formats(spark):
    got = flat(formats.prometheus(lines(spark, "# HELP x", "", 'm{a="x,\\"y\\" } z",b="2"} 1.5 10', "n 3", 'bad{a=b} 1', "q NaN 5", "r +Inf 6"), now_ms=7))
    assert got == [("m", (("a", 'x,"y" } z'), ("b", "2")), 10, 1.5), ("n", (), 7, 3.0), ("q", (), 5, pytest.approx(float("nan"), nan_ok=True)), ("r", (), 6, float("inf"))]
    assert flat(formats.graphite(lines(spark, "a.b;k=v 1 2", "c 3", "bad", "d 1 x"), now_ms=9)) == [("a.b", (("k", "v"),), 2000, 1.0), ("c", (), 9, 3.0)]
    assert flat(formats.opentsdb(lines(spark, "put m 10 2 a=b", "put m 10", "put n 1500000000000 3"))) == [("m", (("a", "b"),), 10000, 2.0), ("n", (), 1500000000000, 3.0)]
    assert flat(formats.influx(lines(spark, 'm,a=b f=1,g="s",h=t 1500000000000000000', "bad"), db="d")) == [("m_f", (("a", "b"), ("db", "d")), 1500000000000, 1.0), ("m_h", (("a", "b"), ("db", "d")), 1500000000000, 1.0)]
    assert flat(formats.csv(lines(spark, 'x,"a,b",3', "y,c,bad"), "1:label:k,2:label:l,3:metric:m", now_ms=1)) == [("m", (("k", "x"), ("l", "a,b")), 1, 3.0)]
    body = json.dumps({"metric": {"__name__": "m", "a": ""}, "values": [1, None, "Infinity"], "timestamps": [1, 2, 3]})
    assert flat(formats.json_lines(lines(spark, body, "{"))) == [("m", (), 1, 1.0), ("m", (), 3, float("inf"))]
    extra = formats.path_labels("/api/metrics/job/j/x@base64/eQ")
    assert extra == {"job": "j", "x": "y"}
    assert flat(formats.graphite(lines(spark, "c 3"), now_ms=9, extra=extra)) == [("c", (("job", "j"), ("x", "y")), 9, 3.0)]


def test_scrape(spark):
    got = flat(formats.scrape(lines(spark, 'm{job="own"} 1'), {"job": "target"}, 5))
    assert ("m", (("exported_job", "own"), ("job", "target")), 5, 1.0) in got
    assert ("up", (("job", "target"),), 5, 1.0) in got


def field(n, kind, payload):
    def var(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    head = var(n << 3 | kind)
    return head + (var(len(payload)) + payload if kind == 2 else var(payload) if kind == 0 else payload)


def test_protobuf(spark):
    lab = lambda k, v: field(1, 2, field(1, 2, k) + field(2, 2, v))
    sample = lambda v, t: field(2, 2, field(1, 1, struct.pack("<d", v)) + field(2, 0, t))
    msg = field(1, 2, lab(b"__name__", b"m") + lab(b"a", b"b") + sample(1.5, 10) + sample(protobuf.STALE, 20))
    raw = bytes([len(msg)]) + bytes([(len(msg) - 1) << 2 & 0xFF]) + msg if len(msg) <= 60 else bytes([len(msg)]) + bytes([60 << 2, len(msg) - 1]) + msg
    df = spark.createDataFrame([(bytearray(raw),), (bytearray(b"\xff\xff"),), (None,)], "content binary")
    got = [(r.name, r.labels, r.ts_ms, r.value, r.is_stale) for r in protobuf.remote_write(df).orderBy("ts_ms").collect()]
    assert got == [("m", {"a": "b"}, 10, 1.5, False), ("m", {"a": "b"}, 20, None, True)]
    attr = lambda n, k, v: field(n, 2, field(1, 2, k) + field(2, 2, field(1, 2, v)))
    point = attr(9, b"x", b"y") + field(3, 1, struct.pack("<Q", 5_000_000)) + field(4, 1, struct.pack("<Q", 3)) + field(5, 1, struct.pack("<d", 9.0)) + field(6, 2, struct.pack("<QQ", 1, 2)) + field(7, 2, struct.pack("<d", 2.5))
    metric = field(1, 2, b"h") + field(9, 2, field(1, 2, point))
    otlp = field(1, 2, field(1, 2, attr(1, b"svc", b"s")) + field(2, 2, field(2, 2, metric)))
    got = flat(protobuf.otlp(spark.createDataFrame([(bytearray(otlp),)], "content binary")))
    base = (("svc", "s"), ("x", "y"))
    assert got == [("h_bucket", (("le", "+Inf"), *base), 5, 3.0), ("h_bucket", (("le", "2.5"), *base), 5, 1.0), ("h_count", base, 5, 3.0), ("h_sum", base, 5, 9.0)]
    import pyarrow as pa

    data = b"abcabcabcabcabcabc" * 30
    assert protobuf.snappy(pa.compress(data, "snappy", asbytes=True)) == data


def test_store_round_trip(spark, tmp_path):
    rows = [("m", {"a": str(i % 3)}, 1704067200000 + i * 86_400_000, float(i), False) for i in range(60)]
    df = spark.createDataFrame(rows, SAMPLES)
    store.write_samples(df, str(tmp_path / "s"))
    assert flat(store.read_samples(spark, str(tmp_path / "s"))) == flat(df)
    assert store.read_samples(spark, str(tmp_path / "s"), rows[40][2], rows[50][2]).count() == 11
    assert store.expired_months(["2023_12", "2024_01", "2024_02"], 1709251200000, 40 * 86_400_000) == ["2023_12"]
    back = formats.json_lines(store.export_json(df, 2).select("value"))
    assert flat(back) == flat(df)
    line = store.matrix_json(MetricsEngine(df).query_range('m{a="0"}', rows[0][2] / 1000, rows[0][2] / 1000 + 60, "1m")).first().value
    assert json.loads(line) == {"metric": {"__name__": "m", "a": "0"}, "values": [[1704067200, "0"], [1704067260, "0"]]}


@pytest.mark.parametrize("max_ids", [10_000, 1])
def test_series_are_resolved_before_samples(spark, tmp_path, max_ids):
    from tidegrid.engine import MetricsEngine
    from tidegrid.sources import series

    rows = [("cpu", {"host": f"h{h}", "job": "a", "empty": ""}, 1_700_000_000_000 + t * 60_000, float(t + h), False) for h in range(6) for t in range(50)]
    rows += [("mem", {"host": "h1"}, 1_700_000_000_000, 1.0, False), (None, None, 1_700_000_000_000, 2.0, None), ("cpu", {"host": "h9"}, None, 1.0, False)]
    df = spark.createDataFrame(rows, SAMPLES)
    path = str(tmp_path / "t")
    series.write(df.where("ts_ms < 1700001000000 or ts_ms is null"), path)
    series.write(df.where("ts_ms >= 1700001000000"), path)  # the same series again, and no new ones
    table = series.StoredSeries(spark, path, max_ids)
    assert table.series().count() == 8
    stored, plain = MetricsEngine(table), MetricsEngine(df)
    for q in ('sum(rate(cpu{host=~"h[0-2]"}[5m])) by (host)', 'cpu{job="a", host!="h3"}', "nope", "max_over_time(cpu[10m]) - on(host) group_left mem", 'count({__name__!=""}) by (__name__)'):
        get = lambda e, q=q: sorted((r.name, tuple(sorted(r.labels.items())), r.ts_ms, round(r.value, 9)) for r in e.query_range(q, 1_700_000_300, 1_700_002_000, "5m").collect())
        assert get(stored) == get(plain), q
    assert stored.series("cpu").count() == 6
    picked = table.select(F.col("labels")["host"] == "h1", 1_700_000_000_000, 1_700_001_000_000)
    scans = [x.split("PushedFilters: ")[1] for x in picked._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PushedFilters: " in x]
    assert any("In(sid" in x or "EqualTo(sid" in x for x in scans) == (max_ids > 1)
    assert any("GreaterThanOrEqual(ts_ms" in x for x in scans)


@pytest.mark.parametrize("dedup", ["", "20s"])
def test_streaming_matches_batch(spark, tmp_path, dedup):
    rows = [("m", {"a": str(i % 2), "b": str(i % 5)}, 1_700_000_000_000 + i * 1000, float(i * 7 % 13), False) for i in range(300)]
    df = spark.createDataFrame(rows, SAMPLES)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    later = spark.createDataFrame([("m", {"a": "0"}, 1_700_009_000_000, 0.0, False)], SAMPLES)
    last = spark.createDataFrame([("m", {"a": "0"}, 1_700_019_000_000, 0.0, False)], SAMPLES)
    c = aggregation.Config("1m", ["avg"] if dedup else ["avg", "last", "count_samples"], by=["a"], dedup_interval=dedup)
    want = flat(aggregation.aggregate(df, c))
    src = spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in"))
    q = aggregation.aggregate(src, c).writeStream.format("memory").queryName("agg").outputMode("append").start()
    q.processAllAvailable()
    for more in (later, last):
        more.write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert [r for r in flat(spark.table("agg")) if r[2] < 1_700_009_000_000] == want


@pytest.mark.parametrize("dedup", ["", "20s"])
def test_streaming_counts_distinct_values_exactly(spark, tmp_path, dedup):
    # 3,000 series and 2,000 values in each of two intervals
    rows = [("m", {"b": str(i % 3000)}, 1_700_000_040_000 + i * 10, float(i % 2000), False) for i in range(12_000)]
    df = spark.createDataFrame(rows, SAMPLES)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    c = aggregation.Config("1m", ["count_series", "unique_samples"], by=["a"], dedup_interval=dedup)
    want = flat(aggregation.aggregate(df, c))
    assert {r[3] for r in want} == {3000.0, 2000.0}
    src = spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in"))
    q = aggregation.aggregate(src, c).writeStream.format("memory").queryName("distinct").outputMode("append").start()
    q.processAllAvailable()
    for t in (1_700_009_000_000, 1_700_019_000_000, 1_700_029_000_000):
        spark.createDataFrame([("m", {"a": "0"}, t, 0.0, False)], SAMPLES).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert [r for r in flat(spark.table("distinct")) if r[2] < 1_700_009_000_000] == want


def test_counter_stream_matches_batch(spark, tmp_path):
    rows = [("m", {"a": str(i % 2)}, 1_700_000_000_000 + i * 1000, float(i % 50), False) for i in range(240)]
    df = spark.createDataFrame(rows, SAMPLES)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    c = aggregation.Config("1m", ["increase"], by=["a"])
    want = flat(aggregation.aggregate(df, c))
    spark.createDataFrame([("m", {"a": "9"}, 1_700_009_000_000, 0.0, False)], SAMPLES).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in"))
    q = aggregation.counter_stream(src, c).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start(str(tmp_path / "deltas"))
    q.processAllAvailable()
    q.stop()
    deltas = spark.readStream.schema("g string, sk string, ts timestamp, delta double").parquet(str(tmp_path / "deltas"))
    q = aggregation.increase_stream(deltas, c).writeStream.format("memory").queryName("inc").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r for r in flat(spark.table("inc")) if r[1] != (("a", "9"),)] == want


def streamed(spark, tmp_path, rows, make, schema=None, name="out"):
    """What a streaming query gives for rows, then for samples far later that push the watermark on."""
    src_dir = str(tmp_path / f"in_{name}")
    spark.createDataFrame(rows, SAMPLES).repartition(1).write.parquet(src_dir)
    src = spark.readStream.schema(SAMPLES).parquet(src_dir)
    w = make(src).writeStream.outputMode("append")
    if schema:
        q = w.format("parquet").option("checkpointLocation", str(tmp_path / f"c_{name}")).start(str(tmp_path / name))
    else:
        q = w.format("memory").queryName(name).start()
    q.processAllAvailable()
    for t in (1_700_009_000_000, 1_700_019_000_000, 1_700_029_000_000):
        spark.createDataFrame([("m", {"a": "z"}, t, 0.0, False)], SAMPLES).write.mode("append").parquet(src_dir)
        q.processAllAvailable()
    q.stop()
    return spark.readStream.schema(schema).parquet(str(tmp_path / name)) if schema else spark.table(name)


# samples with a pause of three intervals (idle, then forgotten) and one of one interval, falls, and two groups
def pausing():
    at = [*range(0, 130, 7), *range(200, 260, 11), *range(700, 800, 13)]
    return [("m", {"a": str(g), "b": str(b)}, 1_700_000_000_000 + (t + b) * 1000, float((t * (g + 3) + b) % 97), False) for t in at for g in range(2) for b in range(2) if not (g == 1 and t > 600)]


def closed(spark, tmp_path, schema, name, extra):
    """A stored stream of results with a row far later, which closes what is before it."""
    end = spark.createDataFrame([("m", 1_700_099_000.0)], "g string, t double").select("g", F.timestamp_seconds("t").alias("ts"), *(F.lit(v).cast(t).alias(k) for k, (t, v) in extra.items()))
    spark.read.schema(schema).parquet(str(tmp_path / name)).unionByName(end).repartition(1).write.parquet(str(tmp_path / f"all_{name}"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / f"all_{name}"))


def drained(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return [(r[0], r[1], r[2], round(r[3], 6)) for r in flat(spark.table(name)) if r[2] < 1_700_009_000_000]


def on_table(spark, c):
    return [(r[0], r[1], r[2], round(r[3], 6)) for r in flat(aggregation.aggregate(spark.createDataFrame(pausing(), SAMPLES), c))]


END = {"x": ("string", ""), "end_ms": ("bigint", 1_700_099_040_000), "n": ("double", 0.0), "last": ("bigint", 1_700_099_000_000)}


@pytest.mark.parametrize("output", ["sum_samples", "sum_samples_total", "histogram_bucket"])
def test_running_outputs_match_on_streams_and_tables(spark, tmp_path, output):
    c = aggregation.Config("1m", [output], by=["a"])
    want = on_table(spark, c)
    streamed(spark, tmp_path, pausing(), lambda d: aggregation.interval_sums(d, c, output), aggregation.SUMS, f"s_{output}")
    sums = closed(spark, tmp_path, aggregation.SUMS, f"s_{output}", END)
    assert drained(spark, aggregation.flush_stream(sums, c, output), f"f_{output}") == want
    assert len({r[2] for r in want}) > len({t[2] // 60_000 for t in pausing()})  # there are idle ends
    with pytest.raises(ValueError, match="flush_stream"):
        aggregation.aggregate(sums.select(F.lit("m").alias("name"), F.create_map().cast("map<string,string>").alias("labels"), F.col("last").alias("ts_ms"), F.col("n").alias("value"), F.lit(False).alias("is_stale")), c)


@pytest.mark.parametrize("output", ["total", "total_prometheus"])
def test_totals_match_on_streams_and_tables(spark, tmp_path, output):
    c = aggregation.Config("1m", [output], by=["a"])
    deltas_schema = "g string, sk string, ts timestamp, delta double"
    streamed(spark, tmp_path, pausing(), lambda d: aggregation.counter_stream(d, c, output == "total"), deltas_schema, f"d_{output}")
    deltas = closed(spark, tmp_path, deltas_schema, f"d_{output}", {"sk": ("string", "m"), "delta": ("double", 0.0)})
    q = aggregation.interval_sums(deltas, c, output).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").start(str(tmp_path / f"s_{output}"))
    q.processAllAvailable()
    q.stop()
    sums = closed(spark, tmp_path, aggregation.SUMS, f"s_{output}", END)
    assert drained(spark, aggregation.flush_stream(sums, c, output), f"t_{output}") == on_table(spark, c)


@pytest.mark.parametrize("output", ["rate_sum", "rate_avg"])
def test_rates_match_on_streams_and_tables(spark, tmp_path, output):
    c = aggregation.Config("1m", [output], by=["a"])
    schema = "g string, sk string, ts timestamp, rate double"
    streamed(spark, tmp_path, pausing(), lambda d: aggregation.rate_parts(d, c), schema, f"p_{output}")
    parts = closed(spark, tmp_path, schema, f"p_{output}", {"sk": ("string", "m"), "rate": ("double", 0.0)})
    assert drained(spark, aggregation.rate_stream(parts, c, output), f"r_{output}") == on_table(spark, c)


def test_running_values_begin_anew_after_staleness(spark):
    rows = [("m", {}, t * 1000, 1.0, False) for t in (10, 20, 70, 400)]
    c = aggregation.Config("1m", ["sum_samples_total"])
    got = {r.ts_ms // 1000: r.value for r in aggregation.aggregate(spark.createDataFrame(rows, SAMPLES), c).collect()}
    assert got == {60: 2.0, 120: 3.0, 180: 3.0, 420: 1.0, 480: 1.0}


def test_aggregation_config():
    for bad in ({"interval": "100ms", "outputs": ["avg"]}, {"interval": "1m", "outputs": []}, {"interval": "1m", "outputs": ["avg", "avg"]}, {"interval": "1m", "outputs": ["nope"]}, {"interval": "1m", "outputs": ["avg"], "by": ["a"], "without": ["b"]}, {"interval": "1m", "outputs": ["quantiles(2)"]}, {"interval": "1m", "outputs": ["avg"], "dedup_interval": "7s"}, {"interval": "1m", "outputs": ["avg"], "staleness_interval": "1s"}, {"interval": "1m", "outputs": ["avg", "max"], "keep_metric_names": True}):
        with pytest.raises(ValueError, match=r".+"):
            aggregation.Config(**bad)


def test_alert_states(spark):
    series = [{"series": 'up{job="a"}', "values": "1 0 0 0 1 1 0 1"}]
    e = MetricsEngine(rules.input_samples(spark, series, 60_000))
    g = rules.Group("g", [], "1m", labels={"team": "t"})
    r = rules.Rule("up == 0", alert="Down", for_="2m", annotations={"summary": "{{ $labels.job }} is down, {{ $value | humanize }}"})
    got = [(x.ts_ms // 60_000, x.state, x.active_at // 60_000) for x in rules.alert_states(e, g, r, 0, 420_000).orderBy("ts_ms").collect()]
    assert got == [(1, "pending", 1), (2, "pending", 1), (3, "firing", 1), (6, "pending", 6)]
    held = rules.Rule("up == 0", alert="Down", for_="2m", keep_firing_for="2m")
    got = [(x.ts_ms // 60_000, x.state) for x in rules.alert_states(e, g, held, 0, 420_000).orderBy("ts_ms").collect()]
    assert got == [(1, "pending"), (2, "pending"), (3, "firing"), (4, "firing"), (5, "firing"), (6, "firing"), (7, "firing")]
    states = rules.alert_states(e, g, r, 0, 420_000)
    alerts = rules.alert_samples(states, 60_000)
    assert {x.labels["alertstate"] for x in alerts.where("name = 'ALERTS'").collect()} == {"pending", "firing"}
    assert alerts.where("is_stale and name = 'ALERTS_FOR_STATE'").count() == 2
    assert rules.render(r.annotations["summary"], {"job": "a"}, 1234567.0) == "a is down, 1.235M"


def test_alert_functions():
    r = lambda t: rules.render(t, {"host": "db1.example.com:9100"}, 0.5)
    assert r("{{ $labels.host | stripPort }}") == "db1.example.com"
    assert r("{{ $labels.host | stripDomain }}") == "db1:9100"
    assert r("{{ $labels.host | pathEscape }}") == "db1.example.com%3A9100"
    assert r("{{ $value | humanizePercentage }}") == "50%"
    assert rules.render("{{ $labels.x | jsonEscape }}", {"x": 'a"b'}, 1) == '"a\\"b"'
    assert rules.render("{{ $labels.x | htmlEscape }}", {"x": "<b>"}, 1) == "&lt;b&gt;"


def test_rule_helpers():
    assert rules.series_values("1 _ stale 1+2x2 5x1 _x2 3-1x1") == [1.0, None, "stale", 1.0, 3.0, 5.0, 5.0, 5.0, None, None, 3.0, 2.0]
    assert rules.eval_time(rules.Group("g", [], "1m", eval_delay="30s"), 125_000) == 60_000
    assert rules.humanize_duration(3661) == "1h 1m 1s"
    assert rules.humanize1024(2048) == "2ki"
    cfg = {"groups": [{"name": "g", "rules": [{"record": "r", "expr": "up"}]}]}
    assert rules.load_groups(cfg)[0].rules[0].record == "r"
    for bad in ({"groups": [{"name": "g", "x": 1}]}, {"groups": [{"name": "g", "rules": [{"expr": "up"}]}]}, {"groups": [{"name": ""}]}):
        with pytest.raises(ValueError, match=r".+"):
            rules.load_groups(bad)


def test_recording_rule_labels(spark):
    e = MetricsEngine(rules.input_samples(spark, [{"series": 'm{a="1",b="2"}', "values": "5x3"}], 60_000))
    r = rules.Rule("m", record="rec", labels={"a": "9", "b": ""})
    got = rules.record(e, rules.Group("g", [], "1m"), r, 0, 180_000).where(F.col("ts_ms") == 60_000).first()
    assert (got.name, got.labels, got.value) == ("rec", {"a": "9", "exported_a": "1"}, 5.0)


def test_fan_out_and_compaction(spark, tmp_path):
    from tidegrid.streaming.fanout import fan_out, parquet_sink

    rows = [("m", {"a": str(i % 2)}, 1_704_067_200_000 + i * 1000, float(i), False) for i in range(20)]
    df = spark.createDataFrame(rows, SAMPLES)
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in"))
    sinks = {n: parquet_sink(str(tmp_path / n)) for n in ("all", "some")}
    q = fan_out(src, sinks, str(tmp_path / "c"), {"some": [{"action": "keep", "source_labels": ["a"], "regex": "1"}]})
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "all")).count() == 20
    assert spark.read.parquet(str(tmp_path / "some")).count() == 10
    store.write_samples(df, str(tmp_path / "s"))
    store.compact_month(spark, str(tmp_path / "s"), "2024_01", str(tmp_path / "out"), 5000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    (tmp_path / "sd.json").write_text('[{"targets": ["h:1", "h:2"], "labels": {"job": "j"}}, {"targets": ["k:1"]}]')
    got = {r.address: r.labels for r in store.file_targets(spark, str(tmp_path / "sd.json")).collect()}
    assert got == {"h:1": {"job": "j"}, "h:2": {"job": "j"}, "k:1": {}}


def test_aggregation_options_without_effect_are_rejected(spark, tmp_path):
    for o in ("ignore_old_samples", "no_align_flush_to_interval", "flush_on_shutdown", "enable_windows"):
        with pytest.raises(ValueError, match=o):
            aggregation.Config("1m", ["avg"], **{o: True})
    src = spark.readStream.schema(SAMPLES).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="ignore_first_intervals"):
        aggregation.aggregate(src, aggregation.Config("1m", ["avg"], ignore_first_intervals=1))
