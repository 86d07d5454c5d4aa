import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import hot_keys, regular_grid, wire_rows
from tidegrid.operators.dedup import deduplicate
from tidegrid.model import SAMPLES

LINES = "line_id bigint, fmt string, line string, fmt2 string, errors string"

INFLUX_GOOD = [
    "m f=1",
    "m,a=b f=1i,g=2u 15",
    "m,a\\ b=c\\,d\\=e f=1.5e3 -7",
    'm f="a b,c=d\\"e"   12  ',
    'm f=""',
    "m f=t,g=F,h=TRUE",
    "m\\ ,a=b f=1",
    "m f=-9223372036854775808i,g=18446744073709551615u",
    "m f=1\r",
    'm "a=b"=1',
    "a=b f=.5",
]
INFLUX_BAD = [
    "m",
    "m,a=b",
    " m f=1",
    ",a=b f=1",
    "m,a f=1",
    "m,=b f=1",
    "m,a= f=1",
    "m,a=b=c f=1",
    "m f",
    "m f=",
    "m =1",
    "m f=1 2 3",
    "m f=1 2.5",
    "m f=1 12ms",
    'm f="a',
    'm f="a"b',
    "m f=nan",
    "m f=1e999",
    "m f=9223372036854775808i",
    "m f=18446744073709551616u",
    "m f=-1u",
    "m f=1,",
    "m f=1_0",
    "m f=0x1f",
    "m f=1\r\r",
    "m " + "f=1," * 5000 + "g",
]
CSV_GOOD = ["1,m,h,z,f,2", '"1","m","x, y","say ""hi""",f,"-2.5e3"', "1,m,,,f,2\r", '1,m,"",z,f,.5']
CSV_BAD = ["1,m,h,z,f", "1,m,h,z,f,2,3", "x,m,h,z,f,2", "1,,h,z,f,2", "1,m,h,z,,2", "1,m,h,z,f,", "1,m,h,z,f,1e400", '1,m,"h,z,f,2', '1,m,h"x,z,f,2', '1,m,"h"x,z,f,2', '1,"",h,z,f,2']
SKIPPED = [("influx", None), ("influx", ""), ("influx", "  \t"), ("influx", "# note"), ("csv", "\r"), ("csv", None)]


def test_lines(spark):
    rows = [("influx", x, "valid") for x in INFLUX_GOOD] + [("influx", x, "rejected") for x in INFLUX_BAD]
    rows += [("csv", x, "valid") for x in CSV_GOOD] + [("csv", x, "rejected") for x in CSV_BAD]
    rows += [(f, x, "skipped") for f, x in SKIPPED] + [(None, "m f=1", "rejected"), ("csv", "# note", "rejected"), ("influx", "m f=1 5", "valid")] * 2
    df = spark.createDataFrame([(i, f, x, w, "clash") for i, (f, x, w) in enumerate(rows)], LINES)
    got = {r.line_id: r for r in wire_rows.classify_lines(df).collect()}
    wrong = [(rows[i], got[i].errors) for i in range(len(rows)) if got[i].status != rows[i][2]]
    assert not wrong
    assert all(bool(got[i].errors) == (rows[i][2] == "rejected") for i in range(len(rows)))
    loaded = {r.line_id: r for r in wire_rows.loaded_rows(df).collect()}
    r = loaded[rows.index(("influx", "m,a\\ b=c\\,d\\=e f=1.5e3 -7", "valid"))]
    assert (r.measurement, r.ts, r.tags, r.fields[0].number) == ("m", -7, {"a b": "c,d=e"}, 1500.0)
    assert loaded[3].fields[0].text == 'a b,c=d"e'
    r = loaded[rows.index(("csv", CSV_GOOD[1], "valid"))]
    assert (r.tags, r.fields[0].number) == ({"host": "x, y", "zone": 'say "hi"'}, -2500.0)


def test_integers_load_exactly_and_mask_characters_stay(spark):
    own = "m\ufdd0x,b\ufdd1c=\ufdef\ufdefo v=9007199254740993i,u=18446744073709551615u,s=\"\ufdd4, \ufdd5=\ufddd\",n=-9223372036854775808i"
    df = spark.createDataFrame([(1, "influx", own, "", ""), (2, "csv", "1,m\ufdd1n,h\ufdefa,z,f,2", "", ""), (3, "influx", "m v=1i,w=t", "", "")], LINES)
    got = {r.line_id: r for r in wire_rows.loaded_rows(df).collect()}
    r = got[1]
    assert (r.measurement, r.tags) == ("m\ufdd0x", {"b\ufdd1c": "\ufdef\ufdefo"})
    assert [(f.key, f.kind, None if f.exact is None else int(f.exact), f.text) for f in r.fields] == [
        ("v", "int", 9007199254740993, None), ("u", "uint", 2**64 - 1, None), ("s", "string", None, "\ufdd4, \ufdd5=\ufddd"), ("n", "int", -(2**63), None)]
    assert (got[2].measurement, got[2].tags) == ("m\ufdd1n", {"host": "h\ufdefa", "zone": "z"})
    assert [(f.number, f.exact) for f in got[3].fields] == [(1.0, 1), (1.0, None)]


def test_no_lines(spark):
    df = spark.createDataFrame([], LINES)
    assert wire_rows.rejected_lines(df).count() == wire_rows.loaded_rows(df).count() == 0


def test_key_stats_against_brute_force(spark):
    random.seed(3)
    keys = [None if random.random() < 0.05 else "hot" if random.random() < 0.4 else f"k{random.randint(0, 40)}" for _ in range(3000)]
    vals = [random.choice([None, float("nan"), float("inf"), 1.0, 2.5, -3.0]) for _ in keys]
    times = [None if random.random() < 0.1 else random.randint(0, 10**6) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, times, vals, ["x"] * 3000, strict=True)), "g string, t bigint, v double, key string").repartition(7)
    want = {}
    for k, t, v in zip(keys, times, vals, strict=True):
        n, lo, hi, s = want.get(k, (0, None, None, None))
        if t is not None:
            lo, hi = (t if lo is None else min(lo, t)), (t if hi is None else max(hi, t))
        if v is not None and abs(v) < 1e9:
            s = (s or 0.0) + v
        want[k] = (n + 1, lo, hi, s)
    got = {r.key: (r.n_rows, r.first_time, r.last_time, r.value_sum) for r in hot_keys.key_stats(df, "g", "t", "v", chunk_rows=64).collect()}
    assert got == want
    assert [r.key for r in hot_keys.hot_keys(hot_keys.key_stats(df, "g", "t", "v"), df, 0.3).collect()] == ["hot"]
    empty = df.where("false")
    assert hot_keys.key_stats(empty, "g", "t", "v").count() == 0


def pchip(ts, vs, x):
    """Monotone cubic interpolation by the published formulas, one point at a time."""
    h = [b - a for a, b in zip(ts, ts[1:], strict=False)]
    d = [(b - a) / k for a, b, k in zip(vs, vs[1:], h, strict=False)]

    def end(h0, d0, h1, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s

    m = []
    for i in range(len(ts)):
        if len(ts) == 2:
            m.append(d[0])
        elif i == 0:
            m.append(end(h[0], d[0], h[1], d[1]))
        elif i == len(ts) - 1:
            m.append(end(h[-1], d[-1], h[-2], d[-2]))
        elif d[i - 1] * d[i] <= 0:
            m.append(0.0)
        else:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m.append((a + b) / (a / d[i - 1] + b / d[i]))
    i = max(j for j in range(len(ts) - 1) if ts[j] <= x)
    s = (x - ts[i]) / h[i]
    return vs[i] * (1 + 2 * s) * (1 - s) ** 2 + h[i] * m[i] * s * (1 - s) ** 2 + vs[i + 1] * s * s * (3 - 2 * s) + h[i] * m[i + 1] * s * s * (s - 1)


@pytest.mark.parametrize("shard", [3, 7, 4096])
def test_grid_against_brute_force(spark, shard):
    random.seed(5)
    readings, grids, want = [], [], {}
    for dev in range(6):
        n = 60
        grids.append(("o", f"d{dev}", 1000, 5000, 5000 + 1000 * n, "extra"))
        slots = sorted(random.sample(range(n), [0, 1, 2, 9, 25, 55][dev]))
        knots = []
        for s in slots:
            t, v = (5000 + 1000 * s + random.randint(0, 999)) * 1000, round(random.uniform(-5, 5), 3)
            knots.append((s, t, v))
            readings += [("o", f"d{dev}", t, v), ("o", f"d{dev}", t, v - 1), ("o", f"d{dev}", (5000 + 1000 * s) * 1000, 99.0)] if t > (5000 + 1000 * s) * 1000 else [("o", f"d{dev}", t, v)]
        for k in range(n):
            ms = 5000 + 1000 * k
            hit = [x for x in knots if x[0] == k]
            before, after = [x for x in knots if x[0] < k], [x for x in knots if x[0] > k]
            if hit:
                want[f"d{dev}", ms] = ("observed", hit[0][2])
            elif not before or not after:
                want[f"d{dev}", ms] = ("edge", None)
            elif after[0][0] - before[-1][0] - 1 > 12:
                want[f"d{dev}", ms] = ("gap", None)
            else:
                want[f"d{dev}", ms] = ("filled", pchip([float(x[1]) for x in knots], [x[2] for x in knots], ms * 1000.0))
    grids += [("o", None, 1000, 0, 5000, ""), ("o", "bad", 0, 0, 5000, ""), ("o", "none", None, 0, 5000, "")]
    readings += [("o", "unknown", 6_000_000, 1.0), ("p", "d5", 6_000_000, 1.0)]
    r = spark.createDataFrame(readings, "origin string, device string, t_us bigint, v double")
    g = spark.createDataFrame(grids, "origin string, device string, step_ms bigint, start_ms bigint, end_ms bigint, slot string")
    got = {(x.device, x.slot_ms): (x.status, x.value) for x in regular_grid.regular_grid(r, g, shard_slots=shard).collect()}
    assert got.keys() == want.keys()
    for k, (status, value) in want.items():
        assert got[k][0] == status, k
        assert got[k][1] == (pytest.approx(value, abs=1e-9) if value is not None else None), k
    assert regular_grid.regular_grid(r.where("false"), g).where("status <> 'edge'").count() == 0
    assert regular_grid.regular_grid(r, g.where("false")).count() == 0


def test_dedup(spark):
    rows = [("m", {"a": "1"}, t, v, s) for t, v, s in ((1, 1.0, False), (10, 2.0, False), (10, 3.0, False), (10, None, True), (11, 4.0, False), (20, None, True), (None, 1.0, False))]
    df = spark.createDataFrame(rows, SAMPLES)
    got = sorted((r.ts_ms, r.value, r.is_stale) for r in deduplicate(df, 10).collect())
    assert got == [(10, 3.0, False), (20, None, True)]
    assert deduplicate(df, 0).count() == 6
    assert deduplicate(df.where("false"), 10).count() == 0
    assert deduplicate(df, 10, ("a",)).select(F.size("labels").alias("n")).first().n == 0
