import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import kmv, qdigest

SCHEMA = "d int, g string, client string, h string"


def rows(n, seed=1):
    r = random.Random(seed)
    return [(r.choice([1, 2, None]), r.choice(["a", "a", "a", "b", None]), r.choice([None, "", f"c{r.randint(0, 4000)}"]), "clash") for _ in range(n)]


def test_small_groups_are_exact(spark):
    data = rows(2000)
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.level, r.d, r.g): r.estimate for r in kmv.cube_sketches(df, ["d", "g"], "client").select("level", "d", "g", kmv.estimate(F.col("hashes"))["estimate"].alias("estimate")).collect()}
    want = {}
    for d, g, c, _ in data:
        if c:
            for level, key in (("", (None, None)), ("d", (d, None)), ("g", (None, g)), ("d+g", (d, g))):
                want.setdefault((level, *key), set()).add(c)
    small = {k: len(v) for k, v in want.items() if len(v) < kmv.K}
    assert got.keys() == want.keys()
    assert {k: got[k] for k in small} == small


def test_estimates_lie_within_bounds(spark):
    k, inside, trials = 64, 0, 40
    df = spark.range(40 * 3000).select((F.col("id") % trials).alias("g"), F.concat(F.lit("x"), "id").alias("client"))
    e = kmv.estimate(F.col("hashes"), k)
    for r in kmv.sketch(kmv.hashed(df, ["g"], "client"), ["g"], k).select(*(c.alias(n) for n, c in e.items())).collect():
        inside += r.lower <= 3000 <= r.upper
        assert r.estimate == pytest.approx(3000, rel=5 / np.sqrt(k))
    assert inside >= 0.85 * trials


def test_merging_parts_equals_the_whole(spark):
    df = spark.createDataFrame(rows(8000, 2), SCHEMA)
    h = lambda d: kmv.sketch(kmv.hashed(d, ["d", "g"], "client"), ["d", "g"], 100)
    parts = h(df.where("xxhash64(client) % 2 = 0")).unionByName(h(df.where("xxhash64(client) % 2 <> 0")))
    whole = {(r.d, r.g): r.hashes for r in h(df).collect()}
    assert {(r.d, r.g): r.hashes for r in kmv.merge(parts, ["d", "g"], 100).collect()} == whole
    rolled = {r.d: r.hashes for r in kmv.merge(parts, ["d"], 100).collect()}
    assert rolled == {r.d: r.hashes for r in kmv.sketch(kmv.hashed(df, ["d"], "client"), ["d"], 100).collect()}


def test_set_estimates(spark):
    df = spark.range(30000).select(F.explode(F.when(F.col("id") < 10000, F.array(F.lit("a"))).when(F.col("id") < 20000, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))).alias("g"), F.col("id").cast("string").alias("client"))
    s = {r.g: r.hashes for r in kmv.sketch(kmv.hashed(df, ["g"], "client"), ["g"]).collect()}
    one = spark.createDataFrame([(s["a"], s["b"])], "a array<bigint>, b array<bigint>")
    r = one.select(*(c.alias(n) for n, c in kmv.set_estimates(F.col("a"), F.col("b")).items())).first()
    for name, truth in (("union", 30000), ("intersection", 10000), ("difference", 10000)):
        assert r[name] == pytest.approx(truth, rel=0.15)
        assert r[f"{name}_lower"] <= r[name] <= r[f"{name}_upper"]


def test_union_with_itself_is_the_estimate(spark):
    df = spark.range(100000).select(F.lit("a").alias("g"), F.col("id").cast("string").alias("client"))
    s = kmv.sketch(kmv.hashed(df, ["g"], "client"), ["g"])
    e, u = kmv.estimate(F.col("hashes")), kmv.set_estimates(F.col("hashes"), F.col("hashes"))
    r = s.select(e["estimate"].alias("e"), u["union"].alias("u"), u["intersection"].alias("i"), u["difference"].alias("d")).first()
    assert r.e == r.u == r.i
    assert r.d == 0


def test_k_above_a_thousand_and_small_holdings(spark, monkeypatch):
    monkeypatch.setattr(kmv, "HELD", 500)
    df = spark.range(30000).select((F.col("id") % 3).cast("int").alias("g"), F.concat(F.lit("x"), F.col("id") % 12000).alias("client"))
    g = np.array([0, 1, 0, 0, 1, 0]), np.array([5, 2, 3, 5, 2, 9])
    assert [x.tolist() for x in kmv.k_smallest(*g, 2)] == [[0, 0, 1], [3, 5, 2]]
    got = {r.g: r.hashes for r in kmv.sketch(kmv.hashed(df, ["g"], "client"), ["g"], 2500).collect()}
    want = {r.g: sorted(r.h)[:2500] for r in kmv.hashed(df, ["g"], "client").groupBy("g").agg(F.collect_set("h").alias("h")).collect()}
    assert got == want


def test_nothing_is_shuffled_before_it_is_reduced(spark):
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("string").alias("client"))
    plan = kmv.sketch(kmv.hashed(df, ["g"], "client"), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    assert plan.rindex("MapInArrow") > plan.index("Exchange ")  # one below the shuffle
    assert "Window" not in plan


def test_keys_of_odd_types_are_refused(spark):
    with pytest.raises(TypeError, match="cannot be a key"):
        kmv.sketch(spark.range(3).select(F.array("id").alias("g"), F.col("id").alias("h")), ["g"])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert kmv.cube_sketches(df, ["d", "g"], "client").count() == 0
    assert qdigest.build(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_leaves_keep_order_and_value():
    big = np.finfo(float).max
    v = np.array([-big, -1e300, -75.262, -1.0, -0.5, -1e-300, -0.0, 0.0, 5e-324, 0.125, 3.0, 1000.0, 1e300, big])
    leaves = qdigest.leaf_of(v).astype(np.int64)
    assert (np.diff(leaves) >= 0).all()
    back = qdigest.value_of(leaves)
    assert np.allclose(back, v, rtol=2**-20)
    assert back[3] == -1.0
    assert back[6] == 0.0


@pytest.mark.parametrize("call_nodes", [1 << 17, 300])
def test_quantiles_within_the_stated_error(spark, call_nodes, monkeypatch):
    monkeypatch.setattr(qdigest, "HELD_NODES", call_nodes)
    rng = np.random.default_rng(4)
    n = 30000
    g = rng.choice(["hot", "hot", "hot", "b"], n)
    v = np.round(rng.lognormal(2, 2, n) * rng.choice([-1, 1], n), 2)
    v[::50], v[1::50], v[2::50] = np.nan, np.inf, 7.0
    data = [(str(a), float(b)) for a, b in zip(g, v, strict=True)] + [(None, 5.0)] * 3 + [("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    k = 400
    d = qdigest.merge(qdigest.build(df, ["g"], "v", k), ["g"], k)
    phis = [0.01, 0.1, 0.5, 0.9, 0.99]
    got = qdigest.quantiles(d, ["g"], phis, k).collect()
    assert {r.g for r in got} == {"hot", "b", None}
    for r in got:
        s = np.sort([b for a, b in data if a == r.g and b is not None and np.isfinite(b)])
        assert r.n == len(s)
        rank = max(1, int(np.ceil(r.phi * len(s))))
        tol = abs(r.value) * 2**-19
        lo, hi = np.searchsorted(s, r.value - tol) + 1, np.searchsorted(s, r.value + tol, "right")
        assert lo - r.rank_error <= rank <= hi + r.rank_error, r
    assert d.where("g = 'hot'").select(F.size("nodes")).first()[0] <= 3 * k
    assert d.groupBy("g").count().where("count > 1").count() == 0
    assert d.where("g is null").select(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).first()[0] == 3


def test_no_window_over_raw_groups(spark):
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    plan = qdigest.roll_up(qdigest.build(df, ["g"], "v"), ["g"], [["g"], []])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "FlatMapGroups" not in plan


def test_roll_up_equals_direct_counts(spark):
    data = [(x, y, float(i % 17)) for i in range(3000) for x, y in (("a", None if i % 5 == 0 else "p"),)]
    df = spark.createDataFrame(data, "x string, y string, v double")
    r = qdigest.roll_up(qdigest.build(df, ["x", "y"], "v"), ["x", "y"], [["x", "y"], ["x"]])
    got = qdigest.quantiles(r, ["level", "x", "y"], [0.5]).collect()
    assert {(q.level, q.x, q.y): (q.n, q.value) for q in got} == {("x", "a", None): (3000, 8.0), ("x+y", "a", None): (600, 8.0), ("x+y", "a", "p"): (2400, 8.0)}
