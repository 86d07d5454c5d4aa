"""Irregular readings onto a regular grid: one row per slot of each source.

Readings are reduced to one knot per slot (the last usable reading; equal times: the larger
value).  Slots without one are filled by shape-preserving monotone cubic interpolation
(Fritsch and Carlson's limited harmonic-mean slopes) between the two knots around, with the slopes
taken from the next knots on either side; gaps of more than ``max_gap_slots`` slots, and slots
before the first or after the last knot, are left null and marked.

A source's grid is cut into time shards of ``shard_slots`` slots.  Each shard gets the two nearest
knots before it and after it as a halo, from the per-shard boundary knots only, so no task holds
more than one shard of a source however long its series is.  All of it is built-in expressions
with one shuffle of the readings to slots and one of the slots to shards.

Defined results for odd input: null times, null/NaN/infinite values, stale markers and readings
outside the grid are not usable; a source without usable readings has all slots marked ``edge``;
sources with a null name, step or range, or a step below 1, have no slots; readings of unknown or
null sources are ignored; repeated readings change nothing; an empty table of readings gives all
slots as ``edge``, an empty table of sources no rows.  Grids repeated under one name are an error
of the caller and give their slots twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SHARD_SLOTS = 4096
MAX_GAP_SLOTS = 12
SALTS = 16  # of a source and day
DAY_MS = 86_400_000


def usable(time: Column, value: Column, stale: Column | None = None) -> Column:
    ok = time.isNotNull() & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return ok if stale is None else ok & ~F.coalesce(stale, F.lit(False))


def slot_knots(readings: DataFrame, grids: DataFrame) -> DataFrame:
    """origin, device, slot, and the knot (t_us, v) of each slot that has a usable reading.

    readings: origin, device, t_us (microseconds), v, usable ones only.  The few grid rows are
    repeated for every day of the grid and salt, and readings pick theirs by their time, so that a
    source with a third of all readings is joined by as many tasks as it has days, times the salts
    for a day that has most of them; the last reading of a slot is combined map-side.
    """
    day = lambda ms: F.floor(ms / DAY_MS)
    salted = grids.select("origin", "device", "step_ms", "start_ms", "end_ms", F.explode(F.sequence(day(F.col("start_ms")), day(F.col("end_ms") - 1))).alias("_day"))
    salted = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = readings.withColumn("_day", day(F.col("t_us") / 1000)).withColumn("_salt", F.pmod(F.xxhash64("t_us", "v"), F.lit(SALTS)).cast("int"))
    # the grids grow with the data: they are hashed per partition, never broadcast
    j = r.join(salted.hint("shuffle_hash"), ["origin", "device", "_day", "_salt"])
    j = j.where((F.col("t_us") >= F.col("start_ms") * 1000) & (F.col("t_us") < F.col("end_ms") * 1000))
    slot = F.floor((F.col("t_us") - F.col("start_ms") * 1000) / (F.col("step_ms") * 1000)).cast("bigint")
    return j.groupBy("origin", "device", slot.alias("slot")).agg(F.max(F.struct("t_us", "v")).alias("knot"))


def _with_halo(knots: DataFrame, shards: DataFrame, shard_slots: int) -> DataFrame:
    """Knots of each shard plus copies of the two before and the two after it."""
    own = knots.withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("bigint"))
    k = F.struct("slot", "knot")
    edge = own.groupBy("origin", "device", "shard").agg(F.min(k).alias("a"), F.max(k).alias("z"), F.count(F.lit(1)).alias("n"))
    # second and second-last knot: the extreme ones among the rest
    rest = own.join(edge, ["origin", "device", "shard"]).where((F.col("slot") > F.col("a.slot")) & (F.col("slot") < F.col("z.slot")))
    second = rest.groupBy("origin", "device", "shard").agg(F.min(k).alias("a2"), F.max(k).alias("z2"))
    edges = edge.join(second, ["origin", "device", "shard"], "left")
    # one row per shard with its boundary knots in order; shards without knots have none
    firsts = F.array_compact(F.array("a", F.coalesce("a2", F.when(F.col("n") == 2, F.col("z")))))
    lasts = F.array_compact(F.array(F.coalesce("z2", F.when(F.col("n") == 2, F.col("a"))), "z"))
    b = shards.join(edges, ["origin", "device", "shard"], "left").select("origin", "device", "shard", F.when(F.col("n") > 0, firsts).alias("firsts"), F.when(F.col("n") > 0, lasts).alias("lasts"))
    w = Window.partitionBy("origin", "device").orderBy("shard")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    # the nearest shard with knots, and the one beyond it, are enough for two knots
    b = b.withColumn("l1", F.last("lasts", True).over(back)).withColumn("r1", F.first("firsts", True).over(ahead))
    b = b.withColumn("l2", F.last(F.when(F.col("lasts").isNotNull(), F.col("l1")), True).over(back)).withColumn("r2", F.first(F.when(F.col("firsts").isNotNull(), F.col("r1")), True).over(ahead))
    empty = F.array().cast(b.schema["lasts"].dataType)
    left = F.concat(F.coalesce("l2", empty), F.coalesce("l1", empty))
    right = F.concat(F.coalesce("r1", empty), F.coalesce("r2", empty))
    left = F.slice(left, F.greatest(F.size(left) - 1, F.lit(1)), 2)
    halo = b.select("origin", "device", "shard", F.explode(F.concat(left, F.slice(right, 1, 2))).alias("h")).select("origin", "device", "shard", "h.slot", "h.knot")
    return own.select("origin", "device", "shard", "slot", "knot").unionByName(halo)


def _slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """Slope at a knot between two secants: 0 at a turn, else their weighted harmonic mean."""
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    return F.when((d0 > 0) & (d1 > 0) | (d0 < 0) & (d1 < 0), (w1 + w2) / (w1 / d0 + w2 / d1)).otherwise(F.lit(0.0))


def _end_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """One-sided three-point slope at an end knot, limited so that the shape is kept."""
    s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    same = (s > 0) & (d0 > 0) | (s < 0) & (d0 < 0)
    turn = (d0 > 0) & (d1 < 0) | (d0 < 0) & (d1 > 0)
    return F.when(~same, F.lit(0.0)).when(turn & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)


def regular_grid(readings: DataFrame, grids: DataFrame, max_gap_slots: int = MAX_GAP_SLOTS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """origin, device, slot_ms, status, value, t_us for every slot of every grid.

    grids: origin, device, step_ms, start_ms, end_ms.  ``status`` is ``observed`` (value and time
    of the last usable reading), ``filled``, ``gap`` (too long to fill) or ``edge`` (outside the
    first and last knot); value is null for the last two.  Filled values are taken at slot_ms.
    """
    g = grids.select("origin", "device", "step_ms", "start_ms", "end_ms").where("device is not null and origin is not null and step_ms >= 1 and end_ms > start_ms")
    n = F.ceil((F.col("end_ms") - F.col("start_ms")) / F.col("step_ms")).cast("bigint")
    shards = g.withColumn("n_slots", n).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_slots") - 1) / shard_slots).cast("bigint"))))
    lo, hi = F.col("shard") * shard_slots, F.least((F.col("shard") + 1) * shard_slots, F.col("n_slots")) - 1
    slots = shards.select("origin", "device", "shard", "step_ms", "start_ms", F.explode(F.sequence(lo, hi)).alias("slot"))
    slots = slots.select("origin", "device", "shard", "slot", (F.col("start_ms") + F.col("slot") * F.col("step_ms")).alias("slot_ms"), F.lit(1).alias("is_slot"))

    # knots are read for the slots, the boundaries and the second knots: written once, not joined three times
    knots = _with_halo(cut(slot_knots(readings, g)), shards.select("origin", "device", "shard"), shard_slots)
    rows = knots.select("origin", "device", "shard", "slot", F.struct("slot", "knot.t_us", "knot.v").alias("k"), F.lit(0).alias("is_slot")).unionByName(slots, allowMissingColumns=True)

    w = Window.partitionBy("origin", "device", "shard").orderBy("slot", "is_slot")
    lag = lambda i: F.expr(f"lag(k, {i}) ignore nulls over (partition by origin, device, shard order by slot, is_slot)")
    lead = lambda i: F.expr(f"lead(k, {i}) ignore nulls over (partition by origin, device, shard order by slot, is_slot)")
    d = rows.select("*", lag(1).alias("b"), lag(2).alias("a"), lead(1).alias("c"), lead(2).alias("d")).where("is_slot = 1")

    observed = F.coalesce(F.col("b.slot") == F.col("slot"), F.lit(False))
    between = F.col("b").isNotNull() & F.col("c").isNotNull()
    short = F.col("c.slot") - F.col("b.slot") - 1 <= max_gap_slots
    status = F.when(observed, "observed").when(~between, "edge").when(short, "filled").otherwise("gap")

    def span(x: str, y: str) -> tuple[Column, Column]:
        h = (F.col(f"{y}.t_us") - F.col(f"{x}.t_us")).cast("double")
        return h, (F.col(f"{y}.v") - F.col(f"{x}.v")) / h

    (h0, d0), (h1, d1), (h2, d2) = span("a", "b"), span("b", "c"), span("c", "d")
    has_a, has_d = F.col("a").isNotNull(), F.col("d").isNotNull()
    m1 = F.when(has_a, _slope(h0, d0, h1, d1)).when(has_d, _end_slope(h1, d1, h2, d2)).otherwise(d1)
    m2 = F.when(has_d, _slope(h1, d1, h2, d2)).when(has_a, _end_slope(h1, d1, h0, d0)).otherwise(d1)
    s = (F.col("slot_ms") * 1000 - F.col("b.t_us")) / h1  # knots lie in other slots, so it is between 0 and 1
    v1, v2 = F.col("b.v"), F.col("c.v")
    cubic = v1 * (1 + 2 * s) * (1 - s) * (1 - s) + h1 * m1 * s * (1 - s) * (1 - s) + v2 * s * s * (3 - 2 * s) + h1 * m2 * s * s * (s - 1)
    value = F.when(status == "observed", F.col("b.v")).when(status == "filled", cubic)
    return d.select("origin", "device", "slot_ms", status.alias("status"), value.alias("value"), F.when(observed, F.col("b.t_us")).alias("t_us"))
