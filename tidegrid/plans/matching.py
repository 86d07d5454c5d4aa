"""Binary operators: equi-joins of vectors on (matching labels, grid point)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import densify
from ..model import NAME, Grid, Scalar, Vector, drop_labels, drop_name, finite_div, keep_labels, key_of, labels_of, missing_if_nan, with_labels
from ..ql.syntax import COMPARISONS, Binary, QueryError

C = F.col


def arith(op: str, a: Column, b: Column) -> Column:
    """a op b; missing operands give a missing result."""
    match op:
        case "+":
            r = a + b
        case "-":
            r = a - b
        case "*":
            r = a * b
        case "/":
            return finite_div(a, b)
        case "%":
            return missing_if_nan(F.when(F.abs(a) == float("inf"), None).when(F.abs(b) == float("inf"), a).otherwise(a % F.when(b != 0, b)))
        case "^":
            r = F.pow(a, b)
        case "atan2":
            r = F.atan2(a, b)
        case _:
            raise QueryError(f"unknown operator {op!r}")
    return missing_if_nan(r)


def compare(op: str, a: Column, b: Column) -> Column:
    """Whether a op b holds; two missing points are equal, and one missing point differs from any other."""
    match op:
        case "==":
            return a.eqNullSafe(b)
        case "!=":
            return ~a.eqNullSafe(b)
    r = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return F.coalesce(r, F.lit(False))


def point_op(e: Binary, a: Column, b: Column) -> Column:
    if e.op in COMPARISONS:
        ok = compare(e.op, a, b)
        return F.when(a.isNotNull(), ok.cast("double")) if e.bool_ else F.when(ok, a)
    return arith(e.op, a, b)


def drops_name(e: Binary) -> bool:
    return not e.keep and not (e.op in COMPARISONS and not e.bool_)


def match_key(e: Binary, sk: Column) -> Column:
    """What series are matched by; the name counts only where it is listed or kept."""
    labels = list(e.match_labels)
    if e.match == "on":
        return keep_labels(sk, labels)
    return drop_labels(sk, labels if e.keep else [*labels, NAME])


def result_key(e: Binary, sk: Column) -> Column:
    if drops_name(e):
        sk = drop_name(sk)
    if e.match == "on":
        return keep_labels(sk, [*e.match_labels, *([NAME] if e.keep else [])])
    return drop_labels(sk, list(e.match_labels)) if e.match_labels else sk


def _one_side(df: DataFrame, e: Binary, side: str, value: str) -> DataFrame:
    """mk, k, the key and the value of a side that must have one series per match and point."""
    g = df.select(match_key(e, C("sk")).alias("mk"), "k", C("sk").alias(f"{value}_sk"), C("v").alias(value))
    many = F.raise_error(F.lit(f"duplicate time series on the {side} side of {e.op}")).cast("double")
    a = g.groupBy("mk", "k").agg(F.count(value).alias("_n"), F.max(value).alias(value), F.min(f"{value}_sk").alias(f"{value}_sk"))
    return a.select("mk", "k", F.when(C("_n") > 1, many).otherwise(C(value)).alias(value), f"{value}_sk")


def join_vectors(e: Binary, left: Vector, right: Vector) -> Vector:
    """Vector op vector, one to one, or many to one with group_left / group_right."""
    if e.op not in COMPARISONS:
        left, right = (Vector(x.df.where(C("v").isNotNull())) for x in (left, right))
    if not e.join:
        j = _one_side(left.df, e, "left", "a").join(_one_side(right.df, e, "right", "b"), ["mk", "k"])
        return Vector(j.select(result_key(e, C("a_sk")).alias("sk"), "k", point_op(e, C("a"), C("b")).alias("v")), unique=False)
    swap = e.join == "group_right"
    many, one = (right, left) if swap else (left, right)
    m = many.df.select(match_key(e, C("sk")).alias("mk"), "k", C("sk").alias("m_sk"), C("v").alias("m"))
    j = m.join(_one_side(one.df, e, "left" if swap else "right", "o"), ["mk", "k"])
    key = drop_name(C("m_sk")) if drops_name(e) else C("m_sk")
    skip = set(e.match_labels) if e.match == "on" else set()
    if "*" in e.join_labels:
        extra = F.map_filter(labels_of(C("o_sk")), lambda n, _: ~n.isin([*skip, NAME]))
        extra = F.transform_keys(extra, lambda n, _: F.concat(F.lit(e.prefix), n))
        rest = F.map_filter(labels_of(key), lambda n, _: ~F.array_contains(F.map_keys(extra), n))
        key = key_of(F.map_concat(rest, extra))
    elif e.join_labels:
        got = labels_of(C("o_sk"))
        key = with_labels(key, {e.prefix + n: F.try_element_at(got, F.lit(n)) for n in e.join_labels if n not in skip})
    a, b = (C("o"), C("m")) if swap else (C("m"), C("o"))
    return Vector(j.select(key.alias("sk"), "k", point_op(e, a, b).alias("v")), unique=False)


def with_scalar(e: Binary, vector: Vector, scalar: Scalar | Vector, scalar_left: bool) -> Vector:
    """Scalar op vector in either order: a projection, or a join with at most one row per grid point."""
    df = vector.df if e.op in COMPARISONS else vector.df.where(C("v").isNotNull())
    if isinstance(scalar, Scalar):
        s = scalar.expr
    else:
        # one series on the grid, whose number of points is bounded
        df = df.join(F.broadcast(scalar.df.select("k", C("v").alias("s"))), "k", "left")
        s = C("s")
    a, b = (s, C("v")) if scalar_left else (C("v"), s)
    key = drop_name(C("sk")) if drops_name(e) else C("sk")
    return Vector(df.select(key.alias("sk"), "k", point_op(e, a, b).alias("v")), vector.single, vector.unique and not drops_name(e))


def _present(e: Binary, v: Vector) -> DataFrame:
    return v.df.where(C("v").isNotNull()).select(match_key(e, C("sk")).alias("mk"), "k").distinct()


def set_op(e: Binary, left: Vector, right: Vector, grid: Grid) -> Vector:
    """and, if: left semi; unless, ifnot: left anti; or: union of what isn't covered; default: fill."""
    lone = right.single and e.op in ("if", "ifnot", "default")  # a lone scalar matches every group
    a = left.df.select("*", match_key(e, C("sk")).alias("mk"))
    if e.op in ("and", "if", "unless", "ifnot"):
        hits = right.df.where(C("v").isNotNull()).select("k").distinct() if lone else _present(e, right)
        on = ["k"] if lone else ["mk", "k"]
        j = a.join(F.broadcast(hits) if lone else hits, on, "left_semi" if e.op in ("and", "if") else "left_anti")
        return Vector(j.select("sk", "k", "v"), left.single, left.unique)
    if e.op == "or":
        b = right.df.where(C("v").isNotNull()).select("*", match_key(e, C("sk")).alias("mk")).join(_present(e, left), ["mk", "k"], "left_anti")
        return Vector(left.df.select("sk", "k", "v").unionByName(b.select("sk", "k", "v")), unique=False, order=("left first",))
    # default
    full = densify(left.df, grid).select("sk", "k", "v", match_key(e, C("sk")).alias("mk"))
    if lone:
        j = full.join(F.broadcast(right.df.select("k", C("v").alias("d"))), "k", "left")
    else:
        fill = right.df.where(C("v").isNotNull()).groupBy(match_key(e, C("sk")).alias("mk"), "k").agg(F.max("v").alias("d"))
        j = full.join(fill, ["mk", "k"], "left")
    filled = j.select("sk", "k", F.coalesce("v", "d").alias("v"))
    # without any series on the left the right side is the result: decided by one row, not by comparing rows
    nothing = left.df.limit(1).agg(F.count(F.lit(1)).alias("_any")).where("_any = 0")
    alone = right.df.join(F.broadcast(nothing), F.lit(True), "left_semi").select("sk", "k", "v")
    return Vector(filled.unionByName(alone), unique=left.unique and right.unique)
