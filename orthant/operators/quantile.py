"""Builders that cut every node at a median, level by level, with Spark's own aggregates."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tree import SplitTree, schedule
from .routing import assign, value, whole

#: Parts of a range that are counted in a pass, passes at most, and values of a node whose distinct ones are counted at last.
BINS, PASSES, FEW = 1024, 8, 1 << 20
_LARGEST = sys.float_info.max


def bounds(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row: least and greatest value of each variable, as lower_<variable> and upper_<variable>."""
    names = list(dict.fromkeys(variables))
    return df.agg(*[f(value(v)).alias(f"{side}_{v}") for v in names for side, f in (("lower", F.min), ("upper", F.max))])


def with_bounds(df: DataFrame, variables: Sequence[str]) -> SplitTree:
    """A tree without levels that knows the bounds of the variables."""
    names = list(dict.fromkeys(variables))
    if not names:
        return SplitTree()
    row = bounds(df, names).first()
    return SplitTree().bounded({v: row[f"lower_{v}"] for v in names}, {v: row[f"upper_{v}"] for v in names})


def normalize(df: DataFrame, variables: Sequence[str], suffix: str = "_unit") -> DataFrame:
    """The rows with each variable scaled to 0..1 by its bounds; 0 where they are equal."""
    names = list(dict.fromkeys(variables))
    row = bounds(df, names).first()
    out = df
    for v in names:
        lo, hi = row[f"lower_{v}"], row[f"upper_{v}"]
        out = out.withColumn(v + suffix, F.when(value(v).isNotNull(), F.lit(0.0) if lo is None or hi == lo else (value(v) - lo) / (hi - lo)))
    return out


def level_points(df: DataFrame, tree: SplitTree, variable: str, median: Column) -> dict[int, float | None]:
    """The median of each non-empty node of the level after the tree; one partial and final aggregate."""
    rows = assign(whole(df, tree.variables), tree, "__leaf").groupBy("__leaf").agg(median.alias("point")).collect()  # 2**depth rows at most
    return {r["__leaf"]: r["point"] for r in rows}


def _values(df: DataFrame, tree: SplitTree, variable: str) -> DataFrame:
    """__leaf, __x, __f: the node and value of each row that has both, and the value as a finite number, null for NaN."""
    x = F.when(F.isnan("__x"), None).otherwise(F.greatest(F.least("__x", F.lit(_LARGEST)), F.lit(-_LARGEST)))
    return assign(whole(df, tree.variables), tree, "__leaf").select("__leaf", value(variable).alias("__x")).where("__x is not null").withColumn("__f", x)


def exact_points(df: DataFrame, tree: SplitTree, variable: str, few: int = FEW) -> dict[int, float | None]:
    """The exact median of each node of the level after the tree: the middle value, or the midpoint of the two; NaN counts as larger than any number."""
    rows = _values(df, tree, variable)
    bounds = rows.groupBy("__leaf").agg(F.count("*").alias("n"), F.count("__f").alias("m"), F.min("__f").alias("lo"), F.max("__f").alias("hi"))
    state = {}  # by leaf: first rank of the range, its bounds, ranks of the middle values
    out: dict[int, float | None] = {}
    for r in bounds.collect():  # 2**depth rows at most
        low, high = (r["n"] - 1) // 2, r["n"] // 2
        if high >= r["m"]:
            out[r["__leaf"]] = float("nan")
        else:
            state[r["__leaf"]] = [0, r["lo"], r["hi"], low, high, r["m"]]
    return out | _picked(rows, state, few)


def lower_points(df: DataFrame, tree: SplitTree, variable: str, accuracy: int, few: int = FEW) -> dict[int, float | None]:
    """The lower median of each node of the level after the tree: a value of the data, as `percentile_approx` gives it, but exact at any size.

    A pass counts the rows beside each sketched median. Where these counts don't
    confirm its rank, the value of that rank is picked from the range between
    sketched quantiles on both sides, or from all values if that range lacks it.
    """
    off = 2.0 / accuracy
    sketch = F.percentile_approx(value(variable), [0.5, max(0.0, 0.5 - off), min(1.0, 0.5 + off)], F.lit(accuracy))
    near = level_points(df, tree, variable, sketch)
    table = df.sparkSession.createDataFrame([(leaf, *p) for leaf, p in near.items() if p is not None], "__at long, __p double, __a double, __b double")
    rows = _values(df, tree, variable)
    n = lambda condition: F.count_if(F.expr(condition))
    counts = rows.join(_small(table), F.col("__leaf") == F.col("__at")).groupBy("__leaf").agg(
        F.count("*").alias("n"), F.count("__f").alias("m"), F.min("__f").alias("lo"), F.max("__f").alias("hi"),
        F.first("__p").alias("p"), F.first("__a").alias("a"), F.first("__b").alias("b"),
        n("__x < __p").alias("below"), n("__x <= __p").alias("upto"), n("__f < __a").alias("skip"), n("__f between __a and __b").alias("held"),
    )
    out: dict[int, float | None] = {}
    state = {}
    for r in counts.collect():  # 2**depth rows at most
        rank = (r["n"] - 1) // 2
        if rank >= r["m"]:
            out[r["__leaf"]] = float("nan")
        elif r["below"] <= rank < r["upto"]:
            out[r["__leaf"]] = r["p"]
        elif r["skip"] <= rank < r["skip"] + r["held"] and abs(r["a"]) <= _LARGEST and abs(r["b"]) <= _LARGEST:
            state[r["__leaf"]] = [r["skip"], r["a"], r["b"], rank, rank, r["held"]]
        else:
            state[r["__leaf"]] = [0, r["lo"], r["hi"], rank, rank, r["m"]]
    return out | _picked(rows, state, few)


def _picked(rows: DataFrame, state: dict[int, list], few: int) -> dict[int, float | None]:
    """The middle value of each node, or the midpoint of the two; state: by node the first rank of a range, its bounds, the ranks of the middle values, rows.

    Every pass counts, for each node, the values in BINS equal parts of the
    range that is known to hold its middle values, and narrows the range to
    the parts that do. When at most `few` values are left in it, or nothing
    but neighbouring floats, its distinct values are counted and the middle
    ones picked. All are partial and final aggregates: no task holds a node's
    values.
    """
    spark, out = rows.sparkSession, {}
    for _ in range(PASSES):
        wide = {leaf: s for leaf, s in state.items() if s[5] > few and s[1] < s[2]}
        if not wide:
            break
        table = spark.createDataFrame([(leaf, s[1], s[2]) for leaf, s in wide.items()], "__at long, __lo double, __hi double")
        step = F.col("__hi") / BINS - F.col("__lo") / BINS
        part = F.floor((F.col("__f") / BINS - F.col("__lo") / BINS) / F.nullif(step, F.lit(0.0)) * BINS)
        part = F.coalesce(F.least(part, F.lit(BINS - 1)), F.lit(0)).cast("int")  # bounds that are too near for parts: one part
        inside = rows.join(_small(table), F.col("__leaf") == F.col("__at")).where("__f between __lo and __hi")
        counts: dict[int, list[tuple]] = {}
        for r in inside.groupBy("__leaf", part.alias("part")).agg(F.count("*").alias("n"), F.min("__f").alias("lo"), F.max("__f").alias("hi")).collect():  # BINS rows a node at most
            counts.setdefault(r["__leaf"], []).append((r["part"], r["n"], r["lo"], r["hi"]))
        for leaf, found in counts.items():
            before, s = state[leaf][0], state[leaf]
            held = []
            for _, n, lo, hi in sorted(found):
                if before + n > s[3] and before <= s[4]:
                    held.append((before, n, lo, hi))
                before += n
            state[leaf] = [held[0][0], held[0][2], held[-1][3], s[3], s[4], sum(h[1] for h in held)]
    if state:
        table = spark.createDataFrame([(leaf, *s[1:3], s[0], *s[3:5]) for leaf, s in state.items()], "__at long, __lo double, __hi double, __before long, __low long, __high long")
        inside = rows.join(_small(table), F.col("__leaf") == F.col("__at")).where("__f between __lo and __hi")
        held = inside.groupBy("__leaf", "__x").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("__before", "__low", "__high")])
        upto = F.col("__before") + F.sum("n").over(Window.partitionBy("__leaf").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
        held = held.withColumn("upto", upto)
        picked = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("__x")))
        for r in held.groupBy("__leaf").agg(picked("__low").alias("a"), picked("__high").alias("b")).collect():
            out[r["__leaf"]] = r["a"] if r["a"] == r["b"] else (r["a"] + r["b"]) / 2
    return out


def _small(table: DataFrame) -> DataFrame:
    """A table of nodes, broadcast: the driver made it from 2**depth rows."""
    return F.broadcast(table)


def _grow(df: DataFrame, variables: Sequence[str], depth: int, points) -> SplitTree:
    df = df.select(*[F.col(f"`{v}`") for v in dict.fromkeys(variables)])
    tree = with_bounds(df, variables)
    for variable in schedule(variables, depth):
        tree = tree.grown(variable, points(df, tree, variable))
    return tree


def canonical_tree(df: DataFrame, variables: Sequence[str], depth: int | None = None, accuracy: int = 100, exact: bool = False) -> SplitTree:
    """Cut at approximate medians (relative rank error at most 1 / accuracy); points are values of the data.

    With `exact`, counts confirm or correct each of them to the lower median; a level then takes a pass more, or a few.
    """
    sketched = lambda df, tree, v: level_points(df, tree, v, F.percentile_approx(value(v), 0.5, F.lit(accuracy)))
    settled = lambda df, tree, v: lower_points(df, tree, v, accuracy)
    return _grow(df, variables, len(variables) if depth is None else depth, settled if exact else sketched)


def exact_tree(df: DataFrame, variables: Sequence[str], depth: int | None = None) -> SplitTree:
    """Cut at exact medians, the midpoint of two middle values; every level takes two passes, or a few more where nodes are large."""
    return _grow(df, variables, len(variables) if depth is None else depth, exact_points)


def deepen(df: DataFrame, tree: SplitTree, variables: Sequence[str]) -> SplitTree:
    """The tree with one more level of exact medians for each of the variables, in order."""
    for variable in variables:
        tree = tree.grown(variable, exact_points(df, tree, variable))
    return tree
