"""The one-pass builder: many levels of cuts from one set of additive harmonic moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.moments import check_budget, joined, moments, order_of, summed_moments
from ..functions.solver import solve
from ..plans.tree import SplitTree, batches, schedule
from .quantile import deepen, with_bounds
from .routing import assign, value, whole


def _grow(tree: SplitTree, variables: list[str], rows) -> SplitTree:
    for d, variable in enumerate(variables):
        tree = tree.grown(variable, {n: p for level, n, p in rows if level == d})
    return tree


def _points(tensor: np.ndarray, axes: list[int], lower: np.ndarray, upper: np.ndarray, leaf: int) -> list[tuple[int, int, float]]:
    """(level, node, point) in data units of the levels below one leaf."""
    found = solve(tensor, axes, upper <= lower)
    return [(d, leaf * len(m) + n, float(lower[a] + x * (upper[a] - lower[a]))) for d, (a, m) in enumerate(zip(axes, found, strict=True)) for n, x in enumerate(m)]


def harmonic_tree(df: DataFrame, variables: Sequence[str], j: Sequence[int] = (2, 4, 4), depth: int | None = None, batch_size: int | None = None, local_depth: int | None = None) -> SplitTree:
    """Cut at medians solved from moments with prod(j) odd frequencies.

    Levels are taken in batches of batch_size, all at once without one. The
    first batch needs one pass over the data; each further batch one more, in
    which every leaf has moments of its own cell. `local_depth` adds levels of
    exact medians at the end. A node without rows has no point where its leaf
    had none before the batch. depth: as many levels as variables, unless given.
    """
    depth = len(variables) if depth is None else depth
    order, names = order_of(j), list(dict.fromkeys(variables))
    df = df.select(*[F.col(f"`{v}`") for v in names])
    tree = with_bounds(df, names)
    if not depth and not local_depth:
        return tree
    lower, upper = dict(tree.lower), dict(tree.upper)
    some = all(lower[v] is not None for v in names)
    plan = schedule(variables, depth + (local_depth or 0))
    for now in batches(plan[:depth], batch_size) if depth else []:
        used = list(dict.fromkeys(now))
        check_budget(order, len(used))
        axes = [used.index(v) for v in now]
        if not some:
            rows = []
        elif not tree.depth:
            lo, hi = np.array([lower[v] for v in used], float), np.array([upper[v] for v in used], float)
            tensor = moments(df, used, order, lo, hi)
            rows = _points(tensor, axes, lo, hi, 0) if tensor.flat[0] else []
        else:
            boxes = {n: tuple(np.array([box[v][k] for v in used], float) for k in (0, 1)) for n, box in enumerate(tree.boxes())}
            points = assign(whole(df, [*tree.variables, *used]), tree, "__leaf").select(F.col("__leaf").alias("leaf"), *[value(v).alias(f"x{i}") for i, v in enumerate(used)])

            shape = (2 * order + 1,) * len(used)

            def cut(table):  # sent out by collect() below, within this round
                leaf, total = table.column("leaf")[0].as_py(), joined(table)
                found = _points((total / total[0]).reshape(shape), axes, *boxes[leaf], leaf)
                return pa.table([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["d", "node", "point"])

            sums = summed_moments(points, order, boxes)
            rows = [tuple(r) for r in sums.groupBy("leaf").applyInArrow(cut, "d int, node long, point double").collect()]  # split points
        tree = _grow(tree, now, rows)
    return deepen(df, tree, plan[depth:])
