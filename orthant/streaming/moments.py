"""Harmonic moments of a stream: sums that merge by addition, kept as streaming state by leaf."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.solver import solve
from ..operators.routing import assign, value, whole
from ..plans.tree import SplitTree


def stream_moments(points: DataFrame, variable: str, order: int, lower: float, upper: float, tree: SplitTree | None = None) -> DataFrame:
    """leaf, count, sums of one variable's basis, for a stream in complete or update mode.

    Only built-in aggregates are used, so the state is 2 * order + 1 sums a
    leaf, whatever the length of the stream. Values outside the bounds are
    moved to them.
    """
    width = upper - lower
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value(variable) - lower) / width)) if width else F.lit(0.0)
    rows = assign(whole(points, [variable, *(tree.variables if tree else ())]), tree or SplitTree()).select("leaf", x.alias("x"))
    sums = [F.sum(f((2 * k + 1) * F.col("x"))) for k in range(order) for f in (F.cos, F.sin)]
    return rows.groupBy("leaf").agg(F.count("*").alias("count"), F.array(*sums).alias("sums"))


def median_of(count: int, sums: Sequence[float], lower: float, upper: float) -> float:
    """The solved median of one leaf's state."""
    tensor = np.array([1.0, *[s / count for s in sums]])
    return float(lower + solve(tensor, [0])[0][0] * (upper - lower))
