"""The builder that cuts at exact medians of a capped stratified sample, several levels per pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tree import SplitTree, rounds, schedule
from .consume import order_key
from .quantile import with_bounds
from .routing import assign, value, whole


def stratified_sample(df: DataFrame, cap: int, spare: int, by: str = "leaf", seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """At most `cap` random rows of each stratum.

    Without a key, rows are first thinned at random to about cap + spare of
    each stratum, then cut to cap; with a key, the rows whose seeded hashes
    are smallest are taken, which is the same on every run and engine. A null
    is a stratum like any other value, but has no random sample.
    """
    if key is None:
        counts = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect() if r[by] is not None}  # as many rows as leaves
        df = df.sampleBy(by, {k: min(1.0, (cap + spare) / n) for k, n in counts.items()}, seed)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order_key(key, seed)))
    return df.withColumn("__k", rank).where(F.col("__k") <= cap).drop("__k")


def subtree(x: np.ndarray, levels: int, columns: Sequence[int]) -> list[list[float | None]]:
    """Exact medians of a few levels over the rows of x; level d cuts on column columns[d]."""
    parts, out = [x], []
    for d in range(levels):
        points = [float(np.median(p[:, columns[d]])) if len(p) else None for p in parts]
        parts = [side for p, c in zip(parts, points, strict=True) for side in ((p, p) if c is None else (p[p[:, columns[d]] <= c], p[~(p[:, columns[d]] <= c)]))]
        out.append(points)
    return out


def sampled_tree(df: DataFrame, variables: Sequence[str], depth: int | None = None, step: int = 4, sigma: int = 32, seed: int = 42, key: Sequence[str] | None = None) -> SplitTree:
    """Cut `step` levels per round at exact medians of a sample with sigma rows for each new leaf.

    A round counts and samples in one or two passes over the data; a task
    holds the sample of one leaf, 2**step * sigma rows at most. Only split
    points reach the driver.
    """
    depth = len(variables) if depth is None else depth
    names = list(dict.fromkeys(variables))
    df = df.select(*[F.col(f"`{v}`") for v in dict.fromkeys([*names, *(key or ())])])
    tree, plan = with_bounds(df, names), schedule(variables, depth)
    for levels in rounds(depth, step):
        now = plan[tree.depth : tree.depth + levels]
        sample = stratified_sample(assign(whole(df, names), tree, "__leaf"), (1 << levels) * sigma, 2 * sigma, "__leaf", seed, key)
        sample = sample.select(F.col("__leaf").alias("leaf"), *[value(v).alias(f"x{i}") for i, v in enumerate(names)])

        def solve(table):  # sent out by collect() below, within this round
            x = np.stack([table.column(f"x{i}").to_numpy() for i in range(len(names))], 1)
            leaf = table.column("leaf")[0].as_py()
            found = subtree(x, len(now), [names.index(v) for v in now])
            rows = [(d, leaf * (1 << d) + n, p) for d, level in enumerate(found) for n, p in enumerate(level)]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["d", "node", "point"])

        points = sample.groupBy("leaf").applyInArrow(solve, "d int, node long, point double").collect()  # split points
        for d, variable in enumerate(now):
            tree = tree.grown(variable, {r["node"]: r["point"] for r in points if r["d"] == d})
    return tree
