"""Connected components of a link table by alternating stars, each round a few shuffles of the links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SCHEMA = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the given links connect; roots have none."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        for end in (x, y):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _local(batches):
    """The forest of a task's own links, a few batches at a time."""
    held, size = [], 0

    def told():
        a, b = forest(*(np.concatenate([t.column(k).to_numpy() for t in held]) for k in ("a", "b")))
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size > 2_000_000:
            yield told()
            held, size = [], 0
    if size:
        yield told()


def _stars(links: DataFrame) -> DataFrame:
    """One large star and one small star: every node's links move to the smallest node beside it."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
    joined = large.join(least, F.col("a") == F.col("w"))
    return joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a > b")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, component (the smallest id reachable) of every node that has a link to another and is not itself the smallest.

    Each round is written to the shared folder, which cuts the lineage, and
    the round before is removed. The rounds end when every node that has a
    smaller neighbour has just one, which itself has none.
    """
    now = scratch.save(links.where("a <> b").mapInArrow(_local, SCHEMA).distinct(), f"{name}-0")
    step = 0
    while True:
        sides = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        open_ = sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
        if not open_.limit(1).count():
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
        step += 1
        now = scratch.save(_stars(now).mapInArrow(_local, SCHEMA).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
