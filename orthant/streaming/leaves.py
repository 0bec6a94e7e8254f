"""Leaf counts of a stream against a given partition, in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.routing import assign, whole
from ..plans.tree import SplitTree


def windowed_leaf_counts(points: DataFrame, tree: SplitTree, time: str, length: str, late: str) -> DataFrame:
    """start, leaf, count by tumbling window; rows later than `late` behind the newest are left out."""
    rows = assign(whole(points.withWatermark(time, late), tree.variables), tree)
    return rows.groupBy(F.window(time, length), "leaf").agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), "leaf", "count")
