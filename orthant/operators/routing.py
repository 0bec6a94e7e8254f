"""Leaf assignment as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tree import SplitTree

#: Levels whose points stand in the plan as literals; deeper ones are joined as tables.
INLINE = 12
#: Points of a level that are broadcast at most; beyond that Spark chooses the join.
BROADCAST_POINTS = 1 << 18


def value(variable: str) -> Column:
    return F.col(f"`{variable}`").cast("double")


def _step(node: Column, variable: str, points: Column) -> Column:
    x = value(variable)
    return F.when(x.isNotNull(), node * 2 + F.when(x > points, 1).otherwise(0))


def whole(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """The rows without a null in the variables.

    Filter like this before assigning leaves, never on the leaf afterwards:
    Catalyst would move such a filter down through the projections, and the
    leaf's expression, written out in full, doubles with every level.
    """
    return df.dropna(subset=list(dict.fromkeys(variables))) if variables else df


def assign(df: DataFrame, tree: SplitTree, name: str = "leaf") -> DataFrame:
    """The rows with their leaf as a long; a column of that name is replaced. Null where a splitting variable is null.

    Up to INLINE levels are a chain of projections without a shuffle, one a
    level: as the node stands twice in the next level's expression, a single
    nested expression would double with each. Deeper levels are looked up in
    the level's split table, which is broadcast up to BROADCAST_POINTS points.
    """
    spark = df.sparkSession
    out = df.withColumn("__node", F.lit(0).cast("long"))
    node = F.col("__node")
    for d, (variable, points) in enumerate(zip(tree.variables, tree.points, strict=True)):
        if d < INLINE:
            level = F.array(*[F.lit(p).cast("double") for p in points])
            out = out.withColumn("__node", _step(node, variable, F.element_at(level, (node + 1).cast("int"))))
        else:
            table = spark.createDataFrame(list(enumerate(points)), "__at long, __point double")
            table = F.broadcast(table) if len(points) <= BROADCAST_POINTS else table
            out = out.join(table, node == F.col("__at"), "left").withColumn("__node", _step(node, variable, F.col("__point"))).drop("__at", "__point")
    return out.withColumn(name, node).drop("__node")
