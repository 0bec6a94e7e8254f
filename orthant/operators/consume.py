"""What a partition is used for: labels, counts, balance, equal cells and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tree import SplitTree
from .routing import assign, whole

#: Buckets by the first three hex digits of a hash, for global ranks without a global sort in one task.
_DIGITS = 3
#: Rows of a leaf that one task ranks, about; larger leaves are ranked in buckets of their order.
RANKED = 1 << 20


def order_key(key: Sequence[str] | None, seed: int) -> Column:
    """A random order: of rows as they come without a key, else by a seeded MD5 of the key columns, which any engine repeats."""
    if key is None:
        return F.rand(seed)
    return F.md5(F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in key], F.lit(str(seed))))


def counts_by_leaf(df: DataFrame, tree: SplitTree) -> DataFrame:
    """leaf, count of the leaves that have rows, in no order."""
    columns = [F.col(f"`{v}`") for v in dict.fromkeys(tree.variables)]
    rows = assign(whole(df.select(*columns) if columns else df.select(F.lit(0).alias("__x")), tree.variables), tree)
    return rows.groupBy("leaf").agg(F.count("*").alias("count"))


def leaf_counts(df: DataFrame, tree: SplitTree) -> DataFrame:
    """leaf, count of the leaves that have rows, in order of leaves."""
    return counts_by_leaf(df, tree).orderBy("leaf")


def precision_of(counts: DataFrame, expected_leaves: int | None = None) -> DataFrame:
    """precision: -ln(sum |count - mean| / sum count), infinite for perfect balance, null without rows; higher is better.

    The mean is over the leaves that have rows; with `expected_leaves` it is
    over so many, and empty ones count as deviating by the mean.
    """
    listed = counts.agg(F.collect_list(F.col("count").cast("double")).alias("c"))  # as many as leaves
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    leaves = F.size("c").cast("double") if expected_leaves is None else F.lit(float(expected_leaves))
    spread = listed.select("c", total.alias("total"), (total / F.nullif(leaves, F.lit(0.0))).alias("mean"), (leaves - F.size("c")).alias("empty"))
    off = F.aggregate("c", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("mean")))
    share = (off + F.col("mean") * F.col("empty")) / F.nullif(F.col("total"), F.lit(0.0))
    return spread.select(share.alias("share")).select(F.when(F.col("share") == 0, F.lit(float("inf"))).otherwise(-F.log("share")).alias("precision"))


def precision(df: DataFrame, tree: SplitTree, expected_leaves: int | None = None) -> float | None:
    return precision_of(counts_by_leaf(df, tree), expected_leaves).first()["precision"]


def ranked_in_leaf(df: DataFrame, tree: SplitTree, key: Sequence[str] | None, seed: int) -> tuple[DataFrame, int]:
    """The rows with leaf and __k, their rank (from 1) in a random order of their leaf, up to the smallest leaf's count; and that count.

    Leaves of more than RANKED rows are cut into buckets of the order: a
    bucket's ranks begin after the rows of earlier ones, and buckets beyond the
    smallest leaf's count are not sorted at all.
    """
    sizes = counts_by_leaf(df, tree).agg(F.min("count").alias("least"), F.max("count").alias("most")).first()
    least, digits = sizes["least"] or 0, 0
    while (sizes["most"] or 0) > RANKED * 16**digits and digits < 8:
        digits += 1
    rows = assign(whole(df, tree.variables), tree)
    if not digits:
        rank = F.row_number().over(Window.partitionBy("leaf").orderBy(order_key(key, seed)))
        return rows.withColumn("__k", rank).where(F.col("__k") <= least), least
    order = order_key(key, seed) if key is not None else F.md5(F.concat_ws("|", F.rand(seed).cast("string"), F.monotonically_increasing_id().cast("string")))
    rows = rows.withColumn("__o", order).withColumn("__b", F.substring("__o", 1, digits))
    before = Window.partitionBy("__l").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy(F.col("leaf").alias("__l"), F.col("__b").alias("__c")).agg(F.count("*").alias("__n"))  # one row for about RANKED rows
    buckets = buckets.select("__l", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip")).where(F.col("__skip") < least)
    ranked = rows.join(buckets, (F.col("leaf") == F.col("__l")) & (F.col("__b") == F.col("__c")))
    rank = F.row_number().over(Window.partitionBy("leaf", "__b").orderBy("__o"))
    return ranked.withColumn("__k", (rank + F.col("__skip")).cast("long")).where(F.col("__k") <= least).drop("__o", "__b", "__l", "__c", "__skip"), least


def balanced_cells(df: DataFrame, tree: SplitTree, key: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """All columns and `leaf`: as many rows of every non-empty leaf as the smallest one has; with a key the same rows on every run."""
    return ranked_in_leaf(df, tree, key, seed)[0].drop("__k")


def representative_samples(df: DataFrame, tree: SplitTree, seed: int = 0, key: Sequence[str] | None = None) -> DataFrame:
    """All columns and `sample`: each sample has one row of every non-empty leaf; rows beyond the smallest leaf's count are left out.

    A row's rank in the random order of its leaf is the number of its sample.
    """
    return ranked_in_leaf(df, tree, key, seed)[0].withColumn("sample", (F.col("__k") - 1).cast("long")).drop("__k", "leaf")


def global_rank(df: DataFrame, key: Sequence[str] | None, seed: int, name: str) -> DataFrame:
    """The rows with their rank (from 1) in a random order: ranked within buckets of the order, plus the rows of earlier buckets."""
    order = order_key(key, seed) if key is not None else F.md5(F.concat_ws("|", F.rand(seed).cast("string"), F.monotonically_increasing_id().cast("string")))
    rows = df.withColumn("__o", order).withColumn("__b", F.substring("__o", 1, _DIGITS))
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col("__b").alias("__c")).agg(F.count("*").alias("__n"))  # 16**_DIGITS rows at most
    sizes = sizes.select("__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__o")))
    return ranked.join(F.broadcast(sizes), F.col("__b") == F.col("__c")).withColumn(name, F.col("__r") + F.col("__skip")).drop("__o", "__b", "__c", "__r", "__skip")


def random_samples(df: DataFrame, sample_size: int, seed: int = 0, key: Sequence[str] | None = None) -> DataFrame:
    """All columns and `sample`: about `sample_size` random samples, with count // sample_size rows each (one at least)."""
    n = max(1, int(df.count() / sample_size))
    rows = global_rank(df, key, seed, "__rank").withColumn("__index", F.col("__rank") % n)
    rank = F.row_number().over(Window.partitionBy("__index").orderBy(order_key(key, seed + 1)))
    return rows.withColumn("sample", (rank - 1).cast("long")).drop("__rank", "__index")


def in_box(df: DataFrame, tree: SplitTree, box: dict[str, tuple[float, float]]) -> DataFrame:
    """All columns and `leaf` of the rows inside a closed box; the ranges reach the scan, so row groups outside are not read."""
    inside = F.lit(True)
    for v, (lo, hi) in box.items():
        inside = inside & F.col(f"`{v}`").between(lo, hi)
    return assign(df.where(inside), tree)


def leaves_of_box(tree: SplitTree, box: dict[str, tuple[float, float]]) -> list[int]:
    """The leaves whose cells meet a closed box: what to read of a table that is partitioned by leaf."""
    far = lambda b, lo, hi: (b[0] is not None and b[0] > hi) or (b[1] is not None and b[1] < lo)
    return [n for n, cell in enumerate(tree.boxes()) if not any(v in cell and far(cell[v], lo, hi) for v, (lo, hi) in box.items())]
