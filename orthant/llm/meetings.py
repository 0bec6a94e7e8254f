"""Pairs of tiles in which rows of a group that are not joined yet meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def meetings(rows: DataFrame, roots: DataFrame, tiles_of: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows, once for each pair of tiles (x, y) that theirs belongs to, and their side of it; rows: doc_id, grp, root; roots: grp, root, n, bytes.

    All rows of a group with different roots meet in some pair. A root with
    more rows than a tile holds has tiles of its own, the others share the
    group's first ones. Two tiles of one root don't meet, so a root that holds
    most of a group is read once for each tile of the others.
    """
    own_tiles = tiles_of(F.col("n"), F.col("bytes"))
    apart = roots.withColumn("own", F.when(own_tiles > 1, own_tiles))
    few = lambda c: F.sum(F.when(F.col("own").isNull(), F.col(c)))
    shared = apart.groupBy("grp").agg(F.coalesce(tiles_of(few("n"), few("bytes")), F.lit(0)).alias("shared"), F.coalesce(F.sum("own"), F.lit(0)).alias("owned"))
    total = (F.col("shared") + F.col("owned")).cast("int").alias("total")
    before = Window.partitionBy("grp").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    alone = apart.where("own is not null").join(shared, "grp").withColumn("begin", (F.col("shared") + F.coalesce(F.sum("own").over(before), F.lit(0))).cast("int"))
    alone = alone.select("grp", "root", "begin", (F.col("begin") + F.col("own")).cast("int").alias("stop"), total, F.col("begin").alias("below"))
    rest = apart.where("own is null").join(shared, "grp").select("grp", "root", F.lit(0).alias("begin"), F.col("shared").alias("stop"), total, F.col("shared").alias("below"))
    met = rows.join(alone.unionByName(rest).withColumnsRenamed({"grp": "g", "root": "r"}), (F.col("grp") == F.col("g")) & (F.col("root") == F.col("r")))
    met = met.withColumn("tile", F.col("begin") + F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.col("stop") - F.col("begin")).cast("int"))
    upto = lambda a, b: F.filter(F.sequence(a, b), lambda i: i < b)
    met = met.withColumn("other", F.explode(F.concat(upto(F.lit(0), F.col("below")), upto(F.col("stop"), F.col("total")))))
    met = met.withColumns({"x": F.least("tile", "other"), "y": F.greatest("tile", "other"), "side": (F.col("tile") > F.col("other")).cast("int")})
    return met.drop("g", "r", "begin", "stop", "total", "below", "tile", "other")
