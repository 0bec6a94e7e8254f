"""Benchmark results: timed runs, their table, and the runtime model."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.consume import precision
from ..plans.tree import SplitTree

RESULTS = "algorithm string, distribution string, size string, parameter string, depth int, precision double, runtime double, fold int"


def benchmark(spark: SparkSession, points: dict[tuple[str, str], DataFrame], algorithm: str, builders: dict[str, Callable[[DataFrame, int], SplitTree]], depths: Sequence[int], folds: Sequence[int] = (1,)) -> DataFrame:
    """One row per input, parameter, depth and fold; only the build is timed.

    points: by (distribution, size as "2^k"); builders: by parameter text.
    """
    rows = []
    for ((distribution, size), df), (parameter, build), depth, fold in itertools.product(points.items(), builders.items(), depths, folds):
        began = time.perf_counter()
        tree = build(df, depth)
        took = time.perf_counter() - began
        rows.append((algorithm, distribution, size, parameter, depth, precision(df, tree), took, fold))
    return spark.createDataFrame(rows, RESULTS)


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    results.write.mode(mode).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).parquet(path)


def combine(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of the tables, by column names; columns that a table lacks are null."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def panel(results: DataFrame, algorithm: str | None = None, distribution: str | None = None, depth: int | None = None, fold: int | None = None, parameter: str | None = None, sizes: Sequence[str] | None = None) -> DataFrame:
    """The rows of one panel: equal to what is given, and of the sizes given."""
    out = results
    for name, wanted in (("algorithm", algorithm), ("distribution", distribution), ("depth", depth), ("fold", fold), ("parameter", parameter)):
        if wanted is not None:
            out = out.where(F.col(name) == F.lit(wanted))
    return out if sizes is None else out.where(F.col("size").isin(list(sizes)))


def labelled(results: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The rows with `label`: the text for their parameter, else the parameter itself."""
    if not labels:
        return results.withColumn("label", F.col("parameter"))
    lookup = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return results.withColumn("label", F.coalesce(F.try_element_at(lookup, F.col("parameter")), F.col("parameter")))


def with_rows(results: DataFrame) -> DataFrame:
    """The rows with `n`: the number that a size text "2^k" stands for."""
    return results.withColumn("n", F.pow(F.lit(2.0), F.substring("size", 3, 10).cast("double")))


def mean_runtime(results: DataFrame) -> DataFrame:
    """parameter, n, runtime: the mean over all else, in order."""
    return with_rows(results).groupBy("parameter", "n").agg(F.avg("runtime").alias("runtime")).orderBy("parameter", "n")


def fit(means: DataFrame, least: int = 3) -> DataFrame:
    """parameter, a, b of the least-squares model runtime = a n ln n + b, for parameters with at least `least` sizes."""
    x = F.col("n") * F.log("n")
    fitted = means.groupBy("parameter").agg(F.count("*").alias("sizes"), F.regr_slope(F.col("runtime"), x).alias("a"), F.regr_intercept(F.col("runtime"), x).alias("b"))
    return fitted.where(F.col("sizes") >= least).select("parameter", "a", "b")


def extrapolate(model: DataFrame, powers: Sequence[int] = (32, 34, 36)) -> DataFrame:
    """parameter, n, runtime that the model gives for 2**power rows."""
    n = F.explode(F.array(*[F.lit(float(1 << p)) for p in powers])).alias("n")
    return model.select("parameter", "a", "b", n).select("parameter", "n", (F.col("a") * F.col("n") * F.log("n") + F.col("b")).alias("runtime"))
