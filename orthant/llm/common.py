"""Shared plumbing of the corpus operators: scratch tables, Arrow streaming and grouping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shared_dir

#: Rows that become Python objects at once, and bytes of a batch on its way to Python and back: many times that much is held outside the JVM's heap.
ROWS, BATCH_BYTES = 1000, 1 << 22


def small_batches(df: DataFrame) -> None:
    """Limit the session's Arrow batches to BATCH_BYTES, unless they are smaller already."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m")))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def over_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The mapInArrow function that applies fn to ROWS rows at a time, so that only so many texts are Python strings at once."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                yield fn(batch.slice(lo, ROWS))

    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from a stream that is sorted by them (nulls not allowed); one group at a time is held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)


def list_column(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def share(column: str) -> Column:
    """A number from 0 to 1 for each value, spread evenly by a 64-bit hash: what is below a share is a sample of that share, at any size."""
    return F.shiftrightunsigned(F.xxhash64(column), 11).cast("double") * 2.0**-53


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["ROWS", "Scratch", "list_column", "over_batches", "share", "shared_dir", "small_batches", "sorted_groups", "table"]
