"""Odd-harmonic moments of normalised points: the additive statistic behind the one-pass builder.

Each variable, scaled to 0..1, has the basis 1, cos x, sin x, cos 3x, sin 3x,
... with `order` odd frequencies. The moment tensor is the mean over rows of
the products of one basis function per variable; sums of products merge by
addition, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a tensor at most; wider trees need smaller batches of levels.
TENSOR_BUDGET = 1 << 21
#: Entries of a tensor that are added up together.
CHUNK = 1024
_ROWS = 4096


def order_of(j: Sequence[int]) -> int:
    """The number of odd frequencies that a list of factors stands for."""
    return prod(j)


def check_budget(order: int, variables: int) -> int:
    size = (2 * order + 1) ** variables
    if size > TENSOR_BUDGET:
        raise ValueError(f"{variables} variables with {order} frequencies need {size} moments a cell; use fewer factors or a smaller batch_size")
    return size


def basis(x: np.ndarray, order: int) -> np.ndarray:
    """Rows of 1, cos x, sin x, cos 3x, sin 3x, ...; each harmonic from the one before by the angle-addition rule for 2x."""
    out = np.empty((len(x), 2 * order + 1))
    out[:, 0] = 1
    c, s = np.cos(x), np.sin(x)
    c2, s2 = np.cos(2 * x), np.sin(2 * x)
    for k in range(order):
        out[:, 2 * k + 1], out[:, 2 * k + 2] = c, s
        c, s = c * c2 - s * s2, s * c2 + c * s2
    return out


def tensor_sum(points: np.ndarray, order: int) -> np.ndarray:
    """Sum over rows of the products of basis values; points: rows by variables, scaled. Its first entry is the number of rows."""
    p = points.shape[1]
    out = np.zeros(((2 * order + 1) ** max(0, p - 1), 2 * order + 1))
    for lo in range(0, len(points), _ROWS if p < 3 else 256):
        part = points[lo : lo + (_ROWS if p < 3 else 256)]
        left = np.ones((len(part), 1))
        for v in range(p - 1):
            left = (left[:, :, None] * basis(part[:, v], order)[:, None, :]).reshape(len(part), -1)
        out += left.T @ basis(part[:, p - 1], order) if p else 0
    return out.reshape((2 * order + 1,) * p)


def summed_moments(df: DataFrame, order: int, boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """leaf, chunk, sums: the tensor of each leaf's rows, flat, in chunks of CHUNK entries.

    df: leaf and x0, x1, ... in data units. boxes: lower and upper bounds of a
    leaf's variables. A task adds up its rows in one tensor for each leaf it
    meets; chunks of a tensor are then added up apart from each other, as a
    stream, so no task holds the tensors of many others.
    """
    names = [c for c in df.columns if c != "leaf"]
    schema = "leaf long, chunk int, sums array<double>"

    def chunks(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        at = pa.array([k for k, _ in sums], pa.int64()), pa.array([c for _, c in sums], pa.int32())
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in sums.values()])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*at, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sums.values(), np.empty(0)])))], names=["leaf", "chunk", "sums"])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            x = np.stack([batch.column(c).to_numpy() for c in names], 1)
            for n in np.unique(leaf).tolist():
                lower, upper = boxes[n]
                rows = x[leaf == n] if len(boxes) > 1 else x
                width = np.where(upper > lower, upper - lower, 1)
                t = tensor_sum((rows - lower) / width, order).ravel()
                sums[n] = sums[n] + t if n in sums else t
        for n, t in sums.items():
            for lo in range(0, len(t), CHUNK << 6):
                yield chunks({(n, k // CHUNK): t[k : k + CHUNK] for k in range(lo, min(len(t), lo + (CHUNK << 6)), CHUNK)})

    def add(batches):
        now, total = None, None
        for batch in batches:
            lists, keys = batch.column("sums"), zip(batch.column("leaf").to_pylist(), batch.column("chunk").to_pylist(), strict=True)
            for i, key in enumerate(keys):
                t = lists[i].values.to_numpy(zero_copy_only=False)
                if key == now:
                    total += t
                else:
                    if now is not None:
                        yield chunks({now: total})
                    now, total = key, t.copy()
        if now is not None:
            yield chunks({now: total})

    part = df.mapInArrow(run, schema)
    return part.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk").mapInArrow(add, schema)


def joined(table: pa.Table) -> np.ndarray:
    """One leaf's tensor, flat, from its chunks."""
    order = np.argsort(table.column("chunk").to_numpy())
    return table.take(pa.array(order)).column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False)


def moments(df: DataFrame, variables: Sequence[str], order: int, lower: Sequence[float], upper: Sequence[float]) -> np.ndarray:
    """The tensor of means over all rows without nulls; only one tensor reaches the driver; all zero without rows."""
    size = check_budget(order, len(variables))
    x = [F.col(f"`{v}`").cast("double").alias(f"x{i}") for i, v in enumerate(variables)]
    points = df.select(F.lit(0).cast("long").alias("leaf"), *x).dropna()
    table = summed_moments(points, order, {0: (np.array(lower, float), np.array(upper, float))}).toArrow()
    if not table.num_rows:
        return np.zeros((2 * order + 1,) * len(variables))
    total = joined(table)
    assert len(total) == size
    return (total / total[0]).reshape((2 * order + 1,) * len(variables))


def moments_table(tensor: np.ndarray, spark) -> DataFrame:
    """The tensor as rows: w0, k0, w1, k1, ..., moment, with frequency w (0 for the constant) and kind k of 1, c, s."""
    names = [(0, "1")] + [(2 * k + 1, kind) for k in range((tensor.shape[0] - 1) // 2) for kind in "cs"]
    rows = [(*[x for i in at for x in names[i]], float(m)) for at, m in np.ndenumerate(tensor)]
    schema = ", ".join(f"w{v} int, k{v} string" for v in range(tensor.ndim)) + ", moment double"
    return spark.createDataFrame(rows, schema)


def moments_by_leaf(df: DataFrame, order: int, boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """leaf, count, moments (flat array of means) of each leaf that has rows; df as for summed_moments."""

    def mean(table: pa.Table) -> pa.Table:
        total = joined(table)
        return pa.table({"leaf": table.column("leaf")[:1], "count": pa.array([round(total[0])], pa.int64()), "moments": pa.array([total / total[0]], pa.list_(pa.float64()))})

    return summed_moments(df, order, boxes).groupBy("leaf").applyInArrow(mean, "leaf long, count long, moments array<double>")
