"""A balanced partition of space: split points by level and node, and views of them as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import cycle, islice

from pyspark.sql import DataFrame, SparkSession

SPLITS = "depth int, variable string, node long, point double"
NODES = "node_id long, level int, axis string, leaf long, median double, parent_id long, left_id long, right_id long"
CELLS = "leaf long, variable string, lower double, upper double"


def schedule(variables: Sequence[str], depth: int) -> list[str]:
    """The splitting variable of each level: the variables in turn."""
    if depth and not variables:
        raise ValueError("a tree with levels needs variables")
    return list(islice(cycle(variables), depth))


def batches(items: Sequence[str], size: int | None) -> list[list[str]]:
    """Consecutive parts of at most `size` items; one part without a size."""
    if size is not None and size < 1:
        raise ValueError("a batch has at least one level")
    size = size or max(1, len(items))
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def rounds(depth: int, step: int) -> list[int]:
    """Levels per round of the sampled builder; no round is empty."""
    if step < 1:
        raise ValueError("a round has at least one level")
    return [step] * (depth // step) + ([depth % step] if depth % step else [])


@dataclass(frozen=True)
class SplitTree:
    """points[d] has 2**d points of level d, split on variables[d]; None where a node has no rows.

    A row goes left where its value is at most the point, else right; below a
    node without a point everything goes left. NaN counts as larger than any
    point. A row with a null in a splitting variable has no leaf.
    """

    variables: tuple[str, ...] = ()
    points: tuple[tuple[float | None, ...], ...] = ()
    lower: tuple[tuple[str, float | None], ...] = ()
    upper: tuple[tuple[str, float | None], ...] = ()

    @property
    def depth(self) -> int:
        return len(self.variables)

    def grown(self, variable: str, points: dict[int, float | None]) -> SplitTree:
        """This tree with one more level; nodes that `points` lacks get None."""
        level = tuple(None if (p := points.get(n)) is None else float(p) for n in range(1 << self.depth))
        return SplitTree((*self.variables, variable), (*self.points, level), self.lower, self.upper)

    def bounded(self, lower: dict[str, float | None], upper: dict[str, float | None]) -> SplitTree:
        return SplitTree(self.variables, self.points, tuple(lower.items()), tuple(upper.items()))

    def boxes(self) -> list[dict[str, tuple[float | None, float | None]]]:
        """Lower and upper bound of each variable in every leaf's cell, by leaf; None where a bound is not known."""
        lower, upper = dict(self.lower), dict(self.upper)
        names = dict.fromkeys([*lower, *self.variables])
        out = [{v: (lower.get(v), upper.get(v)) for v in names}]
        for variable, points in zip(self.variables, self.points, strict=True):
            split = []
            for box, p in zip(out, points, strict=True):
                lo, hi = box[variable]
                split += [box | {variable: (lo, hi if p is None else p)}, box | {variable: (lo if p is None else p, hi)}]
            out = split
        return out

    def split_rows(self) -> list[tuple[int, str, int, float | None]]:
        return [(d, v, n, p) for d, (v, level) in enumerate(zip(self.variables, self.points, strict=True)) for n, p in enumerate(level)]

    def to_splits(self, spark: SparkSession) -> DataFrame:
        """depth, variable, node, point."""
        return spark.createDataFrame(self.split_rows(), SPLITS)

    def to_nodes(self, spark: SparkSession) -> DataFrame:
        """Inner nodes and leaves by heap number: children of i are 2i+1 and 2i+2; leaf is the number within the level."""
        rows = []
        for level in range(self.depth + 1):
            for n in range(1 << level):
                i, inner = (1 << level) - 1 + n, level < self.depth
                rows.append((i, level, self.variables[level] if inner else None, n, self.points[level][n] if inner else None, (i - 1) // 2 if i else None, 2 * i + 1 if inner else None, 2 * i + 2 if inner else None))
        return spark.createDataFrame(rows, NODES)

    def to_cells(self, spark: SparkSession) -> DataFrame:
        """leaf, variable, lower, upper."""
        return spark.createDataFrame([(leaf, v, *b) for leaf, box in enumerate(self.boxes()) for v, b in box.items()], CELLS)


def from_splits(rows) -> SplitTree:
    """The tree of split rows (depth, variable, node, point), in any order."""
    tree = SplitTree()
    levels: dict[int, tuple[str, dict]] = {}
    for depth, variable, node, point in rows:
        levels.setdefault(depth, (variable, {}))[1][node] = point
    for d in range(len(levels)):
        tree = tree.grown(*levels[d])
    return tree
