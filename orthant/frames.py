"""Method form: the builders and consumers as methods of DataFrames, once `attach()` was called."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .operators import consume, harmonic, quantile, routing, sampled
from .plans.tree import SplitTree


def _draw(df: DataFrame, variables: Sequence[str], j: Sequence[int] = (2, 4, 4), depth: int | None = None, batch_size: int | None = None, local_depth: int | None = None, seed: int = 0, key: Sequence[str] | None = None) -> DataFrame:
    """All columns and `sample`: representative samples from a harmonic tree that is built on the way."""
    return consume.representative_samples(df, harmonic.harmonic_tree(df, variables, j, depth, batch_size, local_depth), seed, key)


METHODS = {
    "harmonic_tree": harmonic.harmonic_tree,
    "canonical_tree": quantile.canonical_tree,
    "exact_tree": quantile.exact_tree,
    "sampled_tree": sampled.sampled_tree,
    "assign_leaf": routing.assign,
    "leaf_counts": consume.leaf_counts,
    "tree_precision": consume.precision,
    "balanced_cells": consume.balanced_cells,
    "representative_samples": _draw,
    "random_samples": consume.random_samples,
    "in_box": consume.in_box,
}


def attach(kind: type | None = None) -> None:
    """Make METHODS methods of the DataFrames of this process: ``df.harmonic_tree(["x", "y"], depth=6)``."""
    for cls in {DataFrame, *([kind] if kind else [])}:
        for name, f in METHODS.items():
            setattr(cls, name, lambda self, *a, f=f, **b: f(self, *a, **b))


__all__ = ["METHODS", "SplitTree", "attach"]
