"""Medians of cells from harmonic moments: indicator series, contraction, bisection on all nodes of a level."""

from __future__ import annotations

import numpy as np

STEPS = 50


def indicator(a: np.ndarray, b: np.ndarray, order: int) -> np.ndarray:
    """Coefficients of the series of the indicator of (a, b) within 0..1, one row per interval; borders at 0 and 1 don't count as jumps."""
    a, b = np.atleast_1d(a).astype(float), np.atleast_1d(b).astype(float)
    w = 2 * np.arange(order) + 1
    left, right = (a > 0)[:, None], (b < 1)[:, None]
    wa, wb = a[:, None] * w, b[:, None] * w
    out = np.empty((len(a), 2 * order + 1))
    out[:, 0] = 1 - 0.5 * ((a > 0) * 1.0 + (b < 1))
    out[:, 1::2] = 2 / (np.pi * w) * (right * np.sin(wb) - left * np.sin(wa))
    out[:, 2::2] = 2 / (np.pi * w) * (left * np.cos(wa) - right * np.cos(wb))
    return out


def contract(tensor: np.ndarray, axis: int, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """For each box (rows of lower, upper by variable), the moments along one axis weighted with the indicators of the others."""
    order = (tensor.shape[0] - 1) // 2
    out = np.moveaxis(tensor, axis, 0)[None]
    for v in [v for v in range(tensor.ndim) if v != axis][::-1]:
        g = indicator(lower[:, v], upper[:, v], order)
        out = np.einsum("n...k,nk->n...", np.broadcast_to(out, (len(g), *out.shape[1:])), g, optimize=True) if out.shape[0] in (1, len(g)) else out
    return np.broadcast_to(out, (len(lower), out.shape[1]))


def medians(weights: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The point of each interval with equal mass on both sides, by bisection with a fixed number of steps: to the right while the left side is the lighter."""
    order = (weights.shape[1] - 1) // 2
    lo, hi = lower.astype(float).copy(), upper.astype(float).copy()
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        lighter = np.einsum("nk,nk->n", weights, indicator(lower, mid, order) - indicator(mid, upper, order)) < 0
        lo, hi = np.where(lighter, mid, lo), np.where(lighter, hi, mid)
    return (lo + hi) / 2


def solve(tensor: np.ndarray, axes: list[int], constant: np.ndarray | None = None) -> list[np.ndarray]:
    """Split points of as many levels as axes, in scaled units, level by level from one tensor.

    constant: which variables have equal bounds; their points are 0.
    """
    p = tensor.ndim
    lower, upper, out = np.zeros((1, p)), np.ones((1, p)), []
    for axis in axes:
        if constant is not None and constant[axis]:
            m = np.zeros(len(lower))
        else:
            m = medians(contract(tensor, axis, lower, upper), lower[:, axis], upper[:, axis])
        out.append(m)
        lower, upper = np.repeat(lower, 2, 0), np.repeat(upper, 2, 0)
        upper[0::2, axis] = m
        lower[1::2, axis] = m
    return out
