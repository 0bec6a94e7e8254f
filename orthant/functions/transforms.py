"""Linear maps from power products to harmonics, for checks of the moments against the power form.

Throughout, c = cos x and s = sin x. The direct harmonics of moments.py make
these unnecessary for building trees. All are matrices or sums applied along
an array's last axis, so they are linear by construction.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(32)
def _chebyshev(n: int) -> np.ndarray:
    """Row j holds the coefficients of the Chebyshev polynomial T_j by power."""
    t = np.zeros((n, n))
    t[0, 0] = 1
    if n > 1:
        t[1, 1] = 1
    for j in range(2, n):
        t[j, 1:] = 2 * t[j - 1, :-1]
        t[j] -= t[j - 2]
    return t


def odd_powers_to_harmonics(v: np.ndarray) -> np.ndarray:
    """c, c^3, c^5, ... to cos x, cos 3x, cos 5x, ...; sines give the harmonics with alternating sign."""
    n = v.shape[-1]
    return v @ _chebyshev(2 * n)[1::2, 1::2].T


def powers_to_harmonics(v: np.ndarray) -> np.ndarray:
    """1, c, c^2, ... to 1, cos x, cos 2x, ..."""
    return v @ _chebyshev(v.shape[-1]).T


def sine_products_to_powers(v: np.ndarray) -> np.ndarray:
    """s, s c^2, s c^4, ... to s, s^3, s^5, ...: repeated differences, since s^2 = 1 - c^2."""
    out, v = [], np.asarray(v, float)
    for _ in range(v.shape[-1]):
        out.append(v[..., 0])
        v = v[..., :-1] - v[..., 1:]
    return np.stack(out, -1)


def alternate_signs(v: np.ndarray) -> np.ndarray:
    """Entry j times (-1)^j."""
    return v * (-1.0) ** np.arange(v.shape[-1])


def _unfold(t: np.ndarray, sign: float) -> np.ndarray:
    """A tensor of f(a x) cos(k_1 L_1 x) cos(k_2 L_2 x) ... to the vector of f(w x), w odd ascending.

    Each axis after the first steps by L = twice the number of frequencies so
    far. With u(k) the block of frequencies around k L, the product rule gives
    f(w x) + f(w' x) twice the slice for k, where w' mirrors w at k L; sign is
    that of f at a negative argument.
    """
    out = np.asarray(t, float)
    while out.ndim > 1:
        blocks = [np.take(out, 0, axis=1)]
        for k in range(1, out.shape[1]):
            last = np.flip(blocks[-1], axis=0)
            blocks.append(2 * np.take(out, k, axis=1) - sign * last)
        out = np.concatenate(blocks, axis=0)
    return out


def cosine_products_to_harmonics(t: np.ndarray) -> np.ndarray:
    """Tensor of cos((2j-1)x) cos(k L_1 x) cos(k' L_2 x)... with L_1 = 2J_1, L_2 = 2J_1J_2, ... to cos x, cos 3x, ..."""
    return _unfold(t, 1.0)


def sine_products_to_harmonics(t: np.ndarray) -> np.ndarray:
    """Tensor of sin((2j-1)x) cos(k L_1 x) ... to sin x, sin 3x, ..."""
    return _unfold(t, -1.0)


def power_tensor(x: np.ndarray, j: tuple[int, ...], f: str) -> np.ndarray:
    """The power form of one variable: rows by J_1 by J_2 ...; f is cos or sin.

    Along the first axis c^(2a+1), or s c^(2a); along axis k the powers of
    cos(L_k x), L_k twice the product of the factors before.
    """
    x = np.asarray(x, float)
    a = np.arange(j[0])
    out = np.cos(x)[:, None] ** (2 * a + 1) if f == "cos" else np.sin(x)[:, None] * np.cos(x)[:, None] ** (2 * a)
    step = 2 * j[0]
    for n in j[1:]:
        out = out[..., None] * (np.cos(step * x)[:, None] ** np.arange(n)).reshape(len(x), *[1] * (out.ndim - 1), n)
        step *= n
    return out


def powers_to_basis(cosines: np.ndarray, sines: np.ndarray) -> np.ndarray:
    """Power tensors of one variable (rows first, or summed over rows without that axis) to 1, cos x, sin x, cos 3x, ... without the 1."""

    def apart(t: np.ndarray, f: str) -> np.ndarray:
        t = np.moveaxis(t, 0, -1)
        t = odd_powers_to_harmonics(t) if f == "cos" else alternate_signs(odd_powers_to_harmonics(sine_products_to_powers(t)))
        t = np.moveaxis(t, -1, 0)
        for axis in range(1, t.ndim):
            t = np.moveaxis(powers_to_harmonics(np.moveaxis(t, axis, -1)), -1, axis)
        return cosine_products_to_harmonics(t) if f == "cos" else sine_products_to_harmonics(t)

    c, s = apart(np.asarray(cosines, float), "cos"), apart(np.asarray(sines, float), "sin")
    return np.stack([c, s], -1).ravel()


def along_axes(tensor: np.ndarray, variables: int, j: tuple[int, ...]) -> np.ndarray:
    """Power moments of several variables to harmonic moments, one axis after the other.

    Each axis has 1, then the flattened cosine power tensor, then the sine
    one; each comes out as 1, cos x, sin x, cos 3x, sin 3x, ...
    """
    out = np.asarray(tensor, float)
    n = int(np.prod(j))

    def one(v: np.ndarray) -> np.ndarray:
        return np.concatenate([v[:1], powers_to_basis(v[1 : 1 + n].reshape(j), v[1 + n :].reshape(j))])

    for axis in range(variables):
        out = np.apply_along_axis(one, axis, out)
    return out
