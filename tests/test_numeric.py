"""Identities of moments, solver and transforms."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orthant.functions import transforms as tr
from orthant.functions.moments import basis, check_budget, tensor_sum
from orthant.functions.solver import indicator, medians, solve

X = np.random.default_rng(0).uniform(0, 1, 50)


def test_basis_is_cos_and_sin_of_odd_multiples():
    b, w = basis(X, 75), 2 * np.arange(75) + 1
    assert np.allclose(b[:, 0], 1) and np.allclose(b[:, 1::2], np.cos(X[:, None] * w)) and np.allclose(b[:, 2::2], np.sin(X[:, None] * w))


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 40), st.integers(1, 3), st.integers(0, 10**6))
def test_sums_add_up_over_any_split(n, variables, seed):
    x = np.random.default_rng(seed).uniform(0, 1, (n, variables))
    cut = seed % (n + 1)
    whole = tensor_sum(x, 3)
    assert np.allclose(whole, tensor_sum(x[:cut], 3) + tensor_sum(x[cut:], 3)) and np.isclose(whole.flat[0], n)


def test_tensor_is_product_of_bases():
    x = np.random.default_rng(1).uniform(0, 1, (7, 2))
    assert np.allclose(tensor_sum(x, 4), np.einsum("ni,nj->ij", basis(x[:, 0], 4), basis(x[:, 1], 4)))


def test_indicator_of_everything_is_one_and_halves_add_up():
    assert np.allclose(indicator(0, 1, 5), [[1] + [0] * 10])
    m = np.array([0.3])
    assert np.allclose(indicator(0, m, 5) + indicator(m, 1, 5), indicator(0, 1, 5))


def test_solved_median_is_near_the_median():
    x = np.random.default_rng(2).beta(2, 5, 20_000)
    t = basis(x, 64).mean(0)
    m = medians(t[None], np.zeros(1), np.ones(1))
    assert abs(np.searchsorted(np.sort(x), m[0]) / len(x) - 0.5) < 0.01


def test_solved_tree_balances_two_variables():
    x = np.random.default_rng(3).uniform(0, 1, (20_000, 2))
    points = solve(tensor_sum(x, 24) / len(x), [0, 1, 0])
    assert [len(p) for p in points] == [1, 2, 4]
    left = x[:, 0] <= points[0][0]
    assert abs(left.mean() - 0.5) < 0.02
    assert abs((x[left, 1] <= points[1][0]).mean() - 0.5) < 0.03


def test_constant_variable_splits_at_zero():
    assert solve(np.ones((3, 3)), [0, 1], np.array([True, False]))[0] == [0]


def test_budget():
    assert check_budget(18, 2) == 37**2
    with pytest.raises(ValueError):
        check_budget(75, 3)


def test_one_variable_transforms():
    x = np.random.default_rng(42).uniform(0, 3, 5)[:, None]
    j = np.arange(1, 6)
    assert np.allclose(tr.odd_powers_to_harmonics(np.cos(x) ** (2 * j - 1)), np.cos((2 * j - 1) * x))
    assert np.allclose(tr.odd_powers_to_harmonics(np.sin(x) ** (2 * j - 1)), (-1.0) ** (j - 1) * np.sin((2 * j - 1) * x))
    assert np.allclose(tr.powers_to_harmonics(np.cos(x) ** np.arange(5)), np.cos(np.arange(5) * x))
    assert np.allclose(tr.sine_products_to_powers(np.sin(x) * np.cos(x) ** (2 * j - 2)), np.sin(x) ** (2 * j - 1))
    assert np.allclose(tr.alternate_signs(tr.odd_powers_to_harmonics(tr.sine_products_to_powers(np.sin(x) * np.cos(x) ** (2 * j - 2)))), np.sin((2 * j - 1) * x))


@pytest.mark.parametrize("f", ["cos", "sin"])
def test_product_tensors(f):
    x, (a, b, c) = 0.7, (5, 10, 10)
    g = getattr(np, f)
    w = 2 * np.arange(a) + 1
    t = g(w * x)[:, None, None] * np.cos(np.arange(b) * 2 * a * x)[None, :, None] * np.cos(np.arange(c) * 2 * a * b * x)[None, None]
    unfold = tr.cosine_products_to_harmonics if f == "cos" else tr.sine_products_to_harmonics
    assert np.allclose(unfold(t), g((2 * np.arange(a * b * c) + 1) * x))


@pytest.mark.parametrize("j", [(2, 3, 3), (2, 4, 4), (3,)])
def test_power_moments_equal_direct_ones(j):
    n = int(np.prod(j))
    x = np.array([0.4])
    got = tr.powers_to_basis(tr.power_tensor(x, j, "cos")[0], tr.power_tensor(x, j, "sin")[0])
    assert np.allclose(got, basis(x, n)[0, 1:])


def test_transforms_are_linear():
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(2, 3, 4, 4))
    for f in (tr.cosine_products_to_harmonics, tr.sine_products_to_harmonics):
        assert np.allclose(f(2 * u + 3 * v), 2 * f(u) + 3 * f(v))


def test_along_axes_for_two_variables():
    j, x = (2, 3), np.random.default_rng(6).uniform(0, 1, (9, 2))
    power = [np.concatenate([np.ones((9, 1)), tr.power_tensor(x[:, v], j, "cos").reshape(9, -1), tr.power_tensor(x[:, v], j, "sin").reshape(9, -1)], 1) for v in (0, 1)]
    assert np.allclose(tr.along_axes(np.einsum("ni,nj->ij", *power), 2, j), tensor_sum(x, 6))
