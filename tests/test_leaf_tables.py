"""Contributions by looking up leaf tables equal those of the recursion to the last bit."""

import numpy as np
import pytest

from claimscope.operators import explain as E


@pytest.mark.parametrize("depth", [1, 4, 6])
def test_leaf_tables_give_the_values_of_the_recursion(depth):
    rng = np.random.default_rng(depth)
    n = 2 ** (depth + 1) - 1
    inner = 2**depth - 1
    left = np.array([2 * i + 1 if i < inner else -1 for i in range(n)])
    right = np.array([2 * i + 2 if i < inner else -1 for i in range(n)])
    feat = np.where(left < 0, -1, rng.integers(0, 3, n))  # features repeat on a path
    cover = np.zeros(n)
    for i in range(n - 1, -1, -1):
        cover[i] = rng.integers(1, 50) if left[i] < 0 else cover[left[i]] + cover[right[i]]
    tree = (left, right, feat, rng.normal(size=n), rng.normal(size=n), cover)
    x = rng.normal(size=(200, 3))
    x[::17, 1] = np.nan
    want, got = np.zeros((200, 3)), np.zeros((3, 200))
    E.tree_shap(x, tree, want, 0.3)
    with np.errstate(divide="ignore", invalid="ignore"):
        tables = E.leaf_tables(tree, 0.3)
    E.tree_shap_by_table(x, tree, tables, got)
    assert np.array_equal(got.T, want)
    assert E.leaf_tables(tree, 0.3, room=8) is None
