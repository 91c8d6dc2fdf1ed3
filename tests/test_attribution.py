"""SHAP values against all subsets of features, and their sums on deep trees with features that come up again and again."""

import itertools
import math

import numpy as np
import pytest

from panelwise.operators.attribution import Tree, base_value, explain


def grown(rng, depth, features, stop=0.2):
    rows = []

    def split(level):
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, 1.0, rng.normal()])
        if level < depth and (level < 2 or rng.random() > stop):
            share = rng.uniform(0.05, 0.95)
            rows[at][:2] = rng.integers(features), rng.uniform()
            for side, part in ((2, share), (3, 1 - share)):
                child = split(level + 1)
                rows[at][side], rows[child][4] = child, part
        return at

    split(0)
    f, cut, left, right, share, value = map(np.array, zip(*rows))
    return Tree(f.astype(int), cut, left.astype(int), right.astype(int), share, value)


def margin(tree, x):
    node = 0
    while tree.left[node] >= 0:
        node = tree.left[node] if x[tree.feature[node]] <= tree.cut[node] else tree.right[node]
    return tree.value[node]


def expected(tree, x, known, node=0):
    if tree.left[node] < 0:
        return tree.value[node]
    sides = tree.left[node], tree.right[node]
    if tree.feature[node] in known:
        return expected(tree, x, known, sides[int(x[tree.feature[node]] > tree.cut[node])])
    return sum(tree.share[c] * expected(tree, x, known, c) for c in sides)


@pytest.mark.parametrize("depth", [1, 2, 3, 6])
def test_values_equal_the_definition(depth):
    rng = np.random.default_rng(depth)
    trees, n = [grown(rng, depth, 4) for _ in range(3)], 4
    x = rng.uniform(size=(5, n))
    got = explain(x, trees)
    for row, values in zip(x, got):
        for i in range(n):
            rest, want = [j for j in range(n) if j != i], 0.0
            for size in range(n):
                for known in itertools.combinations(rest, size):
                    scale = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                    want += scale * sum(expected(t, row, {*known, i}) - expected(t, row, set(known)) for t in trees)
            assert values[i] == pytest.approx(want, abs=1e-10)


def test_values_add_up_on_deep_trees():
    rng = np.random.default_rng(7)
    trees = [grown(rng, 10, 12, 0.02) for _ in range(100)]
    assert max(t.depth() for t in trees) == 10
    x = rng.uniform(size=(6, 12))
    assert explain(x, trees).sum(axis=1) + base_value(trees) == pytest.approx([sum(margin(t, r) for t in trees) for r in x], abs=1e-8)


def test_trees_of_one_leaf_say_nothing():
    tree = Tree(np.array([-1]), np.array([0.0]), np.array([-1]), np.array([-1]), np.array([1.0]), np.array([0.7]))
    assert base_value([tree]) == 0.7 and not explain(np.ones((3, 2)), [tree]).any() and explain(np.ones((0, 2)), [tree]).shape == (0, 2)
