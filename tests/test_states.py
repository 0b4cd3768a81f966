"""Whole-tree search by states against brute force, above the bound of the driver's search."""

import random

import numpy as np
import pytest

from sylvaframe.operators import captures
from sylvaframe.operators.captures import Layout
from sylvaframe.plans import special, states
from sylvaframe.plans.estimator import OptimalTree


def cases(seed):
    rng = random.Random(seed)
    m = 3
    rows = sorted({tuple(rng.randint(0, 1) for _ in range(m)) for _ in range(7)})
    return rows, [rng.randint(0, 4) for _ in rows], [rng.randint(1, 4) for _ in rows]


def partitions(rows, at):
    yield [at]
    for f in range(len(rows[0])):
        a, b = [i for i in at if rows[i][f]], [i for i in at if not rows[i][f]]
        if a and b:
            yield from (x + y for x in partitions(rows, a) for y in partitions(rows, b))


@pytest.mark.parametrize("objective, seed", [("acc", 1), ("bacc", 2), ("wacc", 3), ("f1", 4), ("auc", 5), ("pauc", 6), ("f1", 7)])
def test_states_equal_brute_force(spark, objective, seed):
    rows, pos, neg = cases(seed)
    want = min(special.loss(objective, [sum(pos[i] for i in x) for x in p], [sum(neg[i] for i in x) for x in p], 2.0, 0.4) + 0.03 * len(p) for p in partitions(rows, list(range(len(rows)))))
    names = [f"r{i}" for i in range(3)]
    df = spark.createDataFrame([(*r, n, p) for r, n, p in zip(rows, neg, pos)], ", ".join([*[f"{x} int" for x in names], "n0 long", "n1 long"])).repartition(3)
    layout = Layout.of([1] * 3, [False] * 3, [[0, 1], [1, 0]], 0, sum(pos) + sum(neg))
    risk, leaves, proven, _ = states.search(captures.chunked(df, names, ["n0", "n1"], layout), layout, objective, 0.03, w=2.0, theta=0.4)
    assert proven and risk == pytest.approx(want)
    got = [([sum(x[i] for i, r in enumerate(rows) if all(r[f] == sign for f, sign in rule.items())) for x in (pos, neg)]) for rule, _, _ in leaves]
    assert got == [[p, n] for _, p, n in leaves]
    assert special.loss(objective, [p for p, _ in got], [n for _, n in got], 2.0, 0.4) + 0.03 * len(got) == pytest.approx(want)


@pytest.mark.parametrize("objective", ["acc", "bacc", "wacc", "f1", "auc", "pauc"])
def test_losses_of_many_trees(objective):
    rng = np.random.default_rng(3)
    p, n = rng.integers(0, 6, (50, 4)), rng.integers(0, 6, (50, 4))
    p[:, 0], n[:, 0] = p[:, 0] + 1, n[:, 0] + 1
    got = states.losses(objective, p, n, 2.0, 0.3)
    for a, b, x in zip(p, n, got):
        on = a + b > 0
        assert x == pytest.approx(special.loss(objective, a[on], b[on], 2.0, 0.3))


@pytest.mark.parametrize("objective", ["f1", "auc"])
def test_proven_beyond_the_bound(spark, objective):
    """The same risk from the driver's search and from states, for limits on leaves, too."""
    rng = random.Random(3)
    rows = [(*(rng.randint(0, 1) for _ in range(5)), rng.randint(0, 3)) for _ in range(400)]
    df = spark.createDataFrame([(*r, int((r[2] or r[4]) and r[5] > 0) if rng.random() < 0.9 else 0) for r in rows], ", ".join([*[f"f{i} int" for i in range(5)], "z int", "y int"]))
    for more in ({}, {"max_leaves": 2}):
        near, far = (OptimalTree({"objective": objective, "regularization": 0.03, "local_cells": cells, **more}).fit(df) for cells in (2_000_000, 100))
        assert near.summary["proven"] and far.summary["proven"] and far.summary["risk"] == pytest.approx(near.summary["risk"])
        assert far.leaves() == near.leaves() and far.confusion(df, "y").count() > 0
