"""The search by levels against the local search and brute force, under every setting."""

import random
from fractions import Fraction

import numpy as np
import pytest
from test_search import ONE_HOT, brute

from sylvaframe.operators import captures
from sylvaframe.operators.captures import Layout
from sylvaframe.plans import levels
from sylvaframe.plans.estimator import OptimalTree, _runs
from sylvaframe.plans.local import Problem, Search
from sylvaframe.plans.tree import Leaf
from sylvaframe.sources import table_from_text


def random_table(seed, g=14, m=5, k=2):
    rng = random.Random(seed)
    rows = sorted({tuple(rng.randint(0, 1) for _ in range(m)) for _ in range(g)})
    return rows, [[rng.randint(0, 5) for _ in range(k)] for _ in rows]


def cost_of(tree, rows, price, at, unit, listed):
    """The cost of a tree, counted anew; every inner node's sides must be filled, and of a list's one a leaf."""
    if tree.predicate < 0:
        return sum(price[i][tree.label] for i in at) + unit
    yes, no = [i for i in at if rows[i][tree.predicate]], [i for i in at if not rows[i][tree.predicate]]
    assert yes and no and (not listed or min(c.predicate for c in tree.children) < 0)
    return sum(cost_of(c, rows, price, side, unit, listed) for c, side in zip(tree.children, (yes, no)))


def by_levels(spark, rows, counts, unit, small, listed=False, models=1, settings={}, cost=((0, 1), (1, 0))):
    """Each bit is a column of one category."""
    names, held = [f"r{i}" for i in range(len(rows[0]))], [f"n{j}" for j in range(len(counts[0]))]
    df = spark.createDataFrame([(*b, *c) for b, c in zip(rows, counts)], ", ".join([*[f"{x} int" for x in names], *[f"{x} long" for x in held]])).repartition(3)
    layout = Layout.of([1] * len(names), [False] * len(names), cost, unit, sum(map(sum, counts)))
    rules = levels.Rules(listed, settings.get("look_ahead", True), settings.get("continuous", True), settings.get("exchange", True), settings.get("similar", True))
    return levels.search(captures.chunked(df, names, held, layout), layout, small=small, rules=rules, models=models)


@pytest.mark.parametrize("seed, settings, small", [(1, {}, 0), (2, {"rule_list": True}, 0), (3, {"look_ahead": False}, 20), (4, {"models": 4}, 0), (5, {"rule_list": True, "models": 4}, 20), (6, {"continuous": False}, 20), (7, {"similar": False}, 0), (8, {"exchange": False}, 0)])
def test_levels_equal_brute_force(spark, monkeypatch, seed, settings, small):
    monkeypatch.setattr(levels, "PAIRED", 2)
    rows, counts = random_table(seed)
    n = sum(map(sum, counts))
    unit, listed, models = max(1, n // 20), settings.get("rule_list", False), settings.get("models", 1)
    price = [[c[1], c[0]] for c in counts]
    want = brute(rows, counts, [[0, 1], [1, 0]], unit, listed)
    found = by_levels(spark, rows, counts, unit, small, listed, models, settings)
    assert found.done and found.lower == want and all(cost_of(t, rows, price, range(len(rows)), unit, listed) == t.cost == want for t in found.trees)
    near = Search(Problem(np.array(rows), counts, [[Fraction(0), Fraction(1)], [Fraction(1), Fraction(0)]], Fraction(unit)), rule_list=listed)
    root, _, _ = near.run()
    assert root.cost == want
    trees = near.all_trees(models)
    assert all(cost_of(t, rows, price, range(len(rows)), unit, listed) == want for t in trees) and 1 <= len(found.trees) <= models


def test_thresholds_and_effort(spark):
    """Adjacent thresholds of two columns: the exchange rule keeps the optimum, and budgets keep the subproblems few."""
    rng = random.Random(9)
    text = "x,z,y\n" + "\n".join(f"{a},{b},{int(a > 3) ^ int(b > 1) if rng.random() < 0.8 else 1}" for a, b in ((rng.randint(0, 5), rng.randint(0, 2)) for _ in range(200)))
    df = table_from_text(spark, text)
    near = OptimalTree({"regularization": 0.02}).fit(df)
    seen = []
    for more in ({}, {"continuous_feature_exchange": False, "look_ahead": False}):
        far = OptimalTree({"regularization": 0.02, "local_cells": 0, "task_cells": 0, **more}).fit(df)
        assert far.summary["proven"] and far.tree.objective() == pytest.approx(near.tree.objective())
        seen.append(far.summary["opened"])
    assert seen[0] < seen[1] and seen[0] <= 2 * near.summary["opened"], (seen, near.summary["opened"])
    assert set(_runs(near.codex).tolist()) == {0, 1}


def is_list(node):
    return isinstance(node, Leaf) or ((isinstance(node.true, Leaf) or isinstance(node.false, Leaf)) and is_list(node.true) and is_list(node.false))


def test_rule_list_at_any_size(spark):
    """The best tree splits both sides (a, then b or c), so a rule list costs more."""
    rng = random.Random(3)
    rows = []
    for _ in range(160):
        a, b, c = (rng.randint(0, 1) for _ in range(3))
        rows.append((a, b, c, (b if a else c) ^ (rng.random() < 0.05)))
    df = spark.createDataFrame([(str(a), str(b), str(c), str(int(y))) for a, b, c, y in rows], "a string, b string, c string, y string")
    fits = {(rule, cells): OptimalTree({"regularization": 0.01, "rule_list": rule, "local_cells": cells}).fit(df, "y") for rule in (False, True) for cells in (0, 2_000_000)}
    upper = {k: round(m.summary["upperbound"], 9) for k, m in fits.items()}
    assert upper[False, 0] == upper[False, 2_000_000] < upper[True, 0] == upper[True, 2_000_000]
    assert not is_list(fits[False, 0].tree.root) and is_list(fits[True, 0].tree.root)
    lost = fits[True, 0].error(df, "y") + 0.01 * fits[True, 0].leaves()
    assert abs(lost - upper[True, 0]) < 1e-9


def test_settings_hold_at_any_size(spark):
    df = table_from_text(spark, ONE_HOT)
    for more in ({"rule_list": True, "model_limit": 3}, {"model_limit": 5}, {"upperbound": 0.1}):
        near, far = (OptimalTree({"regularization": 0.02, **more, **where}).fit(df) for where in ({}, {"local_cells": 0}))
        assert bool(near.trees) == bool(far.trees) and (not near.trees or near.tree.objective() == pytest.approx(far.tree.objective()))
        assert not near.trees or len(far.trees) > 1 or more.get("model_limit", 1) < 2
