"""Many optimal trees by levels, and the bounds of splits beside the chosen ones."""

import itertools
import json
import random

import pytest

from sylvaframe.plans.estimator import OptimalTree


def table(spark, seed, m=4, n=120):
    rng = random.Random(seed)
    rows = [tuple(rng.randint(0, 1) for _ in range(m)) for _ in range(n)]
    rows = [(*r, int(sum(r[:3]) >= 2)) for r in rows]
    return rows, spark.createDataFrame(rows, ", ".join([*[f"f{i} int" for i in range(m)], "y int"]))


def every(rows, at, m):
    """(errors, leaves, tree) of all trees of at most four leaves over the rows."""
    ones = sum(rows[i][-1] for i in at)
    label = int(ones * 2 >= len(at))
    yield min(ones, len(at) - ones), 1, label
    for f in range(m):
        a, b = [i for i in at if rows[i][f]], [i for i in at if not rows[i][f]]
        if a and b:
            for (e1, l1, x), (e2, l2, y) in itertools.product(every(rows, a, m), every(rows, b, m)):
                if l1 + l2 <= 8:
                    yield e1 + e2, l1 + l2, (f, x, y)


def parts(rows, at, tree):
    """The leaves as sets of distinct rows."""
    if isinstance(tree, int):
        return frozenset({frozenset(rows[i][:-1] for i in at)})
    f, a, b = tree
    return parts(rows, [i for i in at if rows[i][f]], a) | parts(rows, [i for i in at if not rows[i][f]], b)


def form(node):
    if "prediction" in node:
        return int(node["prediction"])
    return int(node["feature"][1:]), form(node["true"]), form(node["false"])


@pytest.mark.parametrize("settings", [{"task_cells": 0}, {"task_cells": 16}, {"local_cells": 2_000_000}])
def test_all_optimal_trees(spark, settings):
    """All partitions into leaves that an optimal tree has, each once; fewer where fewer are wanted."""
    rows, df = table(spark, 1, 3)
    everyone, unit = range(len(rows)), 3 / len(rows)
    trees = [(e / len(rows) + unit * n, t) for e, n, t in every(rows, everyone, 3)]
    best = min(risk for risk, _ in trees)
    want = {parts(rows, everyone, t) for risk, t in trees if risk < best + 1e-9}
    for limit in (1000, 2):
        model = OptimalTree({"regularization": unit, "local_cells": 0, "model_limit": limit, **settings}).fit(df)
        got = [parts(rows, everyone, form(t.as_dict())) for t in model.trees]
        assert len(got) == len(set(got)) == min(limit, len(want)) and set(got) <= want


@pytest.mark.parametrize("cells", [0, 2_000_000])
def test_rivals(spark, tmp_path, cells):
    """The root's bounds by counting, and the chosen splits among all."""
    rows, df = table(spark, 2)
    OptimalTree({"regularization": 0.02, "local_cells": cells, "tree": f"file://{tmp_path}/tree"}).fit(df)
    found = [r.asDict() for r in spark.read.json(f"file://{tmp_path}/tree-rivals").collect()]
    paths = json.loads("\n".join(r["value"] for r in spark.read.text(f"file://{tmp_path}/tree").collect()))
    assert sum(r["chosen"] for r in found) == len(paths) - 1 and len({r["path"] for r in found}) == len(paths) - 1
    for r in found:
        if not r["path"]:
            f, upper = int(r["test"].split(" ")[0][1:]), 0.0
            for b in (0, 1):
                own = [x[-1] for x in rows if x[f] == b]
                upper += min(sum(own), len(own) - sum(own)) / len(rows) + 0.02
            assert r["upper"] == pytest.approx(upper) and r["lower"] <= r["upper"]
