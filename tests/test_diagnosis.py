"""Diagnoses of a search graph, and the tolerance of a search."""

from fractions import Fraction

import numpy as np

from sylvaframe.operators import diagnosis
from sylvaframe.plans.local import Problem, Search


def test_graph(spark):
    tasks = spark.createDataFrame([("r", 10, 2, 6), ("a", 5, 1, 1), ("b", 5, 1, 3), ("c", 4, 4, 4), ("d", 9, 5, 5)], "tid string, leaf long, lower long, upper long")
    edges = spark.createDataFrame([("r", 0, "a"), ("r", 0, "b"), ("d", 1, "a"), ("d", 1, "c")], "tid string, feature int, child string")
    assert [r.tid for r in diagnosis.unresolved(tasks, edges).collect()] == ["b"]
    assert [tuple(r) for r in diagnosis.blocking(tasks, edges).collect()] == [("r", 0, "b")]
    assert [r.tid for r in diagnosis.unfounded(tasks, edges).collect()] == ["a"]


def test_tolerance():
    rng = np.random.default_rng(0)
    bits, counts = np.unique(rng.random((30, 6)) < 0.5, axis=0), None
    counts = rng.integers(0, 5, (len(bits), 2))
    n = int(counts.sum())
    costs = [[Fraction(int(i != j), n) for j in range(2)] for i in range(2)]
    p = Problem(bits, counts, costs, Fraction(1, 50))
    best = Search(p).run()[0].cost
    near, lower, done = Search(p, tolerance=p.scale // 10).run()
    assert done and lower <= best <= near.cost <= best + p.scale // 10
