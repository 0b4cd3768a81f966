"""The codex as tables against the codex on the driver, and beyond what a driver should hold."""

import pytest
from pyspark.sql import functions as F

from sylvaframe.operators import ordered, profile
from sylvaframe.operators.book import book
from sylvaframe.plans.estimator import OptimalTree


@pytest.mark.parametrize("policy", ["reference", "sql"])
def test_same_predicates_and_bits(spark, policy):
    rows = [(str(v) if v % 7 else None, f"c{v % 40}", float(v) / 3 if v % 11 else None, float("nan") if v == 50 else float(v % 45), v % 3, "x", "ab"[v % 2], v % 2) for v in range(-50, 100)]
    df = spark.createDataFrame(rows, "a string, b string, c double, d double, e int, f string, g string, y int").repartition(5)
    near, far = profile.codex(df, "y"), book(df, "y")
    assert len(far) == len(near) and far.classes == near.classes
    got = [(r.pos, r.col, r.relation) for r in far.frame().orderBy("pos").collect()]
    assert got == [(p.pos, p.col, p.relation) for p in near.predicates]
    few = far.predicates(list(range(len(near))))
    assert all(few[p.pos].reference == pytest.approx(p.reference) if p.relation == ">=" else few[p.pos].reference == p.reference for p in near.predicates)
    plain = df.select("a", "b", "c", "d", "e", *[p.column(policy).cast("int").alias(f"p{p.pos}") for p in near.predicates], F.monotonically_increasing_id().alias("k"))
    held = df.withColumn("k", F.monotonically_increasing_id())
    ranks = {r.k: r for r in far.encoded(held, ["k"], policy).collect()}
    for row in plain.collect():
        for i, (c, size) in enumerate(far.sizes.items()):
            rank = ranks[row.k][f"r{i}"]
            bits = [rank > at if far.is_ordered(c) else rank == at + 1 for at in range(size)]
            assert bits == [bool(row[f"p{far.first[c] + at}"]) for at in range(size)], (c, row)


def test_precision(spark):
    df = spark.range(1000).selectExpr("id", "id * 1.0e-7D as tiny", "id % 2 as y")
    near, far = profile.codex(df, "y", precision=1), book(df, "y", precision=1)
    assert {c: len(near.of(c)) for c in ("id", "tiny")} == far.sizes
    assert far.encoded(df, ["id"]).filter("id = 555").first().r0 == sum(p.reference <= 555 for p in near.of("id"))


def test_many_values(spark):
    """Two million thresholds; nothing of them comes to the driver."""
    df = spark.range(0, 2_000_000, 1, 8).selectExpr("id * 3 as x", "id % 2 as y")
    found = book(df, "y")
    assert found.sizes == {"x": 1_999_999} and (found.classes, len(found)) == (("0", "1"), 1_999_999)
    assert {p.reference for p in found.predicates([0, 1_000_000, 1_999_998]).values()} == {3, 3_000_003, 5_999_997}
    sums = found.encoded(df, ["x"]).agg(F.sum("r0").alias("r"), F.max(F.abs(F.col("r0") - F.expr("x div 3"))).alias("gap")).first()
    assert (sums.r, sums.gap) == (1_999_999_000_000, 0)


def test_ordered_over_ranges(spark):
    rows = [(k, v) for k in "abc" for v in range({"a": 1, "b": 400, "c": 7}[k])]
    df = spark.createDataFrame(rows, "k string, v int").repartition(6)
    spread = df.repartitionByRange(5, "k", "v").sortWithinPartitions("k", "v").withColumn(ordered.PART, F.spark_partition_id())
    assert spread.select(ordered.PART).distinct().count() == 5
    lag = {(r.k, r.v): r.prev_v for r in ordered.previous(spread, ["v"], ["v"], ["k"]).collect()}
    assert lag == {(k, v): v - 1 if v else None for k, v in rows}
    total = {(r.k, r.v): r.s for r in ordered.running(spread, ["v"], F.col("v"), "s", ["k"]).collect()}
    assert total == {(k, v): v * (v + 1) // 2 for k, v in rows}
    every = ordered.running(ordered.ranged(df, ["k", "v"]), ["k", "v"], F.lit(1), "n").collect()
    assert sorted(r.n for r in every) == list(range(1, 409)) and [r.n for r in sorted(every)] == list(range(1, 409))
    before = {(r.k, r.v): r.prev_v for r in ordered.previous(spread, ["k", "v"], ["v"]).collect()}
    assert before["b", 0] == 0 and before["a", 0] is None and before["c", 0] == 399


def test_fit_beyond_the_driver(spark):
    """More distinct values than the driver takes: the same tree, additive and special objectives alike."""
    df = spark.range(3000).selectExpr("id % 119 as x", "cast(id % 5 as string) as z", "case when (id % 119 > 50 and id % 5 <> 2) or id % 97 = 0 then 'a' else 'b' end as y")
    for more in ({}, {"objective": "f1", "max_leaves": 2}):
        near, far = (OptimalTree({"regularization": 0.03, "predicate_limit": limit, **more}).fit(df, "y") for limit in (100_000, 100))
        assert far.summary["proven"] and near.summary["proven"] and far.summary["predicates"] == near.summary["predicates"] == 122
        assert far.tree.objective() == pytest.approx(near.tree.objective()) and far.error(df, "y") == pytest.approx(near.error(df, "y"))


def test_resumed_level_by_level(spark, tmp_path):
    """Each call takes one level and starts after the last committed one; the end is that of a search in one go."""
    df = spark.range(400).selectExpr("id % 7 as x", "id % 5 as z", "case when (id % 7 > 3) <> (id % 5 > 1) and id % 11 <> 0 then 1 else 0 end as y")
    base = {"regularization": 0.01, "local_cells": 0, "task_cells": 0}
    whole = OptimalTree(base).fit(df, "y")
    seen = []
    for _ in range(12):
        part = OptimalTree({**base, "checkpoint": str(tmp_path), "level_limit": 1}).fit(df, "y")
        seen.append(part.iterations())
        if part.summary["proven"]:
            break
    assert seen == list(range(1, len(seen) + 1)) and len(seen) > 1
    assert part.summary["proven"] and part.tree.objective() == pytest.approx(whole.tree.objective())
    assert OptimalTree({**base, "checkpoint": str(tmp_path)}).fit(df, "y").tree.objective() == pytest.approx(whole.tree.objective())


def test_prices_beyond_63_bits(spark):
    """Balanced classes whose sizes share no factor: one denominator for all costs has more than 63 bits."""
    df = spark.range(9_000_045).selectExpr("case when id < 3000017 then 'a' when id < 6000016 then 'b' else 'c' end as y", "id % 1000 < 600 or id < 2900000 as f", "id % 7 = 0 or id > 6100000 as g")
    near, far = (OptimalTree({"balance": True, "local_cells": cells, "regularization": 0.01}).fit(df, "y") for cells in (2_000_000, 0))
    assert far.summary["proven"] and near.summary["upperbound"] == far.summary["upperbound"] and 0 < far.summary["upperbound"] < 0.68
