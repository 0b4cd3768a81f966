"""Search against known optima and against brute force."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from sylvaframe.plans import special
from sylvaframe.plans.config import Config
from sylvaframe.plans.estimator import OptimalTree
from sylvaframe.plans.local import Problem, Search
from sylvaframe.sources import parse_costs, table_from_text

ONE_HOT = "f1,f2,f3,f4,f5,l\n" + "\n".join(["1,0,0,0,0,TFF", "1,0,0,0,0,TFF", "0,1,0,0,0,FTF", "0,1,0,0,0,FTF", "0,0,1,0,0,FFT", "0,0,1,0,0,FFT", "0,0,0,1,0,FTT", "0,0,0,1,0,FTT", "0,0,0,0,1,FTF", "0,0,0,0,1,FTT"])
CUBE = "b0,b1,b2,b3,s\n" + "\n".join(",".join([*bits, "v" + "".join(bits)]) for bits in itertools.product("01", repeat=4))

#: One column of each kind: the same value, nulls in several spellings, two values, few and signed integers, decimals, text.
KINDS = [
    ("x", "null", "yes", "1", "alpha", "0", "0.0"),
    ("x", "notnull", "no", "2", "beta", "1", "0.123456789"),
    ("x", "nontrivial", "yes", "3", "gamma", "-2", "-999999.9999999"),
    ("x", "", "no", "4", "delta", "3", "192875.1024875"),
    ("x", "NA", "yes", "1", "epsilon", "-4", "0"),
    ("x", "Null", "no", "2", "zeta", "5", "918273645.564738291"),
    ("x", "NaN", "yes", "3", "eta", "6", "1121121121211.3"),
]
SEQUENCES = "redundant,optional,bin,enum,str,int,float,path\n" + "\n".join(",".join([*r, "".join(r)]) for r in KINDS)
#: The class of each combination of four bits, in their order.
SMALL = "f0,f1,f2,f3,c\n" + "\n".join(",".join([*bits, c]) for bits, c in zip(itertools.product("01", repeat=4), "1011011011011011"))


def brute(bits, counts, costs, penalty, rule_list=False):
    memo = {}
    k = len(costs)

    def leaf(rows):
        return min(sum(costs[i][j] * counts[r][j] for r in rows for j in range(k)) for i in range(k)) + penalty

    def go(rows):
        if rows not in memo:
            best = leaf(rows)
            for f in range(len(bits[0])):
                a, b = tuple(r for r in rows if bits[r][f]), tuple(r for r in rows if not bits[r][f])
                if a and b:
                    best = min(best, min(leaf(a) + go(b), go(a) + leaf(b)) if rule_list else go(a) + go(b))
            memo[rows] = best
        return memo[rows]

    return go(tuple(range(len(bits))))


def tables(seed, n=40):
    rng = random.Random(seed)
    for _ in range(n):
        k, g, m = rng.randint(2, 3), rng.randint(2, 9), rng.randint(1, 5)
        numeric = rng.random() < 0.5
        rows = sorted({tuple(int(v >= t) for t in range(1, m + 1)) if numeric else tuple(rng.randint(0, 1) for _ in range(m)) for v in [rng.randint(0, m) for _ in range(g)]})
        counts = [[rng.randint(0, 4) for _ in range(k)] for _ in rows]
        if sum(map(sum, counts)):
            yield rows, counts, k, numeric


@pytest.mark.parametrize("rule_list", [False, True])
@pytest.mark.parametrize("prunes", [True, False])
def test_random_tables(rule_list, prunes):
    for rows, counts, k, numeric in tables(3):
        n = sum(map(sum, counts))
        costs = [[Fraction(int(i != j), n) for j in range(k)] for i in range(k)]
        for penalty in (Fraction(0), Fraction(1, 20), Fraction(1, 3)):
            p = Problem(np.array(rows), counts, costs, penalty, np.zeros(len(rows[0]), int) if numeric else None)
            s = Search(p, rule_list=rule_list, look_ahead=prunes, similar_support=prunes, feature_exchange=prunes, continuous_feature_exchange=prunes)
            root, lower, done = s.run()
            assert done and Fraction(root.cost, p.scale) == brute(rows, counts, costs, penalty, rule_list) and lower == root.cost


@pytest.mark.parametrize("text, objective, leaves", [(ONE_HOT, 0.30, 4), (CUBE, 0.80, 16), (SEQUENCES, 0.35, 7)])
def test_known_optima(spark, text, objective, leaves):
    df = table_from_text(spark, text)
    model = OptimalTree({"regularization": 0.05}).fit(df)
    assert model.tree.objective() == pytest.approx(objective) and model.leaves() == leaves and model.summary["proven"]
    assert model.error(df, df.columns[-1]) == pytest.approx(model.tree.loss())


def test_small_table(spark):
    model = OptimalTree().fit(table_from_text(spark, SMALL))
    assert model.tree.objective() == pytest.approx(0.3625) and model.leaves() == 1 and model.status() == 0 and model.iterations() >= 1 and model.time() > 0 and model.size() >= 1


def test_codex_of_kinds(spark):
    book = OptimalTree().fit(table_from_text(spark, SEQUENCES)).codex
    assert len(book) == 24 and [(p.relation, p.reference) for p in book.of("optional")] == [("==", "nontrivial"), ("==", "notnull")]
    assert not book.of("redundant") and len(book.of("str")) == 7 and book.of("int")[0].reference == -2


def test_many_thresholds_are_packed_by_rank(spark):
    """Columns of many predicates give the same bits by rank as by one test each."""
    from sylvaframe.operators import encode, profile

    rows = [(str(v) if v % 7 else None, f"c{v % 40}", float(v) / 3 if v % 11 else None, float("nan") if v == 50 else float(v % 45), v % 2) for v in range(-50, 100)]
    df = spark.createDataFrame(rows, "a string, b string, c double, d double, y int")
    book = profile.codex(df, "y")
    assert {len(book.of(c)) > encode.TESTED for c in "abcd"} == {True}
    for policy in ("reference", "sql"):
        packed = df.withColumns(encode.ranks(book, policy)).select(*encode.packed(book, policy, ranked=True)).collect()
        plain = df.select(*[p.column(policy).cast("int").alias(f"p{p.pos}") for p in book.predicates]).collect()
        for x, y in zip(packed, plain):
            assert [(x[p.pos // encode.WORD] >> p.pos % encode.WORD) & 1 for p in book.predicates] == list(y)


def test_codex_is_counted_first(spark):
    from sylvaframe.operators import profile

    df = spark.range(1000).selectExpr("id", "id * 1.0e-7D as tiny", "id % 2 as y")
    with pytest.raises(ValueError, match="precision_limit"):
        profile.codex(df, "y", limit=100)
    few = profile.codex(df, "y", precision=1, limit=100)
    assert {p.type for p in few.of("tiny")} == {"Rational"} and 10 < len(few.of("id")) < 40


def test_levels_equal_local(spark):
    df = table_from_text(spark, ONE_HOT)
    far = OptimalTree({"regularization": 0.02, "local_cells": 0}).fit(df)
    near = OptimalTree({"regularization": 0.02}).fit(df)
    assert far.summary["proven"] and far.tree.objective() == pytest.approx(near.tree.objective())


def test_limits_and_costs(spark):
    df = table_from_text(spark, ONE_HOT)
    assert OptimalTree({"model_limit": 0}).fit(df).trees == []
    many = OptimalTree({"model_limit": 5}).fit(df)
    assert len({t.signature() for t in many.trees}) == len(many.trees) > 1
    assert OptimalTree({"upperbound": 0.1}).fit(df).trees == []
    assert OptimalTree({"balance": True}).fit(df).tree.objective() > 0
    assert OptimalTree({"regularization": 1}).fit(df).leaves() == 1
    cells = {(r.pred, r.truth): r.cost for r in parse_costs(spark, "a,b\n0,0.01\n0.02,0\n").collect()}
    assert cells == {("a", "a"): 0.0, ("a", "b"): 0.01, ("b", "a"): 0.02, ("b", "b"): 0.0}
    vector = {(r.pred, r.truth): r.cost for r in parse_costs(spark, "a,b\n3,4\n").collect()}
    assert vector == {("a", "a"): 0.0, ("b", "a"): 3.0, ("a", "b"): 4.0, ("b", "b"): 0.0}


def test_degenerate_tables(spark):
    one = spark.createDataFrame([("x", "a")], "f string, y string")
    assert OptimalTree().fit(one).leaves() == 1
    empty = spark.createDataFrame([], "f string, y string")
    assert OptimalTree().fit(empty).trees == []
    nulls = spark.createDataFrame([(None, None), ("x", "a"), ("z", "b"), ("w", None)], "f string, y string")
    assert OptimalTree().fit(nulls).summary["proven"]


def test_config():
    with pytest.raises(ValueError):
        Config.of({"regularisation": 1})
    with pytest.raises(ValueError):
        Config.of({"objective": "best"})
    assert Config.of('{"regularization": 0.1}').regularization == 0.1


@pytest.mark.parametrize("objective", ["acc", "bacc", "wacc", "f1", "auc", "pauc"])
def test_special(objective):
    rng = random.Random(5)
    for _ in range(12):
        m = rng.randint(1, 3)
        rows = sorted({tuple(rng.randint(0, 1) for _ in range(m)) for _ in range(6)})
        pos, neg = [rng.randint(0, 4) for _ in rows], [rng.randint(1, 4) for _ in rows]
        if not sum(pos):
            continue

        def partitions(at):
            yield [at]
            for f in range(m):
                a, b = [i for i in at if rows[i][f]], [i for i in at if not rows[i][f]]
                if a and b:
                    for x in partitions(a):
                        for y in partitions(b):
                            yield x + y

        want = min(special.loss(objective, [sum(pos[i] for i in x) for x in p], [sum(neg[i] for i in x) for x in p], 2.0, 0.4) + 0.03 * len(p) for p in partitions(list(range(len(rows)))))
        got, _, done = special.search(np.array(rows), pos, neg, objective, 0.03, w=2.0, theta=0.4)
        assert done and got == pytest.approx(want)


def test_single_leaf_auc():
    assert special.loss("auc", [3], [4]) == pytest.approx(0.5)


def test_log_of_a_special_search(spark, tmp_path):
    """A row for each better tree, the last with the risk of the result."""
    df = spark.range(60).selectExpr("id % 2 as a", "id % 3 as b", "case when id % 2 = 1 or id % 3 = 0 then 1 else 0 end as y")
    model = OptimalTree({"objective": "f1", "regularization": 0.02, "profile": str(tmp_path / "log")}).fit(df, "y")
    rows = spark.read.csv(str(tmp_path / "log"), header=True, sep=";", inferSchema=True).orderBy("state").collect()
    assert rows and rows[-1].objective == pytest.approx(model.summary["risk"]) and rows[-1].leaves == model.leaves()
