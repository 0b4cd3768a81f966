"""Whole-tree search for special objectives as DataFrames, for tables that compress to many groups (labels 0/1).

A state is a row: the leaves of a tree, each with its name, rule, positives and negatives, and whether it is settled. The
tree itself is judged once, when the state is made; whatever else comes of the state has a leaf more. Its bound is therefore
the penalty of one leaf more and a floor of the loss, which lets all that is not settled fall apart into equivalence groups
and so depends on the settled leaves alone. A round takes the open states of the lowest bounds:

1. Their open leaves are priced by all predicates in passes over the chunks of groups (see ``operators.captures``),
   each leaf once in the whole search; splits that part a leaf alike count once.
2. Each of a state's open leaves is the next to be split once, the open leaves before it settled; the floor of that is found
   from the leaves' distributions of positive rates, once for each set of settled leaves. Every split gives a tree, judged in
   batches by numpy, and a state.
3. The best tree so far is the one incumbent. States whose bound can't beat it go, and of states with the same settled and
   the same open leaves, told by their digest, one stays, ever.

States, splits and distributions are tables in the shared folder; the driver sees one tree, the incumbent, and the rules of
a block of leaves. With enough time the result is proven, at any size.
"""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import captures
from ..operators.captures import Layout
from ..store import cut
from . import special

#: Open states that a round takes.
ROUND = 200_000
LEAF = "struct<id: string, p: bigint, n: bigint, size: bigint, settled: boolean, rule: array<int>>"
EPS = 1e-12


def losses(objective: str, p: np.ndarray, n: np.ndarray, w: float, theta: float) -> np.ndarray:
    """The loss of each row's leaves with p positives and n negatives [rows, leaves]; leaves of nobody count for nothing."""
    p, n = np.asarray(p, float), np.asarray(n, float)
    P, N = p.sum(axis=1), n.sum(axis=1)
    if objective not in ("auc", "pauc"):
        y = special.label(objective, w, p, n, P[:, None], N[:, None])
        return special._rates(objective, np.where(y == 1, n, 0).sum(axis=1), np.where(y == 1, 0, p).sum(axis=1), w, P, N)
    rate = np.divide(p, p + n, out=np.full(p.shape, -1.0), where=p + n > 0)
    order = np.argsort(-rate, axis=1, kind="stable")
    tp, fp = (np.cumsum(np.take_along_axis(x, order, 1), axis=1) / t[:, None] for x, t in ((p, P), (n, N)))
    x0, y0 = np.c_[np.zeros(len(p)), fp[:, :-1]], np.c_[np.zeros(len(p)), tp[:, :-1]]
    end = theta if objective == "pauc" else 1.0
    x1 = np.minimum(fp, end)
    y1 = y0 + (tp - y0) * np.divide(x1 - x0, fp - x0, out=np.ones(p.shape), where=fp > x0)
    return 1 - (np.maximum(x1 - np.minimum(x0, end), 0) * (y0 + y1) / 2).sum(axis=1)


def _leaf(id_: Column, p: Column, n: Column, size: Column, rule: Column) -> Column:
    return F.struct(id_.alias("id"), p.cast("long").alias("p"), n.cast("long").alias("n"), size.cast("long").alias("size"), F.lit(False).alias("settled"), rule.cast("array<int>").alias("rule"))


def _signed(states: DataFrame) -> DataFrame:
    """With the digest of settled and open leaves, which stand in the order of their names."""
    return states.withColumn("leaves", F.array_sort("leaves")).withColumn("sign", F.sha2(F.concat_ws(",", F.transform("leaves", lambda x: F.concat_ws(":", x["id"], x["settled"].cast("string")))), 256))


def _splits(chunks: DataFrame, leaves: list, layout: Layout) -> DataFrame:
    """(leaf, feature, and id, p, n, size of both sides) of a block of leaves."""
    names = [r["id"] for r in leaves]

    def finish(k: int, sums: np.ndarray):
        s = captures.sides(sums, layout)
        seen, out = set(), []
        for f in np.flatnonzero((s.size > 0).all(axis=0)).tolist():
            ids = [captures.named(int(s.size[b, f]), s.hashes[b, f]) for b in (0, 1)]
            if min(ids) not in seen:
                seen.add(min(ids))
                out.append((names[k], f, *ids, *(int(s.counts[b, f, c]) for b in (0, 1) for c in (1, 0)), *(int(s.size[b, f]) for b in (0, 1))))
        columns = ["leaf", "feature", "id0", "id1", "p0", "n0", "p1", "n1", "size0", "size1"]
        if out:
            yield pa.RecordBatch.from_pydict({c: pa.array([x[i] for x in out], pa.int32() if c == "feature" else None) for i, c in enumerate(columns)})

    schema = "leaf string, feature int, id0 string, id1 string, p0 long, n0 long, p1 long, n1 long, size0 long, size1 long"
    return captures.swept(chunks, [tuple(r["rule"]) for r in leaves], layout, finish, schema)


def _rates(chunks: DataFrame, leaves: list, layout: Layout) -> DataFrame:
    """(leaf, p, n) of each positive rate among a leaf's groups."""
    names, rules = [r["id"] for r in leaves], [tuple(r["rule"]) for r in leaves]

    def run(batches):
        for chunk in captures.rows_of(batches, layout):
            n, p = chunk.counts[:, 0], chunk.counts[:, 1]
            g = np.maximum(np.gcd(p, n), 1)
            for k, at in chunk.members(rules):
                key, inverse = np.unique(np.stack([p[at] // g[at], n[at] // g[at]], axis=1), axis=0, return_inverse=True)
                times = np.bincount(inverse.ravel(), g[at].astype(float), len(key)).astype(np.int64)
                if len(key):
                    yield pa.RecordBatch.from_pydict({"leaf": pa.array([names[k]] * len(key)), "a": pa.array(key[:, 0]), "b": pa.array(key[:, 1]), "times": pa.array(times)})

    rows = chunks.mapInArrow(run, "leaf string, a long, b long, times long")
    return rows.groupBy("leaf", "a", "b").agg(F.sum("times").alias("t")).select("leaf", (F.col("a") * F.col("t")).alias("p"), (F.col("b") * F.col("t")).alias("n"))


def search(chunks: DataFrame, layout: Layout, objective: str, penalty: float, *, w: float = 1.0, theta: float = 1.0, time_limit: float = 0, max_leaves: int = 0, max_depth: int = 0, say=None):
    """(risk, leaves as [(rule {predicate: sign}, positives, negatives)], proven, states). layout: of two classes, negatives
    first."""
    began, spark = time.monotonic(), chunks.sparkSession
    size, counts, _, root = captures.summary(captures.totals(chunks, layout), layout)
    N, P = int(counts[0]), int(counts[1])
    whole = [{"id": root, "rule": []}]
    dist = cut(_rates(chunks, whole, layout), "rates")
    overall = {(r["p"], r["n"]) for r in dist.collect()}  # reduced: one row for each rate

    def floors(settled: DataFrame, dists: DataFrame) -> DataFrame:
        """(key, floor) of distinct sets of settled leaves, given as (key, leaves [(id, p, n)])."""
        base = [(p, n) for p, n in sorted(overall)]
        place = {}
        for i, (p, n) in enumerate(base):
            g = int(np.gcd(p, n)) or 1
            place[p // g, n // g] = i
        start = np.array(base, float).reshape(-1, 2)

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            open_ = start.copy()
            for p, n in zip(rows["p"], rows["n"]):
                g = int(np.gcd(p, n)) or 1
                open_[place[p // g, n // g]] -= (p, n)
            fixed = [(x["p"], x["n"]) for x in rows["own"].iloc[0]]
            both = np.array([*fixed, *open_[open_.sum(axis=1) > 0]], float).reshape(-1, 2)
            return pd.DataFrame([(rows["key"].iloc[0], special.floor(objective, both[:, 0], both[:, 1], w, theta))], columns=["key", "floor"])

        parts = settled.select("key", "own", F.explode("own").alias("x")).select("key", "own", F.col("x.id").alias("leaf")).join(dists, "leaf")
        return parts.groupBy("key").applyInPandas(one, "key string, floor double")

    start = np.array(sorted(overall), float).reshape(-1, 2)
    top = float(special.floor(objective, start[:, 0], start[:, 1], w, theta))
    best, best_leaves = float(losses(objective, [[P]], [[N]], w, theta)[0]) + penalty, [{"p": P, "n": N, "rule": []}]

    @F.pandas_udf("double")
    def judged(p: pd.Series, n: pd.Series) -> pd.Series:
        out, length = np.zeros(len(p)), p.map(len).to_numpy()
        for m in np.unique(length):
            at = np.flatnonzero(length == m)
            out[at] = losses(objective, np.stack(p.to_numpy()[at]), np.stack(n.to_numpy()[at]), w, theta)
        return pd.Series(out)

    schema = f"leaves array<{LEAF}>, floor double"
    states = spark.createDataFrame([([(root, P, N, size, False, [])], top)], schema)
    # what no split may follow is settled from the start: one group, or a path of the greatest depth
    shut = lambda x: (x["size"] <= 1) | ((F.size(x["rule"]) >= max_depth) if max_depth else F.lit(False))
    frontier = cut(_signed(states).withColumn("bound", F.col("floor") + 2 * penalty), "states")
    seen, splits, dists, proven, rounds, total = [frontier.select("sign")], [], [], True, 0, 1
    priced: DataFrame | None = None
    while True:
        frontier = frontier.filter(F.col("bound") < best - EPS)
        n_open = frontier.count()
        if say:
            say(f"round {rounds}: {n_open} open states, best risk {best:.6f}, {time.monotonic() - began:.1f} s")
        if not n_open:
            break
        if time_limit and time.monotonic() - began > time_limit:
            proven = False
            break
        rounds += 1
        now, later = frontier, None
        if n_open > ROUND:
            # the lowest bounds first; equal ones go together
            edge = frontier.approxQuantile("bound", [ROUND / n_open], 0.01)[0]
            now, later = frontier.filter(F.col("bound") <= edge), frontier.filter(F.col("bound") > edge)
        # each open leaf is the next to be split once, those before it settled
        now = now.withColumn("open", F.filter("leaves", lambda x: ~x["settled"])).select("leaves", "open", "floor", F.posexplode("open").alias("i", "first"))
        now = now.withColumn("before", F.slice(F.col("open.id"), F.lit(1), F.col("i")))
        now = now.withColumn("leaves", F.transform("leaves", lambda x: F.when(F.array_contains("before", x["id"]), x.withField("settled", F.lit(True))).otherwise(x)))
        now = now.withColumn("own", F.transform(F.filter("leaves", lambda x: x["settled"]), lambda x: F.struct(x["id"], x["p"], x["n"]))).withColumn("key", F.concat_ws(",", "own.id"))
        now = cut(now.filter(~shut(F.col("first")) & (F.size("leaves") < max_leaves if max_leaves else F.lit(True))), "now")
        wanted = now.select("first").unionByName(now.select(F.explode(F.filter("leaves", lambda x: x["settled"])).alias("first"))).groupBy(F.col("first.id").alias("id")).agg(F.min("first.rule").alias("rule"))
        if priced is not None:
            wanted = wanted.join(priced, "id", "left_anti")
        for block in _leaves(wanted, layout.block):
            splits.append(cut(_splits(chunks, block, layout), "splits"))
            dists.append(cut(_rates(chunks, block, layout), "rates"))
            names = spark.createDataFrame([(r["id"],) for r in block], "id string")
            priced = names if priced is None else priced.union(names)
        if priced is None or not splits:
            break
        priced = cut(priced, "priced")
        found = floors(now.filter("i > 0").select("key", "own").dropDuplicates(["key"]), _all(dists)).withColumnRenamed("floor", "higher")
        now = now.join(found, "key", "left").withColumn("floor", F.when(F.col("i") > 0, F.col("higher")).otherwise(F.col("floor")))
        # a tree of it has a leaf more at least
        now = now.filter(F.col("floor") + penalty * (F.size("leaves") + 1) < best - EPS)
        rows = now.select(F.filter("leaves", lambda x: x["id"] != F.col("first.id")).alias("rest"), "first", "floor").join(_all(splits), F.col("first.id") == F.col("leaf"))
        sides = [_leaf(F.col(f"id{b}"), F.col(f"p{b}"), F.col(f"n{b}"), F.col(f"size{b}"), F.concat("first.rule", F.array(F.col("feature") + 1 if b else -(F.col("feature") + 1)))) for b in (0, 1)]
        rows = rows.withColumn("leaves", F.concat("rest", F.array(*sides)))
        rows = rows.withColumn("risk", judged(F.col("leaves.p"), F.col("leaves.n")) + penalty * F.size("leaves"))
        rows = _signed(rows.select("leaves", "floor", "risk")).withColumn("bound", F.col("floor") + penalty * (F.size("leaves") + 1))
        # a tree that could win, or a state from which one could come
        made = cut(rows.filter((F.col("risk") < best - EPS) | (F.col("bound") < best - EPS)), "made")
        low = made.orderBy("risk", "sign").first()
        if low is not None and low["risk"] < best - EPS:
            best, best_leaves = low["risk"], [x.asDict() for x in low["leaves"]]
        new = made.select("leaves", "sign", "floor", "bound").filter(F.col("bound") < best - EPS).dropDuplicates(["sign"])
        if not max_depth:
            new = new.join(_all(seen), "sign", "left_anti")
        frontier = cut(new.unionByName(later.select(*new.columns)) if later is not None else new, "states")
        seen.append(cut(new.select("sign"), "seen") if later is not None else frontier.select("sign"))
        total += frontier.count()
    rules = [({abs(x) - 1: x > 0 for x in leaf["rule"]}, leaf["p"], leaf["n"]) for leaf in best_leaves]
    return best, rules, proven, total


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _leaves(wanted: DataFrame, size: int):
    """Leaves in lists of bounded length; a partition of them at most is on the driver beside the list."""
    held = []
    for r in wanted.toLocalIterator():
        held.append({"id": r["id"], "rule": list(r["rule"])})
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
