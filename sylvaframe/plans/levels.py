"""Exact search as DataFrames, level by level, for tables that compress to many groups.

State: the groups in chunks (see ``operators.captures``), and one row for each subproblem: its rule, size, leaf cost, bounds
and budget. A level takes the open subproblems a block at a time. One pass over the chunks and one shuffle, of an array of
sums for each subproblem and task, price all splits of all of them; where they are merged, splits whose bound can't beat the
subproblem's budget go, and each child is named by the size and hash sums of its groups, so equal subproblems meet. A
subproblem of at most ``small`` group-predicate cells is solved whole by the search of ``local`` in one executor task. A
child's budget is what its parent can still pay once the sibling has cost its lower bound; of several parents the largest
holds, and a subproblem that comes back with a larger budget is opened again. A step up aggregates children's values.

Between both steps, predicates of a subproblem are compared with each other where the settings ask for it: a second pass
counts the members that each two surviving predicates share, and their spans (how much a group's label can matter). Where
one's true side lies inside another's and its false side surely costs no more than the other's at least, the other one goes
(exchange); and a split's bound is at least another's less the spans of the members on which they differ (similar support).

Every level is written to the shared folder. With a folder of its own, the names of its tables are committed there too, and
a search goes on after the last committed level. The driver sees blocks of rules, and at the end the rows of the trees.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import captures
from ..operators.captures import Layout
from ..sources import LINKS
from ..store import cut
from .local import Node, OutOfTime, Problem, Search

#: Groups x predicates up to which a subproblem is solved in one task.
SMALL = 200_000
#: Surviving predicates from which on they are compared with each other (fewer save too little), and bytes of pair counts
#: that a task holds.
PAIRED, PAIR_BYTES = 9, 128 << 20
#: Open subproblems that come to the driver at once.
AT_ONCE = 8192


@dataclass
class Found:
    """Trees (the first is the answer), a lower bound, whether the search ended, and how it went: history has a row
    (iterations, time, lower bound, upper bound, subproblems, open ones, share explored, share solved) for each level."""

    trees: list[Node]
    lower: int
    done: bool
    levels: int = 0
    history: list[tuple] = field(default_factory=list)
    tasks: DataFrame | None = None
    edges: DataFrame | None = None


def written(node: Node) -> list:
    return [node.cost, node.label] if node.predicate < 0 else [node.cost, node.predicate, *map(written, node.children)]


def read(x: list) -> Node:
    return Node(x[0], x[1]) if len(x) == 2 else Node(x[0], predicate=x[1], children=(read(x[2]), read(x[3])))


def _column(values, layout: Layout) -> pa.Array:
    if layout.wide:
        return pa.array([Decimal(int(x)) for x in values], pa.decimal128(38, 0))
    return pa.array(np.asarray(values, np.int64))


def _lit(x: int, layout: Layout) -> Column:
    return F.lit(Decimal(x)).cast("decimal(38,0)") if layout.wide else F.lit(int(x)).cast("long")


@dataclass
class Splits:
    """What all splits of a subproblem cost; index 0: the side where the predicate is false."""

    size: np.ndarray
    label: np.ndarray
    leaf: np.ndarray
    lower: np.ndarray
    hashes: np.ndarray
    useful: np.ndarray  # both sides have members

    @classmethod
    def of(cls, sums: np.ndarray, layout: Layout) -> Splits:
        s = captures.sides(sums, layout)
        price = layout.prices(s.counts)
        leaf = price.min(axis=-1) + layout.unit
        label = layout.classes - 1 - price[..., ::-1].argmin(axis=-1)
        return cls(s.size, label, leaf, np.minimum(leaf, s.least + 2 * layout.unit), s.hashes, (s.size > 0).all(axis=0))

    def bounds(self, rule_list: bool) -> tuple[np.ndarray, np.ndarray]:
        """The least and the surely reached cost of each split."""
        if rule_list:
            return np.minimum(self.leaf[0] + self.lower[1], self.lower[0] + self.leaf[1]), self.leaf[0] + self.leaf[1]
        return self.lower[0] + self.lower[1], self.leaf[0] + self.leaf[1]


def _runs_lost(s: Splits, layout: Layout) -> np.ndarray:
    """Thresholds that a neighbour of their column makes needless. They ascend: the lower one's false side lies inside the
    higher one's."""
    lost = np.zeros(layout.predicates, bool)
    for first, size, ordered in zip(layout.first, layout.sizes, layout.ordered):
        own = first + np.flatnonzero(s.useful[first : first + size])
        if not ordered or len(own) < 2:
            continue
        a, b = own[:-1], own[1:]
        low = s.lower[0, a] >= s.leaf[0, b]
        high = (s.lower[1, b] >= s.leaf[1, a]) & ~low
        lost[a[low.astype(bool)]] = True
        lost[b[high.astype(bool)]] = True
    return lost


def _bits(ranks: np.ndarray, layout: Layout) -> np.ndarray:
    """[members, predicates] from the ranks [columns, members]."""
    out = [r[:, None] > np.arange(size) if ordered else r[:, None] == np.arange(1, size + 1) for r, size, ordered in zip(ranks, layout.sizes, layout.ordered)]
    return np.concatenate([*out, np.zeros((ranks.shape[1], 0), bool)], axis=1)


def _solver(tasks: list[dict], layout: Layout, models: int, options: dict):
    """Solves one subproblem, given as its members' ranks and counts, by the local search."""
    runs = np.repeat(np.where(layout.ordered, np.arange(len(layout.sizes)), -1), layout.sizes) if layout.sizes else np.zeros(0, int)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        task = tasks[int(rows["k"].iloc[0])]
        ranks = np.concatenate([np.frombuffer(r, np.int32).reshape(len(layout.sizes), -1) for r in rows["ranks"]], axis=1)
        counts = np.concatenate([np.frombuffer(c, np.int64).reshape(-1, layout.classes) for c in rows["counts"]])
        search = Search(Problem.priced(_bits(ranks, layout), layout.prices(counts), layout.unit, runs), **options)
        names = ["tid", "cost", "trees", "sure"]
        try:
            root = search.solve(np.arange(len(counts)), int(task["budget"]) + (models > 1))
        except (OutOfTime, RecursionError):
            return pd.DataFrame([(task["tid"], None, None, False)], columns=names)
        trees = [] if root is None else search.all_trees(models, root) if models > 1 else [root]
        return pd.DataFrame([(task["tid"], None if root is None else str(root.cost), json.dumps([written(t) for t in trees]), True)], columns=names)

    return solve


def _solved(chunks: DataFrame, tasks: list[dict], layout: Layout, models: int, options: dict) -> DataFrame:
    rules = [tuple(t["rule"]) for t in tasks]

    def members(batches):
        for chunk in captures.rows_of(batches, layout):
            for k, at in chunk.members(rules):
                if len(at):
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "ranks": [np.ascontiguousarray(chunk.ranks[:, at]).tobytes()], "counts": [chunk.counts[at].tobytes()]})

    rows = chunks.mapInArrow(members, "k int, ranks binary, counts binary")
    out = rows.groupBy("k").applyInPandas(_solver(tasks, layout, models, options), "tid string, cost string, trees string, sure boolean")
    return out.withColumn("cost", F.col("cost").cast(layout.kind))


def _edge_schema(layout: Layout) -> str:
    return f"tid string, feature int, bit int, child string, size long, label int, leaf {layout.kind}, lower {layout.kind}, budget {layout.kind}, room {layout.kind}, rule array<int>"


def _edges(task: dict, s: Splits, alive: np.ndarray, room, layout: Layout, rule_list: bool, look_ahead: bool):
    """A row for each side of each surviving split."""
    if not len(alive):
        return
    out: dict[str, list] = {c.split(" ")[0]: [] for c in _edge_schema(layout).split(", ") if " " in c}
    base = list(task["rule"])
    for f in alive.tolist():
        for b in (0, 1):
            other = (s.leaf if rule_list else s.lower)[1 - b, f]
            row = (task["tid"], f, b, captures.named(int(s.size[b, f]), s.hashes[b, f]), int(s.size[b, f]), int(s.label[b, f]), int(s.leaf[b, f]), int(s.lower[b, f]), int(room - other if look_ahead else s.leaf[b, f] + 1), int(room), [*base, f + 1 if b else -(f + 1)])
            for held, x in zip(out.values(), row):
                held.append(x)
    kinds = {"feature": pa.int32(), "bit": pa.int32(), "label": pa.int32(), "size": pa.int64(), "rule": pa.list_(pa.int32())}
    yield pa.RecordBatch.from_pydict({c: _column(x, layout) if c in ("leaf", "lower", "budget", "room") else pa.array(x, kinds.get(c, pa.string())) for c, x in out.items()})


@dataclass(frozen=True)
class Rules:
    """Which pruning rules hold."""

    rule_list: bool = False
    look_ahead: bool = True
    continuous: bool = True
    exchange: bool = True
    similar: bool = True
    more: int = 0  # 1 where ties are of interest, too

    def surviving(self, task: dict, s: Splits, layout: Layout, lb=None) -> tuple[np.ndarray, int]:
        """The splits that may win, and what a tree of the subproblem has to cost less than. lb: better bounds, if any."""
        own_lb, ub = s.bounds(self.rule_list)
        lb = own_lb if lb is None else lb
        on = s.useful.copy()
        if self.continuous and not self.rule_list and not self.more:
            on &= ~_runs_lost(s, layout)
        at = np.flatnonzero(on)
        if not len(at):
            return at, 0
        best = min(at.tolist(), key=lambda f: (int(ub[f]), f))
        own, budget = int(task["leaf"]), int(task["budget"])
        room = min(own, int(ub[best]), budget) if self.look_ahead else min(own, int(ub[best]))
        keep = lb[at] < room + self.more
        if int(ub[best]) < own:
            keep |= at == best
        return at[keep.astype(bool)], room


def _needless(chunks: DataFrame, tasks: list[dict], found: dict[str, pd.DataFrame], layout: Layout, rules: Rules) -> DataFrame:
    """(tid, feature): splits of the tasks that another one makes needless. found: for each task its surviving splits
    (feature, leaf0, leaf1, lower0, lower1, room), ascending. The split that surely costs least stays: the room is its cost."""
    paths = [tuple(t["rule"]) for t in tasks]
    alive = [found[t["tid"]]["feature"].to_numpy(int) for t in tasks]
    costs = [[[int(x) for x in found[t["tid"]][c]] for c in ("leaf0", "leaf1", "lower0", "lower1", "room")] for t in tasks]
    names = [t["tid"] for t in tasks]

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for chunk in captures.rows_of(batches, layout):
            price = layout.prices(chunk.counts)
            span = (price.max(axis=1) - price.min(axis=1)).astype(np.float64)
            for k, at in chunk.members(paths):
                if not len(at):
                    continue
                a = len(alive[k])
                own = sums.setdefault(k, np.zeros((2 * a + 1, a)))
                for i in range(0, len(at), 8192):
                    some = at[i : i + 8192]
                    x = np.stack([chunk.holds(f, some) for f in alive[k].tolist()], axis=1).astype(np.float64)
                    own[:a] += x.T @ x
                    own[a : 2 * a] += (x * span[some, None]).T @ x
                    own[2 * a] += span[some].sum()
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("k").to_pylist(), batch.column("sums")):
                x = np.frombuffer(raw.as_buffer()).reshape(-1, len(alive[k]))
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            a = len(alive[k])
            gone = np.zeros(a, bool)
            leaf0, leaf1, lower0, lower1, room = (np.array(c, object if layout.wide else np.int64) for c in costs[k])
            if rules.exchange:
                inside = x[:a] == np.diag(x[:a])[:, None]  # i's true side lies inside j's
                for i in range(a):
                    if not gone[i]:
                        bad = inside[i] & (leaf0[i] <= lower0).astype(bool)
                        bad[i] = False
                        gone |= bad
            if rules.similar:
                lb, span = lower0 + lower1, np.diag(x[a : 2 * a])
                apart = span[:, None] + span - 2 * x[a : 2 * a]
                apart = np.minimum(apart, x[2 * a, 0] - apart)
                # spans are floats: a little more than they can be wrong by
                apart = np.ceil(apart * (1 + 1e-9) + 1 + 1e-9 * x[2 * a, 0])
                wide = np.vectorize(int, otypes=[object])(apart)
                better = (lb.astype(object)[:, None] - wide).max(axis=0)
                gone |= (np.maximum(better, lb.astype(object)) >= room.astype(object)).astype(bool) & (lb < room).astype(bool)
            gone[int(np.argmin(leaf0 + leaf1))] = False
            if gone.any():
                lost = alive[k][gone]
                yield pa.RecordBatch.from_pydict({"tid": pa.array([names[k]] * len(lost)), "feature": pa.array(lost, pa.int32())})

    return chunks.mapInArrow(count, "k int, sums binary").repartition("k").mapInArrow(merge, "tid string, feature int")


def _priced(chunks: DataFrame, tasks: list[dict], layout: Layout, rules: Rules) -> DataFrame:
    """The edges of a block of subproblems."""

    def finish(k: int, sums: np.ndarray):
        s = Splits.of(sums, layout)
        alive, room = rules.surviving(tasks[k], s, layout)
        yield from _edges(tasks[k], s, alive, room, layout, rules.rule_list, rules.look_ahead)

    edges = captures.swept(chunks, [tuple(t["rule"]) for t in tasks], layout, finish, _edge_schema(layout))
    if rules.rule_list or rules.more or layout.predicates < PAIRED or not (rules.exchange or rules.similar):
        return edges
    edges = cut(edges, "priced")
    pair = lambda c, b: F.max(F.when(F.col("bit") == b, F.col(c)))
    wide = edges.groupBy("tid", "feature").agg(*[pair(c, b).alias(f"{c}{b}") for c in ("leaf", "lower") for b in (0, 1)], F.max("room").alias("room"))
    found = {t: x.sort_values("feature") for t, x in wide.toPandas().groupby("tid")}  # at most a block's sums
    held, lost, size = [], [], 0
    for t in tasks:
        a = len(found.get(t["tid"], ()))
        if a < PAIRED:
            continue
        if held and size + 16 * a * a > PAIR_BYTES:
            lost.append(_needless(chunks, held, found, layout, rules))
            held, size = [], 0
        held.append(t)
        size += 16 * a * a
    if held:
        lost.append(_needless(chunks, held, found, layout, rules))
    if not lost:
        return edges
    return edges.join(reduce(lambda a, b: a.union(b), lost), ["tid", "feature"], "left_anti").select(*edges.columns)


class Tables:
    """Where a search writes its tables. With a folder, each level's are committed by one line of text."""

    def __init__(self, spark, folder: str = ""):
        self.spark, self.folder = spark, folder
        self.paths: dict[str, list] = {}

    def keep(self, df: DataFrame, name: str, level: int) -> DataFrame:
        if not self.folder:
            return cut(df, name)
        path = f"{self.folder}/{name}-{level}"
        df.write.mode("overwrite").parquet(path)
        self.paths.setdefault(name, []).append([path, df.schema.json()])
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, level: int, **facts) -> None:
        if self.folder:
            line = json.dumps({"level": level, "paths": self.paths, **facts}, default=str)
            self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/levels")

    def committed(self) -> dict | None:
        """The last committed level's facts."""
        if not self.folder:
            return None
        try:
            lines = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.folder}/levels").collect()]  # one for each level
        except AnalysisException:
            return None
        if not lines:
            return None
        last = max(lines, key=lambda x: x["level"])
        self.paths = last["paths"]
        return last

    def of(self, name: str) -> list[DataFrame]:
        from pyspark.sql import types as T

        return [self.spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(p) for p, s in self.paths.get(name, [])]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def impurities(chunks: DataFrame, layout: Layout) -> list[tuple[float, int]]:
    """(gini impurity of both sides by their sizes, predicate) of every predicate that parts the groups, ascending."""

    def finish(_, sums: np.ndarray):
        s = captures.sides(sums, layout)
        n = s.counts.astype(np.float64)
        rows = np.maximum(n.sum(axis=-1), 1)
        impure = (rows - (n * n).sum(axis=-1) / rows).sum(axis=0)
        at = np.flatnonzero((s.size > 0).all(axis=0))
        yield pa.RecordBatch.from_pydict({"impure": pa.array(impure[at]), "feature": pa.array(at, pa.int32())})

    return sorted(map(tuple, captures.swept(chunks, [()], layout, finish, "impure double, feature int").collect()))


def search(chunks: DataFrame, layout: Layout, *, time_limit: float = 0, max_levels: int = 0, rules: Rules = Rules(), models: int = 1, upper: int | None = None, known: int | None = None, small: int = SMALL, folder: str = "", say=None) -> Found:
    """chunks: the groups, as ``captures.chunked`` gives them. max_levels: levels of this call, 0 for
    all; rules: the pruning rules; models: optimal trees wanted; upper: the largest cost of interest; known: a cost that
    some tree has; folder: where to commit levels, and from where to go on."""
    began, spark = time.monotonic(), chunks.sparkSession
    tables = Tables(spark, folder)
    if models > 1:
        rules = Rules(rules.rule_list, rules.look_ahead, False, False, False, 1)
    size, count, least, root = captures.summary(captures.totals(chunks, layout), layout)
    if not size:
        return Found([], 0, True)
    price = [int(x) for x in layout.prices(count.astype(object) if layout.wide else count)]
    leaf = min(price) + layout.unit
    label = max(c for c, x in enumerate(price) if x == min(price))
    first = {"tid": root, "size": size, "label": label, "leaf": leaf, "lower": min(leaf, least + 2 * layout.unit), "rule": []}
    top = leaf + 1 if upper is None else min(leaf, upper) + 1
    if known is not None and rules.look_ahead:
        top = min(top, known + 1)
    open_ = (F.col("lower") < F.least(F.col("leaf"), F.col("budget") + rules.more)) & (F.col("size") > 1)
    options = {"rule_list": rules.rule_list, "look_ahead": rules.look_ahead, "continuous_feature_exchange": rules.continuous and models == 1, "feature_exchange": rules.exchange and models == 1, "similar_support": rules.similar and models == 1, "time_limit": time_limit}
    history: list[tuple] = []
    resumed = tables.committed()
    if resumed:
        level, history = resumed["level"], [tuple(h) for h in resumed["history"]]
        all_tasks, all_edges, solved, fronts = tables.of("tasks"), tables.of("edges"), tables.of("solved"), tables.of("frontier")
        frontier, seen = fronts[-1], [f.select("tid", F.col("budget").alias("spent")) for f in fronts[:-1]]
    else:
        level = 0
        one = spark.createDataFrame([(root, size, label)], "tid string, size long, label int")
        one = one.select("*", _lit(first["leaf"], layout).alias("leaf"), _lit(first["lower"], layout).alias("lower"))
        all_tasks = [tables.keep(one, "tasks", 0)]
        frontier = tables.keep(one.select("*", _lit(top, layout).alias("budget"), F.array().cast("array<int>").alias("rule")).filter(open_), "frontier", 0)
        all_edges, solved, seen = [], [], []
    until, done = level + max_levels, True
    while True:
        n_open = frontier.count()
        n_tasks = sum(t.count() for t in all_tasks[-1:]) + (history[-1][4] if history else 0)
        if not resumed:
            history.append((level, time.monotonic() - began, float(first["lower"]), float(first["leaf"]), n_tasks, n_open, 1 - n_open / max(1, n_tasks), len(solved) / max(1, level)))
            tables.commit(level, history=history)
        resumed = None
        if say:
            say(f"level {level}: {n_tasks} subproblems, {n_open} open, {history[-1][1]:.1f} s")
        if not n_open:
            break
        if (max_levels and level >= until) or (time_limit and time.monotonic() - began > time_limit):
            done = False
            break
        level += 1
        seen.append(frontier.select("tid", F.col("budget").alias("spent")))
        ends, edges = [], []
        for tasks in _blocks(frontier, n_open, small // max(1, layout.predicates), layout.block):
            if tasks[0]["size"] * layout.predicates <= small:
                ends.append(_solved(chunks, tasks, layout, models, options))
            else:
                edges.append(_priced(chunks, tasks, layout, rules))
        if ends:
            solved.append(tables.keep(_all(ends), "solved", level))
        if not edges:
            frontier = tables.keep(frontier.limit(0), "frontier", level)
            all_tasks.append(tables.keep(all_tasks[0].limit(0), "tasks", level))
            continue
        here = tables.keep(_all(edges), "edges", level)
        all_edges.append(here)
        children = here.groupBy(F.col("child").alias("tid")).agg(F.first("size").alias("size"), F.first("label").alias("label"), F.first("leaf").alias("leaf"), F.first("lower").alias("lower"), F.max("budget").alias("budget"), F.min("rule").alias("rule"))
        named = _all([t.select("tid") for t in all_tasks])
        all_tasks.append(tables.keep(children.select("tid", "size", "label", "leaf", "lower").join(named, "tid", "left_anti"), "tasks", level))
        spent = _all(seen).groupBy(F.col("tid").alias("__t")).agg(F.max("spent").alias("spent"))
        new = children.filter(open_).join(spent, F.col("tid") == F.col("__t"), "left").filter(F.col("spent").isNull() | (F.col("spent") < F.col("budget")))
        frontier = tables.keep(new.select("tid", "size", "label", "leaf", "lower", "budget", "rule"), "frontier", level)
    tasks = cut(_all(all_tasks), "alltasks")
    own = F.col("leaf")
    if solved:
        ends = _all(solved)
        done = done and ends.filter("not sure").isEmpty()
        ends = ends.filter("cost is not null").groupBy("tid").agg(F.min(F.struct("cost", "trees")).alias("s"))
        tasks = cut(tasks.join(ends, "tid", "left").select(*tasks.columns, F.least("leaf", "s.cost").alias("cost"), F.when(F.col("s.cost") <= F.col("leaf"), F.col("s.trees")).alias("trees")), "settled")
        own = F.coalesce("cost", "leaf")
    else:
        tasks = tasks.withColumn("cost", F.col("leaf")).withColumn("trees", F.lit(None).cast("string"))
    value = tasks.select("tid", "leaf", own.alias("value"), F.lit(None).cast("int").alias("feature"))
    edges = None
    if all_edges:
        edges = cut(_all(all_edges).select("tid", "feature", "bit", "child").distinct(), "alledges")
        # of a rule list's split, the side that gains more by growing does so, and the other one is a leaf
        both = F.sum("cleaf") - F.max(F.col("cleaf") - F.col("value")) if rules.rule_list else F.sum("value")
        base = tasks.select("tid", "leaf", own.alias("own"))
        # a subproblem may be met again on a longer path, so chains can be longer than the levels: until nothing changes
        steps, before = 0, None
        while True:
            held = edges.join(value.select(F.col("tid").alias("child"), F.col("leaf").alias("cleaf"), "value"), "child").groupBy("tid", "feature").agg(both.cast(layout.kind).alias("v"), F.count("*").alias("c")).filter("c = 2")
            low = held.groupBy("tid").agg(F.min(F.struct("v", "feature")).alias("b"))
            better = F.col("b.v") < F.col("own")
            value = cut(base.join(low, "tid", "left").select("tid", "leaf", F.when(better, F.col("b.v")).otherwise(F.col("own")).alias("value"), F.when(better, F.col("b.feature")).alias("feature")), "value")
            steps += 1
            if steps >= level:
                now = value.agg(F.sum(F.col("value").cast("decimal(38,0)"))).first()[0]
                if now == before:
                    break
                before = now
    if models == 1:
        trees = _trees(root, tasks, value, edges, rules.rule_list)
    else:
        trees, wanted = [], models
        while len(trees) < models:
            some = _many(root, tasks, value, edges, rules.rule_list, wanted)
            trees = _distinct(chunks, some, layout)[:models]
            if len(some) < wanted:
                break
            wanted *= 4  # too many of them have the same leaves
    cost = trees[0].cost
    graph = tasks.join(value.select("tid", F.col("value").alias("upper"), "feature"), "tid").select("tid", "size", "leaf", F.when(F.lit(done), F.col("upper")).otherwise(F.col("lower")).alias("lower"), "upper", "feature")
    if upper is not None and cost > upper:
        trees = []
    if edges is None:
        edges = chunks.sparkSession.createDataFrame([], LINKS)
    return Found(trees, cost if done else int(first["lower"]), done, level, history, graph, edges)


def _blocks(frontier: DataFrame, n: int, tiny: int, size: int):
    """The n open subproblems in lists of bounded length; those of up to ``tiny`` groups are in lists of their own. Of more
    than ``AT_ONCE``, a partition at most is on the driver beside the lists."""
    rows = frontier.select("tid", "size", "leaf", "budget", "rule")
    held: tuple[list, list] = [], []
    for r in rows.collect() if n <= AT_ONCE else rows.toLocalIterator():
        own = held[r["size"] <= tiny]
        own.append({"tid": r["tid"], "size": r["size"], "leaf": int(r["leaf"]), "budget": int(r["budget"]), "rule": list(r["rule"])})
        if len(own) == (4096 if own is held[1] else size):
            yield own.copy()
            own.clear()
    yield from (own for own in held if own)


def rivals(chunks: DataFrame, layout: Layout, rules: list[tuple[int, ...]], rule_list: bool = False) -> DataFrame:
    """(node, predicate, lower, upper): the bounds of all splits that part the members of each rule, which is of signed
    predicate numbers from 1; node is the rule's place. The rules come in blocks, each one pass over the chunks."""

    def of(first: int, block: list) -> DataFrame:
        def finish(k: int, sums: np.ndarray):
            s = Splits.of(sums, layout)
            low, up = s.bounds(rule_list)
            at = np.flatnonzero(s.useful)
            yield pa.RecordBatch.from_pydict({"node": pa.array([first + k] * len(at), pa.int32()), "predicate": pa.array(at, pa.int32()), "lower": _column(low[at], layout), "upper": _column(up[at], layout)})

        return captures.swept(chunks, block, layout, finish, f"node int, predicate int, lower {layout.kind}, upper {layout.kind}")

    return _all([of(i, rules[i : i + layout.block]) for i in range(0, len(rules), layout.block)])


def _distinct(chunks: DataFrame, trees: list[Node], layout: Layout) -> list[Node]:
    """The first tree of each partition of the groups into leaves."""

    def leaves(node: Node, rule: tuple = ()):
        if node.predicate < 0:
            yield tuple(sorted(rule))
        else:
            for x, sign in zip(node.children, (1, -1)):
                yield from leaves(x, (*rule, sign * (node.predicate + 1)))

    rules = [list(leaves(t)) for t in trees]
    name = captures.names(chunks, sorted({r for own in rules for r in own}), layout)
    kept: dict = {}
    for tree, own in zip(trees, rules):
        kept.setdefault(frozenset(name[r] for r in own), tree)
    return list(kept.values())


def _many(root: str, tasks: DataFrame, value: DataFrame, edges: DataFrame | None, rule_list: bool, models: int) -> list[Node]:
    """Up to ``models`` optimal trees. Splits whose sides together cost what their subproblem does are found by joins, and
    followed downward from the root; then each subproblem's trees, as JSON and at most ``models`` of them, are put together
    from its children's, upward until nothing changes. The driver sees the root's."""
    text = lambda c: F.col(c).cast("string")
    leaf = F.concat(F.lit("["), text("leaf"), F.lit(","), text("label"), F.lit("]"))
    none = F.array().cast("array<string>")
    own = F.concat(F.when(F.col("leaf") == F.col("value"), F.array(leaf)).otherwise(none), F.coalesce(F.when(F.col("cost") == F.col("value"), F.from_json("trees", "array<string>")), none))
    nodes = cut(tasks.join(value.select("tid", "value"), "tid").select("tid", "value", "leaf", leaf.alias("shut"), F.slice(F.array_distinct(own), 1, models).alias("own")), "nodes")
    if edges is None:
        return [read(json.loads(x)) for x in nodes.filter(F.col("tid") == root).first()["own"]]
    side = lambda c, b: F.max(F.when(F.col("bit") == b, F.col(c))).alias(f"{c}{b}")
    below = edges.join(nodes.select(F.col("tid").alias("child"), F.col("value").alias("v"), "leaf", "shut"), "child")
    both = below.groupBy("tid", "feature").agg(*[side(c, b) for c in ("child", "v", "leaf", "shut") for b in (0, 1)], F.count("*").alias("sides")).filter("sides = 2")
    both = both.join(nodes.select("tid", "value"), "tid")
    way = lambda turn, yes, no, a, b: [F.lit(turn).alias("turn"), yes.alias("yes"), no.alias("no"), a.alias("a"), b.alias("b")]
    col, null = F.col, F.lit(None).cast("string")
    if rule_list:
        # one side is a leaf, the other one grows
        first = both.filter("leaf1 + v0 = value").select("tid", "value", "feature", *way(0, null, col("child0"), col("shut1"), null))
        ways = first.union(both.filter("leaf0 + v1 = value").select("tid", "value", "feature", *way(1, col("child1"), null, null, col("shut0"))))
    else:
        ways = both.filter("v0 + v1 = value").select("tid", "value", "feature", *way(0, col("child1"), col("child0"), null, null))
    ways = cut(ways, "ways")
    met = cut(nodes.filter(F.col("tid") == root).select("tid"), "met")
    found = [met]
    while not met.isEmpty():
        down = ways.join(met, "tid").select(F.explode(F.array("yes", "no")).alias("tid")).filter("tid is not null").distinct()
        met = cut(down.join(_all(found), "tid", "left_anti"), "met")
        found.append(met)
    reached = _all(found)
    ways = cut(ways.join(reached, "tid", "left_semi"), "ways")
    base = cut(nodes.join(reached, "tid", "left_semi").select("tid", "own"), "base")
    grown, before = base.select("tid", F.col("own").alias("trees")), None
    while True:
        sides = [grown.select(F.col("tid").alias(c), F.col("trees").alias(f"of_{c}")) for c in ("yes", "no")]
        rows = ways.join(sides[0], "yes", "left").join(sides[1], "no", "left")
        rows = rows.withColumn("x", F.coalesce("of_yes", F.array("a"))).withColumn("y", F.coalesce("of_no", F.array("b"))).filter("size(x) > 0 and size(y) > 0")
        # as many of the one side for each of the other as are surely enough
        rows = rows.withColumn("y", F.slice("y", F.lit(1), F.ceil(F.lit(models) / F.size("x")).cast("int")))
        start = F.concat(F.lit("["), text("value"), F.lit(","), text("feature"), F.lit(","))
        made = F.flatten(F.transform("x", lambda a: F.transform("y", lambda b: F.concat(F.col("start"), a, F.lit(","), b, F.lit("]")))))
        rows = rows.withColumn("start", start).select("tid", F.struct("feature", "turn", F.slice(made, 1, models).alias("made")).alias("w"))
        more = rows.groupBy("tid").agg(F.flatten(F.array_sort(F.collect_list("w"))["made"]).alias("more"))
        grown = cut(base.join(more, "tid", "left").select("tid", F.slice(F.array_distinct(F.concat("own", F.coalesce("more", none))), 1, models).alias("trees")), "trees")
        now = grown.agg(F.sum(F.xxhash64("tid", "trees").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    return [read(json.loads(x)) for x in grown.filter(F.col("tid") == root).first()["trees"]]


def _trees(root: str, tasks: DataFrame, value: DataFrame, edges: DataFrame | None, rule_list: bool) -> list[Node]:
    """The optimal tree. The rows it is made of come to the driver depth by depth, two jobs each; their number follows from
    its leaves."""
    rows: dict[str, dict] = {}
    splits: dict[str, dict[int, dict[int, str]]] = {}
    ask = [root]
    while ask:
        for r in tasks.join(value.select("tid", "value", "feature"), "tid").filter(F.col("tid").isin(ask)).collect():
            rows[r["tid"]] = r.asDict()
        below: set[str] = set()
        if edges is not None:
            own = edges.filter(F.col("tid").isin([t for t in ask if rows[t]["feature"] is not None] or [""]))
            own = own.join(value.select(F.col("tid"), F.col("feature").alias("chosen")), "tid").filter("feature = chosen").drop("chosen")
            for r in own.collect():
                splits.setdefault(r["tid"], {}).setdefault(r["feature"], {})[r["bit"]] = r["child"]
                below.add(r["child"])
        ask = sorted(below - set(rows))

    def leaf(t: str) -> Node:
        return Node(int(rows[t]["leaf"]), int(rows[t]["label"]))

    def grow(t: str):
        r = rows[t]
        if int(r["leaf"]) == int(r["value"]):
            yield leaf(t)
        if r["trees"] and int(r["cost"]) == int(r["value"]):
            for x in json.loads(r["trees"]):
                yield read(x)
        for f, pair in sorted(splits.get(t, {}).items()):
            if len(pair) < 2:
                continue
            yes, no = pair[1], pair[0]
            if rule_list:
                for shut, flip in ((yes, False), (no, True)):
                    one, rest = leaf(shut), no if not flip else yes
                    if one.cost + int(rows[rest]["value"]) == int(r["value"]):
                        for x in grow(rest):
                            yield Node(int(r["value"]), predicate=f, children=(x, one) if flip else (one, x))
            elif int(rows[yes]["value"]) + int(rows[no]["value"]) == int(r["value"]):
                for a in grow(yes):
                    for b in grow(no):
                        yield Node(int(r["value"]), predicate=f, children=(a, b))

    return [next(grow(root))]
