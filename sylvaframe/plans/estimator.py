"""Fitting: profile, encode, compress, search, and a model that scores as a projection."""

from __future__ import annotations

import hashlib
import json
import sys
import time
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..operators import book as tables
from ..operators import captures, costs, diagnosis, metrics
from ..operators.captures import Layout
from ..operators.encode import WORD, packed, ranks, ranks_of_words
from ..operators.profile import Codex, TooManyValues, codex
from . import levels, special, states
from .config import Config
from .local import Node, Problem, Search
from .tree import Leaf, Split, TreeModel


#: Groups x predicates, and seconds, of the search that gives the search by levels its first upper bound.
NARROW, NARROW_SECONDS = 20_000, 20.0


class OptimalTreeModel:
    """The fitted trees, of which the first scores, and how the search went."""

    def __init__(self, trees: list[TreeModel], book: Codex | None = None, summary: dict | None = None):
        self.trees, self.codex, self.summary = trees, book, summary or {}

    @property
    def tree(self) -> TreeModel:
        if not self.trees:
            raise ValueError("the fit returned no model")
        return self.trees[0]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.tree.transform(df)

    predict = transform

    def classify(self, spark, sample: dict) -> tuple[str, float]:
        """Prediction and confidence of one row."""
        row = self.transform(spark.createDataFrame([sample])).first()
        return row["prediction"], row["confidence"]

    def _scored(self, df: DataFrame, target: str, weight: str | None) -> DataFrame:
        kept = [F.col(weight).alias("__w")] if weight else []
        return df.select(F.col(target).cast("string").alias("__y"), self.tree.prediction().alias("__p"), *kept)

    def score(self, df: DataFrame, target: str, weight: str | None = None, balanced: bool = False) -> float:
        rows = self._scored(df, target, weight)
        if balanced:
            return metrics.balanced_accuracy(rows, "__y", "__p").first()[0]
        return metrics.accuracy(rows, "__y", "__p", weight and "__w").first()["accuracy"]

    def error(self, df: DataFrame, target: str, weight: str | None = None) -> float:
        return 1 - self.score(df, target, weight)

    def confusion(self, df: DataFrame, target: str, weight: str | None = None) -> DataFrame:
        return metrics.confusion(self._scored(df, target, weight), "__y", "__p", weight and "__w")

    def status(self) -> int:
        """0: the search closed and gave a model; 1: it did not."""
        return self.summary.get("status", 1)

    def iterations(self) -> int:
        return self.summary.get("iterations", 0)

    def size(self) -> int:
        """Subproblems or states that the search held."""
        return self.summary.get("size", 0)

    def time(self) -> float:
        return self.summary.get("time", 0.0)

    def confidence(self, df: DataFrame) -> DataFrame:
        return self.transform(df).select("confidence")

    def leaves(self) -> int:
        return self.tree.leaves()

    def nodes(self) -> int:
        return self.tree.nodes()

    def max_depth(self) -> int:
        return self.tree.maximum_depth()

    def latex(self) -> str:
        return self.tree.latex()

    def json(self) -> str:
        return json.dumps([t.nary() if self.summary.get("non_binary") else t.as_dict() for t in self.trees], indent=2, default=str)

    @classmethod
    def load(cls, text: str) -> OptimalTreeModel:
        return cls([TreeModel.of(text)])

    def __len__(self) -> int:
        return len(self.tree)

    def __str__(self) -> str:
        return str(self.tree)


class OptimalTree:
    """Finds the tree with the least loss plus regularization for each leaf."""

    def __init__(self, config: Config | dict | str | None = None):
        self.config = Config.of(config)

    def fit(self, df: DataFrame, target: str | None = None, columns: list[str] | None = None) -> OptimalTreeModel:
        """target: a column, by default the last one."""
        c, began = self.config, time.monotonic()
        target = target or df.columns[-1]
        try:
            book = codex(df, target, columns, c.precision_limit, c.predicate_limit)
        except TooManyValues:
            book = tables.book(df, target, columns, c.precision_limit)  # the same predicates as a table
        classes = list(book.classes)
        y = F.col(target).cast("string")
        y = F.array(*[F.when(F.coalesce(y == k, F.lit(False)), 1).otherwise(0).cast("long") for k in classes]).alias("y") if classes else F.array().cast("array<long>").alias("y")
        if isinstance(book, Codex):
            words = packed(book, c.null_policy, ranked=True)
            names = [f"w{k}" for k in range(len(words))]
            counted = df.withColumns(ranks(book, c.null_policy)).select(*words, y)
        else:
            names = [f"r{k}" for k in range(len(book.sizes))]
            counted = book.encoded(df, [y], c.null_policy)
        per = [F.sum(F.col("y")[k]).alias(f"n{k}") for k in range(len(classes))]
        groups = counted.groupBy(*names).agg(F.count("*").alias("n"), *per) if names else counted.agg(F.count("*").alias("n"), *per)
        groups = groups.persist()
        try:
            return self._search(df, groups, names, book, classes, target, began)
        finally:
            groups.unpersist()

    def _search(self, df, groups, names, book, classes, target, began) -> OptimalTreeModel:
        c = self.config
        totals = groups.agg(F.count("*").alias("g"), F.sum("n").alias("n"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(classes))]).first()
        n, g = totals["n"] or 0, totals["g"]
        if not n or not classes:
            return OptimalTreeModel([], book, {"size": 0, "proven": True})
        counts = [totals[f"n{k}"] for k in range(len(classes))]
        if c.objective:
            return self._special(groups, names, book, classes, n, began)
        cells = None
        if c.costs:
            full = costs.completed(sources.read_costs(df.sparkSession, c.costs, classes), classes)
            cells = {(r["pred"], r["truth"]): r["cost"] for r in full.collect()}
        table = costs.matrix(classes, counts if sum(counts) == n else [*counts], balance=c.balance, cells=cells)
        if not c.balance and cells is None:
            table = [[Fraction(0) if i == j else Fraction(1, n) for j in range(len(classes))] for i in range(len(classes))]
        penalty = Fraction(str(c.regularization))
        k = len(book)
        history: list[tuple] = []
        graph: tuple = ()
        local = g * max(k, 1) <= c.local_cells and isinstance(book, Codex)
        if local:
            rows = groups.collect()
            bits, at = _bits(rows, names, k)
            problem = Problem(bits, [[rows[i][f"n{j}"] for j in range(len(classes))] for i in at], table, penalty, _runs(book))
            search = Search(problem, look_ahead=c.look_ahead, similar_support=c.similar_support, feature_exchange=c.feature_exchange, continuous_feature_exchange=c.continuous_feature_exchange, cancellation=c.cancellation, rule_list=c.rule_list, time_limit=c.time_limit, tolerance=int(Fraction(str(c.uncertainty_tolerance)) * problem.scale))
            key = hashlib.sha256(repr((bits.tobytes(), problem.price.tolist(), problem.unit, c.rule_list)).encode()).hexdigest()
            if c.checkpoint:
                search.resume(sources.load_search(df.sparkSession, f"{c.checkpoint}/{key}"))
            cap = int(Fraction(str(c.upperbound)) * problem.scale) if c.upperbound else None
            root, lower, done = search.run(cap)
            nodes = [] if root is None or not c.model_limit else search.all_trees(c.model_limit, root) if c.model_limit > 1 and done else [root]
            scale, iterations, size = problem.scale, search.iterations, len(search.solved)
            history = search.history
            if c.checkpoint:
                sources.save_search(df.sparkSession, search.state(), f"{c.checkpoint}/{key}")
            if c.trace or c.diagnostics:
                tasks, links = search.graph()
                spark = df.sparkSession
                graph = (spark.createDataFrame(tasks, "tid string, size long, leaf long, lower long, upper long, feature int"), spark.createDataFrame(links, "tid string, feature int, bit int, child string"))
        else:
            from math import lcm

            # the search by levels is exact, so any uncertainty_tolerance holds
            scale = lcm(penalty.denominator, *[x.denominator for row in table for x in row])
            ranked, rank_names, count_names, layout = _ranked(groups, names, book, [[int(x * scale) for x in row] for row in table], int(penalty * scale), n)
            chunks = captures.chunked(ranked, rank_names, count_names, layout)
            cap = int(Fraction(str(c.upperbound)) * scale) if c.upperbound else None
            known = None
            if c.look_ahead and k:
                # the best tree over the predicates that part the classes best is one that all predicates allow
                few, own, chosen = _narrowed(groups, names, book, [f for _, f in levels.impurities(chunks, layout)], len(classes), NARROW)
                rows = few.collect()
                bits, at = _bits(rows, own, len(chosen))
                first = Search(Problem(bits, [[rows[i][f"n{j}"] for j in range(len(classes))] for i in at], table, penalty), rule_list=c.rule_list, time_limit=min(NARROW_SECONDS, c.time_limit or NARROW_SECONDS))
                tree, _, _ = first.run()
                known = None if tree is None else int(Fraction(tree.cost, first.p.scale) * scale)
            folder = ""
            if c.checkpoint:
                # the groups, their counts and the costs tell the search; its rules and what is wanted of it belong to it
                mark = groups.agg(F.sum(F.xxhash64(*names, *count_names).cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64(*count_names, *names)).alias("y")).first()
                asked = (str(mark["x"]), mark["y"], layout, c.rule_list, c.look_ahead, c.continuous_feature_exchange, c.feature_exchange, c.similar_support, c.model_limit, c.task_cells, cap, known)
                folder = f"{c.checkpoint}/{hashlib.sha256(repr(asked).encode()).hexdigest()}"
            rules = levels.Rules(c.rule_list, c.look_ahead, c.continuous_feature_exchange, c.feature_exchange, c.similar_support)
            found = levels.search(chunks, layout, time_limit=c.time_limit, rules=rules, models=max(1, c.model_limit), upper=cap, known=known, small=c.task_cells, folder=folder, max_levels=c.level_limit, say=_say if c.verbose else None)
            nodes = found.trees if c.model_limit else []
            root, lower, done, iterations = found.trees[0] if found.trees else None, found.lower, found.done, found.levels
            size, history, graph = int(found.history[-1][4]) if found.history else 0, found.history, (found.tasks, found.edges)
        models, counts_of = [], _leaf_losses(groups, names, book, table, classes)
        tests = _predicates(book, nodes)
        for node in nodes:
            models.append(TreeModel(counts_of(_to_tree(node, tests, classes, float(penalty), target)), c.null_policy))
        upper = float(Fraction(root.cost, scale)) if root else None
        summary = {"time": time.monotonic() - began, "iterations": iterations, "size": size, "groups": g, "predicates": k, "opened": iterations if local else sum(int(h[5]) for h in history), "lowerbound": float(Fraction(int(lower), scale)), "upperbound": upper, "proven": bool(done), "status": 0 if done and nodes else 1, "non_binary": c.non_binary}
        summary["history"] = [(i, t, float(lo) / scale, float(up) / scale, size, queue, a, b) for i, t, lo, up, size, queue, a, b in history]
        if c.verbose:
            _say(f"{iterations} iterations, {size} subproblems, {summary['time']:.1f} s, bounds {summary['lowerbound']} and {upper}")
        if graph and graph[0] is not None:
            tasks, links = graph
            if c.trace and links is not None:
                sources.write_graph(tasks, links, c.trace)
            if c.diagnostics and links is not None:
                summary["diagnosis"] = {"unresolved": diagnosis.unresolved(tasks, links).count(), "blocking": diagnosis.blocking(tasks, links).count()}
        if c.tree and models:
            sources.write_text(df.sparkSession, json.dumps(models[0].paths(), indent=2, default=str), c.tree)
            if k:
                self._rivals(groups, names, book, table, penalty, n, nodes[0]).write.mode("overwrite").json(f"{c.tree}-rivals")
        if c.model:
            sources.write_models(OptimalTreeModel(models, book, summary), df.sparkSession, c.model)
        if c.timing:
            sources.append_timing(df.sparkSession, summary["time"], c.timing)
        if c.profile:
            sources.write_profile(df.sparkSession, summary["history"], c.profile)
        return OptimalTreeModel(models, book, summary)

    def _rivals(self, groups, names, book, table, penalty, n, root: Node) -> DataFrame:
        """(path, predicate, test, chosen, lower, upper): the bounds of all splits of the inner nodes of the tree; the test is
        given where the codex isn't a table, or the split is the chosen one."""
        from math import lcm

        spark = groups.sparkSession
        scale = lcm(penalty.denominator, *[x.denominator for row in table for x in row])
        ranked, rank_names, count_names, layout = _ranked(groups, names, book, [[int(x * scale) for x in row] for row in table], int(penalty * scale), n)
        rules, chosen, open_ = [], [], [(root, ())]
        while open_:
            node, rule = open_.pop()
            if node.predicate >= 0:
                rules.append(rule)
                chosen.append(node.predicate)
                open_ += [(x, (*rule, sign * (node.predicate + 1))) for x, sign in zip(node.children, (1, -1))]
        tests = _predicates(book, [root])
        said = lambda f: f"{tests[f].col} {tests[f].relation} {tests[f].reference}"
        path = lambda rule: " and ".join(said(x - 1) if x > 0 else f"not {said(-x - 1)}" for x in rule)
        kinds = "node int, path string, chosen int"
        own = spark.createDataFrame([(i, path(r), f) for i, (r, f) in enumerate(zip(rules, chosen))], kinds)
        named = spark.createDataFrame([(f, said(f)) for f in (range(len(book)) if isinstance(book, Codex) else sorted(set(chosen)))], "predicate int, test string")
        if not rules:
            return own.select("path", F.lit(None).cast("int").alias("predicate"), F.lit(None).cast("string").alias("test"), F.lit(False).alias("chosen"), F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"))
        found = levels.rivals(captures.chunked(ranked, rank_names, count_names, layout), layout, rules, self.config.rule_list)
        share = lambda x: (F.col(x).cast("double") / F.lit(float(scale))).alias(x)
        return found.join(own, "node").join(named, "predicate", "left").select("path", "predicate", "test", (F.col("predicate") == F.col("chosen")).alias("chosen"), share("lower"), share("upper"))

    def _special(self, groups, names, book, classes, n, began) -> OptimalTreeModel:
        c = self.config
        if len(classes) != 2:
            raise ValueError("special objectives need two classes")
        k = len(book)
        g = groups.count()
        if g * max(k, 1) > c.local_cells or not isinstance(book, Codex):
            ranked, rank_names, count_names, layout = _ranked(groups, names, book, [[0, 1], [1, 0]], 0, n)
            chunks = captures.chunked(ranked, rank_names, count_names, layout)
            risk, leaves, done, size = states.search(chunks, layout, c.objective, c.regularization, w=c.w, theta=c.theta, time_limit=c.time_limit, max_leaves=c.max_leaves, max_depth=c.max_depth, say=_say if c.verbose else None)
            found = [(rule, None) for rule, _, _ in leaves]
            p, q = (np.array([leaf[i] for leaf in leaves], float) for i in (1, 2))
        else:
            rows = groups.collect()  # at most local_cells cells
            bits, at = _bits(rows, names, k)
            neg, pos = ([rows[i][f"n{j}"] for i in at] for j in (0, 1))
            log: list = []
            risk, found, done = special.search(bits, pos, neg, c.objective, c.regularization, w=c.w, theta=c.theta, time_limit=c.time_limit, max_leaves=c.max_leaves, max_depth=c.max_depth, priority=c.priority, iterations=c.iteration_limit, greedy=c.init_cart, log=log)
            size = log[-1][0] if log else 1
            if c.profile:
                sources.write_log(groups.sparkSession, log, c.profile)
            p = np.array([np.asarray(pos)[at].sum() for _, at in found], float)
            q = np.array([np.asarray(neg)[at].sum() for _, at in found], float)
        y = special.label(c.objective, c.w, p, q, p.sum(), q.sum())
        wrong = [float(b if z else a) / n for a, b, z in zip(p, q, y)]

        tests = book.predicates if isinstance(book, Codex) else book.predicates(sorted({f for rule, _ in found for f in rule}))

        def grow(some: list[int], used: frozenset):
            if len(some) == 1:
                i = some[0]
                return Leaf(classes[int(y[i])], wrong[i], c.regularization, book.target)
            f = next(f for f in found[some[0]][0] if f not in used and all(f in found[i][0] for i in some))
            t = tests[f]
            a, b = ([i for i in some if found[i][0][f] is sign] for sign in (True, False))
            return Split(t.col, t.relation, t.reference, grow(a, used | {f}), grow(b, used | {f}), t)

        tree = TreeModel(grow(list(range(len(found))), frozenset()), c.null_policy)
        return OptimalTreeModel([tree] if c.model_limit else [], book, {"time": time.monotonic() - began, "risk": risk, "proven": done, "groups": g, "predicates": k, "size": size, "status": 0 if done else 1, "non_binary": c.non_binary})


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _bits(rows: list, names: list[str], k: int) -> tuple[np.ndarray, list[int]]:
    """The rows' predicates in ascending order of their words, so that runs agree, and the order."""
    at = sorted(range(len(rows)), key=lambda i: [rows[i][n] for n in names])
    return np.array([[(rows[i][names[f // WORD]] >> (f % WORD)) & 1 for f in range(k)] for i in at], bool).reshape(len(rows), k), at


def _bit(names: list[str], book: Codex | tables.Book, f: int):
    """Whether a predicate holds, from the groups' words or ranks."""
    if isinstance(book, Codex):
        return F.shiftright(F.col(names[f // WORD]), f % WORD).bitwiseAND(F.lit(1).cast("long")) == 1
    i, c = next((i, c) for i, c in enumerate(book.sizes) if book.first[c] <= f < book.first[c] + book.sizes[c])
    at = f - book.first[c]
    return F.col(names[i]) > at if book.is_ordered(c) else F.col(names[i]) == at + 1


def _narrowed(groups: DataFrame, names: list[str], book: Codex | tables.Book, order: list[int], classes: int, cells: int):
    """For a first whole-tree search of tables with too many groups: the best predicates, as many as surely keep groups x
    predicates in bounds, and the groups of those alone. The best tree over them is an upper bound. order: best first."""
    counts = [f"n{j}" for j in range(classes)]
    size = 1
    while size < len(order) and (size + 1) << size + 1 <= cells:
        size += 1
    chosen = sorted(order[:size])  # fewer than a word holds
    word = sum((F.when(_bit(names, book, f), F.lit(1 << i)).otherwise(0).cast("long") for i, f in enumerate(chosen)), F.lit(0).cast("long")).alias("w0")
    return groups.select(word, "n", *counts).groupBy("w0").agg(*[F.sum(x).alias(x) for x in ["n", *counts]]), ["w0"], chosen


def _predicates(book: Codex | tables.Book, nodes: list[Node]):
    """What the trees' predicates are, by number."""
    if isinstance(book, Codex):
        return book.predicates
    used, open_ = set(), list(nodes)
    while open_:
        node = open_.pop()
        if node.predicate >= 0:
            used.add(node.predicate)
            open_ += node.children
    return book.predicates(sorted(used))


def _ranked(groups: DataFrame, names: list[str], book: Codex, cost: list[list[int]], unit: int, n: int):
    """The groups as ranks and counts, for searches over chunks: (groups, names of the ranks, names of the counts, layout)."""
    columns = ranks_of_words(book, names) if isinstance(book, Codex) else [(F.col(r), n, book.is_ordered(c)) for r, (c, n) in zip(names, book.sizes.items())]
    counts = [f"n{j}" for j in range(len(cost))]
    ranked = groups.select(*[r.alias(f"r{i}") for i, (r, _, _) in enumerate(columns)], *counts)
    return ranked, [f"r{i}" for i in range(len(columns))], counts, Layout.of([s for _, s, _ in columns], [o for _, _, o in columns], cost, unit, n)


def _runs(book: Codex) -> np.ndarray:
    columns = {col: k for k, col in enumerate(dict.fromkeys(p.col for p in book.predicates))}
    return np.array([columns[p.col] if p.relation == ">=" else -1 for p in book.predicates], int)


def _to_tree(node: Node, tests, classes: list[str], penalty: float, target: str):
    if node.predicate < 0:
        return Leaf(classes[node.label], 0.0, penalty, target)
    p = tests[node.predicate]
    return Split(p.col, p.relation, p.reference, *(_to_tree(x, tests, classes, penalty, target) for x in node.children), p)


def _leaf_losses(groups: DataFrame, names: list[str], book: Codex | tables.Book, table, classes: list[str]):
    """Fills the leaves' losses in: one aggregation over the groups by leaf."""
    from dataclasses import replace

    def fill(root):
        order: list = []

        def number(node):
            if isinstance(node, Leaf):
                order.append(node)
                return F.lit(len(order) - 1)
            yes = number(node.true)
            return F.when(_bit(names, book, node.predicate.pos), yes).otherwise(number(node.false))

        leaf = number(root)
        sums = {r["leaf"]: r for r in groups.groupBy(leaf.alias("leaf")).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(classes))]).collect()}
        at = iter(range(len(order)))

        def rebuild(node):
            if isinstance(node, Leaf):
                i = next(at)
                k = classes.index(node.prediction)
                lost = sum((table[k][j] * sums[i][f"n{j}"] for j in range(len(classes))), Fraction(0)) if i in sums else Fraction(0)
                return replace(node, loss=float(lost))
            yes = rebuild(node.true)
            return replace(node, true=yes, false=rebuild(node.false))

        return rebuild(root)

    return fill
