"""Exact search over compressed groups on the driver, for tables that compress to few groups.

Subproblems are sets of groups, solved once each. All costs are integers: rationals are brought to one denominator, so
bounds close exactly. Of equal labels the highest class wins, of equal splits the first predicate.
"""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field
from fractions import Fraction
from math import lcm

import numpy as np


class OutOfTime(Exception):
    pass


@dataclass
class Problem:
    """bits [groups, predicates] (bool), counts [groups, classes]; costs [pred][truth] and the leaf penalty as fractions.
    runs: for each predicate, the number of its threshold run (predicates of one column, ascending), or -1."""

    bits: np.ndarray
    counts: np.ndarray
    costs: list
    penalty: Fraction
    runs: np.ndarray | None = None
    scale: int = 1
    unit: int = 0
    price: np.ndarray = field(default=None)
    least: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        self.bits = np.asarray(self.bits, bool)
        self.counts = np.asarray(self.counts, np.int64)
        self.scale = lcm(self.penalty.denominator, *[c.denominator for row in self.costs for c in row])
        cost = np.array([[int(c * self.scale) for c in row] for row in self.costs], object)
        total = int(self.counts.sum()) * int(max(abs(x) for x in cost.flat) if cost.size else 0)
        kind = np.int64 if total < 1 << 60 else object
        self.unit = int(self.penalty * self.scale)
        self.price = self.counts.astype(kind) @ cost.T.astype(kind)  # [groups, predicted class]
        self.least = self.price.min(axis=1) if len(self.price) else self.price.sum(axis=1)
        self.rows = self.counts.sum(axis=1)
        self.bits01 = self.bits.astype(kind)


    @classmethod
    def priced(cls, bits: np.ndarray, price: np.ndarray, unit: int, runs: np.ndarray | None = None) -> Problem:
        """From integer prices [groups, predicted class] and the leaf penalty in the same unit."""
        out = cls(bits, np.zeros((len(bits), price.shape[1]), np.int64), [[Fraction(0)] * price.shape[1]] * price.shape[1], Fraction(unit), runs)
        out.price, out.least, out.unit = price, price.min(axis=1), unit
        return out


@dataclass
class Node:
    """label for a leaf, else predicate and children (true, false)."""

    cost: int
    label: int = -1
    predicate: int = -1
    children: tuple = ()


class Search:
    def __init__(self, problem: Problem, *, look_ahead: bool = True, similar_support: bool = True, feature_exchange: bool = True, continuous_feature_exchange: bool = True, cancellation: bool = True, rule_list: bool = False, time_limit: float = 0, tolerance: int = 0):
        """tolerance: how far from the optimum, in the problem's integers, the root's tree may be."""
        self.p, self.tolerance, self.whole = problem, tolerance, np.arange(len(problem.bits)).tobytes()
        # the exchange and support rules compare free subtrees, which a rule list doesn't have
        free = not rule_list
        self.look_ahead, self.similar, self.exchange, self.continuous, self.rule_list = look_ahead, similar_support and free, feature_exchange and free, continuous_feature_exchange and free, rule_list
        self.deadline = time.monotonic() + time_limit if time_limit else None
        self.solved: dict[bytes, Node] = {}
        self.lower: dict[bytes, int] = {}
        self.iterations, self.pruned, self.began = 0, 0, time.monotonic()
        #: (iterations, time, lower bound, upper bound, subproblems, open ones, share open, share solved)
        self.history: list[tuple] = []
        span = problem.price.max(axis=1) - problem.price.min(axis=1) if len(problem.price) else np.zeros(0, np.int64)
        self.span = span

    def leaf(self, at: np.ndarray) -> Node:
        total = self.p.price[at].sum(axis=0)
        label = len(total) - 1 - int(np.argmin(total[::-1]))
        return Node(int(total[label]) + self.p.unit, label)

    def _splits(self, at: np.ndarray):
        """For each useful predicate: bounds of both children (leaf cost, lower bound), sorted by the split's bound."""
        x, price, least = self.p.bits01[at], self.p.price[at], self.p.least[at]
        size = x.sum(axis=0)
        yes_cost, yes_least = x.T @ price, x.T @ least
        all_cost, all_least = price.sum(axis=0), least.sum()
        useful = np.flatnonzero((size > 0) & (size < len(at)))
        unit = self.p.unit
        ub = np.stack([yes_cost[useful].min(axis=1), (all_cost - yes_cost[useful]).min(axis=1)]) + unit if len(useful) else np.zeros((2, 0), np.int64)
        lb = np.minimum(ub, np.stack([yes_least[useful], all_least - yes_least[useful]]) + 2 * unit) if len(useful) else ub
        return useful, lb, ub

    def _exchanged(self, at: np.ndarray, useful, lb, ub) -> np.ndarray:
        """Predicates that another one makes needless."""
        gone = np.zeros(len(useful), bool)
        if self.continuous and self.p.runs is not None:
            run = self.p.runs[useful]
            for i in range(len(useful) - 1):
                # thresholds ascend: the lower one's false side lies inside the higher one's
                if run[i] >= 0 and run[i] == run[i + 1]:
                    if lb[1, i] >= ub[1, i + 1]:
                        gone[i] = True
                    elif lb[0, i + 1] >= ub[0, i]:
                        gone[i + 1] = True
        if self.exchange and len(useful) <= 64:
            x = self.p.bits[np.ix_(at, useful)]
            for i in range(len(useful)):
                if gone[i]:
                    continue
                inside = ~(x[:, [i]] & ~x).any(axis=0)  # i's true side inside j's
                bad = inside & (ub[1, i] <= lb[1]) & ~gone
                bad[i] = False
                gone |= bad
        self.pruned += int(gone.sum())
        return gone

    def solve(self, at: np.ndarray, budget: int) -> Node | None:
        """The best tree of a subproblem if it costs less than the budget, else None (its lower bound is noted)."""
        key = at.tobytes()
        if key in self.solved:
            node = self.solved[key]
            return node if node.cost < budget else None
        if self.lower.get(key, -1) >= budget:
            return None
        if self.deadline and time.monotonic() > self.deadline:
            raise OutOfTime
        self.iterations += 1
        unit = self.p.unit
        best = self.leaf(at)
        if self.iterations & (self.iterations - 1) == 0:
            self.note()
        least = int(self.p.least[at].sum())
        floor = min(best.cost, least + 2 * unit)
        if floor >= best.cost or len(at) <= 1:
            self.solved[key] = best
            return best if best.cost < budget else None
        if floor >= budget:
            self.lower[key] = floor
            return None
        slack = self.tolerance if key == self.whole else 0
        useful, lb, ub = self._splits(at)
        total = lb.sum(axis=0)
        keep = ~self._exchanged(at, useful, lb, ub)
        order = [int(k) for k in np.lexsort((useful, total.astype(float))) if keep[k]]
        total = [int(t) for t in total]
        for pos, k in enumerate(order):
            limit = (min(best.cost, budget) if self.look_ahead else best.cost) - slack
            if total[k] >= limit:
                if self.similar:
                    continue
                break
            f = int(useful[k])
            on = self.p.bits[at, f]
            yes, no = at[on], at[~on]
            found = self._pair(yes, no, f, limit, [int(v) for v in lb[:, k]])
            if found is not None:
                best = found
                value = found.cost
            else:
                value = limit
            if self.similar and pos + 1 < len(order) and len(order) > 8:
                # a predicate that differs from f on rows worth d can't be better than f's value by more than d
                rest = order[pos + 1 :]
                other = self.p.bits[np.ix_(at, useful[rest])]
                gap = self.span[at]
                d = np.minimum(gap @ (other ^ on[:, None]), gap @ ~(other ^ on[:, None]))
                for r, x in zip(rest, d):
                    total[r] = max(total[r], value - int(x))
        limit = min(best.cost, budget) if self.look_ahead else best.cost
        if best.cost <= limit:
            self.solved[key] = best
        else:
            self.lower[key] = max(self.lower.get(key, 0), budget)
        return best if best.cost < budget else None

    def _pair(self, yes, no, f: int, limit: int, lb) -> Node | None:
        if self.rule_list:
            out = None
            for a, b, flip in ((yes, no, False), (no, yes, True)):
                one = self.leaf(a)
                two = self.solve(b, limit - one.cost)
                if two is not None:
                    out = Node(one.cost + two.cost, predicate=f, children=(two, one) if flip else (one, two))
                    limit = out.cost
            return out
        # the side with the larger bound first: it is the likelier to fail
        first, second = (yes, no) if lb[0] >= lb[1] else (no, yes)
        a = self.solve(first, limit - min(lb))
        if a is None:
            return None
        b = self.solve(second, limit - a.cost)
        if b is None:
            return None
        return Node(a.cost + b.cost, predicate=f, children=(a, b) if first is yes else (b, a))

    def note(self) -> None:
        """A row of the search's profile."""
        n = len(self.solved) + len(self.lower)
        whole = np.arange(len(self.p.bits))
        root = self.solved.get(self.whole)
        upper = root.cost if root else self.leaf(whole).cost
        lower = root.cost if root else min(upper, int(self.p.least.sum()) + 2 * self.p.unit)
        self.history.append((self.iterations, time.monotonic() - self.began, lower, upper, n, self.iterations - len(self.solved), 1 - len(self.solved) / max(1, self.iterations), len(self.solved) / max(1, self.iterations)))

    def run(self, upper: int | None = None):
        """(root or None, lower bound, done). The greedy tree stands in where time runs out."""
        at = np.arange(len(self.p.bits))
        if not len(at):
            return None, 0, True
        top = self.leaf(at).cost + 1 if upper is None else upper + 1
        try:
            root = self.solve(at, top)
            self.note()
            return root, max(0, root.cost - self.tolerance) if root else self.lower.get(at.tobytes(), top), True
        except OutOfTime:
            root = self.greedy(at)
            floor = min(root.cost, int(self.p.least.sum()) + 2 * self.p.unit)
            return root, floor, floor == root.cost
        except RecursionError:
            return self.greedy(at), int(self.p.least.sum()) + self.p.unit, False

    def greedy(self, at: np.ndarray) -> Node:
        """Splits by the best sum of leaf costs while that pays: an upper bound."""
        best = self.leaf(at)
        useful, _, ub = self._splits(at)
        if not len(useful):
            return best
        k = int(np.argmin(ub.sum(axis=0)))
        if ub[:, k].sum() >= best.cost:
            return best
        on = self.p.bits[at, useful[k]]
        yes, no = self.greedy(at[on]), self.greedy(at[~on])
        return Node(yes.cost + no.cost, predicate=int(useful[k]), children=(yes, no))

    def all_trees(self, limit: int, root: Node | None = None) -> list[Node]:
        """Up to limit trees of the optimal cost, which differ in their leaves' partition of the groups. root: the solved
        whole, if it is at hand."""
        at = np.arange(len(self.p.bits))
        out: list[Node] = []
        seen: set = set()

        def grow(at: np.ndarray, cost: int):
            one = self.leaf(at)
            if one.cost == cost:
                yield one, (at.tobytes(),)
            useful, lb, _ = self._splits(at)
            for k, f in enumerate(useful):
                if not self.rule_list and int(lb[:, k].sum()) > cost:
                    continue
                on = self.p.bits[at, f]
                yes, no = at[on], at[~on]
                if self.rule_list:
                    for shut, rest, flip in ((yes, no, False), (no, yes, True)):
                        one = self.leaf(shut)
                        two = self.solve(rest, cost - one.cost + 1)
                        if two and two.cost == cost - one.cost:
                            for t, parts in grow(rest, two.cost):
                                yield Node(cost, predicate=int(f), children=(t, one) if flip else (one, t)), (shut.tobytes(), *parts)
                    continue
                a = self.solve(yes, cost + 1)
                b = self.solve(no, cost + 1 - a.cost) if a else None
                if a and b and a.cost + b.cost == cost:
                    for ta, la in grow(yes, a.cost):
                        for tb, lb_ in grow(no, b.cost):
                            yield Node(cost, predicate=int(f), children=(ta, tb)), la + lb_

        if root is None:
            root, _, _ = self.run()
        if root is None:
            return out
        for tree, parts in grow(at, root.cost):
            sign = frozenset(parts)
            if sign not in seen:
                seen.add(sign)
                out.append(tree)
            if len(out) >= limit:
                break
        return out

    def state(self) -> list[tuple[bytes, int, int, int]]:
        """(groups, cost, label, predicate) of each solved subproblem, to go on from later."""
        return [(k, n.cost, n.label, n.predicate) for k, n in self.solved.items()]

    def resume(self, state: list[tuple[bytes, int, int, int]]) -> None:
        """Take over what an earlier search of the same problem has solved; larger subproblems stand on smaller ones."""
        for key, cost, label, predicate in sorted(state, key=lambda s: len(s[0])):
            if predicate < 0:
                self.solved[key] = Node(int(cost), int(label))
                continue
            at = np.frombuffer(key, np.int64)
            on = self.p.bits[at, predicate]
            children = []
            for side in (at[on], at[~on]):
                children.append(self.solved.get(side.tobytes()) or self.leaf(side))
            if self.rule_list:
                yes, no = (self.leaf(at[on]), self.leaf(at[~on]))
                children = [children[0], no] if children[0].cost + no.cost == cost else [yes, children[1]]
            if sum(c.cost for c in children) == cost:
                self.solved[key] = Node(int(cost), predicate=int(predicate), children=tuple(children))

    def graph(self) -> tuple[list[tuple], list[tuple]]:
        """Subproblems (tid, size, leaf, lower, upper, feature) and the links (tid, feature, bit, child) of their splits."""
        name = lambda at: hashlib.blake2b(at.tobytes(), digest_size=8).hexdigest()
        tasks, edges = [], []
        for key, node in self.solved.items():
            at = np.frombuffer(key, np.int64)
            tasks.append((name(at), len(at), int(self.leaf(at).cost), int(node.cost), int(node.cost), node.predicate if node.predicate >= 0 else None))
            if node.predicate >= 0:
                on = self.p.bits[at, node.predicate]
                edges += [(name(at), node.predicate, b, name(side)) for b, side in ((1, at[on]), (0, at[~on]))]
        for key, lower in self.lower.items():
            if key not in self.solved:
                at = np.frombuffer(key, np.int64)
                tasks.append((name(at), len(at), int(self.leaf(at).cost), int(lower), int(self.leaf(at).cost), None))
        return tasks, edges
