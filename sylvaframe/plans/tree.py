"""A decision tree as data: compiled to CASE expressions, folded to rules, written as JSON, LaTeX or pseudocode."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELATIONS = ("==", ">=", "<=", ">", "<")


@dataclass(frozen=True)
class Leaf:
    prediction: object
    loss: float
    complexity: float
    name: str = "class"


@dataclass(frozen=True)
class Split:
    """A test of a source column; rows for which it holds go to ``true``."""

    feature: str
    relation: str
    reference: object
    true: object
    false: object
    predicate: object = None

    def condition(self, policy: str = "reference") -> Column:
        if self.predicate is not None:
            return self.predicate.column(policy)
        c, r = F.col(self.feature), self.reference
        if self.relation == "==":
            return F.coalesce(c.cast("string") == F.lit(str(r)), F.lit(False))
        v = F.coalesce(c.try_cast("double"), F.lit(0.0))
        return {">=": v >= r, "<=": v <= r, ">": v > r, "<": v < r}[self.relation]

    @property
    def test(self) -> str:
        return f"{self.feature} {self.relation} {self.reference}"


def _typed(x):
    """A JSON literal: int, else float, else text."""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return x
    for kind in (int, float):
        try:
            return kind(x)
        except (TypeError, ValueError):
            pass
    return x


def leaves(node) -> list[tuple[list[tuple[Split, bool]], Leaf]]:
    """(path, leaf) of every leaf, true branches first."""
    if isinstance(node, Leaf):
        return [([], node)]
    return [([(node, side), *path], leaf) for side, child in ((True, node.true), (False, node.false)) for path, leaf in leaves(child)]


class TreeModel:
    """A fitted tree. Scoring is one projection of built-in expressions."""

    def __init__(self, root, policy: str = "reference"):
        self.root, self.policy = root, policy

    # shape

    def leaves(self) -> int:
        return len(leaves(self.root))

    def nodes(self) -> int:
        return 2 * self.leaves() - 1

    def maximum_depth(self) -> int:
        return max(len(path) for path, _ in leaves(self.root)) + 1

    def loss(self) -> float:
        return sum(leaf.loss for _, leaf in leaves(self.root))

    def complexity(self) -> float:
        return sum(leaf.complexity for _, leaf in leaves(self.root))

    def objective(self) -> float:
        return self.loss() + self.complexity()

    def features(self) -> set[str]:
        return {s.feature for path, _ in leaves(self.root) for s, _ in path}

    def encoded_features(self) -> set[str]:
        return {s.test for path, _ in leaves(self.root) for s, _ in path}

    def __len__(self) -> int:
        return self.leaves()

    def signature(self) -> tuple:
        return tuple(sorted(tuple(sorted((s.test, side) for s, side in path)) for path, _ in leaves(self.root)))

    # scoring

    def _case(self, value) -> Column:
        number = iter(range(len(leaves(self.root))))

        def walk(node):
            if isinstance(node, Leaf):
                return F.lit(value(node, next(number)))
            yes = walk(node.true)
            return F.when(node.condition(self.policy), yes).otherwise(walk(node.false))

        return walk(self.root)

    def prediction(self) -> Column:
        return self._case(lambda leaf, _: str(leaf.prediction))

    def confidence(self) -> Column:
        return self._case(lambda leaf, _: float(1 - leaf.loss))

    def leaf_id(self) -> Column:
        return self._case(lambda _, k: k)

    def transform(self, df: DataFrame, prediction: str = "prediction", confidence: str = "confidence", leaf: str = "leaf") -> DataFrame:
        """df with three columns more; of a clashing name, the new one stays."""
        return df.withColumns({prediction: self.prediction(), confidence: self.confidence(), leaf: self.leaf_id()})

    predict = transform

    def training_loss(self, df: DataFrame, target: str) -> DataFrame:
        """(leaf, loss): 1/n for each row that its leaf gets wrong."""
        rows = df.select(self.leaf_id().alias("leaf"), (self.prediction() != F.col(target).cast("string")).alias("miss"))
        n = rows.agg(F.count("*").alias("all"))
        return rows.groupBy("leaf").agg(F.sum(F.when(F.col("miss"), 1).otherwise(0)).alias("m")).crossJoin(F.broadcast(n)).select("leaf", (F.col("m") / F.col("all")).alias("loss"))

    # folded forms

    def rules(self) -> list[dict]:
        """Each leaf as one interval or value a column: tests of the same column are folded."""
        out = []
        for path, leaf in leaves(self.root):
            held: dict[str, dict] = {}
            for s, side in path:
                x = held.setdefault(s.feature, {"equals": None, "not": [], "low": None, "high": None})
                if s.relation == "==":
                    if side:
                        x["equals"] = s.reference
                    else:
                        x["not"].append(s.reference)
                elif (s.relation in (">=", ">")) == side:
                    x["low"] = s.reference if x["low"] is None else max(x["low"], s.reference)
                else:
                    x["high"] = s.reference if x["high"] is None else min(x["high"], s.reference)
            out.append({"conditions": held, "prediction": leaf.prediction, "loss": leaf.loss, "complexity": leaf.complexity})
        return out

    @staticmethod
    def _says(feature: str, x: dict) -> str:
        if x["equals"] is not None:
            return f"{feature} == {x['equals']}"
        parts = []
        if x["low"] is not None and x["high"] is not None:
            parts.append(f"{x['low']} <= {feature} < {x['high']}")
        elif x["low"] is not None:
            parts.append(f"{feature} >= {x['low']}")
        elif x["high"] is not None:
            parts.append(f"{feature} < {x['high']}")
        if len(x["not"]) > 1:
            parts.append(f"{feature} not in {{{', '.join(map(str, sorted(x['not'], key=str)))}}}")
        else:
            parts += [f"{feature} != {v}" for v in x["not"]]
        return " and ".join(parts)

    def pseudocode(self) -> str:
        out = []
        for k, r in enumerate(self.rules()):
            said = " and ".join(self._says(f, x) for f, x in sorted(r["conditions"].items())) or "true"
            head = "if" if k == 0 else "else if"
            out.append(f"{head} {said} then:\n    predicted class: {r['prediction']}\n    misclassification penalty: {r['loss']:.6f}\n    complexity penalty: {r['complexity']:.6f}")
        return "\n".join(out)

    __str__ = pseudocode

    def rules_frame(self, spark) -> DataFrame:
        rows = [(k, " and ".join(self._says(f, x) for f, x in sorted(r["conditions"].items())) or "true", str(r["prediction"]), float(r["loss"])) for k, r in enumerate(self.rules())]
        return spark.createDataFrame(rows, "leaf int, rule string, prediction string, loss double")

    def nary(self) -> dict:
        """Nested form in which a run of thresholds on one column is one node with an interval for each child."""

        def gather(node, feature, low, high):
            if isinstance(node, Split) and node.feature == feature and node.relation == ">=":
                return gather(node.false, feature, low, node.reference) + gather(node.true, feature, node.reference, high)
            return [(low, high, node)]

        def walk(node):
            if isinstance(node, Leaf):
                return _leaf(node)
            if node.relation != ">=":
                return {"feature": node.feature, "relation": node.relation, "reference": _typed(node.reference), "true": walk(node.true), "false": walk(node.false)}
            return {"feature": node.feature, "children": [{"in": [low, high], "then": walk(n)} for low, high, n in gather(node, node.feature, None, None)]}

        return walk(self.root)

    def paths(self) -> list[dict]:
        """Each leaf with the tests on its path and the sides taken."""
        return [{"path": [{"test": s.test, "holds": side} for s, side in path], **_leaf(leaf)} for path, leaf in leaves(self.root)]

    def captures(self) -> list[Column]:
        """The condition of each leaf's path."""
        return [conjunction(path, self.policy) for path, _ in leaves(self.root)]

    def latex(self) -> str:
        def walk(node):
            if isinstance(node, Leaf):
                return f"[ ${str(node.prediction).replace('_', chr(92) + '_')}$ ]"
            test = f"{node.feature} {node.relation} {node.reference}".replace("_", "\\_").replace(">=", "\\ge").replace("<=", "\\le").replace("==", "=")
            return f"[ ${test}$ {walk(node.true)} {walk(node.false)} ]"

        return walk(self.root)

    def as_dict(self) -> dict:
        def walk(node):
            if isinstance(node, Leaf):
                return _leaf(node)
            reference = _typed(node.reference)
            kind = {int: "integral", float: "rational"}.get(type(reference), "categorical")
            return {"feature": node.feature, "relation": node.relation, "type": kind, "reference": reference, "true": walk(node.true), "false": walk(node.false)}

        return walk(self.root)

    def json(self, indent: int | None = 2) -> str:
        return json.dumps(self.as_dict(), indent=indent, default=str)

    @classmethod
    def of(cls, source: dict | list | str) -> TreeModel:
        """From JSON: a tree, or the first of a list of trees."""
        if isinstance(source, str):
            source = json.loads(source)
        if isinstance(source, list):
            if not source:
                raise ValueError("the list holds no model")
            source = source[0]

        def walk(x):
            if "prediction" in x:
                return Leaf(x["prediction"], float(x.get("loss", 0)), float(x.get("complexity", 0)), x.get("name", "class"))
            if x["relation"] not in RELATIONS:
                raise ValueError(f"relation {x['relation']!r} is none of {', '.join(RELATIONS)}")
            feature = x.get("name", x["feature"]) if not isinstance(x["feature"], str) else x["feature"]
            return Split(feature, x["relation"], x["reference"], walk(x["true"]), walk(x["false"]))

        return cls(walk(source))


def _leaf(leaf: Leaf) -> dict:
    return {"prediction": _typed(leaf.prediction), "name": leaf.name, "loss": leaf.loss, "complexity": leaf.complexity}


def nested(rules: list[list[tuple[str, bool]]], predictions: list, losses: list[float], penalty: float):
    """A tree from its leaves' rules (name, sign): the test that most leaves share is asked first."""
    if len(rules) == 1 and not rules[0]:
        return Leaf(predictions[0], losses[0], penalty)
    names = [n for r in rules for n, _ in r]
    first = max(sorted(set(names)), key=names.count)
    feature, relation, reference = first.split(" ", 2)
    sides = []
    for sign in (True, False):
        own = [k for k, r in enumerate(rules) if (first, sign) in r]
        sides.append(nested([[t for t in rules[k] if t[0] != first] for k in own], [predictions[k] for k in own], [losses[k] for k in own], penalty))
    return Split(feature, relation, _typed(reference), *sides)


def conjunction(path, policy: str = "reference") -> Column:
    """The capture of a leaf as one condition."""
    return reduce(lambda a, b: a & b, [s.condition(policy) if side else ~s.condition(policy) for s, side in path], F.lit(True))
