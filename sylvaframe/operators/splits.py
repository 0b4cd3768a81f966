"""Evaluating predicates as splits: one unpivot and one aggregation price every split of every capture set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import entropy, gini
from .groups import largest


def unpivoted(groups: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep, feature, bit): one row for each group and predicate."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bit")) for f in features])
    return groups.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.bit")


def histogram(groups: DataFrame, features: list[str], counts: list[str], by: list[str] = ()) -> DataFrame:
    """(by, feature, bit, n, counts, min_loss) of the children of every split."""
    rows = unpivoted(groups, features, [*by, "n", *counts, "minority"])
    return rows.groupBy(*by, "feature", "bit").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in counts], F.sum("minority").alias("min_loss"))


def _total(counts: list[str]):
    return reduce(lambda a, b: a + b, [F.col(c) for c in counts])


def priced(hist: DataFrame, counts: list[str], by: list[str] = ()) -> DataFrame:
    """(by, feature, loss, min_loss): misclassified rows of both children as leaves; splits that leave a child empty go."""
    child = hist.withColumn("loss", _total(counts) - largest(counts))
    agg = child.groupBy(*by, "feature").agg(F.sum("loss").alias("loss"), F.sum("min_loss").alias("min_loss"), F.count("*").alias("children"))
    return agg.filter("children = 2").drop("children")


def best_split(splits: DataFrame, by: list[str] = ()) -> DataFrame:
    """The cheapest split of each capture set; of equals the first predicate."""
    best = splits.groupBy(*by).agg(F.min(F.struct("loss", "feature")).alias("best"))
    return best.select(*by, F.col("best.feature").alias("feature"), F.col("best.loss").alias("loss"))


def gains(hist: DataFrame, counts: list[str], impurity: str = "entropy") -> DataFrame:
    """(feature, gain, rank): impurity of the whole minus that of the children by their shares, best first."""
    f = entropy if impurity == "entropy" else gini
    side = hist.withColumn("c", _total(counts)).withColumn("h", f([F.col(x) for x in counts], F.col("c")))
    agg = side.groupBy("feature").agg(F.sum("c").alias("total"), F.sum(F.col("c") * F.col("h")).alias("inner"), *[F.sum(x).alias(x) for x in counts])
    out = agg.withColumn("gain", F.round(f([F.col(x) for x in counts], F.col("total")) - F.col("inner") / F.col("total"), 6))
    return out.select("feature", "gain", F.row_number().over(W.orderBy(F.desc("gain"), "feature")).alias("rank"))


def pairs(groups: DataFrame, features: list[str], weight: str = "n") -> DataFrame:
    """(a, b, n11, n10, n01, n00) for predicates a < b: weights of the four sign combinations, without a self-join."""
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(features) for b in features[i + 1 :]])
    rows = groups.select(weight, F.explode(both).alias("p")).select(weight, "p.*")
    cell = lambda x, y: F.sum(F.when((F.col("x") == x) & (F.col("y") == y), F.col(weight)).otherwise(0))
    return rows.groupBy("a", "b").agg(cell(1, 1).alias("n11"), cell(1, 0).alias("n10"), cell(0, 1).alias("n01"), cell(0, 0).alias("n00"))


def subset_pairs(groups: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, implies): which signs of a lie inside which signs of b: ``a->b``, ``a->!b``, ``!a->b``, ``!a->!b``."""
    p = pairs(groups, features)
    rules = F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(s)) for c, s in (("n10", "a->b"), ("n11", "a->!b"), ("n00", "!a->b"), ("n01", "!a->!b"))]))
    return p.select("a", "b", F.explode(rules).alias("implies"))


def distances(groups: DataFrame, features: list[str], weight: str = "n") -> DataFrame:
    """(a, b, distance): rows (or their weight) on which two predicates, or one and the other's negation, differ, whichever is less."""
    return pairs(groups, features, weight).select("a", "b", F.least(F.col("n10") + F.col("n01"), F.col("n11") + F.col("n00")).alias("distance"))


def exchange_candidates(hist: DataFrame, thresholds: DataFrame, counts: list[str]) -> DataFrame:
    """(feature, next_feature, prune_left, prune_right) of adjacent thresholds of one column: the lower one can't win where
    its left side's bound is no better than what the higher one's left side surely reaches; mirrored on the right.
    thresholds: (feature, source, threshold)."""
    child = hist.withColumn("loss", _total(counts) - largest(counts))
    side = lambda b: child.filter(F.col("bit") == b).select("feature", F.col("min_loss").alias(f"lb{b}"), F.col("loss").alias(f"ub{b}"))
    rows = thresholds.join(side(0), "feature", "left").join(side(1), "feature", "left").na.fill(0, ["lb0", "ub0", "lb1", "ub1"])
    w = W.partitionBy("source").orderBy("threshold")
    nxt = lambda c: F.lead(c).over(w)
    return rows.select("feature", nxt("feature").alias("next_feature"), (F.col("lb0") >= nxt("ub0")).alias("prune_left"), (nxt("lb1") >= F.col("ub1")).alias("prune_right")).filter("next_feature is not null")
