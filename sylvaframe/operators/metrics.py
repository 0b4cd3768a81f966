"""Scores of predictions and special objectives, as aggregates and cumulative windows over leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1.0)


def confusion(df: DataFrame, truth: str, pred: str, weight: str | None = None) -> DataFrame:
    """(truth, pred, weight) of every pair that occurs."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.sum(_w(weight)).alias("weight"))


def confusion_matrix(df: DataFrame, truth: str, pred: str, classes: list[str], weight: str | None = None) -> DataFrame:
    """One row for each true class, one column for each prediction."""
    return df.groupBy(F.col(truth).alias("truth")).pivot(pred, classes).agg(F.sum(_w(weight))).na.fill(0.0)


def accuracy(df: DataFrame, truth: str, pred: str, weight: str | None = None) -> Column | DataFrame:
    hit = F.when(F.col(truth) == F.col(pred), _w(weight)).otherwise(0.0)
    return df.agg((F.sum(hit) / F.sum(_w(weight))).alias("accuracy")).withColumn("error", 1 - F.col("accuracy"))


def balanced_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """The mean over true classes of the share that is right."""
    recall = df.groupBy(truth).agg(F.avg(F.when(F.col(truth) == F.col(pred), 1.0).otherwise(0.0)).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"))


#: Leaf labels of the binary objectives: 1 unless the condition on positives p and negatives n of the leaf, P and N in all, holds.
def leaf_rule(objective: str, w: float) -> Column:
    p, n = F.col("pos"), F.col("neg")
    if objective == "acc":
        return F.when(p < n, 0).otherwise(1)
    if objective == "bacc":
        return F.when(p * F.col("all_neg") <= n * F.col("all_pos"), 0).otherwise(1)
    if objective in ("wacc", "f1"):
        return F.when(w * p <= n, 0).otherwise(1)
    return F.lit(1)


def with_totals(leaves: DataFrame) -> DataFrame:
    """leaves (pos, neg) with all_pos and all_neg."""
    return leaves.crossJoin(F.broadcast(leaves.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))))


def loss(leaves: DataFrame, objective: str, w: float = 1.0, theta: float = 1.0) -> DataFrame:
    """(loss): one row. leaves: (pos, neg), one row for each leaf."""
    if objective in ("auc", "pauc"):
        return auc(leaves, theta if objective == "pauc" else 1.0)
    full = with_totals(leaves).withColumn("label", leaf_rule(objective, w))
    agg = full.agg(F.sum(F.when(F.col("label") == 1, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(F.col("label") == 0, F.col("pos")).otherwise(0)).alias("fn"), F.max("all_pos").alias("np"), F.max("all_neg").alias("nn"))
    fp, fn, p, n = (F.col(c) for c in ("fp", "fn", "np", "nn"))
    by = {
        "acc": (fp + fn) / (p + n),
        "bacc": 0.5 * (fn / p + fp / n),
        "wacc": (fp + w * fn) / (w * p + n),
        "f1": (fp + fn) / (2 * p + fp - fn),
    }
    return agg.select(by[objective].alias("loss"))


def roc(leaves: DataFrame) -> DataFrame:
    """(pos, neg, fpr, tpr, fpr0, tpr0): leaves by positive rate, best first, with the curve after and before each."""
    full = with_totals(leaves).withColumn("rate", F.col("pos") / (F.col("pos") + F.col("neg")))
    # leaves of equal rate are one step of the curve
    steps = full.groupBy("rate").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("all_pos").alias("ap"), F.max("all_neg").alias("an"))
    w = W.orderBy(F.desc("rate")).rowsBetween(W.unboundedPreceding, 0)
    tp, fp = F.sum("pos").over(w), F.sum("neg").over(w)
    return steps.select("rate", "pos", "neg", (fp / F.col("an")).alias("fpr"), (tp / F.col("ap")).alias("tpr"), ((fp - F.col("neg")) / F.col("an")).alias("fpr0"), ((tp - F.col("pos")) / F.col("ap")).alias("tpr0"))


def auc(leaves: DataFrame, theta: float = 1.0) -> DataFrame:
    """(loss): one minus the area under the curve up to false-positive rate theta, cut by linear interpolation."""
    x0, x1, y0, y1 = (F.col(c) for c in ("fpr0", "fpr", "tpr0", "tpr"))
    end = F.least(x1, F.lit(theta))
    y_end = F.when(x1 > x0, y0 + (y1 - y0) * (end - x0) / (x1 - x0)).otherwise(y1)
    area = F.when(x0 < theta, (end - x0) * (y0 + y_end) / 2).otherwise(0.0)
    return roc(leaves).agg((1 - F.sum(area)).alias("loss"))
