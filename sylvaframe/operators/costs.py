"""Cost matrices: defaults, class balance, files, and what they imply for each class."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_costs(counts: DataFrame, label: str, balance: bool = False) -> DataFrame:
    """(pred, truth, cost) from (label, cnt): 1/n off the diagonal, or 1/(k * cnt of the true class) when balanced."""
    total = counts.agg(F.sum("cnt").alias("n"), F.count("*").alias("k"))
    truth = counts.select(F.col(label).alias("truth"), F.col("cnt"))
    pred = counts.select(F.col(label).alias("pred"))
    cell = F.when(F.col("pred") == F.col("truth"), 0.0).otherwise(1 / (F.col("k") * F.col("cnt")) if balance else F.lit(1.0) / F.col("n"))
    return pred.crossJoin(truth).crossJoin(total).select("pred", "truth", cell.alias("cost"))


def completed(cells: DataFrame, classes: list[str]) -> DataFrame:
    """All pairs of classes; raises where a file lacks one."""
    spark = cells.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], "name string")
    full = names.select(F.col("name").alias("pred")).crossJoin(names.select(F.col("name").alias("truth"))).join(cells, ["pred", "truth"], "left")
    if missing := full.filter("cost is null").limit(1).collect():
        raise ValueError(f"the cost matrix lacks ({missing[0]['pred']}, {missing[0]['truth']})")
    return full


def aggregates(costs: DataFrame) -> DataFrame:
    """Per true class: match (cost of being right), mismatch (least cost of being wrong), max, min, diff = max - min."""
    return costs.groupBy("truth").agg(
        F.sum(F.when(F.col("pred") == F.col("truth"), F.col("cost"))).alias("match"),
        F.min(F.when(F.col("pred") != F.col("truth"), F.col("cost"))).alias("mismatch"),
        F.max("cost").alias("max_cost"),
        F.min("cost").alias("min_cost"),
        (F.max("cost") - F.min("cost")).alias("diff"),
    )


def prediction_costs(counts: DataFrame, costs: DataFrame, by: list[str]) -> DataFrame:
    """by, pred, cost: what predicting each class costs in each capture set. counts: (by, truth, cnt)."""
    return counts.join(costs, "truth").groupBy(*by, "pred").agg(F.sum(F.col("cnt") * F.col("cost")).alias("cost"))


def best_prediction(priced: DataFrame, by: list[str]) -> DataFrame:
    """by, pred, cost: the cheapest prediction; of equals the highest class."""
    agg = priced.groupBy(*by).agg(F.min("cost").alias("cost"), F.collect_list(F.struct("pred", "cost")).alias("all"))
    return agg.select(*by, F.array_max(F.filter("all", lambda x: x["cost"] == F.col("cost")))["pred"].alias("pred"), "cost")


def matrix(classes: list[str], counts: list[int], *, balance: bool = False, cells: dict | None = None) -> list[list[Fraction]]:
    """Exact costs [pred][truth] for the search."""
    n, k = sum(counts), len(classes)
    if cells is not None:
        return [[Fraction(str(cells[p, t])) for t in classes] for p in classes]
    wrong = [Fraction(1, k * c) if balance and c else Fraction(1, max(n, 1)) for c in counts]
    return [[Fraction(0) if i == j else wrong[j] for j in range(k)] for i in range(k)]
