"""Why a search didn't close, or closed without a model: anti-joins over the subproblem graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unresolved(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Open subproblems (lower < upper) of which no split was explored. tasks: tid, lower, upper; edges: tid, feature, child."""
    return tasks.filter("lower < upper").join(edges.select("tid").distinct(), "tid", "left_anti")


def blocking(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(tid, feature, child): children that are themselves open and keep their parents open."""
    open_ = tasks.filter("lower < upper").select("tid")
    return edges.join(open_, "tid", "left_semi").join(open_.select(F.col("tid").alias("child")), "child", "left_semi").select("tid", "feature", "child")


def unfounded(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Closed subproblems whose value neither their leaf nor the values of two children of one split give."""
    value = tasks.select(F.col("tid").alias("child"), "upper")
    sums = edges.join(value, "child").groupBy("tid", "feature").agg(F.count("*").alias("k"), F.sum("upper").alias("v")).filter("k = 2")
    best = sums.groupBy("tid").agg(F.min("v").alias("v"))
    return tasks.filter("lower = upper").join(best, "tid", "left").filter(F.least("leaf", F.coalesce("v", "leaf")) != F.col("upper")).select("tid", "leaf", "v", "upper")
