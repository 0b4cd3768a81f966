"""Order over range partitions: lags, running sums and dense ranks without a task that sees all rows.

Rows are dealt out by ranges and sorted inside them once, and stored with the number of their partition. What a row needs
of the rows before its partition is carried over: one small row for each partition (and group, where groups are numbered
apart), found by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..store import cut

PART = "__part"


def ranged(df: DataFrame, order: list[str], name: str = "ranged") -> DataFrame:
    """df, stored, with its range partition; lower partitions hold lower rows. Nulls come first."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()), name)


def previous(df: DataFrame, order: list[str], values: list[str], by: list[str] = ()) -> DataFrame:
    """df (as ``ranged`` gives it, by ``by`` and then ``order``) with ``prev_<value>`` of the row before, inside a group;
    null for the first."""
    inside = W.partitionBy(PART, *by).orderBy(*order)
    row = F.struct(*values)
    rows = df.withColumn("__own", F.lag(row).over(inside))
    last = df.groupBy(PART, *by).agg(F.max_by(row, F.struct(*order)).alias("__last"))
    # a partition of a group's first rows takes the last row of the partition before that holds the group
    edge = last.select(F.col(PART).alias("__p"), *[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], F.lag("__last").over(W.partitionBy(*by).orderBy(PART)).alias("__before")) if by else _carried(last, F.lag("__last"), "__before")
    same = F.col(PART) == F.col("__p")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__b{i}"))
    out = rows.join(F.broadcast(edge) if not by else edge, same, "left").withColumn("__own", F.coalesce("__own", "__before"))
    return out.select(*df.columns, *[F.col(f"__own.{v}").alias(f"prev_{v}") for v in values])


def _carried(parts: DataFrame, over, name: str) -> DataFrame:
    """One row for each partition; there are as many as shuffle partitions, so one task may order them."""
    return parts.select(F.col(PART).alias("__p"), over.over(W.orderBy(PART)).alias(name))


def running(df: DataFrame, order: list[str], value: Column, name: str, by: list[str] = ()) -> DataFrame:
    """df (as ``ranged`` gives it) with the sum of value over the rows of the group up to each."""
    rows = df.withColumn("__v", value)
    sums = rows.groupBy(PART, *by).agg(F.sum("__v").alias("__s"))
    upto = W.partitionBy(*by).orderBy(PART) if by else W.orderBy(PART)  # a row for each partition
    before = sums.select(F.col(PART).alias("__p"), *[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], (F.sum("__s").over(upto) - F.col("__s")).alias("__before"))
    same = F.col(PART) == F.col("__p")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__b{i}"))
    own = F.sum("__v").over(W.partitionBy(PART, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__own", own).join(before if by else F.broadcast(before), same, "left").select(*df.columns, (F.col("__own") + F.col("__before")).alias(name))
