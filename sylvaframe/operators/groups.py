"""Equivalence groups: rows with equal bits are interchangeable, so one aggregation compresses a table to group counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ordered


def class_counts(label: str, classes: list[str]) -> list[Column]:
    return [F.count_if(F.col(label) == c).alias(f"n_{c.lower()}") for c in classes]


def compress(bits: DataFrame, features: list[str], label: str, classes: list[str]) -> DataFrame:
    """features, n, one count for each class: partial aggregation, one shuffle of group counts."""
    return bits.groupBy(*features).agg(F.count("*").alias("n"), *class_counts(label, classes))


def largest(columns: list[str]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])


def with_minority(groups: DataFrame, counts: list[str]) -> DataFrame:
    """minority: rows of a group that no label of the group can serve."""
    return groups.withColumn("minority", reduce(lambda a, b: a + b, [F.col(c) for c in counts]) - largest(counts))


def minimiser(counts: list[str], labels: list[str]) -> Column:
    """The best label of a group under unit costs; of equals the lowest."""
    top = largest(counts)
    out = F.lit(labels[-1])
    for c, name in list(zip(counts, labels))[-2::-1]:
        out = F.when(F.col(c) == top, name).otherwise(out)
    return out


def leaf_label(counts: list[str], labels: list[str]) -> Column:
    """The label of a leaf under unit costs; of equals the highest."""
    return minimiser(counts[::-1], labels[::-1])


def majority_rows(bits: DataFrame, features: list[str], label: str, classes: list[str]) -> DataFrame:
    """Rows with a flag: does the row carry its group's best label? Groups join back on their bits."""
    counts = [f"n_{c.lower()}" for c in classes]
    best = compress(bits, features, label, classes).select(*features, minimiser(counts, classes).alias("best"))
    return bits.join(best, features).withColumn("majority", F.coalesce(F.col(label) == F.col("best"), F.lit(False)))


def leaf_summary(groups: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """Per capture set: n, counts, label, max_loss (of the best single label), min_loss (equivalent points), potential."""
    counts = [f"n_{c.lower()}" for c in classes]
    agg = groups.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in counts], F.sum("minority").alias("min_loss"))
    total = reduce(lambda a, b: a + b, [F.col(c) for c in counts])
    return agg.withColumn("label", leaf_label(counts, classes)).withColumn("max_loss", total - largest(counts)).withColumn("potential", F.col("max_loss") - F.col("min_loss"))


def bounds(summary: DataFrame, n: int, leaf_penalty: float) -> DataFrame:
    """base, lower and upper bound of a capture set's objective, and whether it must be a leaf."""
    base = F.col("max_loss") / n + leaf_penalty
    lower = F.least(base, F.col("min_loss") / n + 2 * leaf_penalty)
    closed = (F.col("potential") / n < leaf_penalty) | (F.col("n") <= 1)
    return summary.withColumn("base", base).withColumn("lower", F.when(closed, base).otherwise(lower)).withColumn("upper", base).withColumn("closed", closed)


def distinct_by_leaves(models: DataFrame, signature: str = "leaf_signature") -> DataFrame:
    """Models that partition the rows alike count once."""
    return models.dropDuplicates([signature])


def first_match(rules: list[tuple[Column, str]], default: str) -> Column:
    """An ordered rule list: the first rule that holds gives the label."""
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in rules], F.lit(default))


def running_sums(df: DataFrame, order: list[str], value: str, mask: Column, bucket: Column | None = None) -> DataFrame:
    """Prefix sums of a masked value (sums below the float epsilon count as 0). No task sees all rows: sums run inside
    buckets, which ascend with the order, or without any inside range partitions, and start after the sums of those before."""
    held = F.when(mask, F.col(value)).otherwise(0.0)
    if bucket is None:
        return ordered.running(ordered.ranged(df, order), order, held, "prefix").drop(ordered.PART)
    rows = df.withColumn("__b", bucket).withColumn("__v", held)
    sums = rows.groupBy("__b").agg(F.sum("__v").alias("__s"))
    before = sums.select(F.col("__b").alias("__bb"), (F.sum("__s").over(W.orderBy("__b")) - F.col("__s")).alias("__before"))
    own = F.sum("__v").over(W.partitionBy("__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__own", own).join(before, F.col("__b") == F.col("__bb")).withColumn("prefix", F.col("__own") + F.col("__before")).drop("__b", "__bb", "__v", "__own", "__before")
