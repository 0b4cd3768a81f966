"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only.

A document's place in its source's order is a 60-bit hash of its id. Words are summed by source and hash bucket; a running
sum over the at most ``1 << BITS`` buckets of a source finds the bucket in which the budget runs out, and only the rows of
that boundary bucket are summed by finer buckets, until single hash values remain. The mix is then a filter
``hash <= threshold``: nothing is sorted, budgets are nested (a larger one takes a superset), and reruns agree.

A target above the source's size takes every document once and those below the threshold a second time. The document
on the threshold is taken if that brings the sum nearer to the target. Targets come from a water level over the sources:
target = min(2 x size, level x weight), which is where resharing the excess by weight ends.

Defined cases: null and empty texts have size 0 and are never counted as taken; a null source is a source of its own,
the last; documents with equal ids in one source share a hash and are taken alike; an empty table gives no rows; other
columns are ignored (``plan``) or kept (``mixed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, stored, word_count

BITS = 12
HASH_BITS = 60
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Sources up to this many travel with the tasks.
BROADCAST_SOURCES = 100_000


def hash60(id_col: str) -> Column:
    """The first 15 hex digits of the id's md5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """__source, source_size, target. sizes: one row for each source, a small table."""
    order = W.orderBy(F.col("__source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("__w", pick).withColumn("__full", F.lit(float(most)) * F.col("source_size")).withColumn("__ratio", F.col("__full") / F.col("__w"))
    by_ratio = W.orderBy("__ratio", F.col("__source").asc_nulls_last())
    all_ = W.partitionBy()
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("__full").over(before), F.lit(0.0))) / (F.sum("__w").over(all_) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    whole = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = ranked.withColumn("__level", level).withColumn("__level", F.first(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level")), ignorenulls=True).over(whole))
    return found.select("__source", "source_size", F.least("__full", F.coalesce(F.col("__level") * F.col("__w"), F.col("__full"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def thresholds(points: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with __whole (times every document is taken) and __cut (those with a hash up to it are taken once more)."""
    state = goal.withColumn("__whole", F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)).withColumn("__need", F.col("target") - F.col("__whole") * F.col("source_size")).withColumn("__prefix", F.lit(0).cast("long"))
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        last = shift <= HASH_BITS - 3 * BITS
        shift = 0 if last else shift
        bound = state.select(F.col("__source").alias("__s"), F.col("__prefix").alias("__p"), "__need")
        top = shift + BITS if not last else HASH_BITS - 2 * BITS
        held = points.join(bound, _same("__source", "__s") & (F.shiftright("__hash", top) == F.col("__p")))
        sums = held.groupBy("__source", F.shiftright("__hash", shift).alias("__bucket")).agg(F.sum("__size").alias("__sum"), F.first("__need").alias("__need"))
        upto = F.sum("__sum").over(W.partitionBy("__source").orderBy("__bucket"))
        cut = sums.withColumn("__upto", upto).filter(F.col("__upto") >= F.col("__need")).groupBy("__source").agg(F.min_by(F.struct("__bucket", "__sum", "__upto"), "__bucket").alias("__at"))
        cut = stored(cut.select(F.col("__source").alias("__s"), "__at"), "cut")
        left = F.col("__need") - (F.col("__at.__upto") - F.col("__at.__sum"))
        state = state.join(cut, _same("__source", "__s"), "left").drop("__s")
        if last:
            taken = F.when(F.col("__at.__sum") - left < left, F.col("__at.__bucket")).otherwise(F.col("__at.__bucket") - 1)
            return state.select("__source", "source_size", "target", "__whole", F.coalesce(F.when(F.col("__need") > 0, taken), F.lit(-1)).cast("long").alias("__cut"))
        state = stored(state.withColumn("__need", F.coalesce(left, F.lit(0.0))).withColumn("__prefix", F.coalesce("__at.__bucket", F.lit(0).cast("long"))).drop("__at"), "state")
    raise AssertionError


def _copies() -> Column:
    return F.col("__whole") + F.when(F.col("__hash") <= F.col("__cut"), 1).otherwise(0)


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The stored metadata of the documents, and each source's size, target and threshold."""
    points = stored(docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), hash60(id_col).alias("__hash"), word_count(text_col).alias("__size")), "points")
    goal = stored(targets(points.groupBy("__source").agg(F.sum("__size").alias("source_size")), weights, share, most), "goal")
    cuts = stored(thresholds(points, goal), "cuts")
    # a row for each source: broadcast below a counted bound, so that no source meets in one task; else Spark joins
    return points, F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: size, source_size, target and taken words. Returns id, source, copies too."""
    points, cuts = plan(docs, **options)
    rows = points.join(cuts.withColumnRenamed("__source", "__s"), _same("__source", "__s"))
    return rows.select(F.col("__id").alias(options.get("id_col", "doc_id")), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * _copies()).alias("taken"), _copies().alias("copies"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns, whatever their names."""
    held, number = numbered(docs)
    _, cuts = plan(held, id_col=number[id_col], text_col=number[text_col], source_col=number[source_col], **options)
    rows = held.withColumn("__hash", hash60(number[id_col])).join(cuts, F.col(number[source_col]).cast("string").eqNullSafe(F.col("__source")))
    copies = rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), _copies())))
    return copies.select(*number.values()).toDF(*docs.columns)
