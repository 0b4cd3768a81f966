"""Corpus preparation in five stages, each an operator of sylvaframe.llm at work on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, further
columns too, whatever their names.

Defined cases, beside those of the operators: a document with a null or empty text has no language and goes first; null ids
stand for themselves, and of rows with one id and text one stays; a null source is a source of its own; very long texts run
whole through every stage; ties follow ids; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvaframe.llm import decontaminate, language, mixing, neardup, shards
from sylvaframe.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language holds enough of the letters go; the others get the language found where they name
    none, or clearly the wrong one."""
    return language.accepted(docs, language.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark text go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of 8, of near equal bytes."""
    return shards.with_shard(docs, shards=8)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]

#: No SQL: language spans and the k-d tree have none; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split(" ")[0])
    return docs
