"""The corpus operators as queries over the driver's tables, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, language, masked_lm, mixing, neardup, negatives, oracles, packing, pii, search, shards, tokenfiles, urls
from .common import stored, table


def op1_mixed_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.digests(spark, path).withColumnRenamed("id", "doc_id")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents"), b"surrogates of the query")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.assign(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.train(docs.filter("not held_out"))
    return language.predict(docs, model, keep=("doc_id", "held_out"))


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), k=2)


def op7_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.score(docs, masked_lm.fit(docs))


def op10_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    sequences = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.digests(stored(sequences, "sequences"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mined(negatives.quantized(rows), F.col("id") % 100 == 0)


def op13_max_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_mixed_range_coder, op2_pii_surrogates, op3_kd_shards, op4_url_words, op5_language_spans, op6_bottom_k, op7_hash_mix, op8_fm_decontaminate, op9_masked_lm, op10_scaled_sketch, op11_sum_of_squares, op12_hard_negatives, op13_max_tree_search)}

SQL: dict[str, str] = {"op6_bottom_k": oracles.NEARDUP, "op7_hash_mix": oracles.MIXING, "op8_fm_decontaminate": oracles.DECONTAMINATE, "op12_hard_negatives": oracles.NEGATIVES, "op13_max_tree_search": oracles.RANKED}
