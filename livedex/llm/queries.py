"""The operators' queries, with their production parameters, and the SQL that checks some of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, jaccard_join, language_id, lm_scoring, mixing, packing, pii, suffix_dedup, topk_search
from .common import table


def op1_chat_formatting(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"  # a conversation that says what turns are marked with
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return chat_format.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark, sf_dir):
    return lm_scoring.scored(table(spark, sf_dir, "documents"), order=3)


def op4_language_id(spark, sf_dir):
    return language_id.identified(table(spark, sf_dir, "documents"))


def op5_personal_data(spark, sf_dir):
    return pii.found(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark, sf_dir):
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_suffix_array_dedup, op3_lm_scoring, op4_language_id, op5_personal_data, op6_best_fit_packing, op7_exact_top_k,
        op8_embedding_near_dedup, op9_ngram_jaccard_join, op10_mix_sources,
    )
}

ORACLE_SQL = {
    "op1_chat_formatting": chat_format.ORACLE,
    "op2_suffix_array_dedup": suffix_dedup.ORACLE,
    "op7_exact_top_k": topk_search.ORACLE,
    "op8_embedding_near_dedup": embedding_dedup.ORACLE,
    "op9_ngram_jaccard_join": jaccard_join.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
}
