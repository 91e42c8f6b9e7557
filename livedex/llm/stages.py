"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.  All but the last keep the columns of docs."""

from __future__ import annotations

from . import jaccard_join as jaccard
from . import language_id as language
from . import mixing, packing, pii
from .common import small_batches


def language_id(spark, docs, sf_dir):
    small_batches(spark)
    return language.accepted(docs)


def jaccard_join(spark, docs, sf_dir):
    small_batches(spark)
    return jaccard.representatives(docs)


def personal_data(spark, docs, sf_dir):
    small_batches(spark)
    return pii.redacted(docs)


def mixed(spark, docs, sf_dir):
    small_batches(spark)
    return mixing.mixed_documents(docs, docs.columns)


def packed(spark, docs, sf_dir):
    small_batches(spark)
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
