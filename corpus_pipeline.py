"""Corpus preparation: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from livedex.llm import stages
from livedex.llm.common import new_folder, table

STAGES = [
    ("language ID", stages.language_id),
    ("n-gram Jaccard join", stages.jaccard_join),
    ("PII", stages.personal_data),
    ("mixing sources to target weights", stages.mixed),
    ("best-fit packing", stages.packed),
]

#: Learned models, similarity search and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_folder(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
