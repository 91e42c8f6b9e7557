"""A stored inverted index: postings with positions, partitioned by field and a bucket of the term, and document lengths.

A query's leaves become counts by uid, which search.py scores as it does those from token arrays.  A term or a phrase
reads the buckets of its words only, as the field and the bucket are partition columns; a leaf for many terms reads its
field.  Deletes and updates since the index was built are hidden by an anti join before anything is scored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import postings, terms
from ..functions.scoring import SIMILARITIES, Similarity
from ..plans import query_parser as qp
from .search import Plan, check, holds


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, buckets: int = 64, analyzer=terms, keyword_fields: tuple[str, ...] = ("lang", "source")) -> None:
    """Writes postings (term, uid, tf, first_pos, positions by field and bucket) and lengths.

    Buckets are dealt over several files by term and uid, so a very frequent term isn't one task's.
    """
    rows = postings(docs, analyzer(F.col("content"))).withColumn("field", F.lit("content"))
    for name in keyword_fields:
        if name in docs.columns:
            one = docs.select(F.lower(F.coalesce(name, F.lit(""))).alias("term"), "uid", F.lit(1).cast("long").alias("tf"), F.lit(0).cast("long").alias("first_pos"), F.array(F.lit(0)).alias("positions"), F.lit(name).alias("field"), F.col(name).isNull().alias("none"))
            rows = rows.unionByName(one.where("NOT none").drop("none"))
    rows = rows.withColumn("bucket", bucket_of(F.col("term"), buckets))
    rows.repartition("field", "bucket", F.pmod(F.xxhash64("uid"), F.lit(8))).sortWithinPartitions("field", "bucket", "term", "uid").write.partitionBy("field", "bucket").parquet(f"{path}/postings")
    docs.select("uid", F.coalesce(F.size(analyzer(F.col("content"))), F.lit(0)).alias("length")).write.parquet(f"{path}/lengths")


def documents(spark: SparkSession, path: str, term: str, buckets: int = 64, field: str = "content") -> DataFrame:
    """uid, tf, first_pos and positions of a term's documents; its bucket alone is read."""
    rows = spark.read.parquet(f"{path}/postings")
    return rows.where((F.col("field") == field) & (F.col("bucket") == zlib.crc32(term.encode()) % buckets) & (F.col("term") == term)).select("uid", "tf", "first_pos", "positions")


def _words(leaf: qp.Clause) -> list[str] | None:
    """The terms that a leaf names, None if it stands for many."""
    return list(dict.fromkeys(leaf.words)) if isinstance(leaf, qp.Phrase) else [leaf.text] if isinstance(leaf, qp.Term) else None


def _less(n: int):
    return lambda place: place - n


def _phrases(rows: DataFrame, leaf: qp.Phrase, column: str) -> DataFrame:
    """uid and the number of places where the words of a phrase follow each other, from their positions."""
    lists = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("positions"))), F.array().cast("array<int>")).alias(f"w{k}") for k, w in enumerate(leaf.words)]
    found = rows.where((F.col("field") == leaf.field) & F.col("term").isin(*_words(leaf))).groupBy("uid").agg(*lists)
    # Starts of the phrase that each word allows; the sets of starts are cut with each other.
    starts = F.col("w0")
    for k in range(1, len(leaf.words)):
        places = [F.transform(f"w{k}", _less(d)) for d in range(k, k + leaf.slop + 1)]
        starts = F.array_intersect(starts, F.concat(*places))
    return found.select("uid", F.size(starts).alias(column))


def counted(spark: SparkSession, path: str, plan: Plan, buckets: int, hidden: DataFrame | None) -> DataFrame:
    """uid, length and a count for every leaf, of documents that match one at least (of all, where the query needs them)."""
    rows, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    if hidden is not None:
        rows, lengths = (x.join(hidden.select("uid").distinct(), "uid", "left_anti") for x in (rows, lengths))
    parts, phrases, wanted = [], [], None
    for leaf, column in plan.at.items():
        check(leaf, plan.fields)
        if isinstance(leaf, qp.MatchAll):
            continue
        here = F.col("field") == leaf.field
        if (words := _words(leaf)) is not None:
            here &= F.col("bucket").isin(*sorted({zlib.crc32(w.encode()) % buckets for w in words})) & F.col("term").isin(*words)
        else:
            here &= holds(leaf, F.col("term"))
        if isinstance(leaf, qp.Phrase):
            phrases.append(_phrases(rows.where(here), leaf, column))
            continue
        wanted = here if wanted is None else wanted | here
        number = F.col("tf") if isinstance(leaf, qp.Term) and leaf.field not in plan.fields else F.lit(1)
        parts.append(F.coalesce(F.max(F.when(here, number)), F.lit(0)).cast("int").alias(column))
    out = rows.where(wanted).groupBy("uid").agg(*parts) if parts else None
    for found in phrases:
        out = found if out is None else out.join(found, "uid", "full")
    every = any(isinstance(x, qp.MatchAll) for x in plan.leaves)
    out = lengths if out is None else lengths.join(out, "uid", "left") if every else out.join(lengths, "uid")
    one = {c: F.lit(1) for leaf, c in plan.at.items() if isinstance(leaf, qp.MatchAll)}
    return out.select("uid", "length", *[one.get(c, F.coalesce(c, F.lit(0)) if c in out.columns else F.lit(0)).alias(c) for c in plan.at.values()])


def matches(
    spark: SparkSession, path: str, query: str | list[str] | None, buckets: int = 64, hidden: DataFrame | None = None, similarity: Similarity = SIMILARITIES["classic"], keyword_fields: tuple[str, ...] = ("lang", "source")
) -> DataFrame:
    """uid and score of every hit of a query (a list: any of its words), as search.matches() gives from texts."""
    plan = Plan(" ".join(query) if isinstance(query, list) else query, keyword_fields)
    rows = counted(spark, path, plan, buckets, hidden)
    sums = None
    if plan.needs_sums:
        lengths = spark.read.parquet(f"{path}/lengths")
        if hidden is not None:
            lengths = lengths.join(hidden.select("uid").distinct(), "uid", "left_anti")
        sums = {**plan.sums(rows).asDict(), "n": lengths.count()}  # documents that match nothing count too
    return plan.scored(rows, sums, (), similarity)
