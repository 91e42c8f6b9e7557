"""Analyzers: text to an array of terms, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classic list of English stop words (fixed values).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, stop words and all."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def standard(text: Column) -> Column:
    """Terms without stop words."""
    return F.filter(terms(text), lambda t: ~t.isin(*STOP_WORDS))


def whitespace(text: Column) -> Column:
    """Runs of other characters than white space, as they are."""
    return F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))


def keyword(value: Column) -> Column:
    """The whole value as one term."""
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value))


ANALYZERS: dict[str, Callable[[Column], Column]] = {"standard": standard, "terms": terms, "whitespace": whitespace, "keyword": keyword}


def analyzed(text: Column, analyzer: Column, default: str = "standard") -> Column:
    """Each row's text by the analyzer that the row names."""
    out = ANALYZERS[default](text)
    for name, of in ANALYZERS.items():
        out = F.when(analyzer == name, of(text)).otherwise(out)
    return out


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """term, uid, tf, first position and positions (ascending) of every term of every document.

    Terms of one document meet in the map-side aggregation, so a very frequent term is one row a document in the shuffle,
    and positions are gathered within one document only.
    """
    exploded = docs.select("uid", F.posexplode(tokens).alias("pos", "term"))
    out = exploded.groupBy("term", "uid").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return out.select("term", "uid", F.size("positions").cast("long").alias("tf"), F.col("positions")[0].cast("long").alias("first_pos"), "positions")


def document_frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """Documents that hold each term; a document's repeats are dropped before anything is exchanged."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
