"""Adapters from tables to change streams and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as changes: about a third as many uids as events, errors delete, views are skipped.

    The oldest six tenths are in the disk tier, the next quarter in A, the rest in B.
    """
    events = table(spark, sf_dir, "events")
    n = events.count()  # from the files' footers
    version = F.col("event_id")
    tier = F.when(version < n * 6 // 10, "disk").when(version < n * 85 // 100, "A").otherwise("B")
    return events.select(
        ((version * version + 31 * F.col("user_id")) % max(n // 3, 1)).alias("uid"),
        version.alias("version"),
        version.alias("seq"),
        (F.col("event_type") == "error").alias("is_deleted"),
        (F.col("event_type") == "view").alias("is_skip"),
        "ts", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        tier.alias("tier"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as indexed documents: uid, content, path, lang, source, and the segment of a hundred they are in."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("uid"), F.col("text").alias("content"), F.concat_ws("/", "source", "doc_id").alias("path"),
        "lang", "source", "n_chars", F.floor(F.col("doc_id") / 100).alias("segment"), (F.col("doc_id") % 100).alias("local"),
    )


def updated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live documents after a second wave: uids ending in 0 are deleted, those ending in 1 rewritten."""
    docs = corpus(spark, sf_dir)
    content = F.when(F.col("uid") % 10 == 1, F.concat(F.lit("updated "), "content")).otherwise(F.col("content"))
    tier = F.when(F.col("uid") % 10 == 1, "A").otherwise("disk")
    return docs.where(F.col("uid") % 10 != 0).withColumn("content", content).withColumn("tier", tier)


def row_documents(rows: DataFrame, uid: Column, fields: dict[str, Column]) -> DataFrame:
    """Rows of any table as documents: each field's value as text, null values left out; nothing is ever deleted."""
    pairs = [F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value.cast("string"))) for name, value in fields.items()]
    return rows.select(uid.cast("long").alias("uid"), F.concat_ws("|", *pairs).alias("fields"))


def file_documents(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files (path, text) as documents: the path comes before the text, and a constant keyword field is added."""
    text = F.col("text") if limit is None else F.substring("text", 1, limit)
    return files.select(F.xxhash64("path").alias("uid"), "path", F.concat_ws("\n", "path", text).alias("content"), F.lit("bar").alias("foo"))


def content_documents(content: DataFrame, date_format: str = "dd-MMM-yyyy HH:mm:ss.SSS") -> DataFrame:
    """Content rows (id, title, body, date and, if there is one, a map `props`) as documents: the date is kept beside its text
    form, and `fields` has every field by name, those of `props` too, without null ones."""
    named = {"title": F.col("title"), "body": F.col("body"), "date": F.date_format("date", date_format)}
    own = F.create_map(*[x for name, value in named.items() for x in (F.lit(name), value)])
    if "props" in content.columns:
        props = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*named))
        own = F.map_concat(own, props)
    return content.select(F.col("id").alias("uid"), "title", "body", "date", named["date"].alias("date_text"), F.map_filter(own, lambda _, v: v.isNotNull()).alias("fields"))


def looping(changes: DataFrame, most: int) -> DataFrame:
    """Uids folded into 0..most-1, so that a finite source goes on as updates."""
    return changes.withColumn("uid", F.pmod("uid", F.lit(most)))


def clean_content(rows: DataFrame, column: str, skipped_prefixes: tuple[str, ...] = ("#redirect",), skipped_titles: tuple[str, ...] = ("Image:",), title: str | None = None) -> DataFrame:
    """Rows without redirects and media pages, with tabs and newlines as blanks."""
    out = rows
    for prefix in skipped_prefixes:
        out = out.where(~F.startswith(F.lower(column), F.lit(prefix.lower())))
    for prefix in skipped_titles if title else ():
        out = out.where(~F.startswith(F.col(title), F.lit(prefix)))
    return out.withColumn(column, F.translate(column, "\t\n", "  "))


def source_counts(files: DataFrame) -> DataFrame:
    """Documents and bytes that a file source has read, one row (files: path, bytes)."""
    return files.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


class SourceCounter:
    """Documents and bytes that a file source has read: since the last reset, and in all."""

    def __init__(self) -> None:
        self.docs = self.bytes = self.total_docs = self.total_bytes = 0

    def add(self, files: DataFrame) -> None:
        found = source_counts(files).first()
        self.docs, self.bytes = self.docs + found["docs"], self.bytes + found["bytes"]
        self.total_docs, self.total_bytes = self.total_docs + found["docs"], self.total_bytes + found["bytes"]

    def reset(self) -> None:
        self.docs = self.bytes = 0


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """(query) of a file with one query a line; empty lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")
