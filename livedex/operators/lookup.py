"""Id lookups between uids, document numbers and segments.

Document numbers are positions: a segment starts where the documents before it end.  They are derived from segment
sizes, and never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NOT_FOUND


#: Segments that are put into one order at a time, and document numbers of one bucket.
TOGETHER, SPAN = 4096, 4096


def segment_offsets(docs: DataFrame) -> DataFrame:
    """Segments with their size, their start and the place after their end.

    Sizes are summed over groups of neighbouring segments first, so only a row a group is brought into one order.
    """
    sizes = docs.groupBy("segment").agg((F.max("local") + 1).alias("size")).withColumn("group", F.floor(F.col("segment") / TOGETHER))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("group").agg(F.sum("size").alias("size"))
    groups = groups.select("group", before(Window.orderBy("group")).alias("first"))
    out = sizes.join(groups, "group").withColumn("start", F.col("first") + before(Window.partitionBy("group").orderBy("segment")))
    return out.select("segment", "size", "start", (F.col("start") + F.col("size")).alias("stop"))


def doc_numbers(docs: DataFrame) -> DataFrame:
    """uid, segment, local number and number in the whole index."""
    starts = segment_offsets(docs).select("segment", "start")
    return docs.select("uid", "segment", "local").join(starts, "segment").select("uid", "segment", "local", (F.col("start") + F.col("local")).alias("docid"))


def uid_to_docid(probes: DataFrame, numbers: DataFrame) -> DataFrame:
    """The number of each probed uid, NOT_FOUND if it has none.  The newest segment wins where a uid is in several."""
    newest = numbers.groupBy("uid").agg(F.max_by("docid", "segment").alias("docid"))
    return probes.join(newest, "uid", "left").select("uid", F.coalesce("docid", F.lit(NOT_FOUND)).alias("docid"))


def uid_range(probes: DataFrame, numbers: DataFrame, start: int, count: int) -> DataFrame:
    """As uid_to_docid(), for uids in [start, start + count) only; the range reaches the scan."""
    inside = F.col("uid").between(start, start + count - 1)
    return uid_to_docid(probes, numbers.where(inside)).select("uid", F.when(inside, F.col("docid")).otherwise(NOT_FOUND).alias("docid"))


def docid_to_segment(probes: DataFrame, offsets: DataFrame) -> DataFrame:
    """Segment and local number of each probed document number.  Both sides are joined by the bucket of numbers they lie in,
    and a segment stands in every bucket that it reaches."""
    reached = F.explode(F.sequence(F.floor(F.col("start") / SPAN), F.floor((F.col("stop") - 1) / SPAN)))
    spans = offsets.where("stop > start").select("segment", "start", "stop", reached.alias("bucket"))
    asked = probes.withColumn("bucket", F.floor(F.col("docid") / SPAN))
    inside = (asked["bucket"] == spans["bucket"]) & (F.col("docid") >= F.col("start")) & (F.col("docid") < F.col("stop"))
    found = asked.join(spans, inside, "left")
    return found.select("docid", F.coalesce("segment", F.lit(NOT_FOUND)).alias("segment"), F.coalesce(F.col("docid") - F.col("start"), F.lit(NOT_FOUND)).alias("local"))


def docid_to_uid(probes: DataFrame, numbers: DataFrame) -> DataFrame:
    return probes.join(numbers.select("docid", "uid"), "docid", "left").select("docid", F.coalesce("uid", F.lit(NOT_FOUND)).alias("uid"))


def uids_to_docids(uids: DataFrame, numbers: DataFrame) -> DataFrame:
    """Distinct sorted numbers of a uid list; unknown uids are left out."""
    return uids.select("uid").distinct().join(numbers, "uid").select("docid").distinct().orderBy("docid")


def advance(docids: DataFrame, target: int, count: int = 1) -> DataFrame:
    """The first `count` numbers from `target` on, in order."""
    return docids.where(F.col("docid") >= target).orderBy("docid").limit(count)


def id_list(spark, text: str, name: str) -> DataFrame:
    """A comma-separated list of ids as rows; parts that aren't numbers are left out."""
    one = spark.range(1).select(F.explode(F.split(F.lit(text), ",")).alias("part"))
    return one.select(F.expr("try_cast(trim(part) AS BIGINT)").alias(name)).where(F.col(name).isNotNull())


def contains_all(wanted: DataFrame, having: DataFrame) -> DataFrame:
    """One row: whether every wanted uid is there, and how many are not."""
    missing = wanted.join(having.select("uid").distinct(), "uid", "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n_missing")).select((F.col("n_missing") == 0).alias("contains_all"), "n_missing")


def only(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """Rows whose uid is in the set."""
    return rows.join(uids.select("uid").distinct(), "uid", "left_semi")


def stats(docs: DataFrame, deleted: Column) -> DataFrame:
    """Documents, deletes, bytes and uid range per segment."""
    return docs.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(deleted.cast("long")).alias("n_deleted"), F.sum("n_chars").alias("n_bytes"), F.min("uid").alias("min_uid"), F.max("uid").alias("max_uid")
    )
