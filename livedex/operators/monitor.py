"""Statistics over recent searches and ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Searches that the monitor looks back on.
RECENT = 10_000


def recent(searches: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n searches by time."""
    return searches.orderBy(F.col("ts").desc(), F.col("n").desc()).limit(n)


def latency_stats(searches: DataFrame, n: int = RECENT) -> DataFrame:
    pct = lambda c, p: F.round(F.percentile(c, F.lit(p)), 6)
    return recent(searches, n).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("avg_ms"), pct("ms", 0.5).alias("p50_ms"), pct("ms", 0.9).alias("p90_ms"), pct("ms", 0.99).alias("p99_ms"), pct("hits", 0.9).alias("p90_hits")
    )


def rolling_average(searches: DataFrame, rows: int, partition: Column) -> DataFrame:
    """Mean time over each search and those before it, `rows` in all, within a partition of time."""
    frame = Window.partitionBy(partition).orderBy("ts", "n").rowsBetween(-(rows - 1), 0)
    return searches.select("n", F.round(F.avg("ms").over(frame), 6).alias("rolling_ms"))


def qps_percentile(searches: DataFrame, *shares: float) -> DataFrame:
    per_second = searches.groupBy(F.date_trunc("second", "ts").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    return per_second.agg(F.count(F.lit(1)).alias("seconds"), F.max("n").alias("most"), *[F.round(F.percentile("n", F.lit(s)), 6).alias(f"p{round(s * 100)}") for s in shares])


def per_minute(rows: DataFrame, since: Column | None = None) -> DataFrame:
    """Rows a minute between the first and the last, from a mark on."""
    rows = rows if since is None else rows.where(F.col("ts") >= since)
    ms = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) * 60000 / ms, 6).alias("per_minute"))


def batch_stats(batches: DataFrame) -> DataFrame:
    """Of indexing batches (batch, docs, ms, left_over): the last one, and the mean time a document."""
    last = F.max_by(F.struct("docs", "ms", "left_over"), "batch")
    return batches.agg(last.alias("last"), F.sum("docs").alias("total_docs"), F.round(F.sum("ms") / F.sum("docs"), 6).alias("ms_per_doc")).select(
        F.col("last.docs").alias("last_docs"), F.col("last.ms").alias("last_ms"), F.col("last.left_over").alias("last_left_over"), "total_docs", "ms_per_doc"
    )


def cpu_sums(threads: DataFrame) -> DataFrame:
    """Total and user CPU time over threads (total_ns, user_ns)."""
    return threads.agg(F.sum("total_ns").alias("total_ns"), F.sum("user_ns").alias("user_ns"))


def last_samples(samples: DataFrame, n: int = 10) -> DataFrame:
    """The last n samples, oldest first."""
    return samples.orderBy(F.col("ts").desc()).limit(n).orderBy("ts")
