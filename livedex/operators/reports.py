"""Log analytics: lines to records by patterns, records to reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Client lines: a time line with a running number, and a line with word, query, hits and milliseconds (fixed formats).
CLIENT_TIME = r"^(\w{3} \d{1,2}, \d{4} \d{1,2}:\d{2}:\d{2} [AP]M) .*subTransaction(\d+)"
CLIENT_TAKEN = r"INFO: TIME-TAKEN: (\w+):(.*): (\d+) : (\d+)"
#: What a client writes at its end, each before a number (fixed formats).
TOTALS = {
    "transactions": "INFO: TOTAL TRANSACTIONS:", "executions": "INFO: TOTAL EXECUTIONS:", "successful": "INFO: TOTAL SUCCESSFUL EXECUTIONS:",
    "failed": "INFO: TOTAL FAILED EXECUTIONS:", "minutes": "INFO: TOTAL RUNTIME IN MINS:",
}
#: Server lines; the number of all documents may follow the number of results.
SERVER = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) INFO \[[^\]]*Service\] .*numSearchResults=(\d+)(?:;numTotalDocs=\d+)?\].*in (\d+)ms"
#: Flush lines of either loader.
FLUSH = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d{3}) INFO \[(?:Batched|Realtime)IndexDataLoader\] .*batch of (\d+)[^:]*: (\d+)[^:]*: (\d+)"


def client_log(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a client's log files: a record's two lines, the time line and the one after it, joined by a newline.

    Lines come with their file and their place in it, and a line's successor is the one of that file that starts where it
    ends; so records are whole wherever files are split, and lines are never brought into one order.
    """
    sc, hadoop = spark.sparkContext, "org.apache.hadoop"
    rows = sc.newAPIHadoopFile(path, f"{hadoop}.mapreduce.lib.input.TextInputFormat", f"{hadoop}.io.LongWritable", f"{hadoop}.io.Text")
    lines = rows.map(lambda r: (r[0], r[0] + len(r[1].encode()) + 1, r[1].rstrip("\r"))).toDF("start long, end long, line string")
    lines = lines.withColumn("file", F.input_file_name())
    first = lines.where(F.col("line").rlike(CLIENT_TIME)).select("file", F.col("end").alias("start"), F.col("line").alias("first"))
    second = lines.where(F.col("line").rlike("^" + CLIENT_TAKEN)).select("file", "start", F.col("line").alias("second"))
    return first.join(second, ["file", "start"]).select(F.concat_ws("\n", "first", "second").alias("line"))


def totals(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row: what a client's last lines say, null where there is none."""
    number = F.regexp_extract(line, r"(\S+)\s*$", 1)
    return lines.agg(*[F.max(F.when(F.startswith(F.col(line), F.lit(start)), number)).cast("double" if name == "minutes" else "long").alias(name) for name, start in TOTALS.items()])


def total_throughput(lines: DataFrame) -> DataFrame:
    """Transactions a second and a minute by the totals, cut to three decimals."""
    cut = lambda x: F.floor(x * 1000) / 1000
    out = totals(lines)
    return out.select(*TOTALS, cut(F.col("transactions") / (F.col("minutes") * 60)).alias("per_second"), cut(F.col("transactions") / F.col("minutes")).alias("per_minute"))


def client_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """ts, n, word, query, hits, ms of records of two lines joined by a newline; other lines are left out."""
    rows = lines.where(F.col(line).rlike(CLIENT_TAKEN))
    part = lambda pattern, k: F.regexp_extract(line, pattern, k)
    return rows.select(
        F.to_timestamp(part(CLIENT_TIME, 1), "MMM d, yyyy h:mm:ss a").alias("ts"), part(CLIENT_TIME, 2).cast("long").alias("n"), part(CLIENT_TAKEN, 1).alias("word"),
        part(CLIENT_TAKEN, 2).alias("query"), part(CLIENT_TAKEN, 3).cast("long").alias("hits"), part(CLIENT_TAKEN, 4).cast("long").alias("ms"),
    )


def server_records(lines: DataFrame, line: str = "line") -> DataFrame:
    part = lambda k: F.regexp_extract(line, SERVER, k)
    return lines.where(F.col(line).rlike(SERVER)).select(F.to_timestamp(part(1), "yyyy/MM/dd HH:mm:ss.SSS").alias("ts"), part(2).cast("long").alias("hits"), part(3).cast("long").alias("ms"))


def flush_records(lines: DataFrame, line: str = "line") -> DataFrame:
    part = lambda k: F.regexp_extract(line, FLUSH, k)
    return lines.where(F.col(line).rlike(FLUSH)).select(
        F.to_timestamp(part(1), "yyyy/MM/dd HH:mm:ss.SSS").alias("ts"), part(2).cast("long").alias("flushed"), part(3).cast("long").alias("ms"), part(4).cast("long").alias("left_over")
    )


def averages(records: DataFrame, bucket: Column) -> DataFrame:
    """Mean time and results in each bucket of time."""
    return records.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.round(F.avg("hits"), 6).alias("avg_hits"))


def summary(records: DataFrame, column: str) -> DataFrame:
    """Count, extremes, mean, median, standard deviation and 90th percentile."""
    return records.agg(
        F.count(column).alias("n"), F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.avg(column), 6).alias("mean"),
        F.round(F.percentile(column, F.lit(0.5)), 6).alias("median"), F.round(F.stddev_samp(column), 6).alias("stddev"), F.round(F.percentile(column, F.lit(0.9)), 6).alias("p90"),
    )


def throughput(records: DataFrame) -> DataFrame:
    """Transactions, minutes between first and last, and transactions a second and a minute, cut to three decimals."""
    minutes = (F.max("ts").cast("double") - F.min("ts").cast("double")) / 60
    out = records.agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("total_hits"), minutes.alias("m"))
    cut = lambda x: F.floor(x * 1000) / 1000
    return out.select("n", "total_hits", cut(F.col("m")).alias("minutes"), cut(F.col("n") / (F.col("m") * 60)).alias("per_second"), cut(F.col("n") / F.col("m")).alias("per_minute"))


def flush_lag(records: DataFrame) -> DataFrame:
    """Time to fill of each flush (since the one before) and rows a second; the first gives nothing.

    Flushes are numbered, so the one before comes by an equi-join, and no task has to see them all.
    """
    before = records.select((F.col("n") + 1).alias("n"), F.col("ts").alias("before"))
    fill = F.unix_micros("ts") - F.unix_micros("before")
    return records.join(before, "n").select("n", F.floor(fill / 1000).alias("fill_ms"), F.round(F.col("flushed") * 1000 / F.col("ms"), 6).alias("rate"))


def query_mix(queries: DataFrame, draws: int, key: Column) -> DataFrame:
    """A repeatable workload: the `draws` rows that come first by a hash."""
    return queries.orderBy(F.md5(key), key).limit(draws)
