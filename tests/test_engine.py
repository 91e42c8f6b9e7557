"""The whole system, the stored index, similarities and reports on written lines."""

from pyspark.sql import functions as F

from livedex.engine import Engine, nothing
from livedex.functions.scoring import SIMILARITIES
from livedex.model import IngestConfig, SearchRequest
from livedex.operators import monitor, postings, reports, search
from livedex.sources import adapters


def test_engine(spark, tmp_path):
    def interpret(rows):
        return rows.select(
            "uid", "version", F.col("version").alias("seq"), F.col("text").isNull().alias("is_deleted"), F.lit(False).alias("is_skip"), F.col("text").alias("content"),
            F.concat(F.lit("p/"), F.col("uid").cast("string")).alias("path"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
        )

    e = Engine(spark, str(tmp_path / "e"), interpret, IngestConfig(batch_size=4), decorators=(lambda df: df.where("uid <> 99"),))
    rows = lambda *r: spark.createDataFrame(list(r), "uid long, version long, text string")
    e.consume(rows((1, 0, "red fox"), (2, 1, "red hen"), (99, 2, "red secret")))
    assert e.search(SearchRequest("red")).total_hits == 2 and e.store.manifest().version == -1
    with e.reading() as old:
        e.consume(rows((1, 3, None), (3, 4, "red red")))
        e.store.vacuum()
        assert old.count() == 2
    assert e.store.manifest().version == 4  # enough had come, so it was promoted
    e.sync(4, 1)
    hits = e.search(SearchRequest("red")).hits
    assert [h.fields["uid"] for h in hits] == [["3"], ["2"]]
    line = e.timed("w", SearchRequest("red"))
    record = reports.client_records(spark.createDataFrame([(f"Jan 2, 2024 3:04:05 PM x subTransaction7\n{line}",)], "line string")).first()
    assert (record["n"], record["query"], record["hits"]) == (7, "red", 2)
    assert e.timed("w", SearchRequest("(")).startswith("FAILURE-INFO: w:(:")
    assert len(e.events) == 2 and Engine(spark, str(tmp_path / "e"), nothing).batches == 2


def test_stored_index_scores_as_token_arrays_do(spark, sf_dir, tmp_path):
    live = adapters.updated_corpus(spark, sf_dir)
    postings.build(live, str(tmp_path / "i"), buckets=8)
    for words in (["from", "with"], ["the"], ["nosuchword", "of"]):
        a = {r["uid"]: r["score"] for r in search.matches(live, " ".join(words)).collect()}
        b = {r["uid"]: r["score"] for r in postings.matches(spark, str(tmp_path / "i"), words, 8).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 2e-6 for k in a)
    plan = postings.matches(spark, str(tmp_path / "i"), ["the"], 8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    hidden = live.where("uid % 2 = 1").select("uid")
    rest = postings.matches(spark, str(tmp_path / "i"), ["the"], 8, hidden)
    assert rest.where("uid % 2 = 1").count() == 0
    assert abs(rest.agg(F.sum("score")).first()[0] - search.matches(live.where("uid % 2 = 0"), "the").agg(F.sum("score")).first()[0]) < 1e-3


def test_similarities(spark):
    live = spark.createDataFrame([(1, "a a b", "x", "y"), (2, "a", "x", "y")], "uid long, content string, lang string, source string")
    scores = lambda name: {r["uid"]: r["score"] for r in search.matches(live, "a b", similarity=SIMILARITIES[name]).collect()}
    assert scores("constant")[1] == 2 * scores("constant")[2]
    assert scores("classic")[1] != scores("binary")[1]


def test_log_lines(spark):
    lines = spark.createDataFrame([
        ("2024/01/02 03:04:05.678 INFO [MonitoredService] search: numSearchResults=5] done in 12ms",),
        ("2024/01/02 03:04:06.000 INFO [MonitoredService] search: numSearchResults=7;numTotalDocs=9] done in 3ms",),
        ("2024/01/02 03:04:07.000 INFO [RealtimeIndexDataLoader] flushed batch of 10 to disk: 250, left: 4",),
        ("something else",),
    ], "line string")
    assert [(r["hits"], r["ms"]) for r in reports.server_records(lines).orderBy("ts").collect()] == [(5, 12), (7, 3)]
    assert [(r["flushed"], r["ms"], r["left_over"]) for r in reports.flush_records(lines).collect()] == [(10, 250, 4)]


def test_monitor_and_sources(spark):
    rows = spark.createDataFrame([(k, k * 10) for k in range(20)], "ts long, total_ns long").withColumn("user_ns", F.col("total_ns") / 2)
    assert [r["ts"] for r in monitor.last_samples(rows).collect()] == list(range(10, 20))
    assert monitor.cpu_sums(rows).first()["total_ns"] == 1900
    assert adapters.source_counts(spark.createDataFrame([("a", 3), ("b", 4)], "path string, bytes long")).first() == (2, 7)
    pages = spark.createDataFrame([("Image: x", "pic"), ("t", "#REDIRECT y"), ("u", "a\tb\nc")], "title string, body string")
    assert [r["body"] for r in adapters.clean_content(pages, "body", title="title").collect()] == ["a b c"]


def test_content_dump(spark, tmp_path):
    from livedex.streaming.ingest import content_dump

    page = "<page><title>{}</title><id>{}</id><timestamp>2024-01-02T03:04:05Z</timestamp><text>{}</text></page>"
    (tmp_path / "d.xml").write_text("<dump>" + page.format("A", 1, "one\ttwo\nthree") + page.format("B", 2, "#REDIRECT A") + page.format("Image:C", 3, "x") + "</dump>")
    rows = content_dump(spark, str(tmp_path / "d.xml")).collect()
    assert [(r["id"], r["title"], r["body"]) for r in rows] == [(1, "A", "one two three")] and str(rows[0]["date"]) == "2024-01-02 03:04:05"
    nested = """<mediawiki><page><title>{}</title><ns>0</ns><id>{}</id>{}</page></mediawiki>"""
    revision = '<revision><id>7</id><timestamp>2024-01-02T03:04:05Z</timestamp><contributor><username>u</username><id>9</id></contributor><text xml:space="preserve" bytes="3">{}</text></revision>'
    (tmp_path / "n.xml").write_text(nested.format("A", 1, revision.format("one &lt;b&gt;")) + nested.format("B", 2, revision.format("#redirect x")))
    rows = content_dump(spark, str(tmp_path / "n.xml")).collect()
    assert [(r["id"], r["title"], r["body"]) for r in rows] == [(1, "A", "one <b>")] and str(rows[0]["date"]) == "2024-01-02 03:04:05"
