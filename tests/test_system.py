"""Segments and merges in a store, sources with threads, admin objects, engine extension points and the stored index."""

import datetime as dt
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from livedex.admin import Admin, Optimizer, ProviderAdmin, ScheduleAdmin
from livedex.engine import Engine, LoadTest, Throttled
from livedex.model import IngestConfig, MergeConfig, SearchRequest
from livedex.operators import liveview, lookup, monitor, postings, reports, search
from livedex.plans import query_parser as qp
from livedex.sources import adapters
from livedex.streaming import ingest as ing
from livedex.streaming.store import Store

SCHEMA = "uid long, version long, seq long, is_deleted boolean, is_skip boolean, content string"


def rows(spark, first, n=10, deleted=False, word="alpha", uid=0):
    return spark.createDataFrame([(uid + k, first + k, first + k, deleted, False, f"{word} {k}") for k in range(n)], SCHEMA)


def test_a_flush_writes_its_batch_and_no_more(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(rows(spark, 0, 500))
    store.promote()
    before = {n for n in store.files.names() if n.startswith("segment-")}
    store.append(rows(spark, 500, 3))
    m = store.promote()
    new = [s for s in m.segments if s["name"] not in before]
    assert len(m.segments) == 2 and [s["docs"] for s in new] == [3] and store.spark.read.parquet(f"{store.root}/{m.deletes[0]['name']}").count() == 3
    assert [s.deleted for s in store.segments()] == [3, 0] and store.live().count() == 500
    assert store.expunge().deletes == [] and [s.docs for s in store.segments()] == [497, 3] and store.live().count() == 500


def test_merges_by_policy_keep_the_view(spark, tmp_path):
    r, state, version = random.Random(3), {}, 0
    store = Store(spark, str(tmp_path / "s"), merging=MergeConfig(large_segments=2, merge_factor=2, partial_expunge=True))
    sizes = []
    for _ in range(7):
        batch = []
        for _ in range(12):
            uid, deleted = r.randint(0, 30), r.random() < 0.2
            batch.append((uid, version, version, deleted, False, f"t{version}"))
            state.pop(uid, None)
            if not deleted:
                state[uid] = f"t{version}"
            version += 1
        store.append(spark.createDataFrame(batch, SCHEMA))
        sizes.append(len(store.promote().segments))
        assert {x["uid"]: x["content"] for x in store.live().collect()} == state
    assert max(sizes) <= 4 and store.manifest().version == version - 1
    store.optimize(1)
    assert len(store.manifest().segments) == 1 and {x["uid"]: x["content"] for x in store.live().collect()} == state
    closed = store.segments()[0]
    assert closed.docs == len(state) and closed.deleted == 0


def test_tiers_while_a_flush_works(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(rows(spark, 0))
    assert store.manifest().state == "sleep" and list(store.tiers()) == ["A"]
    store.begin_flush()
    store.append(rows(spark, 10, 4, word="beta"))
    m = store.manifest()
    assert m.state == "working" and m.pending == 4 and {k: v.count() for k, v in store.tiers().items()} == {"A": 6, "B": 4}
    m = store.end_flush()
    assert m.state == "sleep" and (m.version, m.received) == (9, 13) and {k: v.count() for k, v in store.tiers().items()} == {"disk": 6, "A": 4}
    assert store.live().count() == 10


def test_pins_hold_for_other_processes(spark, tmp_path):
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    store.append(rows(spark, 0))
    pin = store.pin()
    other.append(rows(spark, 10, deleted=True))
    other.promote()
    other.vacuum()
    assert store.live(pin.number).count() == 10
    store.unpin(pin)
    assert any(n.startswith("delta-") for n in other.vacuum())
    other.purge()
    assert other.view().columns == rows(spark, 0).columns and other.view().count() == 0


@pytest.mark.parametrize(("batch", "delay_ms"), [(1, 0), (100, 10), (1000, 0), (10, 100)])
def test_every_event_is_delivered(spark, tmp_path, batch, delay_ms):
    """A thousand events through provider, consumer and ingest, whatever the batch size and the delay."""
    seen = []

    settings = IngestConfig(realtime_batch_size=batch, max_batch_size=max(batch, 50))

    class Into:
        config = settings

        def batch(self, part):
            time.sleep(delay_ms / 1000)
            seen.append(part)

        def flush(self):
            pass

    consumer = ing.Consumer(Into(), list, linger_s=0.01)
    source = ing.MemorySource(spark, "n long")
    provider = ing.Provider(source.next, consumer.consume, 10).start()
    source.add((k,) for k in range(1000))
    source.flush(30)
    source.end()
    provider.wait(30)
    consumer.flush(30)
    consumer.stop()
    assert [x for part in seen for x in part] == [(k,) for k in range(1000)] and max(map(len, seen)) > 1 and max(map(len, seen)) <= max(batch, 50) + 10
    with pytest.raises(RuntimeError):
        consumer.consume([(1,)])


def test_producers_wait_while_too_much_is_buffered():
    go, seen = threading.Event(), []

    class Slow:
        config = IngestConfig(realtime_batch_size=1, max_batch_size=5)

        def batch(self, part):
            go.wait(30)
            seen.append(len(part))

        def flush(self):
            pass

    consumer = ing.Consumer(Slow(), list, linger_s=0.0)
    consumer.consume([(0,)])
    time.sleep(0.1)
    consumer.consume([(k,) for k in range(50)])  # there is room, so all of it is taken
    blocked = threading.Thread(target=consumer.consume, args=([(1,)],))
    blocked.start()
    blocked.join(0.2)
    assert blocked.is_alive()
    with pytest.raises(TimeoutError):
        consumer.flush(0.05)
    go.set()
    blocked.join(30)
    consumer.flush(30)
    consumer.stop()
    assert sum(seen) == 52


def test_a_failed_batch_is_told(spark):
    class Bad:
        config = IngestConfig(realtime_batch_size=1)

        def batch(self, part):
            raise ValueError("bad")

    consumer = ing.Consumer(Bad(), list)
    consumer.consume([(1,)])
    with pytest.raises(RuntimeError):
        consumer.flush(10)


def test_provider_controls():
    now, slept, out, n = [0.0], [], [], [0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    def following():
        n[0] += 1
        return (n[0],) if n[0] <= 25 else None

    provider = ing.Provider(following, out.append, 4, per_minute=10, clock=lambda: now[0], sleep=sleep)
    admin = ProviderAdmin(provider)
    admin.set_batch_size(5)
    admin.start()
    provider.wait(10)
    assert [len(x) for x in out] == [5] * 5 and slept == [60.0, 60.0] and admin.stats()["events"] == 25 and admin.stats()["status"] == "ended"
    endless = ing.Provider(lambda: (1,), lambda batch: time.sleep(0.001))
    admin = ProviderAdmin(endless)
    admin.start()
    admin.pause()
    time.sleep(0.2)
    held = endless.count
    time.sleep(0.1)
    assert admin.stats()["status"] == "paused" and endless.count <= held + 1
    admin.set_max_events_per_minute(None)
    admin.resume()
    time.sleep(0.1)
    admin.stop()
    assert endless.count > held and admin.stats()["status"] == "ended"
    loops = [0]

    def again():
        loops[0] += 1
        n[0] = 20

    n[0] = 20
    looping = ing.Provider(following, out.append, 1, again=again)
    looping.start()
    time.sleep(0.2)
    looping.stop()
    assert loops[0] > 1


def test_polling_goes_on_from_the_last_version(spark, tmp_path):
    there, slept = [rows(spark, 0, 3)], []
    store = Store(spark, str(tmp_path / "s"))

    def read(version):
        out = there[0]
        for more in there[1:]:
            out = out.unionByName(more)
        return ing.after_version(out, version)

    poll = ing.Poll(read, ing.Ingest(store, lambda df: df), sleep=slept.append)
    poll.run(2)
    there.append(rows(spark, 3, 4, uid=3))
    poll.run(2)
    assert store.live().count() == 7 and poll.version == 6 and slept == [1.0, 1.0] and len(store.manifest().deltas) == 2
    poll.version = -1
    poll.reset()
    assert poll.version == 6
    options = ing.jdbc_options("mysql", "db", "x", "SELECT * FROM t WHERE v > {version}", 6)
    assert "6" in options["query"]


def test_delay_is_looked_at_between_batches(spark, tmp_path):
    now = [time.time()]
    store = Store(spark, str(tmp_path / "s"))
    ingest = ing.Ingest(store, lambda df: df, IngestConfig(batch_size=100, batch_delay_ms=60_000), clock=lambda: now[0])
    ingest.batch(rows(spark, 0))
    ingest.tick()
    assert store.manifest().version == -1 and not ingest.due()
    assert ing.Ingest(Store(spark, str(tmp_path / "s")), lambda df: df).store.manifest().pending == 10  # known after a restart
    now[0] += 61
    ingest.tick()
    assert store.manifest().version == 9


def test_flush_of_a_running_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(f'{{"uid": {k}, "version": {k}}}' for k in range(5)))
    store = Store(spark, str(tmp_path / "s"))
    full = lambda df: df.select("uid", "version", F.col("version").alias("seq"), F.lit(False).alias("is_deleted"), F.lit(False).alias("is_skip"), F.lit("x").alias("content"))
    ingest = ing.Ingest(store, full)
    query = ingest.start(ing.file_stream(spark, str(tmp_path / "in"), "uid long, version long"), str(tmp_path / "cp"), 100)
    ingest.flush(60)
    assert store.manifest().version == 4
    query.stop()


def test_optimisation_by_schedule(spark, tmp_path):
    store, merge = Store(spark, str(tmp_path / "s")), MergeConfig(large_segments=2, merge_factor=2)
    for k in range(4):
        store.append(rows(spark, 10 * k, 5, uid=4 * k))
        store.promote()
    schedule = ing.Schedule("FULL")
    optimizer, admin = Optimizer(store, merge, schedule), ScheduleAdmin(schedule)
    assert [optimizer.run(dt.datetime(2024, 1, d, h)) for d, h in ((1, 5), (2, 2))] == ["NONE", "FULL"]
    assert len(store.manifest().segments) == 2 and not store.manifest().deletes and store.live().count() == 17
    admin.set_kind("PARTIAL")
    admin.set_time(dt.time(3))
    assert admin.next(dt.datetime(2024, 1, 3, 2)) == dt.datetime(2024, 1, 3, 3)
    with pytest.raises(ValueError):
        admin.set_kind("SOMETIMES")


def test_admin(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    admin = Admin(store, ing.Ingest(store, lambda df: df))
    assert admin.last_modified() is None and admin.status() == "sleep" and admin.tier_stats().count() == 0
    store.append(rows(spark, 0))
    admin.flush()
    store.append(rows(spark, 10, 2))
    assert {r["tier"]: (r["docs"], r["version"]) for r in admin.tier_stats().collect()} == {"disk": (8, 9), "A": (2, 11)}
    assert admin.pending() == 2 and admin.segment_count() == 1 and admin.index_dir() == store.root and admin.last_modified() is not None
    admin.set_merge(merge_factor=3, partial_expunge=True)
    admin.set_batch(size=7, delay_ms=8, most=9)
    assert store.merging.merge_factor == 3 and (admin.config.batch_size, admin.config.batch_delay_ms, admin.config.max_batch_size) == (7, 8, 9)
    with pytest.raises(AttributeError):
        admin.set_merge(nothing=1)
    admin.optimize(1)
    assert admin.segment_count() == 1 and admin.last_optimized and store.live().count() == 10


def interpret(df):
    return df.select(
        "uid", "version", F.col("version").alias("seq"), F.col("text").isNull().alias("is_deleted"), F.lit(False).alias("is_skip"), F.col("text").alias("content"),
        F.lit("p").alias("path"), F.lit("en").alias("lang"), F.lit("s").alias("source"),
    )


def test_empty_engine_and_extension_points(spark, tmp_path):
    merged = []

    def merger(tiers):
        merged.append(len(tiers))
        out = tiers[0]
        for t in tiers[1:]:
            out = out.unionByName(t.select(*out.columns))
        return out

    e = Engine(spark, str(tmp_path / "e"), interpret, merger=merger, mapper=lambda docs: lookup.doc_numbers(docs).withColumn("docid", F.col("docid") + 1000))
    out = e.search(SearchRequest("red"))
    assert (out.total_hits, out.total_docs, out.hits) == (0, 0, [])
    e.consume(spark.createDataFrame([(k, k, "red fox" if k else None) for k in range(4)], "uid long, version long, text string"))
    e.ingest.flush()
    e.consume(spark.createDataFrame([(9, 9, "red hen")], "uid long, version long, text string"))
    assert e.search(SearchRequest("red", 2)).total_hits == 4 and max(merged) == 2
    assert e.search(SearchRequest("nothing")).hits == []
    assert {r["uid"]: r["docid"] for r in e.numbers().collect()} == {1: 1001, 2: 1002, 3: 1003, 9: 1009}
    test = LoadTest(e)
    test.begin()
    test.run(["red", "fox"])
    test.end()
    assert test.stats()["n"] == 2 and test.stats()["p90_ms"] >= 0
    assert monitor.latency_stats(e.metrics()).first()["n"] == 5


def test_throttled_views_keep_three_generations(spark, tmp_path):
    now, store = [0.0], Store(spark, str(tmp_path / "s"))
    views = Throttled(store, 1000, clock=lambda: now[0])
    counts = []
    for k in range(6):
        store.append(rows(spark, 10 * k, 1, uid=k))
        counts.append(views.view().count())
        now[0] += 0.5
    assert counts == [1, 1, 3, 3, 5, 5]
    for k in range(6, 10):
        store.append(rows(spark, 10 * k, 1, uid=k))
        now[0] += 1
        views.view()
    assert len(store.pinned()) == 3


def test_phrases_and_fields_from_the_index(spark, tmp_path):
    r = random.Random(7)
    live = spark.createDataFrame([(k, " ".join(r.choice("abcd") for _ in range(r.randint(0, 12))), r.choice(["en", "fr", None]), "s") for k in range(60)] + [(100, None, "en", "s")], "uid long, content string, lang string, source string")
    postings.build(live, str(tmp_path / "i"), 4)
    for text in ('"a b"', '"a b c"', '"a a"~2', '"a b"~1 -c', "a AND b", "lang:en", "+a lang:fr^2", "[b TO c]", "a* NOT d", "b~1", "?", "", "-a", "lang:e*", '"zz b"', "a OR zz"):
        try:
            a = {x["uid"]: x["score"] for x in search.matches(live, text).collect()}
        except qp.QueryError:
            with pytest.raises(qp.QueryError):
                postings.matches(spark, str(tmp_path / "i"), text, 4)
            continue
        b = {x["uid"]: x["score"] for x in postings.matches(spark, str(tmp_path / "i"), text, 4).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 2e-6 for k in a), text
    brute = {x["uid"] for x in live.collect() if "a b c" in (x["content"] or "")}
    assert {x["uid"] for x in search.matches(live, '"a b c"').collect()} == brute
    plan = search.matches(live, '"a b"')._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_client_logs_as_they_are(spark, tmp_path):
    lines = []
    for k in range(300):
        lines += [f"Jan {k % 28 + 1}, 2024 3:04:0{k % 10} PM x.y subTransaction{k}", f"INFO: TIME-TAKEN: w:lang:en q{k} é: {k} : {2 * k}"]
        lines += ["noise", f"INFO: TIME-TAKEN: w:lost: {k} : 1"] if k % 7 == 0 else []
    lines += ["INFO: TOTAL TRANSACTIONS: 300", "INFO: TOTAL RUNTIME IN MINS: 2.5"]
    (tmp_path / "client.log").write_text("\n".join(lines) + "\n")
    got = sorted((r["n"], r["query"], r["hits"], r["ms"]) for r in reports.client_records(reports.client_log(spark, str(tmp_path / "client.log"))).collect())
    assert got == [(k, f"lang:en q{k} é", k, 2 * k) for k in range(300)]
    total = reports.total_throughput(spark.read.text(str(tmp_path / "client.log")).withColumnRenamed("value", "line")).first()
    assert (total["transactions"], total["failed"], total["per_second"], total["per_minute"]) == (300, None, 2.0, 120.0)


def test_client_logs_in_several_files(spark, tmp_path):
    """Lines stand at equal places of all files, which are read in several splits each; a second line alone is no record."""
    def record(f, k):
        return f"Jan 1, 2024 3:04:05 PM x.y subTransaction{f}{k:05}\nINFO: TIME-TAKEN: w:q{f}: {k} : {f}\n"

    for f in range(5):
        (tmp_path / f"part {f}.log").write_text("".join(record(f, k) for k in range(10000, 14000)))
    (tmp_path / "part 5.log").write_text("n" * len("Jan 1, 2024 3:04:05 PM x.y subTransaction010000") + "\nINFO: TIME-TAKEN: w:lost: 1 : 1\n")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", "50000")
    try:
        got = sorted((r["n"], r["query"], r["hits"], r["ms"]) for r in reports.client_records(reports.client_log(spark, str(tmp_path))).collect())
        splits = spark.sparkContext.newAPIHadoopFile(str(tmp_path), "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text").getNumPartitions()
    finally:
        conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    assert splits > 20
    assert got == [(100000 * f + k, f"q{f}", k, f) for f in range(5) for k in range(10000, 14000)]


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for k in range(3):
        (tmp_path / "t" / f"{k}.txt").write_text("x" * (k + 1))
    twice = ing.file_tree(spark, str(tmp_path / "t"), rounds=2).collect()
    assert sorted(r["version"] for r in twice) == list(range(6))
    counter = adapters.SourceCounter()
    counter.add(ing.file_tree(spark, str(tmp_path / "t")))
    counter.reset()
    counter.add(ing.file_tree(spark, str(tmp_path / "t")))
    assert (counter.docs, counter.bytes, counter.total_docs, counter.total_bytes) == (3, 6, 6, 12)
    (tmp_path / "q.txt").write_text("a b\n\n c \n")
    assert [r["query"] for r in adapters.query_file(spark, str(tmp_path / "q.txt")).collect()] == ["a b", "c"]
    changes = rows(spark, 0)
    assert liveview.live(changes).count() == 10
    offsets = lookup.segment_offsets(spark.createDataFrame([(k * 5000, 9) for k in range(20)], "segment long, local long"))
    assert [(r["segment"], r["start"], r["stop"]) for r in offsets.orderBy("segment").collect()] == [(k * 5000, 10 * k, 10 * k + 10) for k in range(20)]
