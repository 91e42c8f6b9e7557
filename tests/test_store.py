"""The store, ingest and search service: invariants of live views."""

import random

import pytest
from pyspark.sql import functions as F

from livedex.admin import Admin
from livedex.functions import scalars
from livedex.model import IngestConfig, SearchRequest
from livedex.operators import liveview
from livedex.operators.search import SearchService, matches
from livedex.streaming.ingest import Ingest, MemorySource, file_stream, file_tree, split_bad
from livedex.streaming.store import Store

SCHEMA = "uid long, version long, seq long, is_deleted boolean, is_skip boolean, content string"


def changes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def words(spark, name, first, n=10):
    return changes(spark, [(k, first + k, first + k, False, False, f"{name} {'even' if k % 2 else 'odd'} {k}") for k in range(n)])


def hits(view, text):
    rows = view.select("uid", "content").withColumn("lang", F.lit("x")).withColumn("source", F.lit("x"))
    return matches(rows, text).count()


def test_random_streams_equal_the_closed_form(spark, tmp_path):
    r = random.Random(11)
    for round_ in range(2):
        store, all_rows, state, version = Store(spark, str(tmp_path / f"s{round_}")), [], {}, 0
        for _ in range(5):
            batch = []
            for _ in range(r.randint(1, 25)):
                version += r.randint(0, 1)
                row = (r.randint(0, 12), version, len(all_rows) + len(batch), r.random() < 0.25, r.random() < 0.2, f"t{len(all_rows) + len(batch)}")
                batch.append(row)
            for uid, v, _, deleted, skip, content in batch:
                if not skip:
                    state.pop(uid, None)
                    if not deleted:
                        state[uid] = (v, content)
            all_rows += batch
            store.append(changes(spark, batch))
            step = r.choice(("none", "promote", "compact"))
            if step == "promote":
                store.promote()
            elif step == "compact":
                store.compact(2)
            view = {x["uid"]: (x["version"], x["content"]) for x in store.live().collect()}
            assert view == state
            assert store.manifest().received == max(x[1] for x in all_rows)
        closed = {x["uid"] for x in liveview.live(changes(spark, all_rows)).collect()}
        assert closed == set(state)


def test_updates_replace_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(words(spark, "alpha", 0))
    assert (hits(store.live(), "alpha"), hits(store.live(), "beta")) == (10, 0)
    store.append(words(spark, "beta", 10))
    assert (hits(store.live(), "alpha"), hits(store.live(), "beta")) == (0, 10)


def test_durable_version_and_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(words(spark, "alpha", 0, 5))
    assert store.manifest().version == -1
    assert store.promote().version == 4
    store.append(words(spark, "alpha", 0))
    assert store.promote().version == 9
    store.export(str(tmp_path / "snap"))
    store.append(words(spark, "beta", 10))
    assert store.promote().version == 19 and hits(store.live(), "alpha") == 0
    assert store.restore(str(tmp_path / "snap")).version == 9 and hits(store.live(), "alpha") == 10
    with pytest.raises(FileNotFoundError):
        store.restore(str(tmp_path / "nothing"))


def test_pinned_reader_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(words(spark, "alpha", 0))
    pin = store.pin()
    old = store.live(pin.number)
    store.append(words(spark, "beta", 10))
    store.promote()
    store.vacuum()
    assert hits(old, "alpha") == 10
    store.unpin(pin)
    gone = store.vacuum()
    assert any(n.startswith("delta-") for n in gone) and hits(store.live(), "beta") == 10
    Admin(store).purge()
    assert store.live() is None and store.stats().first()["base_rows"] == 0


def test_batches_that_come_again_are_ignored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), realtime=False)
    store.append(words(spark, "alpha", 0), batch_id=0)
    number = store.append(words(spark, "beta", 10), batch_id=0).number
    assert number == 1 and store.live() is None  # without realtime nothing is seen before promotion
    store.promote()
    assert hits(store.live(), "alpha") == 10


def test_stream_to_store(spark, tmp_path):
    for k in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(f'{{"version": {k * 5 + i}, "payload": "alpha even {i}"}}' for i in range(5)))
    seen = []

    def interpret(rows):
        good, _ = split_bad(rows, F.col("payload").isNotNull())
        uid = scalars.fixture_uid(F.col("payload"))
        return good.select(uid.alias("uid"), "version", F.col("version").alias("seq"), F.lit(False).alias("is_deleted"), F.lit(False).alias("is_skip"), F.col("payload").alias("content"))

    store = Store(spark, str(tmp_path / "s"))
    ingest = Ingest(store, interpret, IngestConfig(batch_size=8), seen.append)
    ingest.start(file_stream(spark, str(tmp_path / "in"), "version long, payload string"), str(tmp_path / "cp")).awaitTermination()
    ingest.wait_for(19, 1)
    assert sum(x["docs"] for x in seen) == 20 and len(seen) == 4 and store.live().count() == 5
    assert store.live().agg(F.min("uid")).first()[0] == 4294967294
    with pytest.raises(TimeoutError):
        ingest.wait_for(99, 0.2)


def test_memory_source(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    source = MemorySource(spark, SCHEMA)
    source.add([(k, k, k, False, False, f"w{k}") for k in range(7)])
    source.drain(Ingest(store, lambda df: df), batch_size=3)
    assert source.count == 7 and source.batches == 3 and store.live().count() == 7


def test_file_tree(spark, tmp_path):
    (tmp_path / "t" / "b").mkdir(parents=True)
    (tmp_path / "t" / "b" / "x.txt").write_text("x")
    (tmp_path / "t" / "a.txt").write_text("a")
    rows = file_tree(spark, str(tmp_path / "t")).orderBy("version").collect()
    assert [(r["text"], r["version"]) for r in rows] == [("a", 0), ("x", 1)]


def test_analyzer_per_document(spark):
    from livedex.functions import analysis

    docs = spark.createDataFrame([(4294967294, "john,wang 0", None), (4294967295, "john,wang 1", "whitespace")], "uid long, content string, analyzer string")
    rows = docs.select("uid", F.explode(analysis.analyzed(F.col("content"), F.col("analyzer"))).alias("term"))
    found = lambda t: [r["uid"] for r in rows.where(F.col("term") == t).collect()]
    assert found("john,wang") == [4294967295] and found("john") == [4294967294]


def test_search_service(spark):
    live = spark.createDataFrame([(1, "the red fox", "p/1", "en", "s"), (2, "a red red hen", "p/2", "en", "s"), (3, "blue", "p/3", "fr", "s")], "uid long, content string, path string, lang string, source string")
    service = SearchService(lambda: live)
    out = service.search(SearchRequest("red"))
    assert (out.total_hits, out.total_docs) == (2, 3) and [h.fields["uid"] for h in out.hits] == [["2"], ["1"]]
    assert out.hits[1].fields["fragment"] == ['the <span class="hl">red</span> fox']
    assert service.search(SearchRequest(None)).total_hits == 3
    assert hits(live, "red -hen") == 1 and hits(live, '"red hen"~1') == 1 and hits(live, '"red fox"') == 1
