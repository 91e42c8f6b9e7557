"""The catalogue of queries over the driver's tables, each with the SQL that must give the same rows.

E is `events` as a change stream, D is `documents` as a corpus (with a second wave of updates for search), and W is a
search log written from `events` (see sources/adapters.py).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .admin import Admin
from .functions import analysis, scalars
from .model import IngestConfig, MergeConfig
from .operators import liveview, lookup, monitor, postings, reports, search
from .operators.highlight import best_fragment
from .plans import compaction
from .sources import adapters
from .sources.adapters import table
from .streaming.ingest import Consumer, Ingest, MemorySource, Provider, file_stream
from .streaming.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- E: live views and tiers ------------------------------------------------------------------------------------------

E = """WITH size AS (SELECT count(*) AS n FROM events), e AS (
  SELECT (event_id * event_id + 31 * user_id) % greatest(n // 3, 1) AS uid, event_id AS version, event_id AS seq, event_type = 'error' AS is_deleted,
    event_type = 'view' AS is_skip, ts, event_type, value, json_extract_string(props, '$.k')::BIGINT AS k,
    CASE WHEN event_id < n * 6 // 10 THEN 'disk' WHEN event_id < n * 85 // 100 THEN 'A' ELSE 'B' END AS tier
  FROM events, size)
"""
#: The live rows of a condition on e, by one window.
LIVE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY version DESC, seq DESC) AS rn FROM e WHERE NOT is_skip{and_}) WHERE rn = 1 AND NOT is_deleted"
ROW = "uid, version, event_type, round(value, 6) AS value, k"


def _row(df: DataFrame, *more: str) -> DataFrame:
    return df.select("uid", "version", "event_type", F.round("value", 6).alias("value"), "k", *more)


def live_sql(and_: str = "") -> str:
    return LIVE.format(and_=f" AND {and_}" if and_ else "")


@query(f"{E} SELECT {ROW} FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY version DESC, seq DESC) AS rn FROM e) WHERE rn = 1")
def lww_latest(spark, d):
    return _row(liveview.latest(adapters.event_changes(spark, d)))


@query(ORACLE_SQL["lww_latest"])
def lww_window(spark, d):
    return _row(liveview.latest_by_window(adapters.event_changes(spark, d)))


@query(f"{E} SELECT {ROW}, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY version DESC, seq DESC) AS rn FROM e WHERE NOT is_skip) WHERE rn = 1")
def lww_with_skips(spark, d):
    return _row(liveview.latest(liveview.effective(adapters.event_changes(spark, d))), "is_deleted")


@query(f"{E} SELECT {ROW} FROM ({live_sql()})")
def lww_with_deletes(spark, d):
    return _row(liveview.live(adapters.event_changes(spark, d)))


@query(f"{E} SELECT max(version) AS version, max(version) FILTER (NOT is_skip) AS effective_version FROM e")
def version_watermark(spark, d):
    return liveview.watermark(adapters.event_changes(spark, d))


@query(f"{E} SELECT uid, version, rank FROM (SELECT uid, version, row_number() OVER (PARTITION BY uid ORDER BY version, seq)::INT AS rank FROM e)")
def events_in_version_order(spark, d):
    from pyspark.sql import Window

    changes = adapters.event_changes(spark, d)
    return changes.select("uid", "version", F.row_number().over(Window.partitionBy("uid").orderBy("version", "seq")).alias("rank"))


@query(f"{E} SELECT count(*) AS live_docs FROM ({live_sql()})")
def live_doc_count(spark, d):
    return liveview.live(adapters.event_changes(spark, d)).agg(F.count(F.lit(1)).alias("live_docs"))


@query(f"{E} SELECT uid, event_type, k FROM ({live_sql()})")
def scan_live_docs(spark, d):
    return liveview.live(adapters.event_changes(spark, d)).select("uid", "event_type", "k")


@query(f"{E} SELECT uid, version, seq, is_deleted, is_skip, event_type || ':' || coalesce(k::VARCHAR, '') AS content FROM e")
def interpret_projection(spark, d):
    content = F.concat("event_type", F.lit(":"), F.coalesce(F.col("k").cast("string"), F.lit("")))
    return adapters.event_changes(spark, d).select("uid", "version", "seq", "is_deleted", "is_skip", content.alias("content"))


@query(f"{E} SELECT uid, version, doc_ord, CASE doc_ord WHEN 0 THEN event_type ELSE k::VARCHAR END AS doc FROM ({live_sql()}), (SELECT unnest([0, 1])::INT AS doc_ord)")
def multi_doc_per_uid(spark, d):
    changes = adapters.event_changes(spark, d).withColumn("docs", F.array("event_type", F.col("k").cast("string")))
    return liveview.documents(liveview.live(changes)).select("uid", "version", "doc_ord", "doc")


@query(f"{E}, folded AS (SELECT * REPLACE (uid % 50 AS uid) FROM e) SELECT {ROW} FROM ({live_sql().replace(' FROM e ', ' FROM folded ')})")
def looping_uid_mod(spark, d):
    return _row(liveview.live(adapters.looping(adapters.event_changes(spark, d), 50)))


@query(f"{E} SELECT {ROW} FROM ({live_sql("tier = 'disk'")})")
def tier_base_scan(spark, d):
    return _row(liveview.live(liveview.in_tier(adapters.event_changes(spark, d), "disk")))


@query(f"{E} SELECT {ROW} FROM ({live_sql("tier <> 'disk'")})")
def tier_delta_scan(spark, d):
    return _row(liveview.live(liveview.in_tier(adapters.event_changes(spark, d), "A", "B")))


TIERED = f"""{E}, b AS ({live_sql("tier = 'B'")}), a AS ({live_sql("tier = 'A'")}), disk AS ({live_sql("tier = 'disk'")}),
  in_b AS (SELECT DISTINCT uid FROM e WHERE tier = 'B' AND NOT is_skip), in_ab AS (SELECT DISTINCT uid FROM e WHERE tier <> 'disk' AND NOT is_skip),
  seen AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE uid NOT IN (SELECT uid FROM in_b) UNION ALL SELECT * FROM disk WHERE uid NOT IN (SELECT uid FROM in_ab))
"""


@query(f"{TIERED} SELECT {ROW}, tier FROM b UNION ALL SELECT {ROW}, tier FROM a UNION ALL SELECT {ROW}, tier FROM disk")
def tier_union_no_dedup(spark, d):
    return _row(liveview.merged(adapters.event_changes(spark, d), dedup=False), "tier")


@query(f"{TIERED} SELECT {ROW}, tier FROM a WHERE uid IN (SELECT uid FROM in_b) UNION ALL SELECT {ROW}, tier FROM disk WHERE uid IN (SELECT uid FROM in_ab)")
def tier_masked_rows(spark, d):
    changes = adapters.event_changes(spark, d)
    return _row(liveview.hidden(changes, "A").unionByName(liveview.hidden(changes, "disk")), "tier")


@query(f"{TIERED} SELECT uid, version FROM disk WHERE uid IN (SELECT uid FROM in_ab)")
def tier_duplicates(spark, d):
    return liveview.hidden(adapters.event_changes(spark, d), "disk").select("uid", "version")


@query(f"{E} SELECT uid FROM e WHERE tier = 'disk' AND NOT is_skip EXCEPT SELECT uid FROM e WHERE tier <> 'disk' AND NOT is_skip")
def tier_uid_except(spark, d):
    changes = adapters.event_changes(spark, d)
    return liveview.touched(changes, "disk").join(liveview.touched(changes, "A", "B"), "uid", "left_anti")


@query(f"{E} SELECT uid FROM e WHERE tier = 'disk' AND NOT is_skip INTERSECT SELECT uid FROM e WHERE tier <> 'disk' AND NOT is_skip")
def tier_uid_intersect(spark, d):
    changes = adapters.event_changes(spark, d)
    return liveview.touched(changes, "disk").join(liveview.touched(changes, "A", "B"), "uid", "left_semi")


@query(f"{TIERED} SELECT {ROW}, tier FROM seen")
def live_view_tiers(spark, d):
    return _row(liveview.merged(adapters.event_changes(spark, d)), "tier")


@query(f"{TIERED} SELECT tier, count(*) AS docs, sum(version)::BIGINT AS versions FROM seen GROUP BY tier")
def tier_doc_counts(spark, d):
    return liveview.merged(adapters.event_changes(spark, d)).groupBy("tier").agg(F.count(F.lit(1)).alias("docs"), F.sum("version").alias("versions"))


def new_store(spark, **options) -> Store:
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", **options)


@query(
    f"""{TIERED} SELECT 'working' AS state, tier, count(*) AS docs FROM seen GROUP BY tier
    UNION ALL SELECT 'sleep', CASE tier WHEN 'A' THEN 'disk' WHEN 'B' THEN 'A' ELSE tier END AS t, count(*) FROM seen GROUP BY t"""
)
def tier_state_counts(spark, d):
    """A store while a flush works, with three tiers, and after it: A is on disk and B is the new A."""
    changes, store = adapters.event_changes(spark, d), new_store(spark)
    store.append(liveview.in_tier(changes, "disk"))
    store.promote()
    store.append(liveview.in_tier(changes, "A"))
    store.begin_flush()
    store.append(liveview.in_tier(changes, "B"))

    def counts():
        out, state = None, store.manifest().state
        for tier, rows in store.tiers().items():
            own = rows.agg(F.lit(state).alias("state"), F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("docs"))
            out = own if out is None else out.unionByName(own)
        return out

    working = counts()
    store.end_flush()
    return working.unionByName(counts())


@query(f"{E} SELECT uid, arg_max(tier, CASE tier WHEN 'B' THEN 2 WHEN 'A' THEN 1 ELSE 0 END) AS tier FROM e WHERE NOT is_skip GROUP BY uid")
def uid_to_tier(spark, d):
    rank = F.when(F.col("tier") == "B", 2).when(F.col("tier") == "A", 1).otherwise(0)
    return liveview.effective(adapters.event_changes(spark, d)).groupBy("uid").agg(F.max_by("tier", rank).alias("tier"))


@query(ORACLE_SQL["tier_base_scan"])
def batch_mode_view(spark, d):
    """Without realtime reading, only what is on disk is seen."""
    return _row(liveview.live(liveview.in_tier(adapters.event_changes(spark, d), "disk")))


@query(f"{TIERED} SELECT {ROW} FROM seen")
def promote_delta_to_base(spark, d):
    changes = adapters.event_changes(spark, d)
    base = liveview.applied(liveview.live(liveview.in_tier(changes, "disk")), liveview.in_tier(changes, "A"))
    return _row(liveview.applied(base, liveview.in_tier(changes, "B")))


@query(f"{E} SELECT {ROW} FROM ({live_sql("tier <> 'B'")})")
def apply_batch_upsert(spark, d):
    changes = adapters.event_changes(spark, d)
    return _row(liveview.applied(liveview.live(liveview.in_tier(changes, "disk")), liveview.in_tier(changes, "A")))


@query(f"{E} SELECT {ROW} FROM ({live_sql("tier = 'disk'")}) WHERE uid NOT IN (SELECT uid FROM e WHERE tier = 'A' AND is_deleted)")
def apply_batch_delete(spark, d):
    changes = adapters.event_changes(spark, d)
    deletes = liveview.in_tier(changes, "A").where("is_deleted")
    return _row(liveview.applied(liveview.live(liveview.in_tier(changes, "disk")), deletes))


@query(f"{E} SELECT {ROW} FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY version DESC, seq DESC) AS rn FROM e WHERE NOT is_skip) WHERE rn = 1")
def nrt_baseline_view(spark, d):
    """The comparison mode: deletes aren't honoured."""
    return _row(liveview.live(adapters.event_changes(spark, d), honor_deletes=False))


@query(f"{E} SELECT {ROW} FROM ({live_sql("ts <= (SELECT date_trunc('hour', max(ts)) FROM e)")})")
def nrt_throttled_view(spark, d):
    """The view of the last full hour."""
    changes = adapters.event_changes(spark, d)
    tick = changes.agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("tick")).first()["tick"]
    return _row(liveview.live(changes.where(F.col("ts") <= F.lit(str(tick)).cast("timestamp_ntz"))))


@query(f"{E} SELECT least(version // (n // 4), 3) AS batch, count(*) AS events, max(version) AS version, TRUE AS durable FROM e, size GROUP BY ALL")
def flush_batches(spark, d):
    """Batches of changes through an ingest whose batch size is a quarter of them: what each flush made durable."""
    changes, n = adapters.event_changes(spark, d), table(spark, d, "events").count()
    size, store, out = n // 4, new_store(spark), []
    ingest = Ingest(store, lambda rows: rows, IngestConfig(batch_size=size))
    # Two batches a flush; the last one also takes what four quarters leave over.
    starts = [x for k in range(4) for x in (k * size, k * size + size // 2)]
    for low, high in zip(starts, [*starts[1:], n], strict=True):
        ingest.batch(changes.where((F.col("version") >= low) & (F.col("version") < high)))
        m = store.manifest()
        if not m.deltas:
            before = sum(x[1] for x in out)
            out.append((len(out), m.received + 1 - before, m.version, True))
    return spark.createDataFrame(out, "batch long, events long, version long, durable boolean")


@query(f"{E} SELECT {ROW} FROM ({live_sql('version <= (SELECT n // 2 FROM size)')})")
def snapshot_as_of_version(spark, d):
    changes = adapters.event_changes(spark, d)
    return _row(liveview.as_of(changes, table(spark, d, "events").count() // 2))


@query(ORACLE_SQL["snapshot_as_of_version"])
def snapshot_roundtrip(spark, d):
    """The same view, exported from a store as a snapshot and restored into another."""
    root = f"{shared_dir(spark)}/stores-{uuid.uuid4().hex}"
    changes = adapters.event_changes(spark, d)
    first = Store(spark, f"{root}/first")
    first.append(changes.where(F.col("version") <= table(spark, d, "events").count() // 2))
    first.promote()
    first.export(f"{root}/snapshot")
    second = Store(spark, f"{root}/second")
    second.restore(f"{root}/snapshot")
    return _row(second.live())


@query(f"{E} SELECT {ROW} FROM e WHERE false")
def purge_then_empty(spark, d):
    """A store with segments and a delta, purged: its view has columns and no rows, and its folders are gone."""
    changes, store = adapters.event_changes(spark, d), new_store(spark)
    store.append(liveview.in_tier(changes, "disk"))
    store.promote()
    store.append(liveview.in_tier(changes, "A"))
    Admin(store).purge()
    assert not [n for n in store.files.names() if n.startswith(("segment-", "delta-", "deletes-"))]
    return _row(store.view())


@query(
    f"{E}, v AS ({live_sql()}) SELECT stage, count(*) AS docs, sum(version)::BIGINT AS versions FROM v, (SELECT unnest(['flushed', 'merged', 'expunged', 'optimized']) AS stage) GROUP BY stage"
)
def compaction_invariance(spark, d):
    """A store of six segments with deletes between them, merged by policy, expunged and optimised: the view stays."""
    changes, store, n = adapters.event_changes(spark, d), new_store(spark), table(spark, d, "events").count()
    for k in range(6):
        store.append(changes.where((F.col("version") >= k * n // 6) & (F.col("version") < (k + 1) * n // 6)))
        store.promote()
    out = None
    for stage, step in (
        ("flushed", lambda: None), ("merged", lambda: store.merge(MergeConfig(large_segments=3, merge_factor=2))),
        ("expunged", store.expunge), ("optimized", lambda: store.optimize(1)),
    ):
        before = len(store.manifest().segments)
        step()
        assert stage in ("flushed", "expunged") or len(store.manifest().segments) < before
        sums = store.live().agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("docs"), F.sum("version").alias("versions"))
        out = sums if out is None else out.unionByName(sums)
    assert len(store.manifest().segments) == 1 and not store.manifest().deletes
    return out


@query("SELECT event_id // ((SELECT count(*) FROM events) // 4) AS batch, count(*) AS events FROM events GROUP BY batch")
def src_stream_batches(spark, d):
    """`events` as files of a stream, one a micro-batch, appended to a store by a streaming query: the store's deltas."""
    root, n = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", table(spark, d, "events").count()
    events = table(spark, d, "events").select(F.floor(F.col("event_id") / (n // 4)).alias("batch"), F.col("event_id").alias("version"))
    for k in range(-(-n // (n // 4))):
        events.where(F.col("batch") == k).coalesce(1).write.mode("append").json(f"{root}/in")
    store = new_store(spark)
    ingest = Ingest(store, lambda rows: rows.select(F.col("version").alias("uid"), "version", F.col("version").alias("seq"), F.lit(False).alias("is_deleted"), F.lit(False).alias("is_skip"), "batch"), IngestConfig(batch_size=1 << 40))
    ingest.start(file_stream(spark, f"{root}/in", "batch long, version long"), f"{root}/checkpoint").awaitTermination()
    return store.live().groupBy("batch").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT event_id // greatest(n // 4, 1) AS batch, count(*) AS events, min(event_id) AS first, max(event_id) AS last FROM events, (SELECT count(*) AS n FROM events) GROUP BY ALL")
def src_memory_events(spark, d):
    """All events through a memory source, a provider and a consumer with a thread of its own, batched by the provider."""
    size = max(table(spark, d, "events").count() // 4, 1)
    rows = table(spark, d, "events").select("event_id").sort("event_id").toLocalIterator()
    source = MemorySource(spark, "uid long, version long, seq long, is_deleted boolean, is_skip boolean, batch long")
    source.add((r["event_id"], r["event_id"], r["event_id"], False, False, r["event_id"] // size) for r in rows)
    source.end()
    store = new_store(spark)
    consumer = Consumer(Ingest(store, lambda df: df, IngestConfig(realtime_batch_size=size)), source.rows)
    Provider(source.next, consumer.consume, size).start().wait(120)
    consumer.flush(120)
    consumer.stop()
    return store.live().groupBy("batch").agg(F.count(F.lit(1)).alias("events"), F.min("version").alias("first"), F.max("version").alias("last"))


@query(f"{E} SELECT {ROW} FROM e WHERE version > (SELECT n * 9 // 10 FROM size)")
def src_incremental_from_version(spark, d):
    from .streaming.ingest import after_version

    changes = adapters.event_changes(spark, d)
    return _row(after_version(changes, table(spark, d, "events").count() * 9 // 10))


@query("SELECT event_id AS uid, event_id AS version, event_type FROM events")
def src_uid_from_version(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("uid"), F.col("event_id").alias("version"), "event_type")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master, where there is one machine, may leave it unset."""
    import tempfile

    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="livedex-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


# -- D: lookups -------------------------------------------------------------------------------------------------------

D = """WITH d AS (SELECT doc_id AS uid, text AS content, source || '/' || doc_id AS path, lang, source, n_chars, doc_id // 100 AS segment, doc_id % 100 AS local FROM documents),
  offsets AS (SELECT segment, size, coalesce(sum(size) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT segment, max(local) + 1 AS size FROM d GROUP BY segment)),
  numbers AS (SELECT uid, d.segment, local, start + local AS docid FROM d JOIN offsets USING (segment))
"""
PROBES = "probes AS (SELECT unnest([0, 1, 7, 99, 100, 150, 777, 5000000, -3])::BIGINT AS uid)"


def _probes(spark, name="uid"):
    return spark.createDataFrame([(x,) for x in (0, 1, 7, 99, 100, 150, 777, 5000000, -3)], f"{name} long")


@query(f"{D}, {PROBES} SELECT p.uid, coalesce(docid, -1) AS docid FROM probes p LEFT JOIN numbers n USING (uid)")
def uid_to_docid(spark, d):
    return lookup.uid_to_docid(_probes(spark), lookup.doc_numbers(adapters.corpus(spark, d)))


@query(
    f"""{D}, {PROBES}, twice AS (SELECT uid, segment, docid FROM numbers UNION ALL SELECT uid, segment + 1000, docid + 100000 FROM numbers WHERE uid % 10 = 1)
    SELECT p.uid, coalesce(docid, -1) AS docid FROM probes p LEFT JOIN (SELECT uid, arg_max(docid, segment) AS docid FROM twice GROUP BY uid) USING (uid)"""
)
def uid_to_docid_multi(spark, d):
    numbers = lookup.doc_numbers(adapters.corpus(spark, d)).select("uid", "segment", "docid")
    newer = numbers.where(F.col("uid") % 10 == 1).select("uid", (F.col("segment") + 1000).alias("segment"), (F.col("docid") + 100000).alias("docid"))
    return lookup.uid_to_docid(_probes(spark), numbers.unionByName(newer))


@query(f"{D}, {PROBES} SELECT p.uid, CASE WHEN p.uid BETWEEN 50 AND 149 THEN coalesce(docid, -1) ELSE -1 END AS docid FROM probes p LEFT JOIN numbers n USING (uid)")
def uid_range_lookup(spark, d):
    return lookup.uid_range(_probes(spark), lookup.doc_numbers(adapters.corpus(spark, d)), 50, 100)


@query(f"{D}, {PROBES} SELECT p.uid AS docid, coalesce(n.uid, -1) AS uid FROM probes p LEFT JOIN numbers n ON p.uid = n.docid")
def docid_to_uid(spark, d):
    return lookup.docid_to_uid(_probes(spark, "docid"), lookup.doc_numbers(adapters.corpus(spark, d)))


@query(f"{D}, {PROBES} SELECT p.uid AS docid, coalesce(segment, -1) AS segment, coalesce(p.uid - start, -1) AS local FROM probes p LEFT JOIN offsets ON p.uid >= start AND p.uid < start + size")
def docid_to_segment(spark, d):
    return lookup.docid_to_segment(_probes(spark, "docid"), lookup.segment_offsets(adapters.corpus(spark, d)))


@query(f"{D}, {PROBES} SELECT DISTINCT docid FROM probes JOIN numbers USING (uid)")
def uids_to_docids(spark, d):
    probes = _probes(spark)
    return lookup.uids_to_docids(probes.unionByName(probes), lookup.doc_numbers(adapters.corpus(spark, d)))


@query(
    f"""{D}, ids AS (SELECT unnest([3, 42, 123456789])::BIGINT AS id) SELECT 'docid' AS kind, id, coalesce(n.uid, -1) AS other FROM ids LEFT JOIN numbers n ON id = docid
    UNION ALL SELECT 'uid', id, coalesce(n.docid, -1) FROM ids LEFT JOIN numbers n ON id = uid"""
)
def inspect_ids(spark, d):
    numbers = lookup.doc_numbers(adapters.corpus(spark, d))
    text = "3, 42,x,123456789"
    uids = lookup.docid_to_uid(lookup.id_list(spark, text, "docid"), numbers).select(F.lit("docid").alias("kind"), F.col("docid").alias("id"), F.col("uid").alias("other"))
    docids = lookup.uid_to_docid(lookup.id_list(spark, text, "uid"), numbers).select(F.lit("uid").alias("kind"), F.col("uid").alias("id"), F.col("docid").alias("other"))
    return uids.unionByName(docids)


@query("SELECT doc_id AS uid, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def uid_filter(spark, d):
    wanted = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("uid"))
    return lookup.only(adapters.corpus(spark, d), wanted).select("uid", "lang", "source")


@query("SELECT doc_id AS uid, 1.0::DOUBLE AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def uid_constant_score(spark, d):
    wanted = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("uid"))
    return lookup.only(adapters.corpus(spark, d), wanted).select("uid", F.lit(1.0).alias("score"))


@query(f"WITH {PROBES}, missing AS (SELECT uid FROM probes WHERE uid NOT IN (SELECT doc_id FROM documents)) SELECT count(*) = 0 AS contains_all, count(*) AS n_missing FROM missing")
def uid_contains_all(spark, d):
    return lookup.contains_all(_probes(spark), adapters.corpus(spark, d))


@query(f"{D} SELECT docid FROM numbers WHERE docid >= 57 AND uid IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY docid LIMIT 5")
def docidset_advance(spark, d):
    wanted = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("uid"))
    numbers = lookup.only(lookup.doc_numbers(adapters.corpus(spark, d)), wanted)
    return lookup.advance(numbers.select("docid"), 57, 5)


@query(f"{D} SELECT segment, size, start, start + size AS stop FROM offsets")
def segment_offsets(spark, d):
    return lookup.segment_offsets(adapters.corpus(spark, d))


SEGMENTS = f"{D}, s AS (SELECT segment, count(*) AS n_docs, count(*) FILTER (uid % 10 = 0) AS n_deleted, sum(n_chars)::BIGINT AS n_bytes, min(uid) AS min_uid, max(uid) AS max_uid FROM d GROUP BY segment)"


def _segments(spark, d):
    """Documents, deletes of the second wave and characters per segment."""
    return lookup.stats(adapters.corpus(spark, d), F.col("uid") % 10 == 0)


@query(f"{SEGMENTS} SELECT count(*) AS segments, sum(n_docs)::BIGINT AS docs, sum(n_deleted)::BIGINT AS deleted FROM s")
def segment_stats(spark, d):
    return _segments(spark, d).agg(F.count(F.lit(1)).alias("segments"), F.sum("n_docs").alias("docs"), F.sum("n_deleted").alias("deleted"))


@query(f"{SEGMENTS} SELECT segment, min_uid, max_uid FROM s")
def segment_uid_range(spark, d):
    return _segments(spark, d).select("segment", "min_uid", "max_uid")


@query("SELECT doc_id, doc_id + 4294967294 AS uid FROM documents")
def fixture_uid_parse(spark, d):
    text = F.concat(F.lit("alpha even "), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", scalars.fixture_uid(text).alias("uid"))


# -- D: analysis ------------------------------------------------------------------------------------------------------

TOKENS = r"regexp_extract_all(lower(content), '([\p{L}\p{N}]+)')"
SPACED = r"regexp_extract_all(content, '([^\x20\x09-\x0D]+)')"
STOPPED = f"list_filter({TOKENS}, lambda t: NOT list_contains([{', '.join(repr(w) for w in analysis.STOP_WORDS)}], t))"


def _counts(df: DataFrame, tokens) -> DataFrame:
    return df.select("uid", tokens.alias("t")).select("uid", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def counts_sql(tokens: str) -> str:
    return f"{D} SELECT uid, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT uid, {tokens} AS t FROM d)"


@query(counts_sql(STOPPED))
def analyze_standard(spark, d):
    return _counts(adapters.corpus(spark, d), analysis.standard(F.col("content")))


@query(counts_sql(SPACED))
def analyze_whitespace(spark, d):
    return _counts(adapters.corpus(spark, d), analysis.whitespace(F.col("content")))


@query(counts_sql(f"CASE WHEN uid % 2 = 1 THEN {SPACED} ELSE {STOPPED} END"))
def analyze_per_doc(spark, d):
    docs = adapters.corpus(spark, d)
    return _counts(docs, analysis.analyzed(F.col("content"), F.when(F.col("uid") % 2 == 1, "whitespace")))


@query(f"{D} SELECT uid, lang AS term, 1::BIGINT AS tf FROM d WHERE lang IS NOT NULL")
def analyze_keyword(spark, d):
    return adapters.corpus(spark, d).select("uid", F.explode(analysis.keyword(F.col("lang"))).alias("term"), F.lit(1).cast("long").alias("tf"))


POSTINGS = f"{D}, p AS (SELECT uid, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT uid, {TOKENS} AS t FROM d))"


@query(f"{POSTINGS} SELECT term, uid, count(*) AS tf, min(pos) AS first_pos, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY term, uid")
def build_postings(spark, d):
    return analysis.postings(adapters.corpus(spark, d), analysis.terms(F.col("content"))).withColumn("positions", F.array_join("positions", ","))


_BUILT: dict[tuple[str, str], str] = {}


def stored_index(spark, d, which: str) -> str:
    """The index of the corpus, or of the live documents after the second wave, built once a session."""
    key = (spark.sparkContext.applicationId, d + which)
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/index-{which}-{uuid.uuid4().hex}"
        postings.build({"corpus": adapters.corpus, "live": adapters.updated_corpus}[which](spark, d), path, 16)
        _BUILT[key] = path
    return _BUILT[key]


@query(f"{POSTINGS} SELECT uid, count(*) AS tf FROM p WHERE term = 'the' GROUP BY uid")
def postings_term_docs(spark, d):
    """One term's documents, from its bucket of the stored index."""
    return postings.documents(spark, stored_index(spark, d, "corpus"), "the", 16).select("uid", "tf")


@query(f"{POSTINGS} SELECT uid, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p WHERE term = 'of' GROUP BY uid")
def postings_positions(spark, d):
    return postings.documents(spark, stored_index(spark, d, "corpus"), "of", 16).select("uid", F.array_join("positions", ",").alias("positions"))


@query(f"{POSTINGS} SELECT term, count(DISTINCT uid) AS df FROM p GROUP BY term ORDER BY df DESC, term LIMIT 50")
def term_doc_freq(spark, d):
    return analysis.document_frequencies(adapters.corpus(spark, d), analysis.terms(F.col("content"))).orderBy(F.col("df").desc(), "term").limit(50)


@query(f"{POSTINGS} SELECT term, count(DISTINCT uid) AS df FROM p GROUP BY term HAVING count(DISTINCT uid) * 100 >= (SELECT count(*) FROM d) ORDER BY term LIMIT 10000")
def frequent_terms(spark, d):
    docs = adapters.corpus(spark, d)
    found = analysis.document_frequencies(docs, analysis.terms(F.col("content")))
    return found.where(F.col("df") * 100 >= table(spark, d, "documents").count()).orderBy("term").limit(10_000)


# -- D after the second wave: search ----------------------------------------------------------------------------------

S = f"""WITH s AS (SELECT doc_id AS uid, CASE WHEN doc_id % 10 = 1 THEN 'updated ' || text ELSE text END AS content, source || '/' || doc_id AS path, lang, source,
    CASE WHEN doc_id % 10 = 1 THEN 'A' ELSE 'disk' END AS tier FROM documents WHERE doc_id % 10 <> 0),
  t AS (SELECT *, {TOKENS} AS toks FROM s)"""


def word(w: str) -> str:
    return f"len(list_filter(toks, lambda x: x = '{w}'))"


def some(test: str) -> str:
    return f"(len(list_filter(toks, lambda x: {test})) > 0)::INT"


def search_sql(leaves: list[tuple[str, float, bool]], where: str, extra: str = "") -> str:
    """Scores of leaves (frequency, boost, whether it has a length norm) for the rows of a condition on tf0, tf1 ..."""
    n = range(len(leaves))
    tfs = ", ".join(f"{tf} AS tf{k}" for k, (tf, _, _) in enumerate(leaves))
    idfs = ", ".join(f"1 + ln(count(*)::DOUBLE / (count(*) FILTER (tf{k} > 0) + 1)) AS idf{k}" for k in n)
    scoring = [k for k in n if leaves[k][1]]
    part = lambda k: f"CASE WHEN tf{k} > 0 THEN {f'sqrt(tf{k}::DOUBLE) / sqrt(length::DOUBLE)' if leaves[k][2] else '1.0'} * idf{k} ** 2 * {leaves[k][1]} ELSE 0 END"
    total, matched = " + ".join(map(part, scoring)), " + ".join(f"(tf{k} > 0)::INT" for k in scoring)
    norm = " + ".join(f"(idf{k} * {leaves[k][1]}) ** 2" for k in scoring)
    return f"""{S}, f AS (SELECT uid, path, lang, source, tier, content, len(toks) AS length, {tfs} FROM t), i AS (SELECT {idfs} FROM f),
    hits AS (SELECT uid, path, lang, source, tier, content, round(({matched}) / {len(scoring)}.0::DOUBLE * ({total}) / sqrt({norm}), 6) AS score FROM f, i WHERE {where}){extra or ' SELECT uid, score FROM hits'}"""


TEXTS: dict[str, str | None] = {}


def searching(name: str, text: str | None, sql: str) -> None:
    """A key that gives uid and score of every hit of a query."""

    def run(spark, d):
        return search.matches(adapters.updated_corpus(spark, d), text)

    run.__name__, run.__doc__ = name, f"Hits of {text!r}."
    query(sql)(run)
    TEXTS[name] = text


FROM_WITH = [(word("from"), 1.0, True), (word("with"), 1.0, True)]
OF_THE = "len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' AND toks[i + 1] = 'the'))"
searching("search_match_all", "", f"{S} SELECT uid, 1.0::DOUBLE AS score FROM s")
searching("search_term", "the", search_sql([(word("the"), 1.0, True)], "tf0 > 0"))
searching("search_or_terms", "from with", search_sql(FROM_WITH, "tf0 > 0 OR tf1 > 0"))
searching("search_and_terms", "from AND with", search_sql(FROM_WITH, "tf0 > 0 AND tf1 > 0"))
searching("search_not_term", "from NOT with", search_sql([(word("from"), 1.0, True), (word("with"), 0.0, True)], "tf0 > 0 AND tf1 = 0"))
searching("search_field_qualified", "lang:en", search_sql([("(lower(lang) = 'en')::INT", 1.0, False)], "tf0 > 0"))
searching("search_required_optional", "+from with", search_sql(FROM_WITH, "tf0 > 0"))
searching("search_phrase", '"of the"', search_sql([(OF_THE, 1.0, True)], "tf0 > 0"))
searching("search_prefix", "thr*", search_sql([(some("starts_with(x, 'thr')"), 1.0, False)], "tf0 > 0"))
searching("search_wildcard", "th?s", search_sql([(some("regexp_full_match(x, 'th.s')"), 1.0, False)], "tf0 > 0"))
searching("search_fuzzy", "thir~1", search_sql([(some("levenshtein(x, 'thir') <= 1"), 1.0, False)], "tf0 > 0"))
searching("search_term_range", "[tha TO the]", search_sql([(some("x >= 'tha' AND x <= 'the'"), 1.0, False)], "tf0 > 0"))
searching("search_boost", "from^2.5 with", search_sql([(word("from"), 2.5, True), (word("with"), 1.0, True)], "tf0 > 0 OR tf1 > 0"))
searching("search_score_tfidf", "updated the of", search_sql([(word("updated"), 1.0, True), (word("the"), 1.0, True), (word("of"), 1.0, True)], "tf0 > 0 OR tf1 > 0 OR tf2 > 0"))


def searching_index(name: str) -> None:
    """The same hits and scores as a search over texts gives, from the stored index."""
    text = TEXTS[name]

    def run(spark, d):
        return postings.matches(spark, stored_index(spark, d, "live"), text, 16)

    run.__name__, run.__doc__ = name.replace("search_", "index_", 1), f"Hits of {text!r}."
    query(ORACLE_SQL[name])(run)


for _name in list(TEXTS):
    searching_index(_name)

BEST = " SELECT uid, score FROM hits ORDER BY score DESC, uid LIMIT 10"


@query(search_sql(FROM_WITH, "tf0 > 0 OR tf1 > 0", BEST))
def search_topk(spark, d):
    return search.top(search.matches(adapters.updated_corpus(spark, d), "from with"))


@query(search_sql(FROM_WITH, "tf0 > 0 OR tf1 > 0", " SELECT count(*) AS total_hits FROM hits"))
def search_total_hits(spark, d):
    return search.matches(adapters.updated_corpus(spark, d), "from with").agg(F.count(F.lit(1)).alias("total_hits"))


@query(search_sql(FROM_WITH, "tf0 > 0 OR tf1 > 0", " SELECT tier, count(*) AS hits FROM hits GROUP BY tier"))
def search_hits_by_tier(spark, d):
    return search.matches(adapters.updated_corpus(spark, d), "from with", keep=("tier",)).groupBy("tier").agg(F.count(F.lit(1)).alias("hits"))


@query(search_sql(FROM_WITH, "tf0 > 0 OR tf1 > 0", " SELECT uid, score, path, split_part(path, '/', 2) AS name, lang FROM hits ORDER BY score DESC, uid LIMIT 10"))
def search_stored_fields(spark, d):
    live = adapters.updated_corpus(spark, d)
    best = search.with_fields(search.top(search.matches(live, "from with")), live, ["path", "lang"])
    return best.select("uid", "score", "path", scalars.basename(F.col("path")).alias("name"), "lang")


HIGHLIGHT = r"""(?i)(^|[^\p{L}\p{N}])(from|with)([^\p{L}\p{N}]|$)"""


@query(
    search_sql(
        FROM_WITH, "tf0 > 0 OR tf1 > 0",
        f""", best AS (SELECT * FROM hits ORDER BY score DESC, uid LIMIT 10),
    parts AS (SELECT uid, k, replace(substr(content, k * 100 + 1, 100), ' ', '  ') AS part FROM (SELECT *, unnest(range(greatest(ceil(length(content) / 100.0)::INT, 1))) AS k FROM best)),
    rated AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY len(regexp_extract_all(part, '{HIGHLIGHT}', 2)) DESC, k) AS rn FROM parts)
    SELECT uid, replace(regexp_replace(part, '{HIGHLIGHT}', '\\1<span class="hl">\\2</span>\\3', 'g'), '  ', ' ') AS fragment FROM rated WHERE rn = 1""",
    )
)
def search_highlight(spark, d):
    live = adapters.updated_corpus(spark, d)
    best = search.with_fields(search.top(search.matches(live, "from with")), live, ["content"])
    return best.select("uid", best_fragment(F.col("content"), ["from", "with"]).alias("fragment"))


# -- sources and projections ------------------------------------------------------------------------------------------


@query("SELECT doc_id AS uid, replace(replace(text, chr(9), ' '), chr(10), ' ') AS content FROM documents WHERE NOT starts_with(lower(text), 'the ')")
def src_content_filter(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.col("text").alias("content"))
    return adapters.clean_content(docs, "content", skipped_prefixes=("the ",))


@query("SELECT c_custkey AS uid, 'name=' || c_name || '|segment=' || c_mktsegment || '|nation=' || c_nationkey AS fields FROM customer")
def src_table_to_documents(spark, d):
    fields = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")}
    return adapters.row_documents(table(spark, d, "customer"), F.col("c_custkey"), fields)


@query("SELECT source || '/' || doc_id AS path, source || '/' || doc_id || chr(10) || text AS content, 'bar' AS foo FROM documents")
def file_doc_projection(spark, d):
    files = table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    return adapters.file_documents(files).select("path", "content", "foo")


@query("SELECT o_orderkey AS uid, o_orderpriority AS title, o_orderstatus AS body, strftime(o_orderdate, '%d-%b-%Y %H:%M:%S.') || lpad((date_part('millisecond', o_orderdate)::BIGINT % 1000)::VARCHAR, 3, '0') AS date_text FROM orders")
def wiki_doc_projection(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("body"), F.col("o_orderdate").alias("date"))
    return adapters.content_documents(rows).select("uid", "title", "body", "date_text")


@query(
    """SELECT uid, name, value FROM (SELECT o_orderkey AS uid, unnest(['title', 'body', 'status', 'customer']) AS name,
    unnest([CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, 'text ' || o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END, o_custkey::VARCHAR]) AS value FROM orders) WHERE value IS NOT NULL"""
)
def wiki_doc_fields(spark, d):
    """Fields of documents by name, with dynamic ones, without null ones."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("title"), F.concat(F.lit("text "), F.col("o_orderkey").cast("string")).alias("body"),
        F.lit(None).cast("timestamp").alias("date"), F.create_map(F.lit("status"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), F.lit("customer"), F.col("o_custkey").cast("string")).alias("props"),
    )
    return adapters.content_documents(rows).select("uid", F.explode("fields").alias("name", "value"))


@query("SELECT event_id, strftime(ts, '%d-%b-%Y %H:%M:%S.000') AS text, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS back FROM events")
def scalar_date_format(spark, d):
    text = scalars.iso_to_text(F.col("ts"))
    back = F.date_format(F.to_timestamp(text, "dd-MMM-yyyy HH:mm:ss.SSS"), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select("event_id", text.alias("text"), back.alias("back"))


@query("SELECT doc_id, uid, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS hash FROM (SELECT doc_id, uid, ((xor(uid >> 32, uid) & 4294967295)::HUGEINT * 2147482951 % 4294967296)::BIGINT AS h FROM (SELECT doc_id, doc_id * 1000003 + 4294967294 AS uid FROM documents))")
def scalar_uid_hash(spark, d):
    uid = F.col("doc_id") * 1000003 + F.lit(4294967294)
    return table(spark, d, "documents").select("doc_id", uid.alias("uid"), scalars.uid_hash(uid).alias("hash"))


@query(
    "SELECT doc_id, " + " || ".join(f"lpad(lower(to_hex((uid >> {8 * k}) & 255)), 2, '0')" for k in range(8)) + " AS bytes, uid AS back FROM (SELECT doc_id, doc_id * 1000003 + 4294967294 AS uid FROM documents)"
)
def scalar_uid_bytes(spark, d):
    raw = scalars.uid_bytes(F.col("doc_id") * 1000003 + F.lit(4294967294))
    return table(spark, d, "documents").select("doc_id", raw.alias("bytes"), scalars.bytes_uid(raw).alias("back"))


@query("SELECT doc_id + copy * (SELECT count(*) FROM documents) AS uid, source, lang FROM documents, (SELECT unnest([0, 1, 2]) AS copy)")
def replicate_corpus(spark, d):
    docs = table(spark, d, "documents")
    n = docs.count()
    copies = docs.select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))
    return copies.select((F.col("doc_id") + F.col("copy") * n).alias("uid"), "source", "lang")


# -- W: monitoring and logs -------------------------------------------------------------------------------------------

W = """WITH w AS (SELECT event_id AS n, date_trunc('second', ts) AS ts, event_type AS query, json_extract_string(props, '$.k')::BIGINT AS hits, floor(value)::BIGINT AS ms FROM events)"""


def log_lines(spark, d) -> DataFrame:
    """The search log as text: a time line and a record line for every event."""
    events = table(spark, d, "events")
    at = F.date_format("ts", "MMM d, yyyy h:mm:ss a")
    hits = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    line = F.concat(
        at, F.lit(" client subTransaction"), F.col("event_id").cast("string"), F.lit("\nINFO: TIME-TAKEN: q:"), "event_type", F.lit(": "), hits, F.lit(" : "), F.floor("value").cast("string")
    )
    return events.select(line.alias("line"))


def records(spark, d) -> DataFrame:
    return reports.client_records(log_lines(spark, d))


@query(f"{W} SELECT n, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, query, hits, ms FROM w")
def log_parse(spark, d):
    return records(spark, d).select("n", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "query", "hits", "ms")


@query(
    f"""{W} SELECT 'second' AS unit, strftime(ts, '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n, round(avg(ms), 6) AS avg_ms, round(avg(hits), 6) AS avg_hits FROM w GROUP BY ALL
    UNION ALL SELECT 'hour', strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S'), count(*), round(avg(ms), 6), round(avg(hits), 6) FROM w GROUP BY ALL"""
)
def log_avg_per_second(spark, d):
    rows = records(spark, d)
    of = lambda unit: reports.averages(rows, F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd HH:mm:ss")).select(F.lit(unit).alias("unit"), "bucket", "n", "avg_ms", "avg_hits")
    return of("second").unionByName(of("hour"))


@query(f"{W} SELECT count(ms) AS n, min(ms) AS min, max(ms) AS max, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS median, round(stddev_samp(ms), 6) AS stddev, round(quantile_cont(ms, 0.9), 6) AS p90 FROM w")
def log_summary_stats(spark, d):
    return reports.summary(records(spark, d), "ms")


@query(
    f"""{W}, m AS (SELECT count(*) AS n, sum(hits)::BIGINT AS total_hits, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE / 60 AS m FROM w)
    SELECT n, total_hits, floor(m * 1000) / 1000 AS minutes, floor(n / (m * 60) * 1000) / 1000 AS per_second, floor(n / m * 1000) / 1000 AS per_minute FROM m"""
)
def log_throughput(spark, d):
    return reports.throughput(records(spark, d))


@query(
    """WITH f AS (SELECT event_id // 50 AS n, max(ts) AS ts, count(*) AS flushed, sum(floor(value))::BIGINT + 1 AS ms FROM events GROUP BY 1),
    g AS (SELECT *, lag(ts) OVER (ORDER BY ts, n) AS before FROM f) SELECT n, (epoch_us(ts) - epoch_us(before)) // 1000 AS fill_ms, round(flushed * 1000 / ms, 6) AS rate FROM g WHERE before IS NOT NULL"""
)
def log_flush_lag(spark, d):
    flushes = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 50).alias("n")).agg(F.max("ts").cast("timestamp").alias("ts"), F.count(F.lit(1)).alias("flushed"), (F.sum(F.floor("value")) + 1).alias("ms"))
    return reports.flush_lag(flushes)


@query("SELECT event_id, event_type AS query FROM events ORDER BY md5(event_id::VARCHAR), event_id::VARCHAR LIMIT 100")
def log_query_mix(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("query"))
    return reports.query_mix(rows, 100, F.col("event_id").cast("string"))


@query(
    f"""{W}, r AS (SELECT * FROM w ORDER BY ts DESC, n DESC LIMIT 10000) SELECT count(*) AS n, round(avg(ms), 6) AS avg_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.9), 6) AS p90_ms,
    round(quantile_cont(ms, 0.99), 6) AS p99_ms, round(quantile_cont(hits, 0.9), 6) AS p90_hits FROM r"""
)
def monitor_latency_stats(spark, d):
    return monitor.latency_stats(records(spark, d))


@query(f"{W} SELECT n, round(avg(ms) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling_ms FROM w")
def monitor_rolling_avg(spark, d):
    return monitor.rolling_average(records(spark, d), 10, F.date_trunc("day", "ts"))


@query(f"{W}, s AS (SELECT ts, count(*) AS n FROM w GROUP BY ts) SELECT count(*) AS seconds, max(n) AS most, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.99), 6) AS p99 FROM s")
def monitor_qps_percentile(spark, d):
    return monitor.qps_percentile(records(spark, d), 0.5, 0.99)


@query(f"{W}, r AS (SELECT * FROM w WHERE ts >= TIMESTAMP '2024-01-10') SELECT count(*) AS n, round(count(*) * 60000 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::DOUBLE), 6) AS per_minute FROM r")
def monitor_queries_per_minute(spark, d):
    return monitor.per_minute(records(spark, d), F.lit("2024-01-10 00:00:00").cast("timestamp"))


@query("SELECT count(*) AS n, round(count(*) * 60000 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::DOUBLE), 6) AS per_minute FROM events")
def events_per_minute(spark, d):
    return monitor.per_minute(table(spark, d, "events"))


@query(
    """WITH b AS (SELECT event_id // 1000 AS batch, count(*) AS docs, sum(floor(value))::BIGINT AS ms, count(*) FILTER (event_type = 'error') AS left_over FROM events GROUP BY 1)
    SELECT arg_max(docs, batch) AS last_docs, arg_max(ms, batch) AS last_ms, arg_max(left_over, batch) AS last_left_over, sum(docs)::BIGINT AS total_docs, round(sum(ms) / sum(docs), 6) AS ms_per_doc FROM b"""
)
def indexing_batch_stats(spark, d):
    batches = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("batch")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.floor("value")).alias("ms"), F.sum((F.col("event_type") == "error").cast("long")).alias("left_over")
    )
    return monitor.batch_stats(batches)


@query("SELECT event_id, round(value, 6) AS value FROM events ORDER BY value, event_id LIMIT 20")
def topk_smallest(spark, d):
    return table(spark, d, "events").orderBy("value", "event_id").limit(20).select("event_id", F.round("value", 6).alias("value"))


# -- maintenance ------------------------------------------------------------------------------------------------------


def _sizes(spark, d):
    size = F.when(F.col("n_docs") > 0, F.col("n_bytes") * (1 - F.col("n_deleted") / F.col("n_docs"))).otherwise(0.0)
    return _segments(spark, d).withColumn("size", size)


SIZED = f"{SEGMENTS}, z AS (SELECT *, n_bytes * (1 - n_deleted / n_docs) AS size FROM s)"


@query(f"{SIZED} SELECT segment, round(size, 6) AS size FROM z")
def segment_effective_size(spark, d):
    return _sizes(spark, d).select("segment", F.round("size", 6).alias("size"))


@query(f"{SIZED} SELECT round(sum((size / even - 1) ** 2), 6) AS variance FROM z, (SELECT avg(size) AS even FROM z)")
def merge_variance(spark, d):
    sizes = _sizes(spark, d)
    even = sizes.agg(F.avg("size").alias("even"))  # one row
    return sizes.join(F.broadcast(even)).agg(F.round(F.sum(F.pow(F.col("size") / F.col("even") - 1, 2)), 6).alias("variance"))


@query(f"{SEGMENTS} SELECT segment, n_deleted FROM s WHERE n_deleted > 0")
def expunge_candidates(spark, d):
    return _segments(spark, d).where("n_deleted > 0").select("segment", "n_deleted")


@query(f"{SEGMENTS} SELECT segment, n_deleted FROM s WHERE n_deleted > 0 AND segment < 10 ORDER BY n_deleted DESC, segment DESC LIMIT 1")
def partial_expunge_candidate(spark, d):
    return _segments(spark, d).where("n_deleted > 0 AND segment < 10").orderBy(F.col("n_deleted").desc(), F.col("segment").desc()).limit(1).select("segment", "n_deleted")


#: A manifest of eighteen segments, whatever the corpus: eight large ones and ten small ones, and another of sixteen alike.
MANIFEST = """WITH n AS (SELECT count(*) AS n FROM documents), placed AS (
    SELECT doc_id, CASE WHEN doc_id * 10 < n * 9 THEN doc_id * 80 // (n * 9) ELSE 8 + least((doc_id * 10 - n * 9) * 10 // n, 9) END AS uneven, doc_id * 16 // n AS alike FROM documents, n),
  u AS (SELECT uneven AS k, (1000000 + 100 * uneven * uneven) * (count(*) FILTER (doc_id % 10 <> 0))::DOUBLE AS size FROM placed GROUP BY uneven),
  a AS (SELECT alike AS k, (1000000 + 100 * alike * alike) * (count(*) FILTER (doc_id % 10 <> 0))::DOUBLE AS size FROM placed GROUP BY alike),
  even AS (SELECT sum(size) / 13 AS even FROM a WHERE k < 14),
  joined AS (SELECT x.k, (((x.size + y.size) / even - 1) ** 2) - ((x.size / even - 1) ** 2) - ((y.size / even - 1) ** 2) AS cost FROM a x JOIN a y ON y.k = x.k + 1 AND y.k < 14, even),
  runs AS (SELECT 'promote' AS plan, k AS first, k + 1 AS last FROM (SELECT k FROM joined ORDER BY cost, k LIMIT 1)
    UNION ALL SELECT 'promote', 14, 15 UNION ALL SELECT 'crowded', 8, 17 UNION ALL SELECT 'by size', 8, 12 UNION ALL SELECT 'by size', 13, 17)
SELECT plan, first, last, last - first + 1 AS segments, round((SELECT sum(size) FROM (SELECT 'promote' AS p, * FROM a UNION ALL SELECT 'u', * FROM u) z
  WHERE (z.p = 'promote') = (plan = 'promote') AND z.k BETWEEN first AND last), 3) AS size FROM runs"""


@query(MANIFEST)
def merge_plan(spark, d):
    """The three ways of the merge policy: small segments promoted to a large one, too many of them, and neighbours of one size."""
    docs, n = table(spark, d, "documents").select("doc_id"), table(spark, d, "documents").count()
    uneven = F.when(F.col("doc_id") * 10 < n * 9, F.floor(F.col("doc_id") * 80 / (n * 9))).otherwise(8 + F.least(F.floor((F.col("doc_id") * 10 - n * 9) * 10 / n), F.lit(9)))

    def manifest(place):
        rows = docs.groupBy(place.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("doc_id") % 10 == 0, 1)).alias("gone")).orderBy("k").collect()  # a row a segment, eighteen at most
        return [compaction.Segment(str(r["k"]), r["n"], r["gone"], r["n"] * (1_000_000 + 100 * r["k"] ** 2)) for r in rows]

    first, second = manifest(uneven), manifest(F.floor(F.col("doc_id") * 16 / n))
    out = []
    for plan, segments, config in (
        ("promote", second, MergeConfig(large_segments=14)), ("crowded", first, MergeConfig(large_segments=8, small_segments=12)), ("by size", first, MergeConfig(large_segments=8, merge_factor=5)),
    ):
        for run in compaction.merges(segments, config):
            out.append((plan, int(run[0].name), int(run[-1].name), len(run), round(sum(s.size for s in run), 3)))
    return spark.createDataFrame(out, "plan string, first long, last long, segments long, size double")


@query(f"{W}, t AS (SELECT count(*) AS n, sum(ms) AS ms FROM w) SELECT n AS transactions, n + 3 AS executions, n AS successful, 3::BIGINT AS failed, 12.5::DOUBLE AS minutes, floor(n / 750.0::DOUBLE * 1000) / 1000 AS per_second, floor(n / 12.5::DOUBLE * 1000) / 1000 AS per_minute FROM t")
def log_totals(spark, d):
    """What a client's last lines say, read from log files together with its records."""
    n = table(spark, d, "events").count()
    said = [f"INFO: TOTAL TRANSACTIONS: {n}", f"INFO: TOTAL EXECUTIONS: {n + 3}", f"INFO: TOTAL SUCCESSFUL EXECUTIONS: {n}", "INFO: TOTAL FAILED EXECUTIONS: 3", "INFO: TOTAL RUNTIME IN MINS: 12.5"]
    path = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"
    log_lines(spark, d).unionByName(spark.createDataFrame([(x,) for x in said], "line string")).write.text(path)
    return reports.total_throughput(spark.read.text(path).withColumnRenamed("value", "line"))


@query(ORACLE_SQL["log_parse"])
def log_parse_files(spark, d):
    """The same records from log files as a client writes them, two lines each."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    log_lines(spark, d).write.text(path)
    return reports.client_records(reports.client_log(spark, path)).select("n", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "query", "hits", "ms")
