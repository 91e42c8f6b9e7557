"""Micro-batch ingest into a store, sources with a version to resume from, barriers and schedules."""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import IngestConfig
from .store import Store

Interpreter = Callable[[DataFrame], DataFrame]


def split_bad(rows: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """Rows that can be interpreted, and a dead letter box of the others."""
    good = F.coalesce(ok, F.lit(False))
    return rows.where(good), rows.where(~good)


class Ingest:
    """Interprets batches of rows, appends them to a store, and flushes when enough has come or waited long enough.

    What waits is in the store's manifest, so it is known after a restart.  Spark's checkpoint replays a batch after a
    failure, and the store ignores one it has, so each batch counts once.
    """

    def __init__(self, store: Store, interpret: Interpreter, config: IngestConfig | None = None, listener: Callable[[dict], None] | None = None, clock=time.time):
        self.store, self.interpret, self.config, self.clock = store, interpret, config or IngestConfig(), clock
        self.listeners = [listener] if listener else []
        self.lock, self.query = threading.RLock(), None

    def batch(self, rows: DataFrame, batch_id: int | None = None) -> None:
        began = time.monotonic()
        with self.lock:
            before = self.store.manifest().number
            m = self.store.append(self.interpret(rows), batch_id)
            n = m.deltas[-1]["docs"] if m.number > before else 0
            self.tick()
            left = self.store.manifest().pending
        for listener in self.listeners:
            listener({"docs": n, "ms": (time.monotonic() - began) * 1000, "left_over": left, "version": m.received})

    def due(self) -> bool:
        """Whether enough changes wait, or the first of them for long enough."""
        m = self.store.manifest()
        waiting = m.deltas[m.flushing :]
        return bool(waiting) and (m.pending >= self.config.batch_size or (self.clock() - waiting[0]["at"]) * 1000 >= self.config.batch_delay_ms)

    def tick(self) -> None:
        """Flushes if that is due; a running query is looked at between its batches too."""
        with self.lock:
            if self.due():
                self.store.promote()

    def flush(self, timeout_s: float | None = None) -> None:
        """What the running query's source has now is read and flushed; TimeoutError if reading takes longer."""
        if self.query is not None and self.query.isActive:
            reading = threading.Thread(target=self.query.processAllAvailable, daemon=True)
            reading.start()
            reading.join(timeout_s)
            if reading.is_alive():
                raise TimeoutError(f"the source isn't read to its end within {timeout_s} s")
        with self.lock:
            self.store.promote()

    def start(self, stream: DataFrame, checkpoint: str, interval_ms: int | None = None):
        """Starts the query; without an interval it takes what is there and ends."""
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if interval_ms is None else writer.trigger(processingTime=f"{interval_ms} milliseconds")).start()
        self.query = query

        def watch() -> None:
            while query.isActive:
                time.sleep(min(1.0, max(0.05, self.config.batch_delay_ms / 4000)))
                self.tick()

        threading.Thread(target=watch, daemon=True).start()
        return query

    def wait_for(self, version: int, timeout_s: float, poll_s: float = 0.1) -> None:
        """Blocks until the store has seen a version."""
        end = time.monotonic() + timeout_s
        while self.store.manifest().received < version:
            if time.monotonic() > end:
                raise TimeoutError(f"version {version} hasn't come within {timeout_s} s")
            time.sleep(poll_s)


class Consumer:
    """A buffer between producers of events and an ingest, drained by a thread of its own.

    Producers wait while `max_batch_size` events or more are buffered; a collection that comes when there is room is taken
    whole, however large.  The thread passes on what there is as soon as it is `realtime_batch_size`, the oldest event has
    waited for `linger_s`, or a flush or the end is asked for.
    """

    def __init__(self, ingest: Ingest, rows: Callable[[list[tuple]], DataFrame], config: IngestConfig | None = None, linger_s: float = 0.1):
        self.ingest, self.rows, self.config, self.linger_s = ingest, rows, config or ingest.config, linger_s
        self.buffer: list[tuple] = []
        self.changed, self.taken, self.done, self.hurry, self.ended, self.error = threading.Condition(), 0, 0, False, False, None
        self.batches: list[int] = []  # sizes, for statistics
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def consume(self, events: Iterable[tuple]) -> None:
        events = list(events)
        with self.changed:
            self.changed.wait_for(lambda: len(self.buffer) < self.config.max_batch_size or self.ended or self.error)
            if self.ended or self.error:
                raise RuntimeError("the consumer has ended") from self.error
            self.buffer += events
            self.taken += len(events)
            self.changed.notify_all()

    def _run(self) -> None:
        while True:
            with self.changed:
                self.changed.wait_for(lambda: self.buffer or self.ended)
                self.changed.wait_for(lambda: len(self.buffer) >= self.config.realtime_batch_size or self.hurry or self.ended, self.linger_s)
                part, self.buffer = self.buffer, []
                if not part:
                    return
                self.changed.notify_all()
            try:
                self.ingest.batch(self.rows(part))
            except Exception as e:  # told to whoever waits or adds next
                with self.changed:
                    self.error = e
                    self.changed.notify_all()
                return
            with self.changed:
                self.done += len(part)
                self.batches.append(len(part))
                self.changed.notify_all()

    def flush(self, timeout_s: float | None = None) -> None:
        """Everything consumed so far is in the store and flushed; TimeoutError if that takes longer."""
        with self.changed:
            target, self.hurry = self.taken, True
            self.changed.notify_all()
            there = self.changed.wait_for(lambda: self.done >= target or self.error, timeout_s)
            self.hurry = False
            if self.error:
                raise RuntimeError("a batch failed") from self.error
            if not there:
                raise TimeoutError(f"{target - self.done} events wait after {timeout_s} s")
        self.ingest.flush()

    def stop(self) -> None:
        """Passes on what is buffered and ends."""
        with self.changed:
            self.ended = True
            self.changed.notify_all()
        self.thread.join()


class MemorySource:
    """Events added by the program, handed on one by one; next() blocks until there is one, and gives None after end()."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.queue, self.count, self.batches = spark, schema, deque(), 0, 0
        self.changed, self.handed, self.ended = threading.Condition(), 0, False

    def add(self, events: Iterable[tuple]) -> None:
        events = list(events)
        with self.changed:
            self.queue += events
            self.count += len(events)
            self.changed.notify_all()

    def next(self) -> tuple | None:
        with self.changed:
            self.changed.wait_for(lambda: self.queue or self.ended)
            if not self.queue:
                return None
            self.handed += 1
            event = self.queue.popleft()
            self.changed.notify_all()
            return event

    def end(self) -> None:
        with self.changed:
            self.ended = True
            self.changed.notify_all()

    def flush(self, timeout_s: float | None = None) -> None:
        """Blocks until everything added has been handed on."""
        with self.changed:
            if not self.changed.wait_for(lambda: not self.queue, timeout_s):
                raise TimeoutError(f"{len(self.queue)} events haven't been taken within {timeout_s} s")

    def rows(self, events: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(events, self.schema)

    def drain(self, into: Ingest, batch_size: int = 1, throttle: Throttle | None = None) -> None:
        """Hands on what is there, in batches."""
        while self.queue:
            with self.changed:
                part = [self.queue.popleft() for _ in range(min(batch_size, len(self.queue)))]
                self.handed += len(part)
                self.changed.notify_all()
            if throttle:
                throttle.take(len(part))
            into.batch(self.rows(part), self.batches)
            self.batches += 1


class Provider:
    """Pulls events from `next` until that gives None, and passes them on in batches, the remainder at the end.

    A throttle bounds the events a minute.  `again`, if given, starts a finite source over when it has ended.
    """

    def __init__(self, next: Callable[[], tuple | None], consume: Callable[[list[tuple]], None], batch_size: int = 1, per_minute: int | None = None, again: Callable[[], None] | None = None, clock=time.monotonic, sleep=time.sleep):
        self.next, self.consume, self.batch_size, self.again = next, consume, batch_size, again
        self.throttle, self.status, self.count, self.error = Throttle(per_minute, clock, sleep), "idle", 0, None
        self.thread: threading.Thread | None = None

    def start(self) -> Provider:
        self.status = "running"
        self.thread = threading.Thread(target=self.run, daemon=True)
        self.thread.start()
        return self

    def run(self) -> None:
        self.status, batch = "running", []
        try:
            while self.status == "running":
                event = self.next()
                if event is None:
                    if self.again is None:
                        break
                    self.again()
                    continue
                self.throttle.take(1)
                batch.append(event)
                if len(batch) >= self.batch_size:
                    self._pass(batch)
                    batch = []
            if batch:
                self._pass(batch)
        except Exception as e:
            self.error = e
        self.status = "ended"

    def _pass(self, batch: list[tuple]) -> None:
        self.consume(batch)
        self.count += len(batch)

    def pause(self) -> None:
        self.throttle.paused = True

    def resume(self) -> None:
        self.throttle.paused = False

    def stop(self, timeout_s: float | None = None) -> None:
        self.status, self.throttle.paused = "stopping", False
        if self.thread:
            self.thread.join(timeout_s)

    def wait(self, timeout_s: float | None = None) -> None:
        """Blocks until the source has ended; what went wrong is raised here."""
        self.thread.join(timeout_s)
        if self.thread.is_alive():
            raise TimeoutError(f"the source hasn't ended within {timeout_s} s")
        if self.error:
            raise self.error


class Poll:
    """Reads what a source has beyond the last version, waits, and reads again."""

    def __init__(self, read: Callable[[int], DataFrame], ingest: Ingest, version: int | None = None, pull_ms: int = 1000, sleep=time.sleep):
        self.read, self.ingest, self.pull_ms, self.sleep, self.stopped = read, ingest, pull_ms, sleep, False
        self.version = ingest.store.manifest().received if version is None else version

    def reset(self) -> None:
        """Starts again from what the store has."""
        self.version = self.ingest.store.manifest().received

    def once(self) -> int:
        """Rows that have come; the version is that of the last one."""
        rows = self.read(self.version).persist()
        try:
            found = rows.agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version")).first()
            if found["n"]:
                self.ingest.batch(rows)
                self.version = max(self.version, found["version"])
            return found["n"]
        finally:
            rows.unpersist()

    def run(self, times: int | None = None) -> None:
        """Polls until stopped, or a number of times; waits only when nothing has come."""
        k = 0
        while not self.stopped and (times is None or k < times):
            k += 1
            if not self.once():
                self.sleep(self.pull_ms / 1000)


def file_tree(spark: SparkSession, root: str, rounds: int = 1) -> DataFrame:
    """Every file below a folder that isn't empty: path, text, and a version by the order of paths; `rounds` go through it
    several times.

    Only paths are brought into one order; contents stay where they are read and are joined by path.
    """
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    numbers = files.select("path").withColumn("place", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))
    numbers = numbers.withColumn("of", F.max("place").over(Window.partitionBy()) + 1)
    out = files.select("path", F.col("content").cast("string").alias("text"), F.col("length").alias("bytes")).join(numbers, "path")
    again = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")))
    return out.select("path", "text", "bytes", "place", "of", again.alias("round")).select("path", "text", "bytes", (F.col("round") * F.col("of") + F.col("place")).alias("version"))


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def after_version(rows: DataFrame, version: int, column: str = "version") -> DataFrame:
    """What a source has beyond a version, in order; the comparison reaches the scan."""
    return rows.where(F.col(column) > version).orderBy(column)


#: URL patterns and drivers of the databases offered (fixed values).
JDBC = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
    "oracle": ("jdbc:oracle:thin:@{host}:{port}:{database}", "oracle.jdbc.OracleDriver", 1521),
}


def jdbc_options(kind: str, host: str, database: str, query: str, from_version: int, port: int | None = None, user: str = "", password: str = "") -> dict[str, str]:
    """Reader options for what a table has beyond a version; `query` holds {version}."""
    url, driver, usual = JDBC[kind]
    return {"url": url.format(host=host, port=port or usual, database=database), "driver": driver, "query": query.format(version=int(from_version)), "user": user, "password": password}


def jdbc_changes(spark: SparkSession, partition_by: str | None = None, bounds: tuple[int, int] = (0, 1), partitions: int = 8, **options) -> DataFrame:
    """What a table has beyond a version; with a column to partition by, several tasks read ranges of it."""
    given = jdbc_options(**options)
    if partition_by:  # not together with `query`
        given["dbtable"] = f"({given.pop('query')}) changes"
        given |= {"partitionColumn": partition_by, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**given).load()


#: Elements of a dump's page, at the depths at which they are found; other elements aren't read.
PAGE = "title string, id string, timestamp string, text string, revision struct<timestamp: string, text: string>"


def content_dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of an XML dump as id, title, body, date; redirects and media pages are left out.

    Time and text stand in the page or in its revision (of several, in the last one).
    """
    pages = spark.read.format("xml").option("rowTag", "page").schema(PAGE).load(path)
    from ..sources.adapters import clean_content

    rows = pages.select(
        F.col("id").cast("long").alias("id"), "title", F.coalesce("text", "revision.text").alias("body"), F.to_timestamp(F.coalesce("timestamp", "revision.timestamp")).alias("date")
    )
    return clean_content(rows, "body", title="title")


class Throttle:
    """Events a minute; pause and resume."""

    def __init__(self, per_minute: int | None = None, clock=time.monotonic, sleep=time.sleep):
        self.per_minute, self.clock, self.sleep, self.began, self.n, self.paused = per_minute, clock, sleep, None, 0, False

    def take(self, n: int) -> None:
        while self.paused:
            self.sleep(0.05)
        now = self.clock()
        if self.began is None or now - self.began >= 60:
            self.began, self.n = now, 0
        if self.per_minute is not None and self.n and self.n + n > self.per_minute:
            self.sleep(max(0.0, 60 - (now - self.began)))
            self.began, self.n = self.clock(), 0
        self.n += n


class Schedule:
    """When the daily optimisation is due, and of which kind."""

    def __init__(self, kind: str = "PARTIAL", at: dt.time = dt.time(1)):
        self.kind, self.at, self.last = kind, at, None

    def next_after(self, now: dt.datetime) -> dt.datetime:
        today = dt.datetime.combine(now.date(), self.at)
        return today if today > now else today + dt.timedelta(days=1)

    def due(self, now: dt.datetime) -> str:
        """The kind if a run is due, else NONE; a due run is noted as done."""
        if self.last is None:
            self.last = now
            return "NONE"
        if self.next_after(self.last) <= now:
            self.last = now
            return self.kind
        return "NONE"
