"""The system as one object: changes in, searches out, with its extension points."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .admin import Admin, Optimizer, ProviderAdmin
from .model import IngestConfig, MergeConfig, SearchRequest, SearchResult
from .operators.lookup import doc_numbers
from .operators.search import SearchService
from .streaming.ingest import Consumer, Ingest, Provider, Schedule
from .streaming.store import Store

Decorator = Callable[[DataFrame], DataFrame]


def nothing(rows: DataFrame) -> DataFrame:
    """The interpreter that indexes nothing."""
    return rows.limit(0)


def united(tiers: list[DataFrame]) -> DataFrame:
    """The merger that puts the tiers' visible rows together."""
    out = tiers[0]
    for rows in tiers[1:]:
        out = out.unionByName(rows.select(*out.columns))
    return out


class Throttled:
    """Views that are renewed at most once in an interval; the last few generations stay readable, older ones are let go."""

    def __init__(self, store: Store, refresh_ms: int = 1000, generations: int = 3, clock=time.monotonic):
        self.store, self.refresh_ms, self.generations, self.clock, self.pins, self.at = store, refresh_ms, generations, clock, [], None

    def view(self) -> DataFrame | None:
        if self.at is None or (self.clock() - self.at) * 1000 >= self.refresh_ms:
            self.at = self.clock()
            if not self.pins or self.pins[-1].number != self.store.manifest().number:
                self.pins.append(self.store.pin())
            while len(self.pins) > self.generations:
                self.store.unpin(self.pins.pop(0))
        return self.store.view(self.pins[-1].number)


class Engine:
    """Interprets, stores and searches.

    `decorators` are applied to every view that is handed out, `merger` makes one table of the tiers' visible rows, and
    `mapper` gives the document numbers of uids (a table of uid and docid from one of uid, segment and local number).
    """

    def __init__(
        self, spark: SparkSession, root: str, interpret: Callable[[DataFrame], DataFrame], config: IngestConfig | None = None, merge: MergeConfig | None = None, decorators: tuple[Decorator, ...] = (),
        fields: tuple[str, ...] = ("path", "lang"), merger: Callable[[list[DataFrame]], DataFrame] = united, mapper: Callable[[DataFrame], DataFrame] = doc_numbers, schedule: Schedule | None = None,
    ):
        self.spark, self.config, merging = spark, config or IngestConfig(), merge or MergeConfig()
        self.store = Store(spark, root, self.config.realtime, merging)
        self.events: list[dict] = []
        self.searches: list[tuple] = []
        self.ingest = Ingest(self.store, interpret, self.config, self.events.append)
        self.admin = Admin(self.store, self.ingest, self.config, merging)
        self.optimizer = Optimizer(self.store, merging, schedule)
        self.decorators, self.merger, self.mapper, self.service = decorators, merger, mapper, SearchService(self.view, fields)
        self.batches = self.store.manifest().last_batch + 1

    def consume(self, rows: DataFrame) -> None:
        """One batch of raw rows, outside of a streaming query."""
        self.ingest.batch(rows, self.batches)
        self.batches += 1
        self.optimizer.run(dt.datetime.now())

    def consumer(self, rows: Callable[[list[tuple]], DataFrame]) -> Consumer:
        """A buffer for events that producers add one by one."""
        return Consumer(self.ingest, rows, self.config)

    def provider(self, next: Callable[[], tuple | None], consume: Callable[[list[tuple]], None], batch_size: int = 1) -> ProviderAdmin:
        """A source of events at the configured rate, with its controls."""
        return ProviderAdmin(Provider(next, consume, batch_size, self.config.max_events_per_minute))

    def view(self) -> DataFrame | None:
        """The live view as it is now."""
        return self._view(None)

    def _view(self, number: int | None) -> DataFrame | None:
        tiers = self.store.tiers(number) if self.config.realtime else {}
        rows = self.merger(list(tiers.values())) if tiers else self.store.view(number)
        for f in self.decorators if rows is not None else ():
            rows = rows.transform(f)
        return rows

    @contextmanager
    def reading(self):
        """A view whose folders stay while it is used."""
        pin = self.store.pin()
        try:
            yield self._view(pin.number)
        finally:
            self.store.unpin(pin)

    def numbers(self) -> DataFrame:
        """Document numbers of the live uids, by the engine's mapper: documents are numbered in the order of their uids."""
        return self.mapper(self.view().select("uid", F.floor(F.col("uid") / 100).alias("segment"), F.pmod("uid", F.lit(100)).alias("local")))

    def search(self, request: SearchRequest) -> SearchResult:
        out = self.service.search(request)
        self.searches.append((dt.datetime.now(), len(self.searches), request.query or "", out.total_hits, int(out.time_ms)))
        return out

    def metrics(self) -> DataFrame:
        """The searches so far as (ts, n, query, hits, ms), for operators/monitor.py."""
        return self.spark.createDataFrame(self.searches, "ts timestamp, n long, query string, hits long, ms long")

    def sync(self, version: int, timeout_s: float) -> None:
        self.ingest.wait_for(version, timeout_s)

    def timed(self, word: str, request: SearchRequest) -> str:
        """A search as a line of the load test's log."""
        began = time.perf_counter()
        try:
            hits = self.search(request).total_hits
        except Exception as e:  # a load test goes on, and says what failed
            return f"FAILURE-INFO: {word}:{request.query}: {type(e).__name__}"
        return f"INFO: TIME-TAKEN: {word}:{request.query}: {hits} : {int((time.perf_counter() - began) * 1000)}"


class LoadTest:
    """Marks the beginning and the end of a run of searches, and says how it went."""

    def __init__(self, engine: Engine, wait_s: float = 0.0):
        self.engine, self.wait_s, self.first, self.last = engine, wait_s, 0, None

    def begin(self) -> None:
        self.first, self.last = len(self.engine.searches), None

    def run(self, queries: list[str], k: int = 10) -> None:
        for q in queries:
            self.engine.search(SearchRequest(q, k))
            time.sleep(self.wait_s)

    def end(self) -> None:
        self.last = len(self.engine.searches)

    def stats(self) -> dict:
        """Searches between the marks: number, mean and percentiles of milliseconds, and searches a minute."""
        rows = self.engine.searches[self.first : self.last]
        ms = sorted(r[4] for r in rows)
        at = lambda share: ms[min(len(ms) - 1, int(share * len(ms)))] if ms else None
        minutes = (rows[-1][0] - rows[0][0]).total_seconds() / 60 if len(rows) > 1 else 0.0
        return {"n": len(rows), "mean_ms": sum(ms) / len(ms) if ms else None, "p50_ms": at(0.5), "p90_ms": at(0.9), "p99_ms": at(0.99), "per_minute": len(rows) / minutes if minutes else None}
