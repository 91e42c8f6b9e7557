"""What an operator of a running system may look at and set."""

from __future__ import annotations

import datetime as dt
import time
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import IngestConfig, MergeConfig
from .streaming.ingest import Ingest, Provider, Schedule
from .streaming.store import Store


class Admin:
    """The system: sizes, versions and status; flush, optimise, expunge, purge; batch and merge settings."""

    def __init__(self, store: Store, ingest: Ingest | None = None, config: IngestConfig | None = None, merge: MergeConfig | None = None):
        self.store, self.ingest = store, ingest
        self.config, self.merge = config or (ingest.config if ingest else IngestConfig()), merge or store.merging or MergeConfig()
        self.last_optimized: float | None = None

    def stats(self) -> DataFrame:
        return self.store.stats()

    def status(self) -> str:
        """sleep, or working while a flush is under way."""
        return self.store.manifest().state

    def version(self) -> int:
        return self.store.manifest().version

    def tier_stats(self) -> DataFrame:
        """Visible documents and the highest version of each tier that there is."""
        out = self.store.spark.createDataFrame([], "tier string, docs long, version long")
        for tier, rows in self.store.tiers().items():
            out = out.unionByName(rows.agg(F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("docs"), F.max("version").alias("version")))
        return out

    def index_dir(self) -> str:
        return self.store.root

    def segment_count(self) -> int:
        return len(self.store.manifest().segments)

    def pending(self) -> int:
        """Changes that wait for a flush."""
        return self.store.manifest().pending

    def last_modified(self) -> dt.datetime | None:
        """When the latest manifest was written."""
        numbers, files = self.store.numbers(), self.store.files
        if not numbers:
            return None
        status = files.fs.getFileStatus(files.path(str(PurePosixPath("manifests") / f"manifest-{numbers[-1]}.json")))
        return dt.datetime.fromtimestamp(status.getModificationTime() / 1000, dt.UTC)

    def flush(self) -> None:
        self.ingest.flush() if self.ingest else self.store.promote()

    def optimize(self, segments: int = 1) -> None:
        self.store.promote()
        self.store.optimize(max(segments, 1))
        self.last_optimized = time.time()

    def expunge(self) -> None:
        """Rewrites the segments that hold hidden rows."""
        self.store.promote()
        self.store.expunge()

    def purge(self) -> None:
        self.store.promote()
        self.store.purge()
        self.store.vacuum()

    def set_batch(self, size: int | None = None, delay_ms: int | None = None, most: int | None = None) -> None:
        self.config.batch_size = self.config.batch_size if size is None else size
        self.config.batch_delay_ms = self.config.batch_delay_ms if delay_ms is None else delay_ms
        self.config.max_batch_size = self.config.max_batch_size if most is None else most

    def set_merge(self, **settings) -> None:
        """Any field of MergeConfig; the store merges by them from the next flush on."""
        for name, value in settings.items():
            if not hasattr(self.merge, name) or name == "small_cap":
                raise AttributeError(name)
            setattr(self.merge, name, value)
        self.store.merging = self.merge


class ProviderAdmin:
    """A source of events: start, stop, pause and resume; rate and batch size; what it has done."""

    def __init__(self, provider: Provider):
        self.provider, self.began = provider, time.monotonic()

    def start(self) -> None:
        self.began = time.monotonic()
        self.provider.start()

    def stop(self) -> None:
        self.provider.stop()

    def pause(self) -> None:
        self.provider.pause()

    def resume(self) -> None:
        self.provider.resume()

    def set_batch_size(self, n: int) -> None:
        self.provider.batch_size = n

    def set_max_events_per_minute(self, n: int | None) -> None:
        self.provider.throttle.per_minute = n

    def stats(self) -> dict:
        p = self.provider
        minutes = max((time.monotonic() - self.began) / 60, 1e-9)
        status = "paused" if p.throttle.paused and p.status == "running" else p.status
        return {"status": status, "batch_size": p.batch_size, "events": p.count, "events_per_minute": p.count / minutes, "max_events_per_minute": p.throttle.per_minute}


class Optimizer:
    """Runs the daily optimisation when its schedule says so: call run() between batches, or from a timer."""

    def __init__(self, store: Store, merge: MergeConfig, schedule: Schedule | None = None):
        self.store, self.merge, self.schedule, self.done = store, merge, schedule or Schedule(), []

    def run(self, now: dt.datetime) -> str:
        kind = self.schedule.due(now)
        if kind == "FULL":
            self.store.expunge()
            self.store.optimize(self.merge.large_segments)
        elif kind == "PARTIAL":
            self.store.expunge_one(self.merge.large_segments)
            self.store.merge(self.merge)
        self.done += [kind] if kind != "NONE" else []
        return kind


class ScheduleAdmin:
    """When the daily optimisation runs, and which kind."""

    def __init__(self, schedule: Schedule):
        self.schedule = schedule

    def set_time(self, at: dt.time) -> None:
        self.schedule.at = at

    def set_kind(self, kind: str) -> None:
        if kind not in ("FULL", "PARTIAL", "NONE"):
            raise ValueError(kind)
        self.schedule.kind = kind

    def next(self, now: dt.datetime) -> dt.datetime:
        return self.schedule.next_after(now)
