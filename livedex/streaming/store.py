"""A store of plain Parquet behind one manifest.

Batches of changes are written as delta folders.  A flush reduces the deltas to one segment of live rows and a list of
the uids that they touched, which hides those uids in all older segments; so it writes as much as the deltas hold, and
the base is left as it is.  Segments are rewritten by plan only (plans/compaction.py), and hidden rows then go.

The manifest names the folders of one state, and replacing it is the only step that publishes anything, so a reader that
holds a manifest sees one consistent view for as long as its folders stand.  While a flush works, the deltas that it
takes are tier A and those that come meanwhile are tier B; after it, B is the new A.  Vacuum keeps the latest manifests
and pinned ones; a pin is a file beside the manifests, so that every process sees it.

The store works on any file system that Hadoop knows, through Spark's own classes.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import MergeConfig
from ..operators import liveview
from ..plans import compaction


class Files:
    """The few file operations that a store needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        f = self.fs.open(self.path(name))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def write(self, name: str, text: str) -> None:
        """Under another name first, then renamed; an existing file is never overwritten."""
        other = f"{name}.{uuid.uuid4().hex}"
        f = self.fs.create(self.path(other), False)
        try:
            f.write(bytearray(text.encode()))
        finally:
            f.close()
        if not self.fs.rename(self.path(other), self.path(name)):
            self.fs.delete(self.path(other), False)
            raise FileExistsError(name)

    def names(self, folder: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Manifest:
    number: int = 0
    version: int = -1  # the highest version that is durable in segments
    received: int = -1  # the highest version in segments and deltas
    segments: list[dict] = field(default_factory=list)  # name, docs, bytes, upto: the manifest whose deletes are applied to it
    deletes: list[dict] = field(default_factory=list)  # name, number: hides its uids in segments with a lower `upto`
    deltas: list[dict] = field(default_factory=list)  # name, docs, version, at: when it came
    flushing: int = 0  # how many of the deltas a flush is at work on
    last_batch: int = -1  # to ignore a batch that comes again
    schema: str | None = None

    @property
    def state(self) -> str:
        return "working" if self.flushing else "sleep"

    @property
    def pending(self) -> int:
        """Changes that no flush has taken yet."""
        return sum(d["docs"] for d in self.deltas[self.flushing :])

    def folders(self) -> set[str]:
        return {x["name"] for x in (*self.segments, *self.deletes, *self.deltas)}


class Store:
    """Changes in, live views out.  One writer at a time; any number of readers."""

    def __init__(self, spark: SparkSession, root: str, realtime: bool = True, merging: MergeConfig | None = None):
        self.spark, self.root, self.realtime, self.merging = spark, root.rstrip("/"), realtime, merging
        self.files = Files(spark, root)

    # -- manifests

    def numbers(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.files.names("manifests") if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest:
        numbers = self.numbers()
        if not numbers:
            return Manifest()
        return Manifest(**json.loads(self.files.read(f"manifests/manifest-{numbers[-1] if number is None else number}.json")))

    def publish(self, manifest: Manifest) -> Manifest:
        manifest.number += 1
        self.files.fs.mkdirs(self.files.path("manifests"))
        self.files.write(f"manifests/manifest-{manifest.number}.json", json.dumps(asdict(manifest)))
        return manifest

    def pin(self) -> Manifest:
        """The latest manifest, whose folders stay until unpin(), whichever process vacuums."""
        m = self.manifest()
        m.pinned_as = f"pins/{m.number}-{uuid.uuid4().hex}"
        self.files.fs.mkdirs(self.files.path("pins"))
        self.files.write(m.pinned_as, "")
        return m

    def unpin(self, m: Manifest) -> None:
        self.files.delete(m.pinned_as)

    def pinned(self) -> set[int]:
        return {int(n.split("-")[0]) for n in self.files.names("pins")}

    # -- writing

    def _write(self, rows: DataFrame, name: str) -> tuple[int, int]:
        """Rows and bytes of a folder just written."""
        rows.write.parquet(f"{self.root}/{name}")
        n = self.spark.read.parquet(f"{self.root}/{name}").count()  # from the files' footers
        return n, self.files.fs.getContentSummary(self.files.path(name)).getLength()

    def append(self, changes: DataFrame, batch_id: int | None = None) -> Manifest:
        """Adds a batch of changes as a delta.  A batch id at or below the last one was written before, and is ignored."""
        m = self.manifest()
        if batch_id is not None and batch_id <= m.last_batch:
            return m
        name = f"delta-{m.number + 1}-{uuid.uuid4().hex[:8]}"
        n, _ = self._write(changes, name)
        top = self.spark.read.parquet(f"{self.root}/{name}").agg(F.max("version")).first()[0]
        m.received = max(m.received, -1 if top is None else top)
        m.deltas.append({"name": name, "docs": n, "version": m.received, "at": time.time()})
        m.schema = m.schema or changes.schema.json()
        m.last_batch = m.last_batch if batch_id is None else batch_id
        return self.publish(m)

    def begin_flush(self) -> Manifest:
        """Takes the deltas that are there now: they become tier A, and what is appended from now on tier B."""
        m = self.manifest()
        if m.flushing or not m.deltas:
            return m
        m.flushing = len(m.deltas)
        return self.publish(m)

    def end_flush(self) -> Manifest:
        """Writes what begin_flush() took as a segment and a list of hidden uids; its version is then durable."""
        m = self.manifest()
        if not m.flushing:
            return m
        taken, m.deltas, m.flushing = m.deltas[: m.flushing], m.deltas[m.flushing :], 0
        changes, number, tail = self._rows(taken), m.number + 1, uuid.uuid4().hex[:8]
        if m.segments:
            self._write(liveview.effective(changes).select("uid").distinct(), f"deletes-{number}-{tail}")
            m.deletes.append({"name": f"deletes-{number}-{tail}", "number": number})
        name = f"segment-{number}-{tail}"
        docs, size = self._write(liveview.live(changes), name)
        if docs:
            m.segments.append({"name": name, "docs": docs, "bytes": size, "upto": number})
        m.version = taken[-1]["version"]
        m = self.publish(m)
        return self.merge(self.merging) if self.merging and len(m.segments) > self.merging.large_segments else m

    def promote(self) -> Manifest:
        """A flush from begin to end."""
        self.begin_flush()
        return self.end_flush()

    def rewrite(self, runs: list[list[str]]) -> Manifest:
        """Each run of neighbouring segments (by name) as one, without hidden rows; what is live doesn't change."""
        m = self.manifest()
        number = m.number
        for run in runs:
            at = [s["name"] for s in m.segments].index(run[0])
            name = f"segment-{number + 1}-{uuid.uuid4().hex[:8]}"
            docs, size = self._write(self._base(m, m.segments[at : at + len(run)]), name)
            m.segments[at : at + len(run)] = [{"name": name, "docs": docs, "bytes": size, "upto": number}] if docs else []
        least = min((s["upto"] for s in m.segments), default=number)
        m.deletes = [d for d in m.deletes if d["number"] > least]
        return self.publish(m) if runs else m

    def segments(self) -> list[compaction.Segment]:
        """The manifest's segments with the rows that are hidden in each."""
        m = self.manifest()
        hidden = self._hidden(m, m.segments)
        gone = {}
        if hidden is not None:
            rows = self._labelled(m.segments).select("uid", "upto", "segment")
            gone = {r["segment"]: r["n"] for r in rows.join(hidden, "uid").where("number > upto").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
        return [compaction.Segment(s["name"], s["docs"], gone.get(s["name"], 0), s["bytes"]) for s in m.segments]

    def merge(self, config: MergeConfig) -> Manifest:
        """Rewrites what the policy says."""
        return self.rewrite([[s.name for s in run] for run in compaction.merges(self.segments(), config)])

    def optimize(self, most: int = 1) -> Manifest:
        """Leaves at most `most` segments (at least one)."""
        return self.rewrite([[s.name for s in run] for run in compaction.optimized(self.segments(), most)])

    compact = optimize

    def expunge(self) -> Manifest:
        """Rewrites every segment with hidden rows."""
        return self.rewrite([[s.name] for s in compaction.to_expunge(self.segments())])

    def expunge_one(self, large: int) -> Manifest:
        """Rewrites the one of the large segments that has the most hidden rows."""
        one = compaction.one_to_expunge(self.segments(), large)
        return self.rewrite([[one.name]] if one else [])

    def purge(self) -> Manifest:
        """An empty view; the folders go with the next vacuum."""
        m = self.manifest()
        return self.publish(Manifest(number=m.number, last_batch=m.last_batch, schema=m.schema))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the latest `keep` manifests and pinned ones, and folders that none of them names."""
        numbers = self.numbers()
        stay = {*numbers[-keep:], *self.pinned()}
        used = {name for n in stay if n in numbers for name in self.manifest(n).folders()}
        gone = [f"manifests/manifest-{n}.json" for n in numbers if n not in stay]
        gone += [n for n in self.files.names() if n.startswith(("segment-", "deletes-", "delta-")) and n not in used]
        for name in gone:
            self.files.delete(name)
        return gone

    # -- reading

    def _rows(self, folders: list[dict]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/{x['name']}" for x in folders]) if folders else None

    def _labelled(self, segments: list[dict]) -> DataFrame:
        """Rows of segments with the segment's name and `upto`."""
        out = None
        for s in segments:
            rows = self._rows([s]).withColumn("upto", F.lit(s["upto"]).cast("long")).withColumn("segment", F.lit(s["name"]))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _hidden(self, m: Manifest, segments: list[dict]) -> DataFrame | None:
        """uid and the latest number that hides it, of the deletes that some of the segments don't have applied."""
        least = min((s["upto"] for s in segments), default=0)
        lists = [d for d in m.deletes if d["number"] > least]
        out = None
        for d in lists:
            rows = self._rows([d]).withColumn("number", F.lit(d["number"]).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return None if out is None else out.groupBy("uid").agg(F.max("number").alias("number"))

    def _base(self, m: Manifest, segments: list[dict]) -> DataFrame | None:
        """Rows of segments that no later list of deletes hides.  Segments that have all applied take no part in a join."""
        latest = max((d["number"] for d in m.deletes), default=0)
        new, old = [s for s in segments if s["upto"] >= latest], [s for s in segments if s["upto"] < latest]
        out = self._rows(new)
        if old:
            rows, hidden = self._labelled(old), self._hidden(m, old)
            rows = rows.join(hidden, (rows["uid"] == hidden["uid"]) & (hidden["number"] > rows["upto"]), "left_anti").drop("upto", "segment")
            out = rows if out is None else rows.unionByName(out)
        return out

    def _over(self, below: DataFrame | None, deltas: list[dict]) -> DataFrame | None:
        """Rows below a tier of deltas that it doesn't hide."""
        if below is None or not deltas:  # nothing hides anything: no join
            return below
        return below.join(liveview.effective(self._rows(deltas)).select("uid").distinct(), "uid", "left_anti")

    def tiers(self, number: int | None = None) -> dict[str, DataFrame]:
        """The visible rows of each tier that there is: disk, A (what a flush takes, or all deltas), B (what came since)."""
        m = self.manifest(number)
        a, b = (m.deltas[: m.flushing], m.deltas[m.flushing :]) if m.flushing else (m.deltas, [])
        out = {"disk": self._over(self._base(m, m.segments), m.deltas)}
        out["A"] = self._over(liveview.live(self._rows(a)), b) if a else None
        out["B"] = liveview.live(self._rows(b)) if b else None
        return {k: v for k, v in out.items() if v is not None}

    def live(self, number: int | None = None) -> DataFrame | None:
        """The live view of a manifest (None: nothing was ever added).  Without realtime, deltas stay out of sight."""
        m = self.manifest(number)
        base = self._base(m, m.segments)
        if not self.realtime or not m.deltas:
            return base
        fresh = liveview.live(self._rows(m.deltas))
        return fresh if base is None else self._over(base, m.deltas).unionByName(fresh.select(*base.columns))

    def view(self, number: int | None = None) -> DataFrame | None:
        """live(), or a table without rows if there are none but the columns are known."""
        m, rows = self.manifest(number), self.live(number)
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(m.schema))) if rows is None and m.schema else rows

    # -- snapshots

    def export(self, target: str) -> Manifest:
        """Copies the durable state: the segments' live rows, and a manifest without deltas."""
        m = self.pin()
        try:
            other = Store(self.spark, target)
            kept = Manifest(version=m.version, received=m.version, schema=m.schema)
            other._adopt(kept, self._base(m, m.segments), "segment-snapshot")
            return other.publish(kept)
        finally:
            self.unpin(m)

    def _adopt(self, m: Manifest, rows: DataFrame | None, name: str) -> None:
        if rows is not None:
            docs, size = self._write(rows, name)
            m.segments = [{"name": name, "docs": docs, "bytes": size, "upto": m.number + 1}]

    def restore(self, source: str) -> Manifest:
        """Takes over a snapshot; what the store held is no longer seen."""
        other = Store(self.spark, source)
        theirs, m = other.manifest(), self.manifest()
        if not theirs.number:
            raise FileNotFoundError(f"no snapshot in {source}")
        kept = Manifest(number=m.number, version=theirs.version, received=theirs.version, last_batch=m.last_batch, schema=theirs.schema)
        self._adopt(kept, other._base(theirs, theirs.segments), f"segment-{m.number + 1}-{uuid.uuid4().hex[:8]}")
        return self.publish(kept)

    def stats(self) -> DataFrame:
        """One row: state, rows and bytes in segments and deltas, folders, versions."""
        m = self.manifest()
        total = lambda x, k: sum(y[k] for y in x)
        row = (m.state, total(m.segments, "docs"), total(m.segments, "bytes"), total(m.deltas, "docs"), m.pending, len(m.segments), len(m.deltas), m.version, m.received)
        return self.spark.createDataFrame([row], "state string, base_rows long, base_bytes long, delta_rows long, pending_rows long, segments int, deltas int, version long, received long")
