"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other characters than these six white-space bytes (fixed value).
WORD = "[^\\x20\\x09-\\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Texts are wide rows: Python gets a thousand at a time, unless the session asks for another number than the default.

    Spark reads this setting when a plan runs, so it can't be taken back before; only the registered queries and the
    pipeline's stages set it, in the session that they are given, and the operators leave settings alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local master, where there is one machine,
    gets a temporary one if that is unset."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="livedex-"))
        found = sc.getCheckpointDir()
    return found


#: Folders that this process has written and that still stand.
_WRITTEN: dict[str, SparkSession] = {}


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows as Parquet in the shared folder, read back: no recomputation, and no lineage to lose with an executor.

    A result may be read from such folders later, so they stand until dropped() or cleared() deletes them; cleared() is
    called when the program ends.
    """
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these, which nothing may read any more."""
    for df in frames:
        deleted(df.sparkSession, df.stored_at)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.pop(path, None)


@atexit.register
def cleared() -> None:
    """Deletes everything that this process has written to shared folders: call it when no result is read any more."""
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):  # the session may have ended first, and its folders with it
            deleted(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """As stored(), for what has no name of its own.  (A checkpoint of a union may keep a partitioning by columns it has lost.)"""
    return stored(df, "cut")


def free() -> None:
    """Gives memory that this process no longer uses back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def tidy(rows):
    """A function over batches that frees memory when it is through."""

    def run(batches):
        yield from rows(batches)
        free()

    return run


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column (null: empty) as one array, and the n+1 offsets of its texts."""
    column = pa.array(column, pa.large_string()) if not isinstance(column, pa.Array) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(batches, limit: int = 1_000_000, rows: int = 1024, column: str = "text"):
    """Arrow batches cut to at most `limit` bytes of text (a longer text stands alone) and `rows` rows, to bound memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if (total + n > limit or i - start >= rows) and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


_RNG = np.random.default_rng(20240229)
#: One random 64-bit number per byte value, an odd base and its inverse modulo 2^64.
BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
BASE = int(_RNG.integers(0, 1 << 64, dtype=np.uint64)) | 1
INVERSE = pow(BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """64-bit hashes of the words of texts, by prefix sums of a polynomial; powers are kept for the next batch."""

    def __init__(self):
        self.up, self.down = powers(BASE, 1 << 20), powers(INVERSE, 1 << 20)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes in order, and the n+1 offsets of the texts among them."""
        n = len(data)
        if n >= len(self.up):
            self.up, self.down = powers(BASE, n + 1), powers(INVERSE, n + 1)
        solid = np.zeros(n + 2, bool)
        solid[1:-1] = ~WHITE[data]
        edge = solid[1:] != solid[:-1]
        # A text's end is a boundary too: a word never runs from one text into the next.
        inner = ends[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        joined = np.unique(inner[solid[inner] & solid[inner + 1]]) if len(inner) else inner
        at = np.flatnonzero(edge)
        first, last = at[::2], at[1::2]
        if len(joined):
            first, last = np.sort(np.concatenate([first, joined])), np.sort(np.concatenate([last, joined]))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[data] * self.up[:n], out=total[1:])
        hashes = mixed((total[last] - total[first]) * self.down[first] + (last - first).astype(np.uint64))
        return hashes, np.searchsorted(first, ends, "left")
