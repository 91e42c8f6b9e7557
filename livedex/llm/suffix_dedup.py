"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Two suffixes belong to the same repeat if their first `LENGTH` bytes are equal, so the sort only has to tell groups of
equal windows apart, and never looks deeper.  Passes go from the digit that splits most to the last one, and a suffix
that is alone in its group leaves the sort:

1. The first digit of a window is its anchor, the 256-byte string in it with the least hash (the leftmost of equal
   ones).  Equal windows have equal anchors at equal places, and one anchor in a text stands for all neighbouring
   windows that share it, about one for 73 bytes, so this pass sorts anchors instead of every suffix.
2. The second digit is all bytes that the anchor's windows cover.  Where two anchors agree in it, all their windows
   are repeats, and no window need be looked at.
3. Only windows of anchors that share the first digit but not the second go on, each with its whole 400 bytes.

Digits are compared by 64-bit hashes, and a group in pass 2 or 3 agrees in two of them (of the anchor and of the
longer string).  Groups are counted, never gathered: counts are aggregated before the shuffle, so a string that a third
of all documents share costs no more than any other.

Sums and lists that a frequent string could make long are written before they are joined, so that Spark can split a
frequent key: the anchors that occur again, and the groups of pass 2.  Windows of pass 3 are joined with counts of
themselves; of anchors that agree in pass 2 only one is there, whatever the number of documents.

Matches never cross documents, as windows don't.  Defined results: a null text is empty; a row that repeats another is
a document of its own (and both are removed where they have 400 bytes); a text is told apart from others by a 64-bit hash
of doc_id and text and 16 bits of another hash of it, so rows may share a doc_id or have none; only doc_id and text are
read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BYTE, INVERSE, dropped, mixed, powers, slices, stored, tidy, utf8

LENGTH, ANCHOR = 400, 256
#: Bytes of text that are hashed at a time; about a hundred bytes of memory each.
SLICE = 2_000_000
#: Anchors that a window has to choose from.
CHOICE = LENGTH - ANCHOR + 1
_PLACE = np.uint64((1 << 24) - 1)


class Rolling:
    """Hashes of any substrings of a byte array, by prefix sums of a polynomial."""

    up, down = powers(BASE, 2), powers(INVERSE, 2)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if n > len(Rolling.up):
            Rolling.up, Rolling.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        self.total = np.zeros(n, np.uint64)
        np.cumsum(BYTE[data] * Rolling.up[: n - 1], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * Rolling.down[start] + (end - start).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        n = len(self.total) - width
        return mixed((self.total[width:] - self.total[:n]) * Rolling.down[:n] + np.uint64(width))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours: least from each block's start, and to each block's end."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    ahead = np.minimum.accumulate(blocks.reshape(-1, width), 1).ravel()
    behind = np.minimum.accumulate(blocks.reshape(-1, width)[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray):
    """Places of the anchors, of their first and last window, their hashes and those of all that the windows cover."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(data)
    gram = rolling.grams(ANCHOR)
    least = sliding_least((gram & ~_PLACE) | (np.arange(len(gram), dtype=np.uint64) & _PLACE), CHOICE)
    inside = np.zeros(n + 1, np.int8)
    long = np.diff(ends) >= LENGTH
    inside[ends[:-1][long]] = 1
    inside[ends[1:][long] - (LENGTH - 1)] = -1
    start = np.flatnonzero(np.cumsum(inside[: n - LENGTH + 1], dtype=np.int8))
    place = start + ((least[start].astype(np.int64) - start) & int(_PLACE))
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    place, first, last = place[new], start[new], start[np.concatenate([new[1:], [len(start)]]) - 1] if len(new) else start[:0]
    shape = ((place - first) * CHOICE + (last - first)).astype(np.uint64)
    return place, first, last, gram[place], mixed(rolling(first, last + LENGTH) + shape)


def signature(text: bytes) -> int:
    return zlib.crc32(text) & 0xFFFF


def _raw(column) -> tuple[np.ndarray, np.ndarray, list[int]]:
    data, ends = utf8(column)
    view = memoryview(data)
    return data, ends, [signature(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc, at, h, whole) of all anchors; `at` packs the anchor's place, its distance to its first and last window, and 16 bits that tell texts apart."""

    def rows(batches):
        for batch in slices(batches, SLICE, rows=1 << 20):
            data, ends, sign = _raw(batch.column("text"))
            place, first, last, h, whole = anchors(data, ends)
            doc = np.searchsorted(ends, place, "right") - 1
            at = ((place - ends[doc]) << 32) | ((place - first) << 24) | ((place - last) << 16) | np.array(sign, np.int64)[doc]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(doc)), pa.array(at), pa.array(h.view(np.int64)), pa.array(whole.view(np.int64))], ["doc", "at", "h", "whole"])

    return docs.where(F.octet_length("text") >= LENGTH).mapInArrow(tidy(rows), "doc long, at long, h long, whole long")


def window_rows(texts: DataFrame) -> DataFrame:
    """(doc, at, h, w) of all windows of the anchors in `asked` (array of at << 1 | known), of rows (doc, text, asked)."""

    def rows(batches):
        for batch in slices(batches, SLICE, rows=1 << 20):
            data, ends, sign = _raw(batch.column("text"))
            asked = batch.column("asked")
            counts = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            at, known = flat.field("at").to_numpy(), flat.field("known").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)
            own = (at & 0xFFFF) == np.array(sign, np.int64)[row]
            at, known, row = at[own], known[own], row[own]
            place = (at >> 32) + ends[row]
            first, last = place - ((at >> 24) & 0xFF), place - ((at >> 16) & 0xFF)
            n = last - first + 1
            which = np.repeat(np.arange(len(at)), n)
            start = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
            rolling = Rolling(data)
            h, w = rolling(place, place + ANCHOR), rolling(start, start + LENGTH)
            packed = ((start - ends[row[which]]) << 16) | (at[which] & 0xFFFF)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(row[which])), pa.array(packed), pa.array(h[which].view(np.int64)), pa.array(w.view(np.int64)), pa.array(known[which])], ["doc", "at", "h", "w", "known"]
            )

    return texts.mapInArrow(tidy(rows), "doc long, at long, h long, w long, known boolean")


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and `kept`, binary) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")
    every = stored(anchor_rows(given.select("doc", "text")), "every")
    # Pass 1: anchors that occur again.
    again = stored(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "again")
    shared = stored(every.join(again, "h"), "anchors")
    dropped(every, again)
    # Pass 2: those whose windows all occur again, and groups that must be looked into.
    alike = stored(shared.groupBy("h", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at")).alias("one")), "alike")
    mixed_groups = stored(alike.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("h"), "mixed")
    sure = shared.join(alike.where("n > 1").select("h", "whole"), ["h", "whole"])
    first = F.shiftright("at", 32) - F.shiftright("at", 24).bitwiseAND(0xFF)
    last = F.shiftright("at", 32) - F.shiftright("at", 16).bitwiseAND(0xFF)
    sure = sure.select("doc", F.col("at").bitwiseAND(0xFFFF).alias("sign"), first.alias("first"), (last + LENGTH).alias("end"))
    # Pass 3: windows of the others; of anchors that agree in pass 2, one stands for all and counts as known.
    open_ = alike.join(mixed_groups, "h").select(F.col("one.doc").alias("doc"), F.struct(F.col("one.at").alias("at"), (F.col("n") > 1).alias("known")).alias("a"))
    open_ = open_.groupBy("doc").agg(F.collect_list("a").alias("asked"))
    texts = given.select("doc", "doc_id", "text").repartition("doc")
    # With all columns of `texts`, so that both joins read one exchange of the documents.
    windows = window_rows(texts.join(open_, "doc").select("doc", "doc_id", "text", "asked"))
    twice = windows.groupBy("h", "w").agg((F.count(F.lit(1)) + F.max(F.col("known").cast("long"))).alias("n")).where("n > 1").select("h", "w")
    found = windows.where("NOT known").join(twice, ["h", "w"])
    found = found.select("doc", F.col("at").bitwiseAND(0xFFFF).alias("sign"), F.shiftright("at", 16).alias("first"), (F.shiftright("at", 16) + LENGTH).alias("end"), "h")
    found = found.groupBy("doc", "sign", "h", F.floor(F.col("first") / CHOICE)).agg(F.min("first").alias("first"), F.max("end").alias("end")).select("doc", "sign", "first", "end")
    # Rows that repeat one have its spans too, and need them once.
    spans = sure.unionByName(found).distinct().groupBy("doc").agg(F.collect_list(F.struct("sign", "first", "end")).alias("spans"))

    def rows(batches):
        for batch in slices(batches, SLICE, rows=1 << 20):
            data, ends, sign = _raw(batch.column("text"))
            out = []
            for i, (a, b, spans) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("spans"), strict=True)):
                text, gone, count = data[a:b], 0, 0
                if spans.is_valid:
                    s = spans.values
                    own = s.field("sign").to_numpy() == sign[i]
                    edge = np.zeros(b - a + 1, np.int32)
                    np.add.at(edge, s.field("first").to_numpy()[own], 1)
                    np.add.at(edge, s.field("end").to_numpy()[own], -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    gone, count = int(cover.sum()), int((np.diff(cover.astype(np.int8), prepend=0) == 1).sum())
                    text = text[~cover]
                text = text.tobytes()
                out.append((b - a, gone, count, hashlib.sha256(text).hexdigest(), text))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns[: 4 + with_text]], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(tidy(rows), schema)


#: The same in DuckDB's SQL over `documents`: every window of every text, as hexadecimal digits, by a 64-bit hash.
ORACLE = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents
), pieces AS (
  SELECT r, c, substr(x, 4096 * c + 1, {4096 + 2 * LENGTH}) AS y, least(2048, len(x) // 2 - {LENGTH - 1} - 2048 * c) AS n
  FROM texts, LATERAL (SELECT unnest(range(0, (len(x) // 2 - {LENGTH}) // 2048 + 1)) AS c) WHERE len(x) // 2 >= {LENGTH}
), windows AS (
  SELECT r, 2048 * c + q AS p, hash(substr(y, 2 * q + 1, {2 * LENGTH})) AS h FROM pieces, LATERAL (SELECT unnest(range(0, n)) AS q)
), twice AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM windows JOIN twice USING (h)
), numbered AS (
  SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM gone
), runs AS (
  SELECT r, min(p) AS first, max(p) + {LENGTH} AS last FROM numbered GROUP BY r, run
), before AS (
  SELECT *, coalesce(lag(last) OVER (PARTITION BY r ORDER BY first), 0) AS open FROM runs
), kept AS (
  SELECT r, sum(last - first) AS n_removed, count(*) AS n_spans, max(last) AS tail, string_agg(substr(x, 2 * open + 1, 2 * (first - open)), '' ORDER BY first) AS k FROM before JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN k.r IS NULL THEN x ELSE k || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM texts LEFT JOIN kept k USING (r)
"""
