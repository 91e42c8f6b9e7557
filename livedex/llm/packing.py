"""Best-fit-decreasing packing of token sequences.

Lengths are integers up to the sequence size, so the packing of a corpus of any size is planned from its histogram.
The planner takes lengths in falling order.  A segment tree over the remaining capacities (leaf r counts the open bins
with r free places) finds the tightest open bin in logarithmic time; equal documents that the rule would put into
equal bins are placed together, so the plan has a few thousand entries whatever the corpus.  Each piece then reads its
bin and its place off the plan by its rank among the pieces of its length.

Ranks need no global sort: pieces of a length are dealt over buckets of a few thousand rows, bucket counts are summed
per length, and rows are ranked inside their bucket.  The plan is joined by length, and a rank's step is the one whose
ranks it lies in, so placing is a join without Python.

Defined results: a null text is empty and gives one piece, the end token; repeated rows are separate pieces; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, stored, tidy

SEQUENCE = 1024
END_ID = 2
BUCKET_ROWS = 4096
#: The byte-level vocabulary's pattern of pieces (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space this long are cut out before the pattern is applied: its look-ahead keeps a stack entry for each
#: character of a run, a million at most.  The class is the pattern's \s, which differs from Python's.
RUN = 100_000
_WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_RUNS = re.compile(f"(?<!{_WHITE}){_WHITE}{{{RUN},}}+").finditer


def merger(path: str, pattern: str):
    """tiktoken's text -> ids, by the vocabulary of a tokenizer's file and a pattern of pieces."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    # Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if all(c in byte_of for c in token)}
    ranks.pop(b"<|endoftext|>", None)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Ids:
    """Text -> its ids as little-endian unsigned 32-bit integers.

    The vocabulary is read from the tokenizer's file; tiktoken merges the bytes, four times faster than the library
    that the file is made for, and gives the same ids (a test compares them).  As in that library, a string of an added
    token in a text is that token's id, and the stretches between are texts of their own.
    """

    def __init__(self, path: str):
        self.encode = merger(path, PATTERN)
        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            self.added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def ids(self, text: str) -> bytes:
        if not any(token in text for token in self.added):
            return self.plain(text)
        # Every other part is an added token.
        return b"".join(array("I", [self.added[part]]).tobytes() if k % 2 else self.plain(part) for k, part in enumerate(self.split(text)))

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        out, at = array("I"), 0
        for run in _RUNS(text) if len(text) >= RUN else ():
            # The pattern makes one piece of a run, without its last character if other text follows.
            end = run.end() - (run.end() < len(text))
            out.extend(self.encode(text[at : run.start()]))
            out.extend(self.piece(text[run.start() : end]))
            at = end
        out.extend(self.encode(text[at:] if at else text))
        return out.tobytes()

    def piece(self, text: str) -> list[int]:
        """The ids of a text that is a single piece; few texts need this."""
        if self.whole is None:
            self.whole = merger(self.path, "(?s:.+)")
        return self.whole(text)


@functools.cache
def ids_of(path: str) -> Ids:
    """A process builds its vocabulary once, however many tasks it runs."""
    return Ids(path)


def tokenized(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, 4 bytes each)."""
    end = np.asarray([end_id], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pieces(batches):
        model = ids_of(tokenizer)
        for batch in slices(batches):
            at_row, rows = [], []
            for i, text in enumerate(batch.column("text")):
                ids = model.ids(text.as_py() or "") + end
                n = len(ids) // 4
                at, length = 0, (n - 1) % sequence + 1  # only the first piece is shorter
                for k in range((n - 1) // sequence + 1):
                    part = ids[4 * at : 4 * (at + length)]
                    at_row.append(i)
                    rows.append((k, at, length, zlib.crc32(part), part))
                    at, length = at + length, sequence
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at_row)), *columns[: 4 + with_ids]], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(tidy(pieces), schema)


class Tightest:
    """Segment tree over capacities: which is the smallest one, at least `need`, that has an open bin?"""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        at = self.leaves + capacity
        while at:
            self.counts[at] += bins
            at //= 2

    def find(self, need: int) -> int | None:
        at = self.leaves + need
        if self.counts[at]:
            return need
        while at > 1:  # up until a right neighbour has bins, then down to its first
            if at % 2 == 0 and self.counts[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.counts[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing: (length, rank from 0 of the first piece, first bin, pieces a bin, place in the bin)."""
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(sequence + 1)]  # by free places: (first bin, bins)
    tree, bins, out = Tightest(sequence), 0, []

    def leave(first: int, count: int, free: int) -> None:
        if count and free:
            open_bins[free].append((first, count))
            tree.add(free, count)

    for length in sorted((n for n in histogram if histogram[n]), reverse=True):
        left, rank = histogram[length], 0
        while left:
            free = tree.find(length)
            if free is None:
                free, first, count = sequence, bins, left
            else:
                first, count = open_bins[free].pop()
                tree.add(free, -count)
            each = free // length  # the bin just used is the tightest one as long as the length fits
            whole, odd = min(count, left // each), 0
            if whole:
                out.append((length, rank, first, each, sequence - free))
                left, rank = left - whole * each, rank + whole * each
                leave(first, whole, free - each * length)
            if left and left < each and whole < count:
                odd = 1
                out.append((length, rank, first + whole, left, sequence - free))
                leave(first + whole, 1, free - left * length)
                left, rank = 0, rank + left
            if free == sequence:
                bins += whole + odd
            else:
                leave(first + whole + odd, count - whole - odd, free)
    return out


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to pieces (any rows with doc_id, piece and length); they are read several times."""
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `sequence` rows
    steps = plan(histogram, sequence)
    spark = pieces.sparkSession
    if not steps:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    # Both tables are as long as the plan: a few rows for each of at most `sequence` lengths.
    buckets = F.broadcast(spark.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in histogram.items()], "at_length long, buckets long"))
    dealt = pieces.join(buckets, F.col("length") == F.col("at_length")).drop("at_length")
    # With all that tells pieces apart, so that rows without doc_id don't meet in one bucket.
    known = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(*known), F.col("buckets"))).drop("buckets")
    along = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.col("length").alias("l"), F.col("bucket").alias("b"), (F.sum("n").over(along) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy(*known)
    ranked = dealt.join(counts, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b"))).drop("l", "b")
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(own) - 1).drop("before", "bucket")
    ends = {}
    for length, rank, *_ in sorted(steps, reverse=True):
        ends[length, rank] = ends.get(length, histogram[length])
        ends[length] = rank
    rows = [(*step, ends[step[:2]]) for step in steps]
    step = F.broadcast(spark.createDataFrame(rows, "of_length long, first_rank long, first_bin long, each long, at long, end_rank long"))
    placed = ranked.join(step, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    past = F.col("rank") - F.col("first_rank")
    return placed.select(*pieces.columns, (F.col("first_bin") + F.floor(past / F.col("each"))).alias("sequence_id"), (F.col("at") + past % F.col("each") * F.col("length")).alias("offset"))


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs documents.  Tokens are made once: the pieces are kept in the shared folder."""
    pieces = tokenized(docs, tokenizer, sequence, end_id, with_ids)
    return pack(stored(pieces, "pieces") if with_ids else cut(pieces), sequence)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The packed sequences' ids (binary), from pieces with ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_pieces.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids"))
