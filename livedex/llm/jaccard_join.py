"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document is its set of five-word shingles.  Documents with the same set are one node, so thousands of copies cost no
more than one.  Candidates: MinHash bands.  A bucket of a band links its members to its least one, and the connected
components of these stars hold every pair that shares a bucket (32 bands of 5 values: a pair at similarity 0.8 shares
none with a probability of 3e-6).  Inside a component, pairs compare MinHash values sixteen at a time; with m of n
values equal and a uniform prior, the posterior probability of similarity t or more is P(Bin(n + 1, t) <= m), and a
pair is dropped when that falls below the tolerance.  The pairs that stay are verified exactly, on whole sets.

Small components are packed into tasks together; a large one is cut into blocks of nodes with a common neighbour, and
each pair of blocks that shares a bucket is a task of its own.  A task returns one row per node with a link: the number
of documents it links with there, and the root of a spanning forest of the links.  Pairs are never written.

Defined results: words are runs of other bytes than white space; a text of one to four words is one shingle of all its
words; a null text, or one without words, links with nothing and is its own class; every row is a document, also where
rows share a doc_id (each has the class and the links of its own text); rows without doc_id link with nothing; other
columns don't matter.  Of a class, representatives() keeps one row: that of the least doc_id, and of its texts the one
with the least hash.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mixed, slices, stored, tidy, utf8
from .components import components, forest

WIDTH = 5
#: The least similarity, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 32, 5
#: Values that candidates compare, how many at a time, and the posterior below which a pair is dropped.
COMPARED, STEP, TOLERANCE = 128, 16, 1e-7
BLOCK = 512
#: Shingles that a task over small components is meant to hold.
TASK = 250_000

_RNG = np.random.default_rng(99)
_BAND = (_RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1), _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32))
_OWN = (_RNG.integers(0, 1 << 32, COMPARED, np.uint32) | np.uint32(1), _RNG.integers(0, 1 << 32, COMPARED, np.uint32))
_PLACE = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)], np.uint64)


def shingle_sets(texts, words: Words, width: int = WIDTH):
    """The sorted distinct shingle hashes of each text, in order."""
    data, ends = utf8(texts)
    w, at = words(data, ends)
    n = len(w)
    if n >= width:
        s = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            s += w[k : n - width + 1 + k] * _PLACE[k]
        s = mixed(s)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(s[a : b - width + 1])
        elif b > a:
            yield mixed((w[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield w[:0]


def minhash(shingles: np.ndarray, family) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    a, b = family
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, (x[k : k + 4096, None] * a + b).min(0), out=out)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, key1 and key2 of the document's set, its size, and a hash per band (binary), of every document with words."""

    def rows(batches):
        words = Words()
        for batch in slices(batches):
            keep, keys, sizes, bands = [], [], [], []
            for i, s in enumerate(shingle_sets(batch.column("text"), words)):
                if len(s):
                    keep.append(i)
                    sizes.append(len(s))
                    low, high = s.sum(dtype=np.uint64), mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    keys.append(mixed(np.array([low + np.uint64(len(s)), high], np.uint64)))
                    m = minhash(s, _BAND).astype(np.uint64).reshape(BANDS, ROWS)
                    bands.append(mixed((m * _PLACE[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[ROWS]).tobytes())
            if keep:
                k = np.stack(keys).view(np.int64)
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("hash").take(at), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(sizes, pa.int64()), pa.array(bands, pa.binary())], ["doc_id", "hash", "key1", "key2", "shingles", "bands"]
                )

    given = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    return given.mapInArrow(tidy(rows), "doc_id long, hash long, key1 long, key2 long, shingles long, bands binary")


def numbered(sign: DataFrame) -> DataFrame:
    """One row per set: key1, key2, node, weight (documents), doc (least doc_id), hash (of that document's text), shingles, bands.

    A set's node is its least doc_id.  Where sets share that, because rows of one doc_id have different texts, all but
    the one of the least key get a number made from their key, above every doc_id that is less than 2^62.
    """
    one = F.min(F.struct("doc_id", "hash"))
    nodes = cut(sign.groupBy("key1", "key2").agg(one.alias("one"), F.count(F.lit(1)).alias("weight"), F.min("shingles").alias("shingles"), F.min("bands").alias("bands")))
    shared = nodes.groupBy(F.col("one.doc_id").alias("doc")).agg(F.count(F.lit(1)).alias("sets"), F.min(F.struct("key1", "key2")).alias("first")).where("sets > 1").select("doc", "first")
    out = nodes.select("key1", "key2", F.col("one.doc_id").alias("doc"), F.col("one.hash").alias("hash"), "weight", "shingles", "bands").join(cut(shared), "doc", "left")
    other = F.col("first").isNotNull() & (F.struct("key1", "key2") != F.col("first"))
    return cut(out.withColumn("node", F.when(other, F.xxhash64("key1", "key2").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)).otherwise(F.col("doc"))).drop("first"))


def held(nodes: DataFrame) -> DataFrame:
    """(bucket, node, a): the nodes of every bucket with two or more, and the least of them."""

    def buckets(batches):
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(h)], ["node", "bucket"])

    dealt = nodes.select("node", "bands").mapInArrow(tidy(buckets), "node long, bucket long")
    shared = cut(dealt.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("bucket", "a"))
    return dealt.join(shared, "bucket")


def stars(members: DataFrame) -> DataFrame:
    """Edges (a, b) from the least node of every bucket to its other ones."""
    return members.where("node > a").select("a", F.col("node").alias("b")).distinct()


def blocked(members: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of large components (id, component): the block of each node (id, block), and the pairs of blocks (component, x, y), x <= y,
    that share a bucket.

    Nodes with the same least neighbour stand together, so most buckets lie in few blocks, and blocks of parts of a
    component that only a chain of other documents connects are not compared.
    """
    inside = cut(members.join(large, members["node"] == large["id"]).select("component", "bucket", "node", "a"))
    centre = cut(inside.groupBy("component", "node").agg(F.min("a").alias("centre")))
    groups = cut(centre.groupBy("component", "centre").agg(F.count(F.lit(1)).alias("n")))
    sizes = cut(groups.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks")))
    few = F.pmod(F.xxhash64("centre"), F.col("blocks"))
    own = F.lit(1 << 40) + F.pmod(F.xxhash64("centre"), F.lit(1 << 30)) * 1024 + F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK).cast("long"))
    block = F.when(F.col("n") <= BLOCK, few).otherwise(own)  # two that meet in one number only make a larger block
    blocks = cut(centre.join(groups, ["component", "centre"]).join(sizes, "component").select(F.col("node").alias("id"), block.alias("block")))
    stand = cut(inside.join(blocks, inside["node"] == blocks["id"]).select("component", "bucket", "block").distinct())
    x, y = stand.withColumnRenamed("block", "x"), stand.withColumnRenamed("block", "y")
    return blocks, cut(x.join(y, ["component", "bucket"]).where("x <= y").select("component", "x", "y").distinct())


def least_equal(t: float, tolerance: float) -> list[int]:
    """After each step, the fewest equal values that keep a pair: P(Bin(n + 1, t) <= m) >= tolerance."""
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


_LEAST = least_equal(SIMILARITY[0] / SIMILARITY[1], TOLERANCE)


def candidates(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the signatures a and b whose pairs the comparison keeps (i < j if both are the same block)."""
    rows, columns = [], []
    for k in range(0, len(a), 256):
        part = a[k : k + 256]
        equal = np.zeros((len(part), len(b)), np.int16)
        for v in range(STEP):
            equal += part[:, v, None] == b[:, v]
        i, j = np.nonzero(equal >= _LEAST[0])
        if same:
            keep = i + k < j
            i, j = i[keep], j[keep]
        m = equal[i, j].astype(np.int32)
        for step, least in enumerate(_LEAST[1:], 1):
            for v in range(step * STEP, step * STEP + STEP):
                m += part[i, v] == b[j, v]
            keep = m >= least
            i, j, m = i[keep], j[keep], m[keep]
        rows.append(i + k)
        columns.append(j)
    return np.concatenate(rows), np.concatenate(columns)


def common(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the sets a[i] and b[j]."""
    if len(i) < 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[x], b[y], True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    # Many pairs of few sets: products of indicator matrices, over the shingles that both sides have.
    left, right = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(left, right)
    row_a, row_b = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))
    at_a, at_b = np.searchsorted(shared, left), np.searchsorted(shared, right)
    ok_a, ok_b = (shared[np.minimum(at, len(shared) - 1)] == x if len(shared) else np.zeros(len(x), bool) for at, x in ((at_a, left), (at_b, right)))
    total = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, len(shared), 8192):
        wide = min(8192, len(shared) - k)
        x, y = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
        for m, row, at, ok in ((x, row_a, at_a, ok_a), (y, row_b, at_b, ok_b)):
            use = ok & (at >= k) & (at < k + wide)
            m[row[use], at[use] - k] = 1
        total += x @ y.T
    return np.rint(total[i, j]).astype(np.int64)


def similar(a: list[np.ndarray], b: list[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (rows of a and b) of the least similarity or more."""
    sign_a = np.stack([minhash(s, _OWN) for s in a])
    sign_b = sign_a if same else np.stack([minhash(s, _OWN) for s in b])
    i, j = candidates(sign_a, sign_b, same)
    size_a, size_b = np.array(list(map(len, a)), np.int64), np.array(list(map(len, b)), np.int64)
    p, q = SIMILARITY
    both = size_a[i] + size_b[j]
    keep = np.minimum(size_a[i], size_b[j]) * (p + q) >= p * both  # else the sizes alone forbid it
    i, j, both = i[keep], j[keep], both[keep]
    inside = common(a, b, i, j)
    keep = inside * q >= p * (both - inside)
    return i[keep], j[keep]


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, links: documents it links with, root: a node it is connected with), a few rows per node."""
    members = held(nodes)
    parts = cut(components(stars(members)))
    sizes = cut(parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")))
    wide = parts.join(sizes.where(F.col("n") > BLOCK), "component").select("id", "component")
    parts = parts.join(sizes, "component").join(nodes.select(F.col("node").alias("id"), "weight", "doc", "hash", "shingles"), "id")

    def sets(batches):
        words = Words()
        for batch in slices(batches):
            found = [s.tobytes() for s in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "id", "weight", "n")), pa.array(found, pa.binary())], ["component", "id", "weight", "n", "shingles"])

    # A task takes whole components of about TASK shingles in all, so that a few very long texts don't meet in one.
    groups = max(16, (parts.agg(F.sum("shingles")).first()[0] or 0) // TASK)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"), "text")
    whole = parts.join(texts, ["doc", "hash"]).select("component", "id", "weight", "n", "text")
    whole = whole.mapInArrow(tidy(sets), "component long, id long, weight long, n long, shingles binary").where(F.length("shingles") > 0)
    # A component of one block goes to a task with others like it; one of more blocks has a task for each pair that shares a bucket.
    none = F.lit(-1).cast("long")
    small = whole.where(F.col("n") <= BLOCK).select(F.pmod(F.xxhash64("component"), F.lit(groups)).alias("g"), none.alias("x"), none.alias("y"), "component", "id", "weight", none.alias("block"), "shingles")
    rows = small
    if not wide.isEmpty():
        blocks, pairs = blocked(members, wide)
        asked = pairs.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
        large = whole.where(F.col("n") > BLOCK).join(blocks, "id").join(asked, ["component", "block"])
        rows = small.unionByName(large.select(F.col("component").alias("g"), "x", "y", "component", "id", "weight", "block", "shingles"))

    def compare(key, rows):
        x, y = key[1].as_py(), key[2].as_py()
        out = [pa.RecordBatch.from_pydict({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})]
        ids, weight, part, block = (rows.column(c).to_numpy() for c in ("id", "weight", "component", "block"))
        sets = rows.column("shingles")
        order = np.lexsort([ids, block, part])
        order = order[np.concatenate([[True], np.diff(ids[order]) != 0])]  # repeated rows
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            own = [np.frombuffer(sets[int(k)].as_py(), np.uint64) for k in at]
            if x == y:
                i, j = similar(own, own, True)
            else:
                k = int((block[at] == x).sum())
                if k in (0, len(own)):
                    continue
                i, j = similar(own[:k], own[k:], False)
                j = j + k
            if len(i):
                w, name = weight[at], ids[at]
                sums = np.bincount(i, w[j], minlength=len(at)) + np.bincount(j, w[i], minlength=len(at))
                has = np.flatnonzero(sums)
                root = forest(len(at), i, j)
                out.append(pa.RecordBatch.from_arrays([pa.array(name[has]), pa.array(sums[has].astype(np.int64)), pa.array(name[root[has]])], ["node", "links", "root"]))
        return pa.Table.from_batches(out)

    return cut(rows.groupBy("g", "x", "y").applyInArrow(compare, "node long, links long, root long"))


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and (key1, key2, class_id, n_links, doc, hash) of every set."""
    sign = stored(signed(docs), "signed")
    nodes = numbered(sign)
    found = links(docs, nodes)
    sums = cut(found.groupBy("node").agg(F.sum("links").alias("links")))
    parts = cut(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node"))
    # A component's least node is its least doc_id, unless that is one of the numbers made from keys.
    known = nodes.select("key1", "key2", "node", "weight", "doc", "hash").join(sums, "node", "left").join(parts, "node", "left")
    component, weight = F.coalesce("component", "node"), F.col("weight") - 1
    known = cut(known.select("key1", "key2", component.alias("component"), component.alias("class_id"), (F.coalesce("links", F.lit(0)) + weight).alias("n_links"), "doc", "hash"))
    made = known.where(F.col("component") >= 1 << 62)
    if not made.isEmpty():
        least = cut(made.groupBy("component").agg(F.min("doc").alias("class_id")))
        known = known.where(F.col("component") < 1 << 62).unionByName(made.drop("class_id").join(least, "component"))
    return sign, known


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id reachable by links), n_links."""
    sign, known = classified(docs)
    linked = sign.select("doc_id", "key1", "key2").join(known, ["key1", "key2"]).select("doc_id", "class_id", "n_links")
    alone = docs.where(F.col("doc_id").isNull() | F.coalesce(~F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(True)))
    alone = alone.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def representatives(docs: DataFrame) -> DataFrame:
    """The documents with one row of each class left.  Rows without doc_id, and without words, stay."""
    _, known = classified(docs)
    stay = cut(known.groupBy("component").agg(F.min(F.struct("doc", "hash")).alias("one")).select(F.col("one.doc").alias("stay"), F.col("one.hash").alias("by")))
    worded = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    key = ["own doc_id", "own hash"]  # one exchange of the texts serves the join and the choice of a row
    own = docs.where(worded).withColumns({key[0]: F.col("doc_id").cast("long"), key[1]: F.xxhash64("text")})
    kept = own.join(stay.toDF(*key), key, "left_semi").dropDuplicates(key).drop(*key)
    return kept.select(*docs.columns).unionByName(docs.where(~worded))


#: The classes in DuckDB's SQL over `documents`, from all pairs that share a shingle.
ORACLE = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), hashed AS (
  SELECT doc_id, hash(s) AS h FROM shingles
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM hashed a JOIN hashed b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN sides l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS class_id FROM reach GROUP BY a
)
SELECT doc_id, class_id, (SELECT count(*) FROM sides WHERE sides.a = doc_id)::BIGINT AS n_links FROM documents JOIN least ON least.a = doc_id
"""
