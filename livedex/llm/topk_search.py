"""Exact top-k search by integer inner product with an M-tree.

Vectors are dealt by a hash over shards of a few thousand rows; each shard is an M-tree.  A node has a routing vector, a
covering radius, the distance to its parent's routing vector and the largest norm below it; leaves are pages of entries
with their distances to the routing vector.  For a query q, everything below a node at c with radius r has a product of
at most q.c + |q| r, and, as it is at least d(q, c) - r away, of at most (|q|^2 + top^2 - (d(q, c) - r)^2) / 2.  The same
two bounds with the parent's numbers, by the triangle inequality, come before d(q, c) is computed, and those of an
entry before its product is.

Queries come in blocks against each shard.  A query's open nodes are visited best first, by bound; a block visits as
many nodes at a time as it has queries, so the work is in arrays.  A query is done when its best bound is below its k-th
best score.  Bounds are widened by the rounding they may hold; scores are exact integers.  The shards' best k of a query
are merged by rank.

Rows whose vector is null, or holds null or non-finite components, take no part.  Vectors are only compared with
vectors of their own length.  A query's own row, and others with its id, are no candidates.  Repeated rows are separate
candidates, and separate queries, each with its k rows.  Components that are so large that products might not be exact
in doubles are multiplied as Python integers; a score beyond 64 bits is held at the limit, but ranked as it is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

SHARD_ROWS, PAGE_ROWS, FANOUT, QUERY_ROWS = 4096, 64, 8, 4096
SCALE = 64
_EXACT = 2.0**52


def usable(column: str = "embedding") -> Column:
    """Not null, and every component finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True))


def blocks(rows: DataFrame, per_block: int, *, named: str) -> DataFrame:
    """Rows (vec_id, v: array of doubles) as blocks of one vector length: dim, block, ids and vectors as binaries.

    Blocks are dealt by a hash of id and vector, so their sizes are even whatever the ids and values are.
    """
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("blocks"))
    dealt = rows.join(sizes, "dim")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")))

    def gather(key, table):
        ids = table.column("vec_id").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        order = np.lexsort([*v.T[::-1], ids]) if len(ids) else np.zeros(0, int)
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([v[order].astype("<f8").tobytes()], pa.binary())],
            ["dim", named, "ids", "vectors"],
        )

    return dealt.select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInArrow(gather, f"dim int, {named} long, ids binary, vectors binary")


def halved(v: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows in two halves, by which of two far ones they lean to."""
    far = rows[np.argmax(((v[rows] - v[rows[0]]) ** 2).sum(1))]
    other = rows[np.argmax(((v[rows] - v[far]) ** 2).sum(1))]
    order = np.argsort(v[rows] @ (v[far] - v[other]), kind="stable")
    return [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


class MTree:
    """Nodes in arrays, the root first; children of a node, and rows of a leaf, stand in lists."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, page_rows: int = PAGE_ROWS, fanout: int = FANOUT):
        self.ids, self.v, self.norms = ids, v, np.einsum("ij,ij->i", v, v)
        self.computed = self.possible = 0  # products with entries, done and without any bound
        self.children: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []  # of leaves
        routing, radius, top, parent, self.away = [], [], [], [], []
        todo = [(np.arange(len(v)), -1)] if len(v) else []
        while todo:
            rows, above = todo.pop()
            k = len(routing)
            routing.append(v[rows].mean(0))
            away = np.sqrt(((v[rows] - routing[k]) ** 2).sum(1))
            radius.append(away.max())
            top.append(self.norms[rows].max())
            parent.append(above)
            self.children.append([])
            if above >= 0:
                self.children[above].append(k)
            leaf = len(rows) <= page_rows
            self.rows.append(rows if leaf else rows[:0])
            self.away.append(away if leaf else away[:0])
            if not leaf:
                parts = [rows]
                while len(parts) < fanout and len(parts[0]) > page_rows:
                    parts = [half for part in parts for half in halved(v, part)]
                todo += [(part, k) for part in parts]
        self.routing, self.radius, self.top = np.array(routing).reshape(len(routing), v.shape[1]), np.array(radius), np.array(top)
        above = np.array(parent, int)
        self.to_parent = np.sqrt(((self.routing - self.routing[above]) ** 2).sum(1)) if len(above) else np.zeros(0)
        self.children = [np.array(c, int) for c in self.children]

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and products of each query's best k (row -1: fewer)."""
        n, nodes = len(q), len(self.children)
        score, row = np.full((n, k), -np.inf), np.full((n, k), -1)
        self.possible += n * len(self.v)
        if not n or not nodes:
            return row, score
        norm = np.einsum("ij,ij->i", q, q)
        length = np.sqrt(norm)
        slack = 1e-6 * (1 + norm + self.top[0])
        # What is known of an open node: its bound (-inf: not open), and of a visited one: product and distance.
        bound, product, distance = np.full((n, nodes), -np.inf), np.zeros((n, nodes)), np.zeros((n, nodes))
        product[:, 0] = q @ self.routing[0]
        distance[:, 0] = np.sqrt(np.maximum(norm + self.routing[0] @ self.routing[0] - 2 * product[:, 0], 0.0))
        bound[:, 0] = np.inf
        while True:
            best = bound.argmax(1)
            open_ = np.flatnonzero(bound[np.arange(n), best] >= score[:, -1] - slack)
            open_ = open_[bound[open_, best[open_]] > -np.inf]
            if not len(open_):
                return row, score
            node = best[open_]
            bound[open_, node] = -np.inf
            by = np.argsort(node, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(node[by])) + 1):
                at, who = node[group[0]], open_[group]
                limit = (score[who, -1] - slack[who])[:, None]
                if len(self.children[at]):
                    below = self.children[at]
                    by_parent = self.most(norm[who], length[who], product[who, at][:, None] + length[who][:, None] * self.to_parent[below], np.abs(distance[who, at][:, None] - self.to_parent[below]), below)
                    near = np.flatnonzero((by_parent >= limit).any(0))
                    below = below[near]
                    p = q[who] @ self.routing[below].T
                    d = np.sqrt(np.maximum(norm[who, None] + np.einsum("ij,ij->i", self.routing[below], self.routing[below]) - 2 * p, 0.0))
                    cells = np.ix_(who, below)
                    product[cells], distance[cells] = p, d
                    most = np.minimum(by_parent[:, near], self.most(norm[who], length[who], p, d, below))
                    bound[cells] = np.where(most >= limit, most, -np.inf)
                else:
                    rows, away = self.rows[at], self.away[at]
                    apart = np.maximum(np.abs(distance[who, at][:, None] - away) - 1e-6 * (1 + length[who] + math.sqrt(self.top[0]))[:, None], 0.0)
                    most = np.minimum(product[who, at][:, None] + length[who][:, None] * away, (norm[who, None] + self.norms[rows] - apart**2) / 2)
                    wanted = most >= limit
                    entries = np.flatnonzero(wanted.any(0))
                    asking = np.flatnonzero(wanted.any(1))
                    if len(entries) and len(asking):
                        found = q[who[asking]] @ self.v[rows[entries]].T
                        self.computed += found.size
                        found[query_ids[who[asking]][:, None] == self.ids[rows[entries]]] = -np.inf
                        self.merge(score, row, who[asking], found, rows[entries])

    def most(self, norm, length, product, distance, nodes) -> np.ndarray:
        """The largest product that anything below the nodes may have, by products with and distances to their routing vectors."""
        apart = np.maximum(distance - self.radius[nodes] - 1e-6 * (1 + length + math.sqrt(self.top[0]))[:, None], 0.0)
        return np.minimum(product + length[:, None] * self.radius[nodes], (norm[:, None] + self.top[nodes] - apart**2) / 2)

    def merge(self, score, row, who, found, rows) -> None:
        """Keeps the best k of each query: higher products, then smaller ids."""
        k = score.shape[1]
        i, j = np.nonzero((found >= score[who, -1][:, None]) & (found > -np.inf))
        asking, i = np.unique(i, return_inverse=True)
        who = who[asking]
        s = np.concatenate([score[who].ravel(), found[asking[i], j]])
        r = np.concatenate([row[who].ravel(), rows[j]])
        w = np.concatenate([np.repeat(np.arange(len(who)), k), i])
        order = np.lexsort([r, np.where(r >= 0, self.ids[r], np.iinfo(np.int64).max), -s, w])
        place = np.arange(len(order)) - np.searchsorted(w[order], np.arange(len(who)))[w[order]]
        best, place = order[place < k], place[place < k]
        score[who[w[best]], place], row[who[w[best]], place] = s[best], r[best]


def exact_search(ids, v, query_ids, q, k):
    """The same for components that doubles don't multiply exactly: Python integers, every pair, and scores of any size."""
    whole = [[int(x) for x in r] for r in v.tolist()]
    row, score = np.full((len(q), k), -1), np.full((len(q), k), None, object)
    for n, (own, vector) in enumerate(zip(query_ids, q.tolist(), strict=True)):
        vector = [int(x) for x in vector]
        found = sorted((-sum(a * b for a, b in zip(vector, x, strict=True)), int(i), m) for m, (i, x) in enumerate(zip(ids, whole, strict=True)) if i != own)
        for place, (s, _, m) in enumerate(found[:k]):
            row[n, place], score[n, place] = m, -s
    return row, score


def held(score: int) -> tuple[int, bytes | None]:
    """A score within 64 bits, and for one beyond them bytes in the order of the scores."""
    inside = max(-(1 << 63), min((1 << 63) - 1, score))
    if inside == score:
        return score, None
    raw = abs(score).to_bytes(-(-abs(score).bit_length() // 8), "big")
    raw = len(raw).to_bytes(4, "big") + raw
    return inside, raw if score > 0 else bytes(255 - x for x in raw)


def search(vectors: DataFrame, queries: Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """The k best candidates of every row for which `queries` holds: query_id, rank, vec_id, score."""
    # Doubles from 2^53 on are whole, and floor() would hold them at the limit of a long.
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    floors = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    rows = vectors.where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long").alias("vec_id"), floors.alias("v"), F.size("embedding").alias("dim"), queries.alias("asks"))
    asked = stored(blocks(rows.where("asks"), QUERY_ROWS, named="ask"), "queries").withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    shards = stored(blocks(rows, SHARD_ROWS, named="shard"), "shards")
    # A stated query set against all rows, in blocks: a block of queries goes to every shard of its length, and a shard
    # stays where it is, so its tree is built once.
    numbers = shards.groupBy("dim").agg((F.max("shard") + 1).alias("n"))  # a row a length
    sent = asked.join(numbers, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pairs = sent.join(shards, ["dim", "shard"]).select("dim", "shard", "ids", "vectors", "ask", "q_ids", "q_vectors")

    def best(batches):
        last, tree = None, None
        for batch in batches:
            for one in batch.to_pylist():
                ids, q_ids = np.frombuffer(one["ids"], "<i8"), np.frombuffer(one["q_ids"], "<i8")
                v, q = (np.frombuffer(b, "<f8").reshape(len(i), -1) for b, i in ((one["vectors"], ids), (one["q_vectors"], q_ids)))
                if max(np.abs(v).max(initial=0), np.abs(q).max(initial=0)) ** 2 * max(1, one["dim"]) < _EXACT:
                    if last != (one["dim"], one["shard"]):
                        last, tree = (one["dim"], one["shard"]), MTree(ids, v)
                    row, score = tree.search(q_ids, q, k)
                else:
                    row, score = exact_search(ids, v, q_ids, q, k)
                there = row >= 0
                of, place = np.nonzero(there)
                scores = [held(int(x)) for x in score[there]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[of]), pa.array(np.full(len(of), one["ask"])), pa.array(of), pa.array(ids[row[there]]), pa.array([x for x, _ in scores], pa.int64()), pa.array([x for _, x in scores], pa.binary()), pa.array(place)],
                    ["query_id", "ask", "asker", "vec_id", "score", "beyond", "part"],
                )

    found = pairs.mapInArrow(tidy(best), "query_id long, ask long, asker long, vec_id long, score long, beyond binary, part long")
    # A query is a row of a block of queries: rows that share an id are separate queries.
    order = Window.partitionBy("query_id", "ask", "asker").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id", "part")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH usable AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
