"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Rows with the same vector are one node with a weight.  Nodes are dealt over cells around pivots, as many as there would
be tiles up to a bound, and each cell over tiles of a few thousand nodes.  A cell knows the angle that covers it: cells
that the triangle inequality on angles keeps apart are never paired, and tiles only meet tiles of paired cells, where
the same test on their own centres and angles follows.  In the pairs that stay, unit vectors are int8 numbers times a
scale of their own.  With e the norm of a vector's quantisation error, a cosine differs from the quantised product by at
most e_u + (1 + e_u) e_w.  A product that stays above or below the threshold by its bound is decided; only the pairs
between are computed again in doubles.

Of a pair, one tile (by a hash) is the owner, and the other is sent to it, a few to a task; so a tile moves once for each
pair it doesn't own, and once for each task it does.  Vectors in no clusters are far from nothing, and then all tiles
meet: the work is quadratic, as the method of tile products is, but never in one task.

A tile pair returns one row per node with a link: how many vectors it links with there, and the root of a spanning
forest of the links, never the pairs themselves.  Components of the forests are components of the links.

Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths
aren't compared.  Rows without vec_id link with nothing.  Repeated rows are separate vectors, which link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored, tidy
from .components import components, forest
from .topk_search import usable

THRESHOLD = 0.95
#: Nodes of a tile, pivots of a vector length at most, tiles that are sent to a task, and rows that are multiplied at once.
TILE, PIVOTS, SENT, ROWS = 8192, 1024, 4, 512


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True, initial=1e-300)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scales and the norms of the errors (rounded up) of unit vectors."""
    scale = np.abs(u).max(1, initial=0.0) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    error = np.sqrt(((u - q * scale[:, None]) ** 2).sum(1)) + 1e-12
    return q, scale, error


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of unit vectors whose cosine reaches the threshold, by quantised products."""
    (qa, sa, ea), (qb, sb, eb) = quantised(a), quantised(b)
    exact = a.shape[1] * 127 * 127 < 1 << 24  # then single precision adds int8 products without rounding
    qb = qb.astype(np.float32 if exact else np.float64)
    rows, columns = [], []
    # A row's least product, in units of its scale; rounding to single precision is less than the millionth taken off.
    least = (threshold - ea - (1 + ea) * eb.max(initial=0.0) - 1e-9) / sa
    least = (least - np.abs(least) * 1e-6).astype(np.float32)
    units = sb.astype(qb.dtype)
    for k in range(0, len(a), ROWS):
        part = slice(k, k + ROWS)
        whole = qa[part].astype(qb.dtype) @ qb.T
        whole *= units
        i, j = np.nonzero(whole >= least[part, None])
        product = whole[i, j].astype(np.float64) * sa[k + i]
        bound = ea[k + i] + (1 + ea[k + i]) * eb[j] + 1e-6  # with the rounding of `whole`
        near = product + bound >= threshold
        i, j, product, bound = i[near], j[near], product[near], bound[near]
        open_ = product - bound < threshold
        keep = ~open_
        check = np.flatnonzero(open_)
        for c in range(0, len(check), 1 << 18):
            at = check[c : c + (1 << 18)]
            keep[at] = np.einsum("ij,ij->i", a[k + i[at]], b[j[at]]) >= threshold
        rows.append(i[keep] + k)
        columns.append(j[keep])
    return np.concatenate(rows), np.concatenate(columns)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """One row per different vector: v, node (least vec_id), weight."""
    fit = vectors.where(F.col("vec_id").isNotNull() & usable() & F.exists("embedding", lambda x: x != 0))
    return fit.groupBy(F.col("embedding").alias("v")).agg(F.min("vec_id").cast("long").alias("node"), F.count(F.lit(1)).alias("weight"))


def pivots_of(nodes: DataFrame, tile_rows: int, pivots: int) -> dict[int, np.ndarray]:
    """Unit vectors by length: of lengths with more nodes than a tile, the first ones by a hash, at most `pivots`."""
    sizes = nodes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile_rows)
    first = Window.partitionBy("dim").orderBy(F.xxhash64("node"), "node")
    found = nodes.select("node", "v", F.size("v").alias("dim")).join(sizes, "dim").withColumn("place", F.row_number().over(first))
    found = found.where((F.col("place") <= pivots) & (F.col("place") <= F.ceil(F.col("n") / tile_rows))).select("dim", "place", "v").collect()
    out = {}
    for dim in sorted({r["dim"] for r in found}):
        out[dim] = unit(np.array([r["v"] for r in sorted((r for r in found if r["dim"] == dim), key=lambda r: r["place"])], np.float64))
    return out


def near_cells(cells: list, chosen: dict[int, np.ndarray], reach: float) -> list[tuple[int, int, int]]:
    """(dim, cell, cell2), cell <= cell2, of all cells (rows of dim, cell, angle) that may hold vectors within `reach` of each other."""
    out = []
    for dim in sorted({c["dim"] for c in cells}):
        own = sorted((c["cell"], c["angle"]) for c in cells if c["dim"] == dim)
        names, angle = np.array([c for c, _ in own]), np.array([a for _, a in own])
        if dim not in chosen:
            out.append((dim, 0, 0))
            continue
        p = chosen[dim][names]
        near = np.arccos(np.clip(p @ p.T, -1, 1)) <= angle[:, None] + angle + reach
        np.fill_diagonal(near, True)
        out += [(dim, int(names[i]), int(names[j])) for i, j in zip(*np.nonzero(np.triu(near)), strict=True)]
    return out


def tiles(nodes: DataFrame, tile_rows: int, pivots: int, reach: float) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """dim, cell, tile, centre (array), angle, and the nodes' ids, weights and vectors as binaries; and the pairs of cells to compare."""
    chosen = pivots_of(nodes, tile_rows, pivots)

    def nearest(batches):
        for batch in batches:
            v = batch.column("v")
            lengths = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            cell, angle = np.zeros(len(lengths), np.int32), np.full(len(lengths), math.pi)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                if dim in chosen:
                    cosine = unit(flat[starts[at][:, None] + np.arange(dim)]) @ chosen[dim].T
                    cell[at] = np.argmax(np.round(cosine, 12), 1)
                    angle[at] = np.arccos(np.clip(cosine[np.arange(len(at)), cell[at]], -1, 1)) + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), v, pa.array(cell), pa.array(angle)], ["node", "weight", "v", "cell", "angle"])

    kind = nodes.schema["v"].dataType.simpleString()
    dealt = cut(nodes.select("node", "weight", "v").mapInArrow(tidy(nearest), f"node long, weight long, v {kind}, cell int, angle double").withColumn("dim", F.size("v")))
    sizes = cut(dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("parts"), F.max("angle").alias("angle")))
    paired = near_cells(sizes.select("dim", "cell", "angle").collect(), chosen, reach)  # a row a pivot
    dealt = dealt.drop("angle").join(sizes.drop("angle"), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def gather(key, table):
        ids, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        u = unit(v)
        centre = u.mean(0)
        centre /= max(math.sqrt(float(centre @ centre)), 1e-300)
        angle = float(np.arccos(np.clip((u @ centre).min(), -1, 1))) + 1e-6
        dim, cell, part = (k.as_py() for k in key)
        return pa.Table.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), pa.array([(cell << 32) + part], pa.int64()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([angle]), *(pa.array([x[order].tobytes()], pa.binary()) for x in (ids, weight, v.astype("<f4") if single else v))],
            ["dim", "cell", "tile", "centre", "angle", "ids", "weights", "vectors"],
        )

    single = "float" in kind
    schema = "dim int, cell int, tile long, centre array<double>, angle double, ids binary, weights binary, vectors binary"
    return stored(dealt.groupBy("dim", "cell", "part").applyInArrow(gather, schema), "tiles"), paired


def links(nodes: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """(node, links: weight of the nodes it links with, root: a node it is connected with), a few rows per node."""
    reach = math.acos(threshold) + 1e-6
    kept, paired = tiles(nodes, tile_rows, pivots, reach)
    kind = "<f4" if "float" in nodes.schema["v"].dataType.simpleString() else "<f8"
    paired = nodes.sparkSession.createDataFrame(paired, "dim int, cell int, cell2 int")
    brief = kept.select("dim", "cell", "tile", "centre", "angle")
    other = brief.toDF("dim", "cell2", "tile2", "centre2", "angle2")
    dot = F.aggregate(F.zip_with("centre", "centre2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) <= F.col("angle") + F.col("angle2") + reach
    pairs = brief.join(paired, ["dim", "cell"]).join(other, ["dim", "cell2"]).where((F.col("tile") <= F.col("tile2")) & ((F.col("tile") == F.col("tile2")) | near))
    swapped = (F.xxhash64("tile", "tile2") % 2 == 0) & (F.col("tile") != F.col("tile2"))
    pairs = pairs.select("dim", F.when(swapped, F.col("tile2")).otherwise(F.col("tile")).alias("own"), F.when(swapped, F.col("tile")).otherwise(F.col("tile2")).alias("sent"))
    tasks = F.ceil(F.col("n") / SENT).cast("long")
    owned = pairs.groupBy("dim", "own").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs.join(owned, ["dim", "own"]).withColumn("task", F.pmod(F.xxhash64("sent"), tasks)).drop("n"))
    data = kept.select("dim", "tile", "ids", "weights", "vectors")
    columns = ["dim", "own", "task", "tile", "ids", "weights", "vectors"]
    sent = pairs.where("own <> sent").withColumnRenamed("sent", "tile").join(data, ["dim", "tile"]).select(*columns)
    # The owner's row has its own number as the tile; the task that holds the pair with itself is marked by a row of its own.
    owners = pairs.groupBy("dim", "own", "task").agg(F.max(F.col("own") == F.col("sent")).alias("itself")).withColumn("tile", F.col("own"))
    owners = owners.join(data, ["dim", "tile"]).select(*columns, "itself")

    def compare(key, rows):
        out = [pa.RecordBatch.from_pydict({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})]

        def read(k):
            ids, w = (np.frombuffer(rows.column(c)[k].as_py(), "<i8") for c in ("ids", "weights"))
            return ids, w, unit(np.frombuffer(rows.column("vectors")[k].as_py(), kind).astype(np.float64).reshape(len(ids), -1))

        def add(ids, i, j, sums):
            root = forest(len(ids), i, j)
            has = np.flatnonzero(sums)
            out.append(pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(sums[has].astype(np.int64)), pa.array(ids[root[has]])], ["node", "links", "root"]))

        itself = rows.column("itself").to_pylist()
        own = next(k for k, x in enumerate(itself) if x is not None)
        ids, w, a = read(own)
        if itself[own]:
            i, j = linked(a, a, threshold)
            i, j = i[i != j], j[i != j]
            add(ids, i, j, np.bincount(i, w[j], minlength=len(ids)))
        for k in range(rows.num_rows):
            if k != own:
                ids2, w2, b = read(k)
                i, j = linked(a, b, threshold)
                add(np.concatenate([ids, ids2]), i, j + len(a), np.concatenate([np.bincount(i, w2[j], minlength=len(ids)), np.bincount(j, w[i], minlength=len(ids2))]))
        return pa.Table.from_batches(out)

    work = sent.withColumn("itself", F.lit(None).cast("boolean")).unionByName(owners)
    return cut(work.groupBy("dim", "own", "task").applyInArrow(compare, "node long, links long, root long"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    nodes = cut(nodes_of(vectors))
    found = links(nodes, threshold)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    known = nodes.join(sums, "node", "left").join(parts, "node", "left")
    known = known.select(
        F.col("v").alias("embedding"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    every = vectors.select("vec_id", "embedding")
    out = every.join(known, (every["embedding"] == known["embedding"]) & every["vec_id"].isNotNull(), "left")
    own = F.col("vec_id").cast("long")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", own).alias("component_id"), F.coalesce(F.coalesce("component_id", own) == own, F.lit(True)).alias("kept")
    )


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c ON c.a = e.vec_id
"""
