"""Operators on embeddings against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from livedex.llm import embedding_dedup, topk_search
from livedex.llm.components import components, forest

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 16))
    rows = [(k, (centres[k % 6] + r.normal(size=16) * (0.05 if k % 4 else 0.5)).astype(np.float32).tolist(), 1) for k in range(600)]
    rows += [(1000 + k, rows[0][1], None) for k in range(25)]
    rows += [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [1.0] * 15 + [None], 1), (2080, [math.inf] * 16, 1), (2100, [1.0, 2.0], 1), (2120, [1.0, 2.0], 1), (2140, [], 1), (None, rows[1][1], 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("block", F.lit(1)).withColumn("node", F.lit("x")), rows


def fit(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 150)
    df, rows = vectors(spark)
    got = collections.defaultdict(list)
    for x in topk_search.search(df, F.col("vec_id") % 20 == 0).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    whole = [(k, [math.floor(64 * x) for x in v]) for k, v, _ in rows if k is not None and fit(v)]
    want = {}
    for k, q in whole:
        if k % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in whole if i != k and len(v) == len(q))[:20]
            want[k] = [(n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert topk_search.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_huge_components(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 2)
    values = [2.0**k for k in (60, 61, 62, 59, 400)] + [-(2.0**65), 3.0]
    rows = [(k * 20, [x, float(k)], 1) for k, x in enumerate(values)]
    out = topk_search.search(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), F.lit(True)).collect()
    assert len(out) == 42
    exact = [[int(64 * x), 64 * k] for k, x in enumerate(values)]
    for k, q in enumerate(exact):
        order = sorted((-(q[0] * v[0] + q[1] * v[1]), i) for i, v in enumerate(exact) if i != k)
        got = sorted((x["rank"], x["vec_id"], x["score"]) for x in out if x["query_id"] == k * 20)
        assert got == [(n + 1, i * 20, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(order)]


def test_top_k_of_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), *((k, [k / 40, 0.5], 1) for k in range(1, 31) if k % 20)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = topk_search.search(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((x["rank"], x["vec_id"]) for x in out) == sorted((n + 1, k) for n, k in enumerate([k for k in range(30, 0, -1) if k % 20][:20]) for _ in range(2))


def test_tree_is_an_m_tree_that_prunes_and_is_exact():
    r = np.random.default_rng(5)
    for v, most in (
        (np.floor(r.normal(size=(40, 12)).repeat(50, 0) * 64 + r.normal(size=(2000, 12)) * 3), 0.25),  # clustered
        (np.floor(r.normal(size=(40, 12)).repeat(50, 0) * 64 * r.uniform(0.1, 4, (2000, 1)) + r.normal(size=(2000, 12)) * 3), 0.25),  # of very different norms
        (np.floor(r.normal(size=(2000, 4)) * 64), 0.35),  # few dimensions
        (np.floor(r.normal(size=(2000, 64)) * 8), 1.0),  # nothing to avoid
    ):
        tree = topk_search.MTree(np.arange(2000), v)
        for k, below in enumerate(tree.children):
            for c in below:
                assert tree.to_parent[c] == pytest.approx(np.linalg.norm(tree.routing[c] - tree.routing[k]))
        for rows, away, centre, radius in zip(tree.rows, tree.away, tree.routing, tree.radius, strict=True):
            assert np.allclose(away, np.linalg.norm(v[rows] - centre, axis=1)) and (away <= radius + 1e-9).all()
        assert sorted(np.concatenate(tree.rows).tolist()) == list(range(2000))
        asked = r.choice(2000, 60, replace=False)
        row, score = tree.search(asked, v[asked], 5)
        for n, own in enumerate(asked):
            s = v @ v[own]
            s[own] = -np.inf
            best = np.lexsort([np.arange(2000), -s])[:5]
            assert row[n].tolist() == best.tolist() and score[n].tolist() == s[best].tolist()
        assert tree.computed <= most * tree.possible


def test_near_duplicates(spark):
    df, rows = vectors(spark)
    out = embedding_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    ids = [k for k, v, _ in rows if k is not None and fit(v) and any(v)]
    v = {k: np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64)) for k, x, _ in rows if k in set(ids)}
    links, root = collections.Counter(), {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and len(v[a]) == len(v[b]) and v[a] @ v[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for x in out:
        k = x["vec_id"]
        if k in root:
            assert (x["n_links"], x["component_id"], x["kept"]) == (links[k], find(k), find(k) == k)
        else:
            assert (x["n_links"], x["component_id"], x["kept"]) == (0, k, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_many_tiles_and_bounds(spark, monkeypatch):
    df, _ = vectors(spark)
    nodes = embedding_dedup.nodes_of(df)
    few = {(x["node"]): x["n"] for x in embedding_dedup.links(nodes).groupBy("node").agg(F.sum("links").alias("n")).collect()}
    many = {(x["node"]): x["n"] for x in embedding_dedup.links(nodes, tile_rows=20, pivots=5).groupBy("node").agg(F.sum("links").alias("n")).collect()}
    assert few == many
    third = {(x["node"]): x["n"] for x in embedding_dedup.links(nodes, tile_rows=7, pivots=40).groupBy("node").agg(F.sum("links").alias("n")).collect()}
    assert few == third
    chosen = embedding_dedup.pivots_of(nodes, 20, 5)
    assert {k: len(v) for k, v in chosen.items()} == {16: 5}
    cells = [{"dim": 16, "cell": k, "angle": 0.01} for k in range(5)]
    assert [c[1:] for c in embedding_dedup.near_cells(cells, chosen, 0.01)][:1] == [(0, 0)] and len(embedding_dedup.near_cells(cells, chosen, 4.0)) == 15
    u = embedding_dedup.unit(np.random.default_rng(0).normal(size=(200, 32)))
    q, s, e = embedding_dedup.quantised(u)
    assert (np.abs(u @ u.T - (q @ q.T.astype(float)) * s[:, None] * s) <= e[:, None] + (1 + e[:, None]) * e + 1e-9).all()


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    out = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = forest(300, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    assert out == {k: int(label[k]) for e in edges for k in e if e[0] != e[1]}
