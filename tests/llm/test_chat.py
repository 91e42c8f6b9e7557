"""Chat formatting: trees, ranks, round trips."""

import hashlib
import random

from pyspark.sql import functions as F

from livedex.llm import chat_format as cf

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "<", "[", "/", "<\\s>", "é", "\n", "a "]


def brute_paths(rows, per_tree):
    """Best branches by mean score of every tree, walked one step at a time."""
    node = {}
    for i, p, *_ in rows:
        node.setdefault(i, p)
    score = {i: s for i, _, _, _, s in rows}
    parent = {i: p if p in node else None for i, p in node.items()}
    out = {}
    for leaf in set(node) - set(parent.values()):
        path, at = [], leaf
        while at is not None and len(path) <= len(node):
            path.append(at)
            at = parent[at]
        if at is None:
            out.setdefault(path[-1], []).append((-sum(score[x] for x in path) / len(path), -len(path), leaf, path[::-1]))
    return {(root, k + 1): p[3] for root, ps in out.items() for k, p in enumerate(sorted(ps)[:per_tree])}


def test_trees(spark):
    r = random.Random(4)
    rows = []
    for k in range(120):
        parent = None if k % 40 == 0 else f"n{k - 1 if r.random() < 0.6 else (k // 40) * 40 + r.randint(0, k % 40 - 1)}"
        text = "".join(r.choice(CONTROL) for _ in range(r.randint(0, 6)))
        rows.append((f"n{k}", parent, r.choice(("user", "assistant", "system", "tool[TEXT]", None)), text, float(r.randint(0, 4))))
    rows += [("m", "missing", "user", None, 1.0), ("c1", "c2", "user", "x", 1.0), ("c2", "c1", "user", "y", 1.0), ("below", "c1", "user", "z", 9.0)]
    df = spark.createDataFrame(rows, "id string, parent string, role string, text string, score double").withColumn("root", F.lit(1)).withColumn("depth", F.lit("x"))
    out = cf.formatted(df, per_tree=2).withColumn("turns", cf.parsed(F.col("formatted"))).withColumn("loss", cf.loss_text(F.col("formatted"))).collect()
    said = {i: (role or "", text or "") for i, _, role, text, _ in rows}
    want = brute_paths(rows, 2)
    assert {(x["root"], x["branch"]) for x in out} == set(want)
    for x in out:
        turns = [said[i] for i in want[x["root"], x["branch"]]]
        assert [(t["role"], t["text"]) for t in x["turns"]] == turns
        assert x["loss"] == "".join(t for role, t in turns if role == "assistant")
        spans = [x["formatted"][s["start"] : s["start"] + s["length"]] for s in x["loss_spans"]]
        assert len(spans) == sum(role == "assistant" for role, _ in turns)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 5, None, None), (None, 1, "user", "no id"), (3, None, "user", "x" * 100_000), (3, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(9))
    out = {x["conv_id"]: x for x in cf.digests(df).collect()}
    assert set(out) == {1, 2, 3, None}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 42
    assert out[1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]" * 2).hexdigest()
    assert out[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest()
    assert out[3]["n_turns"] == 2 and out[3]["turns_sha256"] == hashlib.sha256(b"user\n" + b"x" * 100_000 + b"\nassistant\n\n").hexdigest()
    assert cf.digests(df.limit(0)).count() == 0


def test_same_as_sql_on_odd_control_strings(spark):
    import duckdb
    import pandas as pd

    texts = ["a <INST] b", "[s> <TEXT]", "<<SYS>> <</s> [/ROLE] [[TEXT]", "\\<s>\\", "<\\s>", "", None]
    rows = pd.DataFrame([(k, t, role, x) for k in range(9) for t, x in enumerate(texts) for role in (["user", "assistant"][t % 2],)], columns=["conv_id", "turn", "role", "text"])
    con = duckdb.connect()
    con.register("conversations", rows)
    want = con.execute(cf.ORACLE).df().sort_values("conv_id").reset_index(drop=True)
    extra = [(-1, t, role, "</s>[INST] ok [/INST]") for t, role in enumerate(("user", "assistant"))]
    df = spark.createDataFrame([tuple(None if x is None else x for x in r) for r in rows.itertuples(index=False)] + extra, "conv_id long, turn long, role string, text string")
    got = cf.digests(df).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert (got[sorted(got.columns)].values == want[sorted(want.columns)].values).all()


def test_columns_with_other_names_dont_clash(spark):
    rows = [("a", None, "user", "x", 1.0), ("b", "a", "assistant", "y", 1.0)]
    df = spark.createDataFrame(rows, "id string, parent string, role string, text string, score double")
    for name in ("root", "depth", "leaf", "branch", "step", "place", "end", "head", "body", "tail", "plain", "found", "up", "top", "n"):
        df = df.withColumn(name, F.lit("clash"))
    assert [x["formatted"] for x in cf.formatted(df).collect()] == ["[INST]x[/INST]<s>y</s>"]
    conversations = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    for name in ("root", "id", "score", "parent", "n", "key", "turns", "loss"):
        conversations = conversations.withColumn(name, F.lit("clash"))
    assert cf.digests(conversations).first()["n_turns"] == 1
