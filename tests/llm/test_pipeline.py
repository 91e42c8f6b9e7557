"""The pipeline over the small tables, each stage held against what its operator promises."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from livedex.llm import jaccard_join, language_id, mixing, pii


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "PII", "mixing sources to target weights", "best-fit packing"]
    for df in kept[1:-1]:
        assert df.columns == kept[0].columns
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(kept[-1].columns)


def test_language_stage(kept):
    out = language_id.identified(kept[0]).collect()
    assert ids(kept[1]) == {r["doc_id"] for r in out if r["lang_pred"] != "und" and not r["ambiguous"]}
    assert kept[1].count() >= 0.97 * kept[0].count()


def test_jaccard_stage(kept):
    from test_texts import brute_classes, texts_of

    classes = {c for _, c, _ in brute_classes(texts_of(kept[1]))}
    assert {str(x) for x in ids(kept[2])} == classes and kept[2].count() == len(classes)
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in jaccard_join.classes(kept[1]).collect()) == brute_classes(texts_of(kept[1]))


def test_pii_stage(kept):
    field = pii.trained()
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in kept[2:4])
    assert after == {k: pii.without(t, field) for k, t in before.items()}
    assert any("[EMAIL]" in t for t in after.values()) and not any(pii.base_spans(t) for t in after.values())


def test_mixing_stage(kept):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(kept[3]).collect()}
    assert collections.Counter(r["doc_id"] for r in kept[4].collect()) == collections.Counter({k: n for k, n in copies.items() if n})


def test_packing_stage(kept):
    import public_tokenizers

    from livedex.llm.packing import Ids

    model = Ids(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in kept[4].collect():
        want[r["doc_id"]] += len(model.ids(r["text"])) // 4 + 1
    got = {r["doc_id"]: r["n"] for r in kept[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == dict(want)
    bins = kept[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(b["n"] == b["end"] <= 1024 for b in bins)
    assert len(bins) <= sum(want.values()) / 1024 * 1.02 + 1


def test_run_is_the_stages_in_order(spark, sf_dir, kept):
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, out.drop("sequence_id", "offset").collect())) == sorted(map(str, kept[-1].drop("sequence_id", "offset").collect()))
