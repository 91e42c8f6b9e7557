"""Operators on texts: edge cases of each, and brute force on small fixtures."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from livedex.llm import elias_fano, jaccard_join, language_id, lm_scoring, mixing, packing, pii, suffix_dedup
from livedex.llm.common import Words, mixed, utf8

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("size", "band", "bucket", "doc", "at", "h", "node", "key1", "component", "spans", "length", "rank", "held_out", "kept", "stay", "f", "score", "shard")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    df = spark.createDataFrame(rows, schema)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(n))
    long = prose(9000)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, long, "en", None, 1), (3, long, "en", None, 1), (4, prose(300), None, "b", 1), (5, " \n\t ", "de", "b", 3),
        (None, prose(80), "en", "a", 5), (None, None, None, None, None), (6, "one", "fr", "a", 3), (7, "one", "fr", "b", 3), (8, "a" * 3000, "en", "c", 9), (9, "12 34", "en", "c", 5), (10, long[:30000] + " x", "en", "a", 1),
    ]
    return frame(spark, rows).cache()


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_word_hashes():
    for texts in (["a b", "b", None, "", " a", "b a\n", "ab"], ["x"], [""], []):
        data, ends = utf8(texts)
        h, at = Words()(data, ends)
        seen = {}
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            found = WORD.findall(t or "")
            assert len(found) == b - a
            for w, x in zip(found, h[a:b].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


# -- mixing


def test_mixing(odd):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count()
    by = collections.defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in out)
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:  # share, stop those above their limit, share again
        left = 1.5 * total - sum(target[s] for s in full)
        open_ = [s for s in names if s not in full]
        now = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if now[s] > 2 * by[s][0]["source_size"]}
        if not over:
            target |= now
            break
        target |= {s: 2 * by[s][0]["source_size"] for s in over}
        full |= over
    for s, rows in by.items():
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
        assert rows[0]["target"] == pytest.approx(target[s])
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(odd).collect()))
    docs = mixing.mixed_documents(odd, odd.columns)
    assert docs.columns == odd.columns and docs.count() == sum(r["copies"] for r in out)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_is_its_sql(spark, odd):
    import duckdb

    con = duckdb.connect()
    rows = [(k if k % 3 else None, f"w{k} " * (k % 400), "x", "hot" if k % 2 else None, 1) for k in range(9000)]
    docs = odd.unionByName(frame(spark, rows))
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    want = sorted(map(str, con.execute(f"SELECT doc_id, source, size, copies, taken FROM ({mixing.ORACLE})").fetchall()))
    got = mixing.mix(docs).select("doc_id", "source", "size", "copies", "taken").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_mixing_numbers_rows_by_their_place_in_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    doubled = docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).drop("k")
    assert mixing.scanned(docs) and mixing.scanned(docs.where("doc_id > 3").select("doc_id", "text")) and not mixing.scanned(doubled)
    for df in (docs, doubled):
        copies = collections.Counter()
        for r in mixing.mix(df).collect():
            copies[r["doc_id"]] += r["copies"]
        got = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(df, df.columns).collect())
        assert got == collections.Counter({k: n for k, n in copies.items() if n})
    plan = mixing.mixed_documents(docs, docs.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan  # words were counted before


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(2)
    rows = [(k, "w " * int(r.paretovariate(1.2) * 20 % 900), "x", "hot" if k % 3 else f"s{k % 5}", 1) for k in range(6000)]
    out = mixing.mix(frame(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.03 and r["most"] <= 2 for r in out)


# -- packing


def best_fit(lengths, size):
    """Bins of the plain rule, one document at a time."""
    free = []
    for n in sorted(lengths, reverse=True):
        fit = [(f, k) for k, f in enumerate(free) if f >= n]
        if fit:
            free[min(fit)[1]] -= n
        else:
            free.append(size - n)
    return sorted(free)


def test_plan_is_best_fit_decreasing():
    r = random.Random(6)
    for size in (1, 7, 64, 100):
        for _ in range(60):
            lengths = [r.randint(1, size) for _ in range(r.randint(1, 120))]
            steps = packing.plan(collections.Counter(lengths), size)
            bins, placed = collections.defaultdict(list), collections.Counter(lengths)
            by = collections.defaultdict(list)
            for s in sorted(steps):
                by[s[0]].append(s)
            for n, count in placed.items():
                for rank in range(count):
                    s = [x for x in by[n] if x[1] <= rank][-1]
                    bins[s[2] + (rank - s[1]) // s[3]].append((s[4] + (rank - s[1]) % s[3] * n, n))
            for content in bins.values():
                at = 0
                for offset, n in sorted(content):
                    assert offset == at
                    at += n
                assert at <= size
            assert sorted(size - sum(n for _, n in c) for c in bins.values()) == best_fit(lengths, size)


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    strange = frame(spark, [(20, "a\t\n\nb  c　d it's <|endoftext|> \x1c 日本 <|endoftext|><|endoftext|>", "x", "x", 1)])
    docs = odd.where("doc_id IS NOT NULL").unionByName(strange)
    out = packing.packed(docs, path, with_ids=True)
    rows = out.collect()
    want = {k: model.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts_of(docs)}
    seen = collections.defaultdict(list)
    for r in rows:
        seen[r["doc_id"]].append(r)
        assert r["length"] <= 1024 and (r["length"] == 1024 or r["piece"] == 0)
        part = np.asarray(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert bytes(r["ids"]) == part and r["ids_crc32"] == zlib.crc32(part)
    for k, ids in want.items():
        assert sum(r["length"] for r in seen[k]) == len(ids) * (2 if k == 3 else 1)
    assert sum(len(bytes(r["ids"])) for r in packing.sequences(out).collect()) == 4 * sum(r["length"] for r in rows)
    assert packing.packed(odd, path).count() >= odd.count() and packing.packed(odd.limit(0), path).count() == 0


def test_ids_of_long_runs():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, ids = Tokenizer.from_file(path), packing.Ids(path)
    same = lambda text: ids.ids(text) == np.asarray(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    n, r = packing.RUN, random.Random(4)
    assert same(" " * 3_000_000) and same("a b" + " \n" * 1_000_000 + "c")
    for k in (n - 1, n):
        for before, white, after in (("it's", " ", "a"), ("x ", "\n ", ""), ("", "\t \u3000\x85", "\x1c9"), ("\x1f", " ", " 日本 ")):
            assert same(before + (white * k)[:k] + after)
    for _ in range(2):
        assert same("".join(r.choice(("a", " ", "\n", "'s", "7", "\x1c", "é", " " * n, "\t" * n, "\xa0" * (n - 1))) for _ in range(12)))


# -- n-gram Jaccard join


def brute_classes(texts):
    sets = []
    for _, t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    link, root = collections.Counter(), list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        c = len(sets[i] & sets[j])
        if texts[i][0] is not None and texts[j][0] is not None and c and 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c):
            link[i] += 1
            link[j] += 1
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    group = collections.defaultdict(list)
    for i, x in enumerate(root):
        group[x].append(texts[i][0])
    return sorted((str(texts[i][0]), str(min(group[root[i]], key=lambda x: (x is None, x))), link[i]) for i in range(len(texts)))


def test_jaccard_join(spark, odd):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows, base = [], [r.choice(vocabulary) for _ in range(200)]
    own = base
    for k in range(700):  # a group of near copies that is larger than a block, beside small groups and loners
        if k < 560:
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        elif k % 3:
            words = list(own)
            words[r.randrange(len(words))] = "new"
        else:
            own = words = [r.choice(vocabulary) for _ in range(r.randint(1, 150))]
        rows.append((100 + k, " ".join(words), "en", "s", 1))
    docs = odd.unionByName(frame(spark, rows))
    out = jaccard_join.classes(docs)
    assert sorted((str(x["doc_id"]), str(x["class_id"]), x["n_links"]) for x in out.collect()) == brute_classes(texts_of(docs))
    stay = jaccard_join.representatives(docs)
    assert stay.columns == docs.columns
    known = [x["doc_id"] for x in stay.collect() if x["doc_id"] is not None]
    assert sorted(known) == sorted({x["class_id"] for x in out.collect() if x["class_id"] is not None})
    assert jaccard_join.classes(odd.limit(0)).count() == 0


def test_rows_that_share_a_doc_id_keep_their_texts(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee ff gg hh ii jj"
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "h i j k l m n"), (2, "z"), (3, near), (3, near + " kk"), (4, near + " kk ll"), (5, "h i j k l m n"), (6, " "), (None, "z")]
    docs = frame(spark, [(k, t, "en", "s", 1) for k, t in rows])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in jaccard_join.representatives(docs).collect()) in (
        sorted([(0, "z"), (1, "a b c d e f g"), (1, "h i j k l m n"), (2, "z"), (3, text), (6, " ")]) for text in (near, near + " kk")
    )
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.classes(docs).collect() if r["doc_id"])
    assert got == [(1, 1, 0), (1, 1, 2), (1, 1, 2), (2, 2, 0), (3, 3, 2), (3, 3, 2), (4, 3, 2), (5, 1, 2), (6, 6, 0)]


def test_posterior_keeps_what_could_be_similar():
    assert all(least < n * 0.8 for least, n in zip(jaccard_join._LEAST, range(16, 129, 16), strict=True))
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 900, np.uint64))
    b = np.concatenate([a[:850], a[:40] + np.uint64(1)])
    i, j = jaccard_join.similar([a, np.sort(b)], [a, np.sort(b)], True)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1)]


# -- suffixes


def brute_removal(texts):
    place = collections.defaultdict(list)
    raw = [(t or "").encode() for _, t in texts]
    for k, b in enumerate(raw):
        for p in range(len(b) - 399):
            place[b[p : p + 400]].append((k, p))
    gone = [np.zeros(len(b), bool) for b in raw]
    for found in place.values():
        if len(found) > 1:
            for k, p in found:
                gone[k][p : p + 400] = True
    out = []
    for (doc, _), b, g in zip(texts, raw, gone, strict=True):
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        out.append((str(doc), len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, odd):
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefg é") for _ in range(n))
    shared = [noise(n) for n in (399, 400, 401, 430, 900)]
    rows = []
    for k in range(60):
        text = noise(r.randint(0, 500)) + r.choice(shared)[r.randint(0, 40) :] + noise(r.randint(0, 50)) + r.choice(shared) + noise(r.randint(0, 300))
        rows.append((200 + k, text, "en", "s", 1))
    rows += [(300, "ab" * 700, "x", "s", 1), (301, noise(50) + "ab" * 300 + noise(50), "x", "s", 1), (302, shared[4] + shared[4], "x", "s", 1)]
    docs = odd.where("doc_id IS NULL OR doc_id <> 10").unionByName(frame(spark, rows))
    out = suffix_dedup.deduplicated(docs).collect()
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out) == brute_removal(texts_of(docs))
    kept = suffix_dedup.deduplicated(docs, with_text=True).collect()
    assert all(hashlib.sha256(bytes(x["kept"])).hexdigest() == x["kept_sha256"] for x in kept)
    assert suffix_dedup.deduplicated(odd.limit(0)).count() == 0


def test_texts_that_share_a_doc_id_are_told_apart(spark):
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefg") for _ in range(n))
    shared = noise(500)
    # Hundreds of texts under one id, and under none, some with a shared passage.
    rows = [(7 if k % 2 else None, (noise(600) if k % 3 else noise(40) + shared + noise(60)), "x", "s", 1) for k in range(300)] + [(7, "x" * 500, "x", "s", 1)] * 2
    docs = frame(spark, rows)
    out = suffix_dedup.deduplicated(docs).collect()
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out) == brute_removal(texts_of(docs))


# -- language model


def test_elias_fano(tmp_path):
    r = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (5, 5), (1000, 1500), (1000, 10**9), (3000, 10**14)):
        v = np.sort(r.integers(0, u, n))
        elias_fano.write(f"{tmp_path}/f", elias_fano.encode(v, u))
        e = elias_fano.EliasFano(elias_fano.mapped(f"file:{tmp_path}/f"))
        assert (e.get(np.arange(n)) == v.astype(np.uint64)).all()
        q = np.concatenate([r.integers(0, u, 300), v])
        assert (e.successor(q.astype(np.uint64), np.zeros(len(q), int), np.full(len(q), n)) == np.searchsorted(v, q)).all()
        place = np.where(np.isin(q, v), np.searchsorted(v, q), -1)
        assert (e.find(q.astype(np.uint64), np.zeros(len(q), int), np.full(len(q), n)) == place).all()


def test_lm_scoring(spark, odd):
    out = lm_scoring.scored(odd).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    every = [(k, WORD.findall(lower(t)) + ["</>"]) for k, t in texts_of(odd)]
    is_out = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    count = collections.Counter(w for k, ws in every if not is_out(k) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(k), is_out(k), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for k, ws in every)
    assert sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in out) == want
    assert lm_scoring.scored(odd.limit(0)).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    docs = frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(("a b a b c", "a c", "b b", "c a b"))])
    model = lm_scoring.trained(docs)
    hashes = np.unique(np.concatenate([lm_scoring.tokens(["a b c"], Words())[0]]))
    ids, counts = model.ids(hashes)
    assert (ids >= 0).all() and model.vocabulary == 4
    word, n = np.concatenate([ids, [-1]]), np.concatenate([counts, [0]])  # all words, and one that isn't known
    for context in [*ids.tolist(), -1]:
        p = 10 ** model.pairs(np.full(5, context), word, model.base(n))
        assert p.sum() == pytest.approx(1, abs=0.03)  # quantised


def test_lm_score_is_the_bigram_model(spark, sf_dir):
    """Scores against probabilities from dictionaries, without tries; stored ones are quantised."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: (r["held_out"], r["score"]) for r in lm_scoring.scored(docs).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    every = {k: ["</>", *WORD.findall(lower(t)), "</>"] for k, t in texts_of(docs)}
    one, two = collections.Counter(), collections.Counter()
    for k, ws in every.items():
        if not got[k][0]:
            one.update(ws[1:])
            two.update(itertools.pairwise(ws))
    n, v = sum(one.values()), len(one)
    shards, names = lm_scoring.Model("", 64, np.zeros(64, int), 0), [w for w in one if w != "</>"]
    shard = dict(zip(names, shards.shard_of(Words()(*utf8(names))[0]).tolist(), strict=True)) | {"</>": int(shards.shard_of(np.array([lm_scoring.END]))[0])}
    by = collections.defaultdict(list)
    for (a, _), c in two.items():
        by[shard[a]].append(c)
    off = {s: lm_scoring.discounts(np.array(c)) for s, c in by.items()}
    total, back = collections.Counter(), collections.Counter()
    for (a, _), c in two.items():
        total[a] += c
        back[a] += min(off[shard[a]][min(c, 3) - 1], c)

    def p(a, b):
        base = (one[b] + 1) / (n + v + 1)
        if not total[a]:
            return base
        c = two[a, b]
        return (c - min(off[shard[a]][min(c, 3) - 1], c) if c else 0.0) / total[a] + back[a] / total[a] * base

    assert sum(p("the", w) for w in one) + p("the", "never seen") == pytest.approx(1)
    for k, ws in every.items():
        want = sum(math.log10(p(a, b)) for a, b in itertools.pairwise(ws))
        assert got[k][1] == pytest.approx(want, abs=0.01 * len(ws) + 0.05), k


def test_lm_score_is_the_trigram_model(spark, odd):
    """The third level against dictionaries, over the pairs' level, which the test above holds to its own."""
    extra = frame(spark, [(1000 + k, t, "en", "s", 1) for k, t in enumerate(["a b c a b d a b c", "b c a b", "a b c", "A B", "c a b c d"] * 9)])
    docs = odd.select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    rows = docs.withColumn("held_out", lm_scoring.held_out(F.col("doc_id"))).collect()
    two = sorted((str(r["doc_id"]), r["held_out"], r["score"]) for r in lm_scoring.scored(docs).collect())
    three = sorted((str(r["doc_id"]), r["held_out"], r["score"]) for r in lm_scoring.scored(docs, order=3).collect())
    assert [x[:2] for x in two] == [x[:2] for x in three]
    model = lm_scoring.trained(docs.where(~lm_scoring.held_out(F.col("doc_id"))), 3)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = Words()

    def ids(text):
        token = lm_scoring.tokens([text], words)[0]
        unique, back = np.unique(token, return_inverse=True)
        found, counts = model.ids(unique)
        return found[back], model.base(counts[back])

    end = ids("")[0][0]
    texts = [(str(r["doc_id"]), r["held_out"], *ids(r["text"])) for r in rows]
    counts = collections.Counter()
    for _, out, found, _ in texts:
        if not out:
            counts.update(zip([end, *found.tolist()], found[:-1].tolist(), found[1:].tolist(), strict=False))
    shard = lambda u, v: int(model.shard_of(mixed(np.array([u << 32 | v], np.uint64)))[0])
    by = collections.defaultdict(list)
    for (u, v, _), c in counts.items():
        by[shard(u, v)].append(c)
    off = {s: lm_scoring.discounts(np.array(c)) for s, c in by.items()}
    total, back = collections.Counter(), collections.Counter()
    for (u, v, _), c in counts.items():
        total[u, v] += c
        back[u, v] += min(off[shard(u, v)][min(c, 3) - 1], c)
    want = []
    for k, out, found, base in texts:
        score, before = 0.0, [end, *found[:-1].tolist()]
        for t, w in enumerate(found.tolist()):
            p = 10 ** model.pairs(np.array([before[t]]), np.array([w]), base[t : t + 1])[0]
            u, v = (before[t - 1], before[t]) if t else (None, None)
            if t and total[u, v]:
                c = counts[u, v, w]
                p = (c - min(off[shard(u, v)][min(c, 3) - 1], c) if c else 0.0) / total[u, v] + back[u, v] / total[u, v] * p
            score += math.log10(p)
        want.append((k, out, score, len(found)))
    for got, (k, out, score, n) in zip(three, sorted(want), strict=True):
        assert got[:2] == (k, out)
        assert got[2] == pytest.approx(score, abs=0.02 * n + 0.05), k
    pytest.raises(ValueError, lm_scoring.trained, docs, 4)


def test_lm_triples_of_a_pair_sum_to_one(spark):
    docs = frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(("a b a b c", "a c", "b b", "c a b"))])
    model = lm_scoring.trained(docs, 3)
    hashes = np.unique(lm_scoring.tokens(["a b c"], Words())[0])
    ids, counts = model.ids(hashes)
    of = dict(zip(hashes.tolist(), ids.tolist(), strict=True))
    a, b = (of[int(lm_scoring.tokens([t], Words())[0][0])] for t in "ab")
    word, n = np.concatenate([ids, [-1]]), np.concatenate([counts, [0]])
    below = model.pairs(np.full(5, b), word, model.base(n))
    p = model.triples(np.full(5, mixed(np.array([a << 32 | b], np.uint64))[0]), word, below)
    assert (10**p).sum() == pytest.approx(1, abs=0.04)
    assert not np.allclose(p, below)


def test_packed_numbers():
    n = np.array([1, 254, 255, 256, 1 << 40, 3])
    assert lm_scoring.unsmall(lm_scoring.small(n), 6).tolist() == n.tolist()
    assert lm_scoring.parted(lm_scoring.joined(b"", b"ab", b"c")) == [b"", b"ab", b"c"]
    count = lm_scoring.TripleCount(None)
    key = np.array([5, 5, 5, (7 << 32) | 1], np.uint64), np.array([1, 2, lm_scoring.NONE, 0], np.uint32)
    assert [c.tolist() for c in count.unpack(count.pack(key))] == [c.tolist() for c in key]


def test_lm_beats_its_base_on_held_out_text(spark, sf_dir):
    out = lm_scoring.scored(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out["s"] > out["b"]


# -- languages


def test_language_id(spark, odd, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fitted(docs)
    out = language_id.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    rows = {(r["doc_id"], r["lang_pred"]) for r in language_id.identified(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (5, "und"), (9, "und"), (None, "und")} <= rows
    assert language_id.identified(odd, model).where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert language_id.identified(odd.limit(0)).count() == 0
    untaught = language_id.identified(odd.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in untaught] == ["und"]
    single = language_id.identified(odd.withColumn("lang", F.lit("xx"))).where("lang_pred = 'xx'").count()
    assert single == 8
    kept = language_id.accepted(docs)
    assert kept.columns == docs.columns and kept.count() > 0.97 * docs.count()


def test_codewords_are_apart():
    for n, least in ((2, 6), (3, 6), (4, 6), (10, 6), (30, 9), (100, 10)):
        code = language_id.codewords(n)
        assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= least


def test_decoding_is_brute_force_and_corrects_bits(spark):
    r = np.random.default_rng(3)
    code, weight = language_id.codewords(12), r.uniform(0.1, 1, language_id.bits_for(12))
    margin = r.normal(size=(40, len(weight)))
    want = [[sum(w * math.log1p(math.exp(-m * c)) for m, c, w in zip(row, word, weight, strict=True)) for word in code] for row in margin]
    assert np.allclose(language_id.decoded(margin, code, weight), want)
    for k, word in enumerate(code):  # fewer wrong bits than half the least distance
        wrong = word * 4.0
        wrong[r.choice(len(wrong), 2, replace=False)] *= -1
        assert language_id.decoded(wrong[None], code, np.ones(len(wrong)))[0].argmin() == k
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fitted(docs)
    texts = [t for _, t in texts_of(docs)][:30]
    import pyarrow as pa

    names, score, unsure = model.predict(pa.array(texts))
    for t, name, p, flag in zip(texts, names, score, unsure, strict=True):
        f = np.zeros(language_id.DIMENSIONS)
        symbols = [int(language_id._SYMBOL[x]) for x in t.encode()]
        for width in (2, 3, 4):
            for at in range(len(symbols) - width + 1):
                gram = symbols[at] * 257 + symbols[at + 1]
                for x in symbols[at + 2 : at + width]:
                    gram = gram * 0x01000193 + x
                f[(gram * 0x9E3779B1 % (1 << 32)) >> 20] += 1
        f = np.sqrt(f / f.sum())
        loss = [sum(w * math.log1p(math.exp(-m * c)) for m, c, w in zip(f @ model.w + model.b, word, model.bits, strict=True)) for word in model.code]
        order = sorted(range(len(loss)), key=loss.__getitem__)
        assert name == model.languages[order[0]] and p == pytest.approx(1 / sum(math.exp(loss[order[0]] - x) for x in loss), abs=1e-3)
        assert flag == (loss[order[1]] - loss[order[0]] < language_id.TOLERANCE * (loss[order[1]] + loss[order[0]]))


def test_short_texts_score_alike_alone_and_in_company():
    import pyarrow as pa

    for t in ("ab", "abc", "abcd", "a"):
        assert (language_id.features(pa.array([t]))[0] == language_id.features(pa.array([t, "some longer text"]))[0]).all()


# -- personal data


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


def test_base_spans_are_the_patterns():
    r = random.Random(9)
    parts = ["a", "b.c", "@", "x@y.z", "@d.e", "1", "22", "333", ".", " ", "-", "+", "+1 (", ") ", "4111 1111 1111 1111", "255.1.1.1", "256", "000", "%", "é", "١", "\n"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@" * 1000) == []


def test_personal_data(spark, odd):
    field = pii.trained()
    right = wrong = missed = 0
    for text, spans in pii.sentences(150, seed=77):
        got = {(a, b, k) for a, b, k, p in field.best(text) if p >= pii.CONFIDENCE}
        right, wrong, missed = right + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert wrong <= 2 and missed <= 0.1 * (right + missed)
    text = "é mail a@b.co, +1 (605) 555-9305 4078918989542222 call (605) 555-9305 on 2021-03-04 or bob at example dot com"
    docs = odd.unionByName(frame(spark, [(50, text, "en", "s", 1)]))
    out = {(r["doc_id"], r["spans"]): r for r in pii.found(docs).collect()}
    assert len(pii.found(docs).collect()) == docs.count()
    spans = next(s for k, s in out if k == 50).split(",")
    found = [(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in spans]
    assert found == [("email", "a@b.co"), ("phone", "+1 (605) 555-9305"), ("card", "4078918989542222"), ("phone", "(605) 555-9305"), ("email", "bob at example dot com")]
    assert out[1, ""]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    row = clean.where("doc_id = 50").first()
    assert row["text"] == "é mail [EMAIL], [PHONE] [CARD] call [PHONE] on 2021-03-04 or [EMAIL]" and row["n_chars"] == len(row["text"])
    assert pii.found(odd.limit(0)).count() == 0


def test_personal_data_beside_base_spans_and_in_long_lists():
    field = pii.trained()
    added = lambda text: [text[a:b] for a, b, _ in sorted(pii.added_spans(text, pii.base_spans(text), field))]
    assert added("Tel +1 555 123 4567 / 555-987-6543") == ["555-987-6543"]
    assert added("call 555-987-6543 +1 555 123 4567") == ["555-987-6543"]
    assert added("call 10.0.0.1 555-987-6543 10.0.0.2 (605) 555-9305") == ["555-987-6543", "(605) 555-9305"]
    assert added("24.66.114.173 4808200777490071 is") == ["4808200777490071"]
    for n in (4, 200):  # more than nine groups, and more than a window
        numbers = [f"({200 + k}) {999 - k}-{4000 + 29 * k}" for k in range(n)]
        assert added("call " + " / ".join(numbers)) == numbers and added("call 12 34 " + " - ".join(numbers)) == numbers
    assert pii.without("Tel +1 555 123 4567 / 555-987-6543", field) == "Tel [PHONE] / [PHONE]"


def test_field_against_all_segmentations():
    """Best segmentation and posteriors by dynamic programming, and by listing every segmentation."""
    field = pii.trained()
    for text in ("call 555-987-6543 x", "id 123 4567 89", "mail bob at ab dot com", "10 . 0 . 0 . 1 host", "4078918989542222 605-555", "a b"):
        cuts = pii.tokens(text)
        scored = field.scored(pii.candidates(text, cuts))
        starts = collections.defaultdict(list)
        for s in scored:
            starts[s[0]].append(s)

        def every(t, starts=starts, n=len(cuts)):
            if t == n:
                yield 0.0, ()
                return
            yield from every(t + 1)
            for s in starts[t]:
                for score, rest in every(s[1]):
                    yield score + s[4], (s[:3], *rest)

        ways = list(every(0))
        total = sum(math.exp(score) for score, _ in ways)
        top = max(score for score, _ in ways)
        got = field.best(text)
        spans = {(cuts[i][0], cuts[j - 1][1], kind): sum(math.exp(score) for score, segments in ways if (i, j, kind) in segments) / total for i, j, kind, *_ in scored}
        assert sum(next(s[4] for s in scored if (cuts[s[0]][0], cuts[s[1] - 1][1], s[2]) == g[:3]) for g in got) == pytest.approx(top)
        for a, b, kind, sure in got:
            assert sure == pytest.approx(spans[a, b, kind], abs=1e-9)


def test_personal_data_in_documents():
    """On the documents, what the field adds is few and right: numbers that the patterns run together with their neighbours."""
    import pyarrow.parquet as pq

    field, base, added = pii.trained(), 0, []
    for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist():
        spans = pii.base_spans(t or "")
        base += len(spans)
        added += [(kind, (t or "")[a:b]) for a, b, kind in pii.added_spans(t or "", spans, field)]
    assert base > 600 and len(added) >= 3
    for kind, found in added:
        digits = re.sub("[^0-9]", "", found)
        assert {"card": pii.luhn(digits) and 12 <= len(digits) <= 19, "phone": found.startswith("+") and 9 <= len(digits) <= 15}.get(kind, False), found
