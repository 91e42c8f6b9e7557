"""Ranked search: a query's tree becomes columns over the token arrays of a live view.

A document is read and cut into tokens once; every leaf of the tree is a count over its token array, and the counts leave
by a generator, so that neither filters nor projections above it cut the text again.  Documents, document frequencies
and hits are one row of sums over those counts.  Only the best k rows are joined with their stored fields.  Over a
stored index (postings.py), the counts come from postings and all else is the same.

    score = coord * norm * sum over matched leaves of sqrt(tf) * idf^2 * boost / sqrt(length)
    idf = 1 + ln(N / (df + 1)),  coord = matched / leaves,  norm = 1 / sqrt(sum of (idf * boost)^2)

N, df and lengths are those of the live view.  A leaf for many terms (prefix, wildcard, fuzzy, range) or for a keyword
field has tf 1 where it matches and no length norm.
"""

from __future__ import annotations

import math
import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import terms
from ..functions.scoring import CLASSIC, Similarity
from ..model import SearchHit, SearchRequest, SearchResult
from ..plans import query_parser as qp
from .highlight import best_fragment


def wildcard(text: str) -> str:
    """The regular expression of a pattern with * and ?."""
    parts = re.findall(r"\\.|[*?]|[^*?\\]+", text)
    return "^" + "".join(".*" if p == "*" else "." if p == "?" else re.escape(p.replace("\\", "", 1) if p[0] == "\\" else p) for p in parts) + "$"


def holds(leaf: qp.Clause, term: Column) -> Column:
    """Whether a term is one of those that a leaf stands for."""
    if isinstance(leaf, qp.Term):
        return term == leaf.text
    if isinstance(leaf, qp.Prefix):
        return F.startswith(term, F.lit(leaf.text))
    if isinstance(leaf, qp.Wildcard):
        return F.rlike(term, F.lit(wildcard(leaf.text)))
    if isinstance(leaf, qp.Fuzzy):
        return F.levenshtein(term, F.lit(leaf.text), leaf.edits) >= 0
    ok = F.lit(True)
    if leaf.low is not None:
        ok &= term >= leaf.low if leaf.include_low else term > leaf.low
    if leaf.high is not None:
        ok &= term <= leaf.high if leaf.include_high else term < leaf.high
    return ok


def _phrase(tokens: Column, leaf: qp.Phrase) -> Column:
    """Places where the words follow each other, each within the slop of its place: arrays of one shift after the other
    are put together, so every token is looked at once a word."""
    size = F.greatest(F.size(tokens), F.lit(1))
    both = lambda a, b: F.coalesce(a & b, F.lit(False))
    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    at = lambda word, place: F.transform(F.slice(tokens, place, size), lambda t: t == word)
    out = at(leaf.words[0], 1)
    for k, word in enumerate(leaf.words[1:], 2):
        here = at(word, k)
        for place in range(k + 1, k + 1 + leaf.slop):
            here = F.zip_with(here, at(word, place), either)
        out = F.zip_with(out, here, both)
    return F.size(F.filter(out, lambda x: x))


def check(leaf: qp.Clause, fields: set[str]) -> None:
    if not isinstance(leaf, qp.MatchAll) and leaf.field != "content" and leaf.field not in fields:
        raise qp.QueryError(f"no field {leaf.field}")
    if isinstance(leaf, qp.Phrase) and leaf.field in fields:
        raise qp.QueryError(f"{leaf.field} has no positions")


def frequency(leaf: qp.Clause, tokens: Column, fields: set[str]) -> Column:
    """How often a document matches a leaf."""
    check(leaf, fields)
    if isinstance(leaf, qp.MatchAll):
        return F.lit(1)
    if leaf.field in fields:  # a keyword field: its whole value is one term
        return F.coalesce(holds(leaf, F.lower(F.coalesce(leaf.field, F.lit("")) if not isinstance(leaf, qp.Term) else F.col(leaf.field))), F.lit(False)).cast("int")
    if isinstance(leaf, qp.Term):
        return F.size(F.filter(tokens, lambda t: t == leaf.text))
    if isinstance(leaf, qp.Phrase):
        return _phrase(tokens, leaf)
    return F.exists(tokens, lambda t: holds(leaf, t)).cast("int")


def condition(tree: qp.Clause, match: dict[qp.Clause, Column]) -> Column:
    """Whether a document is a hit."""
    if not isinstance(tree, qp.Group):
        return match[tree]
    ok = F.lit(True)
    for c in tree.must:
        ok &= condition(c, match)
    if tree.should and not tree.must:
        some = F.lit(False)
        for c in tree.should:
            some |= condition(c, match)
        ok &= some
    for c in tree.must_not:
        ok &= ~condition(c, match)
    return ok if tree.must or tree.should else F.lit(False)


def _every_leaf(tree: qp.Clause) -> list[qp.Clause]:
    return [leaf for c in (*tree.must, *tree.should, *tree.must_not) for leaf in _every_leaf(c)] if isinstance(tree, qp.Group) else [tree]


class Plan:
    """A query's leaves: all of them, those that score, and each one's column."""

    def __init__(self, query: str | None, keyword_fields: tuple[str, ...]):
        self.tree, self.fields = qp.parse(query), set(keyword_fields)
        self.leaves = list(dict.fromkeys(_every_leaf(self.tree)))
        self.scoring, self.at = qp.leaves(self.tree), {leaf: f"tf{k}" for k, leaf in enumerate(self.leaves)}

    @property
    def is_hit(self) -> Column:
        return condition(self.tree, {leaf: F.col(c) > 0 for leaf, c in self.at.items()})

    def counted(self, live: DataFrame, keep: tuple[str, ...], analyzer) -> DataFrame:
        """uid, the kept columns, length and a count for every leaf, from one look at each text."""
        keyword_fields = sorted(self.fields)
        counts = lambda tokens: F.struct(F.size(tokens).alias("length"), *[frequency(leaf, tokens, self.fields).cast("int").alias(c) for leaf, c in self.at.items()])
        rows = live.select("uid", *dict.fromkeys((*keep, *keyword_fields)), F.array(F.coalesce(analyzer(F.col("content")), F.array().cast("array<string>"))).alias("tokens"))
        return rows.select("uid", *keep, F.inline(F.transform("tokens", counts)))

    def sums(self, counted: DataFrame):
        """One row: documents, hits, and the documents that match each leaf."""
        n = lambda ok: F.coalesce(F.sum(ok.cast("long")), F.lit(0))
        return counted.agg(F.count(F.lit(1)).alias("n"), n(self.is_hit).alias("hits"), *[n(F.col(c) > 0).alias(c) for c in self.at.values()]).first()

    def scored(self, counted: DataFrame, sums, keep: tuple[str, ...], similarity: Similarity) -> DataFrame:
        idf = {leaf: similarity.idf(sums["n"], sums[c]) for leaf, c in self.at.items()} if sums else dict.fromkeys(self.leaves, 1.0)
        norm = math.sqrt(sum((idf[leaf] * leaf.boost) ** 2 for leaf in self.scoring)) or 1.0
        total, matched = F.lit(0.0), F.lit(0)
        for leaf in self.scoring:
            tf = F.col(self.at[leaf])
            weight = idf[leaf] ** 2 * leaf.boost
            normed = isinstance(leaf, (qp.Term, qp.Phrase)) and leaf.field not in self.fields
            part = similarity.tf(tf) * weight * similarity.norm(F.col("length")) if normed else F.lit(weight)
            total += F.when(tf > 0, part).otherwise(0.0)
            matched += (tf > 0).cast("int")
        score = F.lit(1.0) if isinstance(self.tree, qp.MatchAll) else (matched / max(len(self.scoring), 1) if similarity.coord else F.lit(1.0)) * total / norm
        return counted.where(self.is_hit).select("uid", *keep, F.round(score, 6).alias("score"))

    @property
    def needs_sums(self) -> bool:
        return any(not isinstance(leaf, qp.MatchAll) for leaf in self.scoring)


def matches(live: DataFrame, query: str | None, keyword_fields: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = (), analyzer=terms, similarity: Similarity = CLASSIC) -> DataFrame:
    """uid and score of every hit (and the columns in `keep`)."""
    plan = Plan(query, keyword_fields)
    if isinstance(plan.tree, qp.MatchAll):  # no text has to be read
        return live.select("uid", *keep, F.lit(1.0).alias("score"))
    counted = plan.counted(live, keep, analyzer)
    return plan.scored(counted, plan.sums(counted) if plan.needs_sums else None, keep, similarity)


def top(hits: DataFrame, k: int = 10) -> DataFrame:
    """The best k hits: higher scores, then smaller uids."""
    return hits.orderBy(F.col("score").desc(), "uid").limit(k)


def with_fields(hits: DataFrame, live: DataFrame, fields: list[str]) -> DataFrame:
    """Stored fields of a few hits, joined late; `hits` must be a top-k, so it is small whatever the corpus."""
    return live.select("uid", *fields).join(F.broadcast(hits), "uid")


class SearchService:
    """search(request) -> result over a function that gives the current live view."""

    def __init__(self, view, fields: tuple[str, ...] = ("path", "lang")):
        self.view, self.fields = view, fields

    def search(self, request: SearchRequest) -> SearchResult:
        """Two looks at the view: one for the sums, which also give the numbers of hits and documents, one for the best hits."""
        began = time.perf_counter()
        took = lambda: (time.perf_counter() - began) * 1000
        live = self.view()  # the snapshot that the whole search reads
        plan = Plan(request.query, tuple(f for f in ("lang", "source") if live is not None and f in live.columns))
        if live is None:
            return SearchResult(0, 0, took())
        counted = plan.counted(live, (), terms)
        sums = plan.sums(counted)
        words = [leaf.text for leaf in plan.scoring if isinstance(leaf, qp.Term)]
        rows = []
        if sums["hits"] and request.k > 0:
            best = with_fields(top(plan.scored(counted, sums if plan.needs_sums else None, (), CLASSIC), request.k), live, [*self.fields, "content"])
            rows = best.withColumn("fragment", best_fragment(F.col("content"), words)).drop("content").orderBy(F.col("score").desc(), "uid").collect()
        out = [SearchHit(r["score"], {f: [str(r[f])] for f in ("uid", *self.fields, "fragment")}) for r in rows]
        return SearchResult(sums["hits"], sums["n"], took(), out)
