"""The query parser and the compaction planner."""

import datetime as dt
import itertools
import random

import pytest

from livedex.model import MergeConfig
from livedex.plans import compaction as c
from livedex.plans import query_parser as qp
from livedex.streaming.ingest import Schedule, Throttle, jdbc_options


def test_parser_leaves():
    assert qp.parse(None) == qp.MatchAll() == qp.parse("  ")
    assert qp.parse("The") == qp.Term(text="the")
    assert qp.parse("lang:en^2") == qp.Term(field="lang", boost=2.0, text="en")
    assert qp.parse('"of the"~3^1.5') == qp.Phrase(boost=1.5, words=("of", "the"), slop=3)
    assert qp.parse("thr*") == qp.Prefix(text="thr")
    assert qp.parse("t?s*x") == qp.Wildcard(text="t?s*x")
    assert qp.parse("thir~2") == qp.Fuzzy(text="thir", edits=2)
    assert qp.parse("[a TO b}") == qp.Range(low="a", high="b", include_low=True, include_high=False)
    assert qp.parse("[* TO b]").low is None


def test_parser_groups():
    a, b, d = (qp.Term(text=x) for x in "abd")
    assert qp.parse("a b") == qp.Group(should=(a, b))
    assert qp.parse("a AND b") == qp.Group(must=(a, b))
    assert qp.parse("a && b OR d") == qp.Group(must=(a, b), should=(d,))
    assert qp.parse("+a -b d") == qp.Group(must=(a,), should=(d,), must_not=(b,))
    assert qp.parse("a NOT b") == qp.Group(should=(a,), must_not=(b,))
    assert qp.parse("a b", default_and=True) == qp.Group(must=(a, b))
    assert qp.parse("(a b)^2 AND d") == qp.Group(must=(qp.Group(boost=2.0, should=(a, b)), d))
    assert qp.parse("lang:(a b)") == qp.Group(should=(qp.Term("lang", 1.0, "a"), qp.Term("lang", 1.0, "b")))
    for bad in ("(a", "a)", "a AND", "+", "()", '"a', "f:"):
        with pytest.raises(qp.QueryError):
            qp.parse(bad)


def test_balanced_against_all_ways():
    r = random.Random(3)
    for _ in range(40):
        sizes = [r.randint(1, 50) for _ in range(r.randint(1, 8))]
        parts = r.randint(1, len(sizes))
        even = sum(sizes) / parts
        cost = lambda ends, sizes=sizes, even=even: sum(c.residual(sum(sizes[a:b]), even) for a, b in zip((0, *ends), ends, strict=False))
        best = min(cost((*cut, len(sizes))) for cut in itertools.combinations(range(1, len(sizes)), parts - 1))
        assert abs(cost(c.balanced(sizes, parts)) - best) < 1e-9


def test_merges():
    seg = lambda k, docs=100, deleted=0, size=1000: c.Segment(str(k), docs, deleted, size)
    named = lambda runs: [[s.name for s in r] for r in runs]
    few = [seg(k) for k in range(4)]
    assert c.merges(few, MergeConfig(large_segments=4)) == [] == c.merges(few[:2], MergeConfig(large_segments=4))
    many = [seg(k, size=10_000) for k in range(3)] + [seg(k + 3, size=100) for k in range(10)]
    assert c.merges(many, MergeConfig(large_segments=3, merge_factor=5)) == [many[3:8], many[8:13]]
    # Too many segments: from the first small one under a quarter of the share on.
    crowded = [*many[:3], seg("x", size=4000), *many[3:]]
    assert c.merges(crowded, MergeConfig(large_segments=3, merge_factor=5)) == [many[3:]]
    # The small ones have grown to a large one: two large ones make room.
    grown = [seg(0, size=900), seg(1, size=1000), seg(2, size=1000), *(seg(k + 3, size=900) for k in range(2))]
    assert named(c.merges(grown, MergeConfig(large_segments=3, merge_factor=5))) == [["0", "1"], ["3", "4"]]
    # To more than two of them: all is laid out anew.
    more = [seg(k, size=1000) for k in range(3)] + [seg(k + 3, size=1000) for k in range(3)]
    assert named(c.merges(more, MergeConfig(large_segments=3, merge_factor=5))) == [["0", "1"], ["2", "3"], ["4", "5"]]
    dirty = [seg(0, size=900), seg(1, size=1000), seg(2, size=1000, deleted=4), *(seg(k + 3, size=900) for k in range(2))]
    assert named(c.merges(dirty, MergeConfig(large_segments=3, partial_expunge=True))) == [["0", "1"], ["2"], ["3", "4"]]
    quiet = [seg(0, size=9000, deleted=2), seg(1, size=9000, deleted=5), seg(2, size=10)]
    assert named(c.merges(quiet, MergeConfig(large_segments=2, partial_expunge=True))) == [["1"]]
    assert c.merges(more, MergeConfig(large_segments=3, merge_factor=5, max_merge_docs=150)) == []
    assert sum(map(len, c.optimized(many, 2))) - len(c.optimized(many, 2)) + 2 == len(many)
    assert c.optimized(many, 50) == []
    assert seg(1, 0, 0, 5).size == 0
    dirty = [seg(0, deleted=3), seg(1, deleted=7), seg(2, deleted=7), seg(3)]
    assert c.to_expunge(dirty) == dirty[:3]
    assert c.one_to_expunge(dirty, 4) == dirty[2] and c.one_to_expunge(dirty, 2) == dirty[1] and c.one_to_expunge(dirty[3:], 1) is None


def test_schedule_is_strictly_in_the_future():
    s = Schedule()
    assert s.next_after(dt.datetime(2024, 1, 1, 1, 0)) == dt.datetime(2024, 1, 2, 1, 0)
    assert s.next_after(dt.datetime(2024, 1, 1, 0, 30)) == dt.datetime(2024, 1, 1, 1, 0)
    assert [s.due(dt.datetime(2024, 1, d, h)) for d, h in ((1, 5), (1, 20), (2, 2), (2, 3))] == ["NONE", "NONE", "PARTIAL", "NONE"]


def test_throttle():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = Throttle(100, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        t.take(50)
    assert slept == [60.0, 60.0]


def test_jdbc_options():
    o = jdbc_options("oracle", "db", "SID", "SELECT * FROM t WHERE v > {version} ORDER BY v", 42)
    assert o["url"] == "jdbc:oracle:thin:@db:1521:SID" and o["query"].endswith("v > 42 ORDER BY v")
