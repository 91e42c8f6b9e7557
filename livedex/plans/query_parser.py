"""The query language: text to a tree of clauses.

    the of            either (default operator OR)        the AND of, the && of    both
    NOT of, -of       not                                 +the of                  required, optional
    "of the"~2        phrase, with slop                   lang:en                  field
    th* th?s          prefix, wildcard                    thier~1                  fuzzy, within edits
    [a TO b] {a TO b} term range, inclusive or not        the^2.5, (a b)^2         boost, group
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Clause:
    field: str = "content"
    boost: float = 1.0


@dataclass(frozen=True)
class MatchAll(Clause):
    pass


@dataclass(frozen=True)
class Term(Clause):
    text: str = ""


@dataclass(frozen=True)
class Phrase(Clause):
    words: tuple[str, ...] = ()
    slop: int = 0


@dataclass(frozen=True)
class Prefix(Clause):
    text: str = ""


@dataclass(frozen=True)
class Wildcard(Clause):
    text: str = ""


@dataclass(frozen=True)
class Fuzzy(Clause):
    text: str = ""
    edits: int = 1


@dataclass(frozen=True)
class Range(Clause):
    low: str | None = None
    high: str | None = None
    include_low: bool = True
    include_high: bool = True


@dataclass(frozen=True)
class Group(Clause):
    must: tuple[Clause, ...] = ()
    should: tuple[Clause, ...] = ()
    must_not: tuple[Clause, ...] = field(default=())


class QueryError(ValueError):
    """The text isn't a query, or asks for something that isn't offered."""


_SCAN = re.compile(
    r"\s*(?:(?P<and>AND\b|&&)|(?P<or>OR\b|\|\|)|(?P<not>NOT\b|!)|(?P<sign>[+-])|(?P<open>\()|(?P<close>\)(?:\^(?P<group_boost>[\d.]+))?)"
    r'|(?P<field>[A-Za-z_][A-Za-z0-9_]*):|"(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?(?:\^(?P<phrase_boost>[\d.]+))?'
    r"|(?P<left>[\[{])(?P<low>[^\s\]}]+)\s+TO\s+(?P<high>[^\s\]}]+)(?P<right>[\]}])(?:\^(?P<range_boost>[\d.]+))?"
    r"|(?P<word>(?:\\.|[^\s()\[\]{}\"^~:+!\\-])(?:\\.|[^\s()\[\]{}\"^~:\\])*)(?P<fuzzy>~(?P<edits>\d*))?(?:\^(?P<boost>[\d.]+))?)"
)


def _scan(text: str):
    at = 0
    while at < len(text.rstrip()):
        m = _SCAN.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"not a query from here: {text[at:at + 20]!r}")
        at = m.end()
        yield m


def parse(text: str | None, default_field: str = "content", default_and: bool = False) -> Clause:
    """The tree of a query; all documents for an empty one."""
    if text is None or not text.strip():
        return MatchAll()
    items = list(_scan(text))
    tree, at = _group(items, 0, default_field, default_and)
    if at < len(items):
        raise QueryError("a bracket closes that wasn't opened")
    return tree


def _group(items, at: int, name: str, default_and: bool):
    """Clauses up to the closing bracket.  AND makes both neighbours required, NOT excludes what follows."""
    clauses: list[tuple[str, Clause]] = []
    mode, joined = "", ""
    own = name
    while at < len(items):
        m = items[at]
        if m["close"]:
            break
        at += 1
        if m["and"]:
            joined = "and"
            if clauses and clauses[-1][0] == "should":
                clauses[-1] = ("must", clauses[-1][1])
            continue
        if m["or"]:
            joined = "or"
            continue
        if m["not"] or m["sign"]:
            mode = "must" if m["sign"] == "+" else "must_not"
            continue
        if m["field"]:
            own = m["field"]
            continue
        if m["open"]:
            clause, at = _group(items, at, own, default_and)
            if at >= len(items):
                raise QueryError("a bracket isn't closed")
            clause = replace(clause, boost=clause.boost * float(items[at]["group_boost"] or 1))
            at += 1
        else:
            clause = _leaf(m, own)
        clauses.append((mode or ("must" if joined == "and" or default_and and joined != "or" else "should"), clause))
        mode, joined, own = "", "", name
    if mode or joined or own != name:
        raise QueryError("an operator has nothing to work on")
    if not clauses:
        raise QueryError("an empty group")
    if len(clauses) == 1 and clauses[0][0] != "must_not":
        return clauses[0][1], at
    of = lambda what: tuple(c for k, c in clauses if k == what)
    return Group(must=of("must"), should=of("should"), must_not=of("must_not")), at


def _leaf(m, name: str) -> Clause:
    if m["phrase"] is not None:
        words = tuple(re.findall(r"[^\W_]+", m["phrase"].lower()))
        boost = float(m["phrase_boost"] or 1)
        return Term(name, boost, words[0]) if len(words) == 1 else Phrase(name, boost, words, int(m["slop"] or 0))
    if m["left"]:
        open_ = lambda x: None if x == "*" else x.lower()
        return Range(name, float(m["range_boost"] or 1), open_(m["low"]), open_(m["high"]), m["left"] == "[", m["right"] == "]")
    boost = float(m["boost"] or 1)
    word = m["word"]
    if word == "*":
        return MatchAll(name, boost)
    wild = re.search(r"(?<!\\)[*?]", word)
    plain = re.sub(r"\\(.)", r"\1", word)
    if m["fuzzy"]:
        return Fuzzy(name, boost, plain.lower(), int(m["edits"] or 1))
    if wild and wild.start() == len(word) - 1 and word.endswith("*"):
        return Prefix(name, boost, plain[:-1].lower())
    return Wildcard(name, boost, word.lower()) if wild else Term(name, boost, plain.lower())


def leaves(tree: Clause) -> list[Clause]:
    """Clauses that score: all leaves that aren't excluded, from left to right within must and should."""
    if isinstance(tree, Group):
        return [leaf for c in (*tree.must, *tree.should) for leaf in leaves(c)]
    return [tree]
