"""Personal data by rules and a semi-Markov conditional random field.

The base spans are exact patterns, leftmost and non-overlapping per kind.  A semi-Markov CRF adds spans that the
patterns can't describe, such as national telephone numbers, e-mail addresses in words, or cards and addresses with
other separators: whole-span features (digit groups, separators, checksums, words to the left) score candidate segments
of bounded length, and dynamic programming over a passage chooses boundaries and kinds together.  An added span never
touches a base span, and needs a posterior of `confidence`.  The field is trained here, on sentences written by a
seeded generator, by exact gradients of the log-likelihood.

Every pattern is written or applied so that its time is linear in the text, however long its runs are.

Defined results: a null text is empty and has no spans; rows keep their number and repeated rows are separate; only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, slices, tidy

#: Kinds, in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone")
#: Most tokens of a segment, and the posterior that an added span needs.
LONGEST, CONFIDENCE = 18, 0.9
#: Characters of a passage that are scored at once, and those at a cut that the next window scores again: several of the
#: longest numbers.
WINDOW, MARGIN = 1024, 128

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+").finditer
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_DIGIT = re.compile(r"[0-9]").search


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str):
    """At each @, the run of local characters before it; a domain must follow."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in the order of start and then kind."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    if _DIGIT(text):
        for m in _IP(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# -- the field ---------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]").finditer
#: Passages worth a look: seven or more digits with few other characters between, and addresses in words.
_NUMBERS = re.compile(r"(?<![0-9])[(+]?[0-9]{1,19}(?:[ ().\-/]{1,3}[0-9]{1,19})+").finditer
_NINE = re.compile(r"(?<![0-9])[(+]?[0-9]{1,19}(?:[ ().\-/]{1,3}[0-9]{1,19}){1,8}").finditer
_WORDED = re.compile(r"(?i)(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}").finditer
_WORDED_WHOLE = re.compile(r"(?i)[A-Za-z0-9._%+ -]+ ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]+(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Za-z0-9-]+)+").fullmatch
_WORDED_HINT = re.compile(r"(?i)[\[({]at[\])}]| dot ").search
_HINTS = {
    "phone": frozenset("phone telephone tel call mobile cell fax dial".split()),
    "card": frozenset("card visa credit debit mastercard payment".split()),
    "email": frozenset("mail email contact write reach".split()),
    "ip": frozenset("ip host server address node".split()),
}


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN(text)]


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole segment; each is paired with the kind."""
    span = text[start:end]
    runs = re.findall(r"[0-9]+", span)
    digits = "".join(runs)
    seps = "".join(sorted({c for c in re.sub(r"[A-Za-z0-9]", "", span)}))
    out = ["bias", f"n{min(len(digits), 20)}", f"sep{seps[:4]}", "shape" + "-".join(str(len(r)) for r in runs[:6]) if len(digits) >= 7 else "few"]
    if 12 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "no luhn")
    if len(runs) == 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs):
        out.append("octets")
    lower = span.lower()
    at = bool(re.search(r"[\[({ ]at[\])} ]", lower))
    dot = bool(re.search(r"[\[({ ]dot[\])} ]|\.[a-z]{2,6}$", lower))
    if at or dot:
        out += [f"at{at} dot{dot}", f"words{min(9, len(re.findall(r'[A-Za-z0-9]+', span)))}", f"local{min(3, len(re.split(r'[^A-Za-z0-9._%+-]', re.split(r'[\[({ ]+at[\])} ]', lower)[0].strip())))}"]
    before = re.findall(r"[a-z]+", text[max(0, start - 24) : start].lower())[-2:]
    out += [f"left {kind}" for kind, words in _HINTS.items() if words & set(before)]
    if start and (text[start - 1].isalnum() or text[start - 1] in "(.-/+"):
        out.append("cut left")
    if end < len(text) and (text[end].isalnum() or text[end] in ".-/" and text[end + 1 : end + 2].isalnum()):
        out.append("cut right")
    if re.fullmatch(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}.*|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}.*", span):
        out.append("date")
    return out


def candidates(text: str, cuts: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
    """Segments (first token, token after the last, features) that might be an entity."""
    out = []
    for i, (start, _) in enumerate(cuts):
        if not (text[start].isalnum() or text[start] in "(+"):
            continue
        for j in range(i + 1, min(len(cuts), i + LONGEST) + 1):
            end = cuts[j - 1][1]
            if not text[end - 1].isalnum():
                continue
            span = text[start:end]
            if 7 <= sum(c.isdigit() for c in span) <= 20 and not re.search(r"[A-Za-z]", span) or _WORDED_WHOLE(span) or re.fullmatch(r"[0-9]{1,3}(?: ?[. ] ?[0-9]{1,3}){3}", span):
                out.append((i, j, span_features(text, start, end)))
    return out


def _lse(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class Field:
    """Weights by (kind, feature); tokens outside of entities score 0."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None):
        self.w = weights or {}

    def scored(self, segments):
        return [(i, j, kind, f, sum(self.w.get((kind, x), 0.0) for x in f)) for i, j, f in segments for kind in KINDS]

    def sums(self, n: int, scored):
        """Logarithms of the sums over all segmentations before and after each boundary."""
        ends: dict[int, list] = {}
        starts: dict[int, list] = {}
        for s in scored:
            ends.setdefault(s[1], []).append(s)
            starts.setdefault(s[0], []).append(s)
        a, b = [0.0] * (n + 1), [0.0] * (n + 1)
        for t in range(1, n + 1):
            a[t] = _lse([a[t - 1], *(a[s[0]] + s[4] for s in ends.get(t, ()))])
        for t in range(n - 1, -1, -1):
            b[t] = _lse([b[t + 1], *(b[s[1]] + s[4] for s in starts.get(t, ()))])
        return a, b, ends

    def best(self, text: str, low: int = 0, high: int | None = None) -> list[tuple[int, int, str, float]]:
        """The best segmentation's entities between two places: (start, end, kind, posterior).  Features see the whole text."""
        cuts = [(low + a, low + b) for a, b in tokens(text[low:high])]
        scored = self.scored(candidates(text, cuts))
        if not scored:
            return []
        a, b, ends = self.sums(len(cuts), scored)
        v, back = [0.0] * (len(cuts) + 1), [None] * (len(cuts) + 1)
        for t in range(1, len(cuts) + 1):
            v[t] = v[t - 1]
            for s in ends.get(t, ()):
                if v[s[0]] + s[4] > v[t]:
                    v[t], back[t] = v[s[0]] + s[4], s
        out, t = [], len(cuts)
        while t:
            s = back[t]
            if s:
                out.append((cuts[s[0]][0], cuts[s[1] - 1][1], s[2], math.exp(min(0.0, a[s[0]] + s[4] + b[s[1]] - a[-1]))))
            t = s[0] if s else t - 1
        return out[::-1]

    def train(self, sentences, rounds: int = 24, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Stochastic ascent on the log-likelihood of sentences [(text, [(start, end, kind)])]."""
        prepared = []
        for text, spans in sentences:
            cuts = tokens(text)
            at, to = {c[0]: k for k, c in enumerate(cuts)}, {c[1]: k + 1 for k, c in enumerate(cuts)}
            prepared.append((len(cuts), candidates(text, cuts), {(at[s], to[e], kind) for s, e, kind in spans}))
        for k in range(rounds):
            step = rate / (1 + 0.3 * k)
            for n, segments, gold in prepared:
                scored = self.scored(segments)
                if not scored:
                    continue
                a, b, _ = self.sums(n, scored)
                for i, j, kind, f, score in scored:
                    pull = ((i, j, kind) in gold) - math.exp(min(0.0, a[i] + score + b[j] - a[-1]))
                    if abs(pull) > 1e-4:
                        for x in f:
                            old = self.w.get((kind, x), 0.0)
                            self.w[kind, x] = old + step * (pull - decay * old)
        return self


def sentences(n: int = 260, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated training sentences: entities in forms that the patterns miss, and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "ti", "on", "er", "sch", "ent", "lo", "mi")) for _ in range(r.randint(1, 3)))
    d = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))

    def card(sep: str) -> str:
        body = "4" + d(14)
        check = next(c for c in "0123456789" if luhn(body + c))
        return sep.join((body + check)[k : k + 4] for k in range(0, 16, 4))

    def entity():
        kind = r.choice(KINDS)
        if kind == "phone":
            a, b, c = d(3), d(3), d(4)
            return kind, r.choice((f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"0{d(3)} {d(7)}" if r.random() < 0.2 else f"{a} {b} {c}"))
        if kind == "card":
            return kind, card(r.choice(("", "", " ", ".", "/")))
        if kind == "ip":
            return kind, " . ".join(str(r.randint(1, 255)) for _ in range(4))
        at, dot = r.choice(((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", ".")))
        return kind, f"{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net'))}"

    def other() -> str:
        return r.choice((
            f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"20{d(2)}-{d(2)}-{d(2)} {d(2)}.{d(2)}", f"{d(8)}", f"{d(12)}", f"{d(4)} {d(4)} {d(4)} {d(3)}",
            f"{d(2)}/{d(2)}/20{d(2)}", f"{d(4)}-{d(4)}", f"{d(5)}.{d(5)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{word()} at {word()}", f"{word()} at {word()}. {word()}", f"{d(3)} - {d(4)} - {d(5)}", f"{d(10)}",
        ))

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(1, 4))) + " ", []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.5:
                kind, value = entity()
                text += r.choice((*sorted(_HINTS[kind]), word(), word())) + r.choice((" ", ": "))
                spans.append((len(text), len(text) + len(value), kind))
                text += value
                if kind in ("phone", "card") and r.random() < 0.5:  # two entities that one pattern would run together
                    kind, value = ("card", card("")) if kind == "phone" else ("phone", f"+1 ({d(3)}) {d(3)}-{d(4)}")
                    spans.append((len(text) + 1, len(text) + 1 + len(value), kind))
                    text += " " + value
            else:
                text += other()
            text += r.choice((" ", ". ", ", ")) + word() + " "
        out.append((text, spans))
    return out


def trained() -> Field:
    return Field().train(sentences())


def remaining(taken: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int, int, int]]:
    """What `taken` (disjoint, in order) leaves of a passage, each with the end of what is taken before and the start of
    what is taken after it (0 and `end` or more, if nothing is)."""
    k = bisect_right(taken, start, key=lambda s: s[1])
    out, before = [], taken[k - 1][1] if k else 0
    for a, b in taken[k:]:
        if start < a:
            out.append((start, min(end, a), before, a))
        start = before = max(start, b)
        if a >= end or start >= end:
            return out
    return [*out, (start, end, before, 1 << 62)] if start < end else out


def windowed(text: str, low: int, high: int, field: Field):
    """field.best() of a stretch of any length, in windows that overlap, so that memory is bounded."""
    at = low
    while high - at > WINDOW + MARGIN:
        safe = at + WINDOW
        while text[safe - 1].isalnum() and text[safe].isalnum() and safe > at + WINDOW // 2:
            safe -= 1
        follows = safe
        for span in field.best(text, max(low, at - MARGIN), safe + MARGIN):
            if at <= span[0] and span[1] <= safe:
                yield span
            elif at < span[0] < safe:
                follows = span[0]
        at = follows
    yield from (span for span in field.best(text, max(low, at - MARGIN), high) if span[0] >= at)


def worth(number: str) -> bool:
    return sum(c.isdigit() for c in number) >= 7 or number.strip(" ().-/").count(".") == 3


def added_spans(text: str, base: list[tuple[int, int, str]], field: Field, confidence: float = CONFIDENCE) -> list[tuple[int, int, str]]:
    """The field's spans in the passages of `text` that may hold one, apart from the base spans."""
    passages = []
    if _DIGIT(text):
        passages += [(*m.span(), True) for m in _NUMBERS(text) if worth(m[0])]
    if _WORDED_HINT(text):
        passages += [(*m.span(), False) for m in _WORDED(text)]
    taken: list[tuple[int, int]] = []
    for start, end, _ in base if passages else ():  # spans of different kinds may overlap
        if taken and start < taken[-1][1]:
            taken[-1] = taken[-1][0], max(end, taken[-1][1])
        else:
            taken.append((start, end))
    out: list[tuple[int, int, str]] = []

    def add(spans) -> None:
        for a, b, kind, sure in spans:
            if sure >= confidence and [(a, b)] == [r[:2] for r in remaining(taken, a, b)]:
                insort(taken, (a, b))
                out.append((a, b, kind))

    given = list(taken)
    for start, end, number in sorted(passages):
        for first, last, before, after in remaining(taken, start, end):
            if not number or worth(text[first:last]):
                add(windowed(text, max(before, first - 24), min(len(text), last + 8, after), field))
        nine = [m.span() for m in _NINE(text, start, end)] if number else []
        if len(nine) > 1:  # of a long list, nine groups also on their own: fewer readings compete with the right one
            for a, b in nine:
                if worth(text[a:b]) and [(a, b)] == [r[:2] for r in remaining(given, a, b)]:
                    low = max(0, a - 24)
                    add((low + x, low + y, kind, sure) for x, y, kind, sure in field.best(text[low : b + 8]))
    return out


def listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def found(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every document."""
    field = field or trained()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def rows(batches):
        for batch in slices(batches):
            out = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                added = added_spans(text, base, field)
                counts = [sum(s[2] == k for s in base) for k in KINDS]
                every = sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if added else base
                out.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(added)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(tidy(rows), schema)


def without(text: str, field: Field) -> str:
    """The text with a mark in the place of each span; spans that overlap get the first one's mark."""
    base = base_spans(text)
    out, at = [], 0
    for start, end, kind in sorted([*base, *added_spans(text, base, field)]):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by marks; n_chars, where there is one, follows the text."""
    field = trained()

    def clean(texts: pa.Array) -> pa.Array:
        out = pa.array([None if t is None else without(t, field) for t in (x.as_py() for x in texts)], pa.string())
        free()
        return out

    out = docs.withColumn("text", F.arrow_udf(clean, "string")(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
