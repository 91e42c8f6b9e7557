"""Language identification with error-correcting output codes.

Every language has a codeword of bits, longer the more languages there are, so that codewords stay apart.  One binary classifier per bit (logistic regression on hashed byte n-grams)
predicts it; a text gets the language whose codeword has the least loss under the classifiers' margins, each bit
weighted by how well it was learned.  The score is the softmax of the negative losses, and a text whose best two
languages are closer than a tolerance is flagged as ambiguous.

The classifiers are fitted on a bounded sample of the labelled rows (`per_language`, a parameter); every row's whole
text is scored.  Scoring is vectorised: n-gram hashes of a batch are counted into one matrix, and a matrix product
gives all bits of all texts.

Defined results: a null text, or one without a letter, is `und` with score 0 and not ambiguous; if nothing can be
learned, every text is `und`; with one language, every text with a letter is of that language; rows keep their number;
columns other than doc_id, text and lang don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, slices, tidy, utf8

#: Labelled documents of each language that the fit may read (expected number).
PER_LANGUAGE = 800
BITS = 15
DIMENSIONS = 4096
#: Difference of losses, as a share of their sum, below which a text is ambiguous.
TOLERANCE = 0.02
UNDETERMINED = "und"

#: Bytes to n-gram symbols: letters in lower case, bytes of other alphabets as they are, all else a blank.
_SYMBOL = np.full(256, 32, np.uint32)
_SYMBOL[128:] = np.arange(128, 256)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[97:123] = np.arange(97, 123)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Texts that are scored at once: bytes and rows, each row with a line of DIMENSIONS counts.
SLICE = 1_000_000, 256


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of the fit: its remainder is 2."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def features(texts) -> np.ndarray:
    """One row per text: the square roots of the shares of its hashed 2-, 3- and 4-grams; zeros if it has no letter."""
    data, ends = utf8(texts)
    n = len(ends) - 1
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(ends))
    s = _SYMBOL[data]
    counts = np.zeros((n, DIMENSIONS), np.float32)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    for width in (2, 3, 4):
        if len(s) < width:
            break
        gram = s[:-1] * np.uint32(257) + s[1:] if width == 2 else gram[:-1] * np.uint32(0x01000193) + s[width - 1 :]
        cell = (gram * np.uint32(0x9E3779B1)) >> shift
        first = rows[: len(gram)]
        inside = first == rows[width - 1 :]
        counts += np.bincount((first * DIMENSIONS + cell)[inside], minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    total = counts.sum(1, keepdims=True)
    np.sqrt(np.divide(counts, total, out=counts, where=total > 0), out=counts)
    return counts


def lettered(texts: pa.Array) -> np.ndarray:
    """Which texts have a letter.  Only those without an ASCII letter are looked at as characters."""
    data, ends = utf8(texts)
    before = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])
    out = before[ends[1:]] > before[ends[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(map(str.isalpha, texts[int(i)].as_py() or ""))
    return out


def bits_for(languages: int) -> int:
    """Bits of a codeword: more languages need longer ones to stay as far apart."""
    return BITS + 6 * max(0, (languages - 1).bit_length() - 2)


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1: of many random codes, the one whose closest rows differ most; no column is constant."""
    rng, bits = np.random.default_rng(7), bits_for(languages)
    best, most = None, -1
    for _ in range(max(50, 2000 // max(1, languages // 8))):
        code = rng.choice([-1, 1], (languages, bits))
        if (np.abs(code.sum(0)) == languages).any() and languages > 1:
            continue
        alike = (code @ code.T).astype(np.float64)  # bits that agree less bits that differ
        np.fill_diagonal(alike, -bits)
        apart = int(bits - alike.max(initial=-bits)) // 2
        if apart > most:
            best, most = code, apart
    return best if best is not None else np.where(np.arange(bits) % languages == np.arange(languages)[:, None], 1, -1)


def decoded(margin: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The loss of each language (columns) for each text: over the bits, weight * log(1 + exp(-margin * bit))."""
    return (np.logaddexp(0, -margin[:, None, :] * code) * weight).sum(2)


class Model:
    """Languages, their codewords, and the classifiers' weights and bit weights."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.zeros((0, BITS), int)
        bits = self.code.shape[1]
        self.w, self.b, self.bits = np.zeros((DIMENSIONS, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits)
        if len(languages) > 1:
            self.fit(x, self.code[y].astype(np.float32), np.bincount(y, minlength=len(languages))[y])

    def fit(self, x: np.ndarray, signs: np.ndarray, sizes: np.ndarray, steps: int = 80) -> None:
        """Full-batch logistic regressions, all bits at once; every language weighs the same."""
        weight = (1.0 / sizes / len(self.languages)).astype(np.float32)[:, None]
        m = v = np.zeros_like(self.w)
        for step in range(1, steps + 1):  # Adam
            margin = signs * (x @ self.w + self.b)
            pull = -signs / (1 + np.exp(np.clip(margin, -30, 30))) * weight
            g = x.T @ pull + 1e-5 * self.w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.w = self.w - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            self.b = self.b - 0.5 * pull.sum(0)
        right = ((signs * (x @ self.w + self.b)) > 0).astype(np.float32)
        self.bits = np.maximum((right * weight).sum(0) * 2 - 1, 0.05)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        n, k = len(texts), len(self.languages)
        known = lettered(texts)
        names, score, unsure = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n, bool)
        if k == 1:
            names[known], score[known] = self.languages[0], 1.0
        elif k and known.any():
            loss = decoded((features(texts) @ self.w + self.b).astype(np.float64), self.code, self.bits)
            order = np.argsort(loss, 1, kind="stable")
            best, next_ = (np.take_along_axis(loss, order[:, i : i + 1], 1)[:, 0] for i in (0, 1))
            share = 1 / np.exp(best[:, None] - loss).sum(1)
            names[known] = np.array(self.languages, object)[order[:, 0]][known]
            score[known] = np.round(share, 6)[known]
            unsure = known & ((next_ - best) < TOLERANCE * (next_ + best))
        return names, score, unsure


def fitted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from the labelled documents that aren't held out: of each language `per_language` are expected, drawn by a
    hash of doc_id and text."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20))
    wanted = F.lit(False)
    for name in languages:
        wanted |= (F.col("lang") == name) & (draw < F.lit(int(min(1.0, per_language / sizes[name]) * (1 << 20))))

    def rows(batches):
        for batch in slices(batches, *SLICE):
            whole = np.round(features(batch.column("text")) * 8192).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array([r.tobytes() for r in whole], pa.binary())], ["lang", "doc_id", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Rows that repeat one have its draw too; one of them is enough, so that the sample stays bounded.
    found = labelled.where(wanted).mapInArrow(tidy(rows), f"lang string, doc_id {kind}, f binary").distinct().collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["f"])))
    x = np.frombuffer(b"".join(bytes(r["f"]) for r in found), "<u2").reshape(-1, DIMENSIONS).astype(np.float32) / 8192
    y = np.array([languages.index(r["lang"]) for r in found], int)
    present = [k for k in range(len(languages)) if (y == k).any()]  # a draw may miss a tiny language
    return Model([languages[k] for k in present], x, np.searchsorted(present, y))


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    model = model or fitted(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for batch in slices(batches, *SLICE):
            found = model.predict(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("held_out"), *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    given = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return given.mapInArrow(tidy(rows), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is determined and not ambiguous, with their own columns.

    The decision is a vectorised predicate beside the row, so rows don't pass through Python.
    """
    model = fitted(docs)

    def clear(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, bool)]
        for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], *SLICE):
            names, _, unsure = model.predict(part.column("text"))
            out.append((names != UNDETERMINED) & ~unsure)
        free()
        return pa.array(np.concatenate(out))

    return docs.where(F.arrow_udf(clear, "boolean")(F.col("text")))
