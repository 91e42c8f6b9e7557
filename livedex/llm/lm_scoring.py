"""Language-model scoring with an Elias-Fano n-gram trie.

The corpus is read three times.  First, words are counted; a word is a 64-bit hash, and shards of the vocabulary are
ranges of hashes, so a word's id is its rank among all hashes.  Second, runs of two words, or of three as the registered
query has it, are counted.  Third, texts are scored: the files are mapped into memory, and an n-gram is
found by its context's pointers and a successor search between them.

A level has monotone Elias-Fano pointers from a context to its successors, the successors as an Elias-Fano sequence, and
one byte for the quantised logarithm of each smoothed probability and of each context's back-off.  The level of pairs is
sharded by the first word.  The level of triples is sharded by a bijective 64-bit mix of the context's two ids, so that
the pairs of a frequent word are in all shards; its contexts are an Elias-Fano sequence of as many leading bits of these
mixes as tell them apart.

Smoothing interpolates absolute discounts, three of them by count, down to the add-one unigram distribution:
p(w | u, v) = (c(u v w) - D) / c(u v) + b(u v) p(w | v) and p(w | v) = (c(v w) - D) / c(v) + b(v) p(w), where
p(w) = (c(w) + 1) / (N + V + 1) is the base.  Pairs are stored interpolated; triples are stored discounted, and interpolated
when they are queried, as p(w | v) is in another shard.  A text's first word has one word of context, its start; words
after a pair that training lacks have p(w | v).  The discounts come from the counts of counts of the context's shard.
Probabilities over known words and one unknown word sum to one before quantisation; a quantised value stands for the
mean of a 256th of its range of logarithms.

Counts travel as packed arrays, summed per task before the shuffle, so a frequent n-gram is one entry a task.  Words, and
pairs where they are the last level, are dealt by shard and by a part of the words first, where what the tasks have
counted is summed, and the sums of a shard's parts then meet.  Triples are dealt once and are summed as they arrive, so a
shard holds its distinct triples and not what every task sends; pairs are their sums, and are sent on once.
What is gathered grows with the distinct n-grams of the corpus; nothing is pruned.  Ids are 32 bits: a corpus of more
distinct words raises an OverflowError.

Defined results: a null text is empty and has one token, the end; with no training text every token is unknown and
scores log10(1 / 1) = 0; rows keep their number; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mixed, new_folder, slices, tidy, utf8
from .elias_fano import EliasFano, encode, mapped, removed, write

#: The end of a text, as a word; it is also the context of the first word.
END = np.uint64(0x9E3779B97F4A7C15)
#: Columns of entries that a counting task holds before it passes them on.
HELD = 3_000_000
#: In the place of the word after a text's end.
NONE = 0xFFFFFFFF
_MASK = np.uint64(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2, F.lit(False))


def tokens(column, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's followed by an end, and the n+1 offsets of the texts among them."""
    data, ends = utf8(column)
    hashes, at = words(_LOWER[data], ends)
    n = len(at) - 1
    out = np.empty(len(hashes) + n, np.uint64)
    places = at[1:] + np.arange(n)
    is_end = np.zeros(len(out), bool)
    is_end[places] = True
    out[is_end], out[~is_end] = END, hashes
    return out, np.concatenate([[0], places + 1])


def runs(column: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]])) if len(column) else np.zeros(0, np.int64)


def ranks(column: np.ndarray) -> np.ndarray:
    """The number of each value's run."""
    out = np.zeros(len(column), np.uint64)
    np.cumsum(column[1:] != column[:-1], out=out[1:])
    return out


Key = tuple[np.ndarray, ...]


def summed(keys: list[Key], counts: list[np.ndarray]) -> tuple[Key, np.ndarray]:
    """Distinct keys in order, and the sums of their counts.  A key is one column of 64 bits, or that and one of 32."""
    columns, count = [np.concatenate(c) for c in zip(*keys, strict=True)], np.concatenate(counts)
    order = np.argsort(columns[0], kind="stable")
    one = columns[0][order]
    if len(columns) > 1:
        one = (ranks(one) << np.uint64(32)) | columns[1][order].astype(np.uint64)
        again = np.argsort(one, kind="stable")
        order, one = order[again], one[again]
    first = runs(one)
    return tuple(c[order[first]] for c in columns), np.add.reduceat(count[order], first) if len(first) else count


#: Files that this process has mapped, of the model it used last.  Workers live on from task to task.
_OPEN: dict[str, dict[str, np.ndarray]] = {}
#: Parts of a shard's words that are summed on their own.
PARTS = 8


def opened(folder: str, name: str) -> dict[str, np.ndarray]:
    path = f"{folder}/{name}"
    if path not in _OPEN:
        for other in [k for k in _OPEN if not k.startswith(f"{folder}/")]:
            del _OPEN[other]
        _OPEN[path] = mapped(path)
    return _OPEN[path]


class Model:
    """Where the shards are, and what is known of all of them; files are opened lazily, once a worker."""

    def __init__(self, folder: str, shards: int, sizes: np.ndarray, tokens: int):
        self.folder, self.shards, self.tokens = folder, shards, tokens
        self.first_id = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.vocabulary = int(self.first_id[-1])
        if self.vocabulary >= 1 << 32:
            raise OverflowError(f"{self.vocabulary} distinct words, ids have 32 bits")

    def arrays(self, kind: str, shard: int) -> dict[str, np.ndarray]:
        return opened(self.folder, f"{kind}-{shard}")

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - (self.shards - 1).bit_length())).astype(np.int64) if self.shards > 1 else np.zeros(len(hashes), np.int64)

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted distinct hashes."""
        out, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(self.shard_of(hashes), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            if self.first_id[s] < self.first_id[s + 1]:
                part, level = hashes[edges[s] : edges[s + 1]], self.arrays("words", s)
                at = np.minimum(np.searchsorted(level["hash"], part), len(level["hash"]) - 1)
                known = level["hash"][at] == part
                out[edges[s] : edges[s + 1]] = np.where(known, at + self.first_id[s], -1)
                counts[edges[s] : edges[s + 1]] = np.where(known, level["count"][at], 0)
        return out, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by id."""
        unique, back = np.unique(ids, return_inverse=True)
        edges = np.searchsorted(unique, self.first_id)
        found = np.zeros(len(unique), np.int64)
        for s in np.flatnonzero(np.diff(edges)):
            found[edges[s] : edges[s + 1]] = self.arrays("words", s)["count"][unique[edges[s] : edges[s + 1]] - self.first_id[s]]
        return found[back]

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.vocabulary + 1))

    def _score(self, level: dict[str, np.ndarray], context: np.ndarray, word: np.ndarray, below: np.ndarray, stored_whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities after contexts of a level (sorted, by place), and which n-grams it has; ids of -1 are unknown."""
        pointers, successors = sequence(level, "p"), sequence(level, "s")
        start = runs(context)
        which = ranks(context).astype(np.int64)
        first, last = (pointers.get(context[start] + k).astype(np.int64)[which] for k in (0, 1))
        asked = np.flatnonzero((word >= 0) & (first < last))
        at = successors.find((context[asked] * self.vocabulary + word[asked]).astype(np.uint64), first[asked], last[asked])
        hit, at = asked[at >= 0], at[at >= 0]
        score = level["back_values"][level["back"][context]] + below
        own = level["log_values"][level["log"][at]]
        score[hit] = own if stored_whole else np.log10(10 ** score[hit] + 10**own)
        known = np.zeros(len(word), bool)
        known[hit] = True
        return score, known

    def pairs(self, context: np.ndarray, word: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 probabilities of words after contexts, sorted by context; ids of -1 are unknown."""
        return self.known_pairs(context, word, base)[0]

    def known_pairs(self, context: np.ndarray, word: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As pairs(), and which of the pairs training has."""
        out, known = base.copy(), np.zeros(len(base), bool)
        edges = np.searchsorted(context, self.first_id)
        for s in np.flatnonzero(np.diff(edges)):
            part = slice(edges[s], edges[s + 1])
            out[part], known[part] = self._score(self.arrays("pairs", s), context[part] - self.first_id[s], word[part], base[part], True)
        return out, known

    def triples(self, pair: np.ndarray, word: np.ndarray, below: np.ndarray) -> np.ndarray:
        """log10 probabilities of words after mixed pairs that training has, sorted; `below` has those after the last word alone."""
        out = below.copy()
        edges = np.searchsorted(self.shard_of(pair), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            part = slice(edges[s], edges[s + 1])
            level = self.arrays("triples", s)
            asked = (pair[part] - self.least(s)) >> level["unused"][0]
            start = runs(asked)
            contexts = sequence(level, "c")
            at = contexts.find(asked[start], np.zeros(len(start), np.int64), np.full(len(start), contexts.n))[ranks(asked).astype(np.int64)]
            out[part] = self._score(level, at, word[part], below[part], False)[0]
        return out

    def least(self, shard: int) -> np.uint64:
        """The least hash of a shard."""
        return np.uint64(int(shard) << (64 - (self.shards - 1).bit_length())) if self.shards > 1 else np.uint64(0)


def sequence(level: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano({k[1:]: v for k, v in level.items() if k[0] == name})


def small(numbers: np.ndarray) -> bytes:
    """Integers from 0, most of them below 255, as a byte each; the others follow."""
    large = numbers >= 255
    return np.where(large, 255, numbers).astype(np.uint8).tobytes() + numbers[large].astype("<u8").tobytes()


def unsmall(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], "<u8")
    return out


def joined(*parts: bytes) -> bytes:
    return b"".join(len(part).to_bytes(8, "little") + part for part in parts)


def parted(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each value, and the 256 values that the bytes stand for: means of equal parts of the range."""
    low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
    code = np.minimum((values - low) * (256 / max(high - low, 1e-9)), 255).astype(np.uint8)
    n = np.bincount(code, minlength=256)
    middle = low + (np.arange(256) + 0.5) * (high - low) / 256
    return code, np.where(n > 0, np.bincount(code, values, minlength=256) / np.maximum(n, 1), middle)


SCHEMA = "shard int, part int, keys binary, counts binary"


def packed(count, key: Key, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA of distinct keys: one, or few, for each part of a shard."""
    place = count.shard(key) * PARTS + count.part(key)
    order = np.argsort(place, kind="stable")
    key, n, place = tuple(c[order] for c in key), n[order], place[order]
    edges = [*runs(place).tolist(), len(place)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        shard, part = divmod(int(place[a]), PARTS)
        for at in range(a, b, 1 << 21):
            piece = slice(at, min(b, at + (1 << 21)))
            values = [shard], [part], [count.pack(tuple(c[piece] for c in key))], [small(n[piece])]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "part", "keys", "counts"])


def counted(docs: DataFrame, count) -> DataFrame:
    """Rows of SCHEMA of what `count(text column)` finds, several for a key."""

    def rows(batches):
        keys, counts, held = [], [], 0
        for batch in slices(batches, 3_000_000, rows=1 << 20):
            key = count(batch.column("text"))
            key, n = summed([key], [np.ones(len(key[0]), np.int64)])
            keys.append(key)
            counts.append(n)
            held += len(n) * len(key)
            if held > HELD:
                yield from packed(count, *summed(keys, counts))
                keys, counts, held = [], [], 0
        if keys:
            yield from packed(count, *summed(keys, counts))

    return docs.select("text").mapInArrow(tidy(rows), SCHEMA)


def packed_counts(docs: DataFrame, count) -> DataFrame:
    """Rows of SCHEMA of the keys that `count(text column)` finds, a row or few for each part of a shard."""

    def together(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(count, *gathered(batches, count))

    return counted(docs, count).groupBy("shard", "part").applyInArrow(together, SCHEMA)


def gathered(batches: Iterator[pa.RecordBatch], count) -> tuple[Key, np.ndarray]:
    """The summed keys and counts of rows that packed() made, summed as they arrive."""
    keys, counts, held, distinct = [], [], 0, 0
    for batch in batches:
        for raw, numbers in zip(batch.column("keys"), batch.column("counts"), strict=True):
            key = count.unpack(raw.as_py())
            keys.append(key)
            counts.append(unsmall(numbers.as_py(), len(key[0])))
            held += len(key[0])
            if held > max(HELD // 2, distinct):
                key, n = summed(keys, counts)
                keys, counts, held, distinct = [key], [n], 0, len(n)
    return summed(keys, counts)


class WordCount:
    def __init__(self, shards: int):
        self.model, self.words = Model("", shards, np.zeros(shards, np.int64), 0), None

    def __call__(self, column) -> Key:
        self.words = self.words or Words()
        return (tokens(column, self.words)[0],)

    def shard(self, key):
        return self.model.shard_of(key[0])

    def part(self, key):
        return (key[0] % np.uint64(PARTS)).astype(np.int64)

    def pack(self, key) -> bytes:
        return key[0].astype("<u8").tobytes()

    def unpack(self, raw: bytes) -> Key:
        return (np.frombuffer(raw, "<u8"),)


class PairCount:
    """Keys are context << 32 | word, as ids; packed as the steps from a context's id to the next, their numbers of words, and the words."""

    def __init__(self, model: Model):
        self.model, self.words = model, None

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens, and the n+1 offsets of the texts among them."""
        self.words = self.words or Words()
        token, ends = tokens(column, self.words)
        unique, back = np.unique(token, return_inverse=True)
        return self.model.ids(unique)[0][back].astype(np.uint64), ends

    def __call__(self, column) -> Key:
        ids, _ = self.ids(column)
        before = np.concatenate([ids[-1:], ids[:-1]])  # the last token is an end, as is the one before each text
        return ((before << np.uint64(32)) | ids,)

    def shard(self, key):
        return np.searchsorted(self.model.first_id, (key[0] >> np.uint64(32)).astype(np.int64), "right") - 1

    def part(self, key):
        return (key[0] & _MASK).astype(np.int64) * PARTS // max(self.model.vocabulary, 1)

    def pack(self, key) -> bytes:
        context = key[0] >> np.uint64(32)
        start = runs(context)
        steps = small(np.diff(context[start].astype(np.int64), prepend=0))
        return joined(len(start).to_bytes(8, "little"), steps, small(np.diff(start, append=len(context))), key[0].astype("<u4").tobytes())

    def unpack(self, raw: bytes) -> Key:
        length, steps, n, word = parted(raw)
        context = np.cumsum(unsmall(steps, int.from_bytes(length, "little"))).astype(np.uint64)
        return ((np.repeat(context, unsmall(n, len(context))) << np.uint64(32)) | np.frombuffer(word, "<u4").astype(np.uint64),)


class TripleCount(PairCount):
    """Keys are the pairs that end in each token, and the token after it, or NONE after a text's end; so a pair's triples
    sum to its own count.  Packed as pairs are, the numbers of words, and the words."""

    def __call__(self, column) -> Key:
        ids, ends = self.ids(column)
        before = np.concatenate([ids[-1:], ids[:-1]])
        after = np.concatenate([ids[1:], ids[:1]]).astype(np.uint32)
        after[ends[1:] - 1] = NONE
        return (before << np.uint64(32)) | ids, after

    def shard(self, key):
        return self.model.shard_of(mixed(key[0]))

    def part(self, key):
        return np.zeros(len(key[0]), np.int64)

    def pack(self, key) -> bytes:
        start = runs(key[0])
        return joined(PairCount.pack(self, (key[0][start],)), small(np.diff(start, append=len(key[0]))), key[1].astype("<u4").tobytes())

    def unpack(self, raw: bytes) -> Key:
        pair, n, word = parted(raw)
        (pair,) = PairCount.unpack(self, pair)
        return np.repeat(pair, unsmall(n, len(pair))), np.frombuffer(word, "<u4")


def discounts(counts: np.ndarray) -> np.ndarray:
    """What to take off counts of 1, 2, and 3 or more."""
    n = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    if min(n) == 0:
        return np.array([0.75, 0.75, 0.75])
    y = n[0] / (n[0] + 2 * n[1])
    return np.clip([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], [0.1, 0.1, 0.1], [0.98, 1.9, 2.9])


def trie_level(context: np.ndarray, word: np.ndarray, counts: np.ndarray, contexts: int, vocabulary: int, below: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """A level's arrays from its n-grams, sorted by the context's place and the last word; `below` are the last words'
    probabilities one level down, where they are to be interpolated now."""
    total = np.maximum(np.bincount(context, counts, minlength=contexts), 1)
    off = np.minimum(discounts(counts)[np.minimum(counts, 3) - 1], counts)
    back = np.bincount(context, off, minlength=contexts) / total
    size = np.bincount(context, minlength=contexts)
    back[size == 0] = 1.0
    p = (counts - off) / total[context]
    if below is not None:
        p += back[context] * below
    log, log_values = quantised(np.log10(p))
    back, back_values = quantised(np.log10(np.maximum(back, 1e-12)))
    out = {"log": log, "log_values": log_values, "back": back, "back_values": back_values}
    out |= {f"p{k}": v for k, v in encode(np.concatenate([[0], np.cumsum(size)]), len(word) + 1).items() if k != "zeros"}
    return out | {f"s{k}": v for k, v in encode(context * vocabulary + word, contexts * vocabulary + 1).items() if k != "ones"}


def triple_level(model: Model, shard: int, pair: np.ndarray, word: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a shard of triples, and of its contexts, from sorted keys without NONE."""
    start = runs(pair)
    hashes = mixed(pair[start])
    order = np.argsort(hashes)
    place = np.empty(len(start), np.int64)
    place[order] = np.arange(len(start))
    context = place[ranks(pair).astype(np.int64)]
    again = np.argsort(context, kind="stable")  # words stay in order
    out = trie_level(context[again], word[again].astype(np.int64), counts[again], len(start), model.vocabulary)
    # Only pairs that training has are looked up, so the bits that tell the contexts apart are enough.
    hashes = hashes[order] - model.least(shard)
    spare = int((hashes[1:] ^ hashes[:-1]).min()).bit_length() - 1 if len(hashes) > 1 else 0
    universe = (1 << (64 - (model.shards - 1).bit_length())) >> spare
    return out | {"unused": np.array([spare], np.uint64)} | {f"c{k}": v for k, v in encode(hashes >> np.uint64(spare), universe).items() if k != "ones"}


def trained(docs: DataFrame, order: int = 2) -> Model:
    """Counts the given documents' n-grams of up to `order` words, 2 or 3, and writes the trie to the shared folder."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: a trie has 2 or 3 levels")
    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    shards = 64
    rows = docs.count()
    while shards * 4096 < rows:
        shards *= 2
    words = WordCount(shards)

    def word_level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        (hashes,), n = gathered(batches, words)
        write(f"{folder}/words-{shard}", {"hash": hashes, "count": n})
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "size": [len(hashes)], "tokens": [int(n.sum())]})

    found = packed_counts(docs, words).groupBy("shard").applyInArrow(word_level, "shard int, size long, tokens long").collect()  # a row a shard
    sizes = np.zeros(shards, np.int64)
    for r in found:
        sizes[r["shard"]] = r["size"]
    model = Model(folder, shards, sizes, sum(r["tokens"] for r in found))
    pairs, triples = PairCount(model), TripleCount(model)

    def pairs_of_triples(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        (pair, word), n = gathered(batches, triples)
        inside = word != NONE
        write(f"{folder}/triples-{shard}", triple_level(model, shard, pair[inside], word[inside], n[inside]))
        start = runs(pair)
        yield from packed(pairs, (pair[start],), np.add.reduceat(n, start))

    def pair_level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        (pair,), n = gathered(batches, pairs)
        context, word = (pair >> np.uint64(32)).astype(np.int64) - model.first_id[shard], (pair & _MASK).astype(np.int64)
        contexts = int(model.first_id[shard + 1] - model.first_id[shard])
        write(f"{folder}/pairs-{shard}", trie_level(context, word, n, contexts, model.vocabulary, 10 ** model.base(model.counts(word))))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "size": [len(pair)]})

    if model.vocabulary:
        sums = packed_counts(docs, pairs) if order == 2 else counted(docs, triples).groupBy("shard").applyInArrow(pairs_of_triples, SCHEMA)
        sums.groupBy("shard").applyInArrow(pair_level, "shard int, size long").collect()
    return model


def scored(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores every document by a model of that order; learns from those that aren't held out."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = trained(given.where("NOT held_out"), order)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def rows(batches):
        words = Words()
        for batch in slices(batches, 3_000_000, rows=1 << 20):
            token, ends = tokens(batch.column("text"), words)
            n = len(ends) - 1
            text = np.repeat(np.arange(n), np.diff(ends))
            unique, back = np.unique(token, return_inverse=True)
            ids, counts = model.ids(unique)
            ids, counts = ids[back], counts[back]
            base = model.base(counts)
            before = np.concatenate([ids[-1:], ids[:-1]])
            by = np.lexsort([ids, before])
            score, known = np.empty(len(ids)), np.empty(len(ids), bool)
            score[by], known[by] = model.known_pairs(before[by], ids[by], base[by])
            if order == 3:
                # Tokens after a known pair of their own text.
                later = known[:-1].copy()
                later[ends[1:-1] - 1] = False
                at = np.flatnonzero(later) + 1
                pair = mixed((before[at - 1].astype(np.uint64) << np.uint64(32)) | ids[at - 1].astype(np.uint64))
                by = np.argsort(pair)
                at, pair = at[by], pair[by]
                score[at] = model.triples(pair, ids[at], score[at])
            columns = [np.diff(ends), np.bincount(text, counts > 0, minlength=n).astype(np.int64), np.full(n, model.tokens), np.bincount(text, base, minlength=n), np.bincount(text, score, minlength=n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, columns)], names)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = cut(given.mapInArrow(tidy(rows), schema))
    if model.vocabulary:
        removed(model.folder)
    return out
