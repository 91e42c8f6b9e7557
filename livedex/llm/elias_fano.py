"""Elias-Fano coding of non-decreasing integers, and files of named arrays that are mapped into memory.

A value's low bits are packed side by side; its high part is unary: element i sets bit (high + i).  That takes about
2 + log2(universe / n) bits a value.  A directory of ones before each 64-bit word serves select, and all operations
work on whole arrays of queries.
"""

from __future__ import annotations

import json
import mmap
import re
import tempfile

import numpy as np
from pyarrow import fs

_ONE = np.uint64(1)
#: Place of the r-th one (from 0) in a byte; 8 if there is none.
_NTH = np.array([[([k for k in range(8) if b >> k & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)


def _select(words: np.ndarray, before: np.ndarray, r: np.ndarray, zeros: bool = False) -> np.ndarray:
    """Places of the r-th ones, or zeros (from 0); `before` has how many stand before each word, and in all."""
    w = np.searchsorted(before, r, "right") - 1
    left = r - before[w]
    word = ~words[w] if zeros else words[w]
    at = w.astype(np.int64) * 64
    for half in (32, 16, 8):
        ones = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
        later = left >= ones
        left -= ones * later
        at += half * later
        word = word >> (np.uint64(half) * later)
    return at + _NTH[(word & np.uint64(255)).astype(np.int64), left]


def _ones_before(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bitwise_count(words), out=out[1:])
    return out


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """The arrays of non-decreasing values below `universe`."""
    n = len(values)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    places = high + np.arange(n)
    length = (universe >> low_bits) + n + 2
    bits = np.zeros(-(-length // 64) * 64, np.uint8)
    bits[places] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    packed = np.zeros(n * low_bits // 64 + 2, np.uint64)
    if low_bits and n:
        low = values & np.uint64((1 << low_bits) - 1)
        offset = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
        w, s = (offset >> np.uint64(6)).astype(np.int64), offset & np.uint64(63)
        np.bitwise_or.at(packed, w, low << s)
        np.bitwise_or.at(packed, w + 1, (low >> (np.uint64(63) - s)) >> _ONE)
    ones, zeros = _ones_before(words), _ones_before(~words)
    return {"words": words, "ones": ones, "zeros": zeros, "packed": packed, "shape": np.array([n, low_bits, universe], np.int64)}


class EliasFano:
    """Reads what encode() made; the arrays may be mapped.  get() takes `ones`, and the searches take `zeros`; the other may be left out."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.words, self.ones, self.zeros, self.packed = (arrays.get(k) for k in ("words", "ones", "zeros", "packed"))
        self.n, self.low_bits, self.universe = map(int, arrays["shape"])

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        offset = i.astype(np.uint64) * np.uint64(self.low_bits)
        w, s = (offset >> np.uint64(6)).astype(np.int64), offset & np.uint64(63)
        both = (self.packed[w] >> s) | ((self.packed[w + 1] << (np.uint64(63) - s)) << _ONE)
        return both & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        high = _select(self.words, self.ones, i) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.low(i)

    def _run(self, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where in [first, last) elements with the value's high part stand, which is between two zeros; and its low part."""
        high = (value >> np.uint64(self.low_bits)).astype(np.int64)
        start = np.zeros(len(value), np.int64)
        later = high > 0
        start[later] = _select(self.words, self.zeros, high[later] - 1, True) - (high[later] - 1)
        end = _select(self.words, self.zeros, high, True) - high
        return np.clip(start, first, last), np.clip(end, first, last), value & np.uint64((1 << self.low_bits) - 1)

    def _search(self, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first place in [a, b) whose low part is at least `low` (b: none), by halves."""
        a, b = a.copy(), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) // 2
            less = self.low(middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        return a

    def successor(self, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place in [first, last) of the first element of at least `value` (last: none)."""
        start, end, low = self._run(value, first, last)
        return self._search(low, start, end)

    def find(self, value: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place in [first, last) of the first element that is `value`, or -1: its successor's, if that is equal."""
        start, end, low = self._run(value, first, last)
        at = self._search(low, start, end)
        inside = np.flatnonzero(at < end)
        inside = inside[self.low(at[inside]) == low[inside]]
        out = np.full(len(value), -1, np.int64)
        out[inside] = at[inside]
        return out


def _store(path: str):
    """File system and path in it; Spark writes local paths with one slash."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON with the arrays' places, then the arrays on 64-byte borders."""
    at, places, parts = 0, {}, []
    for name, array in arrays.items():
        raw = np.ascontiguousarray(array).tobytes()
        places[name] = [array.dtype.str, at, len(raw)]
        pad = -len(raw) % 64
        parts += [raw, b"\0" * pad]
        at += len(raw) + pad
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    system, name = _store(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    # Under another name first: a task that is run again, or twice at once, leaves a whole file either way.
    own = f"{name}.{np.random.default_rng().integers(1 << 62):x}"
    with system.open_output_stream(own) as f:
        f.write(head)
        for part in parts:
            f.write(part)
    system.move(own, name)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory.  A file in a remote store is copied to a nameless local one first."""
    system, name = _store(path)
    if isinstance(system, fs.LocalFileSystem):
        with open(name, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, system.open_input_stream(name) as source:
            while part := source.read(1 << 24):
                f.write(part)
            f.flush()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    head = data[: data.find(b"\n") + 1]
    return {k: np.frombuffer(data, kind, size // np.dtype(kind).itemsize, len(head) + at) for k, (kind, at, size) in json.loads(head).items()}


def removed(path: str) -> None:
    system, name = _store(path)
    system.delete_dir(name)
