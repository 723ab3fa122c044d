"""Vectorised word tokenising and hashing shared by the operators of this subpackage.

A batch of texts is joined into one UTF-8 byte array.  Words are maximal runs of
bytes outside space and 0x09-0x0D (the six ASCII white-space characters); a
separator between documents keeps words from crossing a boundary.  UTF-8
continuation bytes are all >= 0x80, so byte-level splitting equals splitting by
character.  Only A-Z are folded to lower case.

Every hash is a 64-bit polynomial over bytes (mod 2**64) passed through a
finaliser, so equal words hash equally on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_MULT = _U(0xD1342543DE82EF95)
#: Texts of a batch are handled in chunks of about this many bytes.
CHUNK_BYTES = 1 << 19


def _fold_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, 9, 10, 11, 12, 13]] = True
    return table


_FOLD = _fold_table()
_SPACE = _space_table()
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(255, _BASE, np.uint64)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), vectorised over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def chunks(texts: Iterable[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts), about `limit` bytes each; a longer text stands alone."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def powers(n: int) -> np.ndarray:
    """The first n powers of the base; grown on demand for very long words."""
    global _POWERS
    if n > len(_POWERS):
        more = np.full(max(n, 2 * len(_POWERS)), _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.cumprod(more)
    return _POWERS[:n]


class Words:
    """Words of a chunk of encoded texts.

    start, end: byte offsets into `data` of each word; doc: index of its text in
    the chunk; hash: the word's 64-bit hash; first[d]:first[d+1]: the words of text d.
    """

    def __init__(self, raws: list[bytes], fold: bool = True):
        joined = b"\n".join(raws) + b"\n"
        data = np.frombuffer(joined, dtype=np.uint8)
        gap = _SPACE[data]
        edge = np.empty(len(data), dtype=bool)
        edge[0] = not gap[0]
        np.not_equal(gap[1:], gap[:-1], out=edge[1:])
        marks = np.flatnonzero(edge)
        self.start, self.end = marks[0::2], marks[1::2]
        self.bytes = joined
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.start, self.doc_start)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raws)), self.counts)
        if len(self.start):
            kept = data[~gap]
            size = self.end - self.start
            self.hash = run_hashes(_FOLD[kept] if fold else kept, np.cumsum(size) - size)
        else:
            self.hash = np.empty(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> str:
        return self.bytes[self.start[i] : self.end[i]].decode("utf-8", "surrogatepass")


def grams(words: Words, n: int, whole_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, first word index) of every n consecutive words inside a text.

    With whole_short, a text of 1 to n-1 words gives one gram of its whole word sequence.
    """
    h, total = words.hash, len(words)
    if total == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.arange(total)
    left = words.first[words.doc + 1] - at
    full = np.flatnonzero(left >= n)
    acc = np.zeros(len(full), np.uint64)
    for k in range(n):
        acc = acc * _BASE + h[full + k]
    value, doc, pos = mix(acc + _U(n)), words.doc[full], full
    if whole_short:
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        if len(short):
            more = np.zeros(len(short), np.uint64)
            for k in range(n - 1):
                on = words.counts[short] > k
                more[on] = more[on] * _BASE + h[words.first[short[on]] + k]
            value = np.concatenate([value, mix(more + words.counts[short].astype(np.uint64))])
            doc = np.concatenate([doc, short])
            pos = np.concatenate([pos, words.first[short]])
    return value, doc, pos


def distinct(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value), sorted by doc then value."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    if len(value) == 0:
        return value, doc
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], doc[keep]


class HashTable:
    """Open addressing from uint64 keys (never 0) to int32 values, looked up and filled many at a time."""

    PROBES = 16

    def __init__(self, bits: int = 18):
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys >> _U(64 - self.bits)).astype(np.int64)) + probe) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        at = self._slot(keys, 0)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found != 0))
        for probe in range(1, self.PROBES):
            if not len(left):
                break
            at = self._slot(keys[left], probe)
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit & (found != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are distinct and not yet present."""
        while (self.used + len(keys)) * 2 > 1 << self.bits or not self._try(keys, values):
            old = self.keys != 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            keys, at = np.unique(keys, return_index=True)
            self.__init__(self.bits + 1)
            values = values[at]

    def _try(self, keys, values) -> bool:
        left = np.arange(len(keys))
        for probe in range(self.PROBES):
            at = self._slot(keys[left], probe)
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            mine = free & (self.keys[at] == keys[left])
            self.values[at[mine]] = values[left[mine]]
            self.used += int(mine.sum())
            left = left[~mine]
            if not len(left):
                return True
        return False


def run_hashes(kept: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of the runs of `kept` that start at `begin` (uint8, runs tile the array), as Words has them."""
    size = np.diff(np.append(begin, len(kept)))
    at = np.arange(len(kept)) - np.repeat(begin, size)
    terms = kept.astype(np.uint64)
    terms += _U(1)
    terms *= powers(int(size.max()))[at]
    return mix(np.add.reduceat(terms, begin) + size.astype(np.uint64) * _MULT)
