"""Letter and digit runs of whole texts, for operators that must not see case or punctuation."""

from __future__ import annotations

import numpy as np

from . import words as W

_U = np.uint64


def _run_class() -> np.ndarray:
    """True for bytes of a run: ASCII letters and digits and every byte of a multi-byte character."""
    own = np.zeros(256, bool)
    own[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return own


_RUN = _run_class()
_FOLD = W._FOLD


class Runs:
    """Runs of a chunk of encoded texts: start, end (bytes of the joined data), doc, first, hash.

    A-Z and the upper-case letters of Latin-1 are folded; other characters stay as they are.
    """

    def __init__(self, raws: list[bytes], prefixes: tuple[int, ...] = ()):
        self.bytes = b"\n".join(raws) + b"\n"
        data = _FOLD[np.frombuffer(self.bytes, np.uint8)]
        upper = np.flatnonzero(data == 0xC3) + 1
        # 0xC3 is a lead byte, so a byte follows unless the text was cut; 0x97 is the multiplication sign.
        upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E) & (data[upper] != 0x97)]
        data[upper] += 0x20
        self.data = data
        own = _RUN[data]
        edge = np.empty(len(data), bool)
        edge[0] = own[0]
        np.not_equal(own[1:], own[:-1], out=edge[1:])
        marks = np.flatnonzero(edge)
        self.start, self.end = marks[0::2], marks[1::2]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        self.doc_start = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.start, self.doc_start)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raws)), self.counts)
        self.prefix: dict[int, np.ndarray] = {}
        if not len(self.start):
            self.hash = np.empty(0, np.uint64)
            self.prefix = dict.fromkeys(prefixes, self.hash)
            return
        kept = data[own]
        size = self.end - self.start
        begin = np.cumsum(size) - size
        at = np.arange(len(kept)) - np.repeat(begin, size)
        terms = (kept.astype(np.uint64) + _U(1)) * W.powers(int(size.max()))[at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        self.hash = W.mix(sums[begin + size] - sums[begin] + size.astype(np.uint64) * W._MULT)
        for k in prefixes:
            cut = np.minimum(size, k)
            self.prefix[k] = W.mix(sums[begin + cut] - sums[begin] + _U(k) * _U(0x2545F4914F6CDD1D))

    def __len__(self) -> int:
        return len(self.start)


def sentences(runs: Runs, most: int = 40) -> np.ndarray:
    """Whether each run starts a sentence: a text's first run, one after . ! ? or a line break, or the next after `most` runs without any."""
    n = len(runs)
    if not n:
        return np.empty(0, bool)
    stop = np.zeros(256, np.int64)
    stop[[10, 33, 46, 63]] = 1
    seen = np.concatenate([[0], np.cumsum(stop[runs.data])])
    fresh = np.ones(n, bool)
    fresh[1:] = seen[runs.start[1:]] > seen[runs.end[:-1]]
    fresh[runs.first[:-1][runs.counts > 0]] = True
    head = np.flatnonzero(fresh)
    since = np.arange(n) - head[np.cumsum(fresh) - 1]
    return since % most == 0
