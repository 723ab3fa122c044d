"""Token ids of whole texts under a public word-level byte BPE file, by distinct words.

The file's pre-tokenizer cuts a text into runs of letters, single digits and runs of
other marks, lower-cased.  In texts of plain Latin letters those pieces are found by
byte classes and each distinct piece is merged once per worker, many at a time.  Every
other text (other scripts, apostrophes, special tokens) goes through the tokenizers
library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

from . import words as W
from .common import spread

#: Pieces that a worker keeps, some tens of bytes each; the table starts anew beyond this.
CACHE_PIECES = 1 << 18
MAX_PIECE = 40
_NONE = np.iinfo(np.int32).max
_DIGIT = 2


def _classes() -> np.ndarray:
    """Of bytes: 0 white space, 1 letters (all of 0x80 up in plain texts), 2 digits, 3 the rest."""
    kind = np.full(256, 3, np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = _DIGIT
    return kind


_CLASS = _classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_characters() -> dict[int, str]:
    """The usual printable stand-ins of byte-level BPE: printable Latin-1 bytes stay, the rest follow from 256 up."""
    stay = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + k) for k, b in enumerate(moved)}


class _Pairs:
    """Rank and merged id of symbol pairs, by two open tables; the few keys that meet in both go to a dict-ordered tail."""

    def __init__(self, keys: np.ndarray):
        self.tables = []
        left = np.arange(len(keys))
        for bits, mult in ((20, 0x9E3779B97F4A7C15), (16, 0xC2B2AE3D27D4EB4F), (12, 0x165667B19E3779F9)):
            slot = self._slot(keys[left], bits, mult)
            held = np.full(1 << bits, -1, np.int64)
            rank = np.full(1 << bits, _NONE, np.int32)
            _, first = np.unique(slot, return_index=True)
            held[slot[first]], rank[slot[first]] = keys[left[first]], left[first]
            self.tables.append((bits, mult, held, rank))
            left = np.delete(left, first)
        self.tail = {int(keys[k]): int(k) for k in left}

    @staticmethod
    def _slot(keys, bits, mult):
        return ((keys.astype(np.uint64) * np.uint64(mult)) >> np.uint64(64 - bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, _NONE, np.int32)
        for bits, mult, held, rank in self.tables:
            slot = self._slot(keys, bits, mult)
            hit = held[slot] == keys
            out = np.where(hit, rank[slot], out)
        for key, k in self.tail.items():
            out[keys == key] = k
        return out


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.specials = [t["content"].encode() for t in spec["added_tokens"]]
        chars = _byte_characters()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[chars[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(vocab.values()) + 1
        self.pairs = _Pairs(np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._reset()

    def _reset(self):
        self.table = W.HashTable()
        self.ids = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.count = np.empty(0, np.int64)

    def _pieces(self, pieces: list[bytes]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of distinct pieces of at most MAX_PIECE bytes; the lowest-ranked leftmost pair merges first."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        count = size.copy()
        order = np.argsort(size, kind="stable")
        for k in range(0, len(order), 1 << 12):
            part = order[k : k + (1 << 12)]
            wide = int(size[part].max())
            if not wide:
                continue
            raw = np.frombuffer(b"".join([pieces[i].ljust(wide, b"\0") for i in part.tolist()]), np.uint8).reshape(len(part), wide)
            at = np.arange(wide)
            sym = np.where(at == size[part][:, None] - 1, self.final[raw], self.inner[raw]).astype(np.int64)
            left = size[part].copy()
            self._merge(sym, left)
            count[part] = left
            for row, n, i in zip(sym.tolist(), left.tolist(), part.tolist(), strict=True):
                out[i] = row[:n]
        return out, count

    def _merge(self, sym: np.ndarray, left: np.ndarray) -> None:
        rows, wide = np.arange(len(sym)), sym.shape[1]
        if wide < 2:
            return
        at = np.arange(wide)
        rank = np.where(at[1:] < left[:, None], self.pairs.rank(sym[:, :-1] * self.width + sym[:, 1:]), _NONE)
        while len(rows):
            j = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), j]
            on = best != _NONE
            if not on.all():
                rows, rank, j, best = rows[on], rank[on], j[on], best[on]
                if not len(rows):
                    break
            cur = sym[rows]
            k = np.arange(len(rows))
            cur[k, j] = self.merged[best]
            shift = np.minimum(at + (at > j[:, None]), wide - 1)
            cur = np.take_along_axis(cur, shift, axis=1)
            left[rows] -= 1
            sym[rows] = cur
            rank = np.take_along_axis(rank, shift[:, :-1].clip(max=wide - 2), axis=1)
            n = left[rows]
            rank[at[None, 1:] >= n[:, None]] = _NONE
            for side in (j - 1, j):
                ok = (side >= 0) & (side + 1 < n)
                x, y = k[ok], side[ok]
                rank[x, y] = self.pairs.rank(cur[x, y] * self.width + cur[x, y + 1])

    #: Texts of these characters only are cut into pieces by byte classes; an apostrophe needs the pattern's contractions.
    _PLAIN = re.compile("[\t-\r\x20-&(-~À-ÖØ-öø-ÿ]*")

    def encode(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first): text k has ids[first[k]:first[k + 1]]."""
        plain = [self._PLAIN.fullmatch(raw.decode("utf-8", "replace")) is not None and not any(s in raw for s in self.specials) for raw in raws]
        if all(plain):
            return self._plain(raws)
        ids, first = self._plain([raw if p else b"" for raw, p in zip(raws, plain, strict=True)])
        odd = [k for k, p in enumerate(plain) if not p]
        coded = dict(zip(odd, (e.ids for e in self.library.encode_batch([raws[k].decode("utf-8", "replace") for k in odd], add_special_tokens=False)), strict=True))
        parts = [np.array(coded[k], np.int32) if k in coded else ids[first[k] : first[k + 1]] for k in range(len(raws))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _plain(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = _LOWER[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
        upper = np.flatnonzero(data == 0xC3) + 1
        upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E)]
        data[upper] += 0x20
        kind = _CLASS[data]
        fresh = kind != 0
        fresh[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        start = np.flatnonzero(fresh)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)])
        first = np.searchsorted(start, bounds)
        if not len(start):
            return np.empty(0, np.int32), first
        body = kind != 0
        kept = data[body]
        begin = np.flatnonzero(fresh[body])
        h = W.run_hashes(kept, begin)
        if self.table.used > CACHE_PIECES:
            self._reset()
        slot = self.table.get(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            keys, at = np.unique(h[new], return_index=True)
            at = new[at]
            ends = np.append(begin, len(kept))
            whole = kept.tobytes()
            self._learn([whole[x:y] for x, y in zip(ends[at].tolist(), ends[at + 1].tolist(), strict=True)], keys)
            slot[new] = self.table.get(h[new])
        per_piece = self.count[slot]
        ids = self.ids[spread(self.start[slot], per_piece)]
        ends = np.concatenate([[0], np.cumsum(per_piece)])
        return ids, ends[first]

    def _learn(self, pieces: list[bytes], keys: np.ndarray) -> None:
        rows, count = self._pieces([x if len(x) <= MAX_PIECE else b"" for x in pieces])
        for k, x in enumerate(pieces):
            if len(x) > MAX_PIECE:
                rows[k] = self.library.encode(x.decode("utf-8"), add_special_tokens=False).ids
                count[k] = len(rows[k])
        flat = np.array([i for row in rows for i in row], np.int32)
        base = len(self.count)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, flat])
        self.table.put(keys, np.arange(base, base + len(keys), dtype=np.int32))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)
