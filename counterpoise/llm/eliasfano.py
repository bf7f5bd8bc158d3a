"""Elias-Fano sequences and n-gram tries as flat byte strings, read in place and in bulk.

A sequence of n ascending whole numbers keeps the low bits of each number packed and the high bits
in unary; the number at a place and the first number not below a value are found by counting bits,
for whole arrays of questions at once.

A trie over rows of d words has one level per word.  A level holds the words of all nodes, children
of one parent side by side, and pointers say where the children of each parent start.  Words are
kept relative to their parent: the running total of the last words of the parents before is
added, which makes a level one ascending sequence.  To find a word below a node, the total before
its children is added to the word, and its successor is searched among the children alone.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONE = _U(1)


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of every number, one after the other, in 64-bit words."""
    words = np.zeros((len(values) * width + 63) // 64 + 2, _U)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, off = at >> 6, (at & 63).astype(_U)
        low = values & _U((1 << width) - 1)
        # each word is the sum of the pieces that start in it and those that reach into it
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] = np.add.reduceat(low << off, first)
        over = np.flatnonzero(off + _U(width) > _U(64))
        words[word[over] + 1] += low[over] >> (_U(64) - off[over])
    return words


def _read_bits(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(i), _U)
    at = i.astype(np.int64) * width
    word, off = at >> 6, (at & 63).astype(_U)
    # a shift by 64 is undefined, so the upper part is shifted twice
    value = (words[word] >> off) | ((words[word + 1] << (_U(63) - off)) << _ONE)
    return value & _U((1 << width) - 1)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0); ``before`` counts the bits ahead of every word."""
    word = np.searchsorted(before, k, side="right") - 1
    left = (k - before[word]).astype(np.int64)
    w = words[word].copy()
    at = word.astype(np.int64) << 6
    for step in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(w & _U((1 << step) - 1)).astype(np.int64)
        go = n <= left
        left -= np.where(go, n, 0)
        w >>= np.where(go, _U(step), _U(0))
        at += np.where(go, step, 0)
    return at


class EliasFano:
    """Ascending whole numbers below 2^63."""

    def __init__(self, data: bytes | memoryview):
        head = np.frombuffer(data, np.int64, 4)
        self.n, self.width, lows, highs = (int(x) for x in head)
        self.low = np.frombuffer(data, _U, lows, 32)
        self.high = np.frombuffer(data, _U, highs, 32 + 8 * lows)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])[:-1]
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones)])[:-1]
        self.buckets = 64 * highs - int(ones.sum())

    @staticmethod
    def build(values: np.ndarray) -> bytes:
        v = np.asarray(values).astype(_U)
        n = len(v)
        top = int(v[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        low = _pack_bits(v, width)
        high = (v >> _U(width)).astype(np.int64)
        size = -(-(n + (int(high[-1]) if n else 0) + 1) // 64) * 64
        bits = np.zeros(size, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        head = np.array([n, width, len(low), len(words)], np.int64)
        return head.tobytes() + low.tobytes() + words.tobytes()

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``."""
        high = _select(self.high, self.ones, i) - i
        return ((high.astype(_U) << _U(self.width)) | _read_bits(self.low, i, self.width)).astype(np.int64)

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below ``high``."""
        some = np.clip(high, 0, self.buckets)
        out = np.zeros(len(some), np.int64)
        more = some > 0
        out[more] = _select(~self.high, self.zeros, some[more] - 1) - (some[more] - 1)
        return np.minimum(out, self.n)

    def successor(self, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in [start, end) whose number is at least ``value``; end if there is none."""
        high = value >> self.width
        lo = np.clip(self._upto(high), start, end)
        hi = np.clip(self._upto(high + 1), start, end)
        low = value.astype(_U) & _U((1 << self.width) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = _read_bits(self.low, mid, self.width) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


class Trie:
    """Rows of d words to the number of the row, over one byte string."""

    def __init__(self, data: bytes | memoryview):
        view = memoryview(data)
        depth = int(np.frombuffer(view, np.int64, 1)[0])
        sizes = np.frombuffer(view, np.int64, 2 * depth, 8)
        at, parts = 8 + 16 * depth, []
        for s in sizes.tolist():
            parts.append(EliasFano(view[at : at + s]) if s else None)
            at += s
        self.words, self.pointers = parts[:depth], parts[depth:]

    @staticmethod
    def build(rows: np.ndarray) -> bytes:
        """From distinct rows (n, d) in lexicographic order."""
        n, depth = rows.shape
        words, pointers = [], [b""]
        parent = np.zeros(n, np.int64)  # node of the level before, per row
        new = np.zeros(n, bool)
        new[:1] = True
        for j in range(depth):
            new[1:] |= rows[1:, j] != rows[:-1, j]
            at = np.flatnonzero(new)
            own, word = parent[at], rows[at, j].astype(np.int64)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else own
            last = word[np.append(first[1:], len(own))[: len(first)] - 1]
            before = np.concatenate([[0], np.cumsum(last + 1)])[:-1] if len(first) else last
            words.append(EliasFano.build(word + before[own]))
            if j:
                pointers.append(EliasFano.build(np.append(first, len(own))))
            parent = np.cumsum(new) - 1
        sizes = np.array([len(x) for x in words + pointers], np.int64)
        return np.int64(depth).tobytes() + sizes.tobytes() + b"".join(words + pointers)

    def find(self, rows: np.ndarray) -> np.ndarray:
        """Number of each row, -1 for those that the trie does not hold."""
        out = np.full(len(rows), -1, np.int64)
        left = np.arange(len(rows))
        node = np.zeros(len(rows), np.int64)
        for j, level in enumerate(self.words):
            if not len(left) or not level.n:
                return out
            if j:
                start, end = self.pointers[j].get(node), self.pointers[j].get(node + 1)
                before = np.zeros(len(node), np.int64)
                some = np.flatnonzero(start > 0)
                before[some] = level.get(start[some] - 1) + 1
            else:
                start, end = np.zeros(len(left), np.int64), np.full(len(left), level.n, np.int64)
                before = start
            want = before + rows[left, j].astype(np.int64)
            at = level.successor(want, start, end)
            hit = np.flatnonzero(at < end)
            hit = hit[level.get(at[hit]) == want[hit]]
            left, node = left[hit], at[hit]
        out[left] = node
        return out


def quantised(values: np.ndarray, bins: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook): bins of equal width, each with the mean of its values, so no value is off
    by more than the width; exact where there are no more different values than bins."""
    found, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
    if len(found) <= bins:
        return inverse.astype(np.uint8), found.astype(float)
    place = (found - found[0]) * (bins / (found[-1] - found[0]))
    used, bin_of = np.unique(np.minimum(place.astype(np.int64), bins - 1), return_inverse=True)
    weight = np.bincount(bin_of, n, len(used))
    return bin_of[inverse].astype(np.uint8), np.bincount(bin_of, found * n, len(used)) / weight
