"""Elias-Fano sequences and an n-gram trie built of them, as flat buffers.

A sequence of ascending numbers keeps the low bits of each in a packed array
and the high bits in unary; a small directory of ones per 64 bits makes both
access by index and successor search fast.  All arrays are views of one buffer,
so a buffer in a file can be memory-mapped and used as it is.  Every method
works on whole arrays of queries.
"""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64
_BYTE_SELECT = np.array([[([k for k in range(8) if b >> k & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)],
                        np.uint8)


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each 64-bit word."""
    out, r = np.zeros(len(word), np.int64), r.copy()
    for half in (32, 16, 8):  # the half that holds it
        n = np.bitwise_count(word & U64((1 << half) - 1))
        up = r >= n
        r -= n * up
        out += half * up
        word = word >> (up * U64(half))
    return out + _BYTE_SELECT[(word & U64(255)).astype(np.uint8), np.minimum(r, 7)]


class EliasFano:
    """Ascending numbers below 2^63."""

    def __init__(self, buffer: bytes | memoryview, at: int = 0):
        self.n, self.bits, words, low_words = struct.unpack_from("<qqqq", buffer, at)
        at += 32
        self.high = np.frombuffer(buffer, "<u8", words, at)
        at += 8 * words
        self.ones = np.frombuffer(buffer, "<u4", words + 1, at)  # ones before each word
        at += 4 * (words + 1) + 4 * ((words + 1) % 2)
        self.low = np.frombuffer(buffer, "<u8", low_words, at)
        self.end = at + 8 * low_words
        self._zeros = None

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max((top // max(n, 1)).bit_length() - 1, 0)
        place = (values >> bits) + np.arange(n)
        words = int(place[-1]) // 64 + 1 if n else 1
        high = np.zeros(words, U64)
        np.bitwise_or.at(high, place >> 6, U64(1) << (place & 63).astype(U64))
        ones = np.append(0, np.cumsum(np.bitwise_count(high))).astype("<u4")
        low = np.zeros((n * bits + 63) // 64 + 1, U64)
        if bits:
            v = values.astype(U64) & U64((1 << bits) - 1)
            bit = np.arange(n, dtype=np.int64) * bits
            word, off = bit >> 6, (bit & 63).astype(U64)
            np.bitwise_or.at(low, word, v << off)
            over = (off + U64(bits)) > U64(64)
            np.bitwise_or.at(low, word[over] + 1, v[over] >> (U64(64) - off[over]))
        return (struct.pack("<qqqq", n, bits, words, len(low)) + high.tobytes() + ones.tobytes()
                + b"\0" * (4 * ((words + 1) % 2)) + low.tobytes())

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        bit = i * self.bits
        word, off = bit >> 6, (bit & 63).astype(U64)
        v = self.low[word] >> off
        over = (off + U64(self.bits)) > U64(64)
        v[over] |= self.low[word[over] + 1] << (U64(64) - off[over])
        return (v & U64((1 << self.bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at indexes ``i``."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = 64 * word + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i) << self.bits) | self._lows(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below ``h``."""
        if self._zeros is None:
            self._zeros = 64 * np.arange(len(self.ones)) - self.ones
        k = h - 1  # the zero that ends the values with high bits h - 1
        word = np.searchsorted(self._zeros, np.maximum(k, 0), side="right") - 1
        word = np.minimum(word, len(self.high) - 1)
        r = np.maximum(k, 0) - self._zeros[word]
        beyond = r >= 64 - np.bitwise_count(self.high[word]).astype(np.int64)
        place = 64 * word + _select_in_word(~self.high[word], np.minimum(r, 63))
        out = np.where(beyond, self.n, place - k)
        return np.where(h <= 0, 0, np.minimum(out, self.n))

    def _successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value that is not below each ``x``, and whether it is ``x``."""
        x = np.asarray(x, np.int64)
        high = x >> self.bits
        new = np.append(True, high[1:] != high[:-1])[:len(x)]
        h, of = high[new], np.cumsum(new) - 1  # neighbours share their high bits, if they ascend
        first = self._before(h)
        last = np.append(first[1:], 0)  # where the next one has the next high bits
        apart = np.append(h[1:] != h[:-1] + 1, True)[:len(h)]
        last[:len(h)][apart] = self._before(h[apart] + 1)
        lo, hi = first[of], last[of]
        low = x & ((1 << self.bits) - 1)
        there = np.zeros(len(x), bool)
        at = np.flatnonzero(lo < hi)
        a, b, wanted = lo[at], hi[at], low[at]
        while len(at):
            mid = (a + b) >> 1
            v = self._lows(mid)
            there[at[v == wanted]] = True
            less = v < wanted
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            lo[at] = a
            live = a < b
            at, a, b, wanted = at[live], a[live], b[live], wanted[live]
        return lo, there

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not below each ``x`` (n if none)."""
        return self._successor(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is ``x``, -1 where there is none."""
        at, there = self._successor(x)
        return np.where(there, at, -1)


class Trie:
    """Two levels: contexts, and under each the words seen after it with a
    quantised value.  Words are kept relative to their context: each context's
    words are shifted behind the last one's, so the level ascends throughout,
    and monotone pointers tell where a context's words begin."""

    def __init__(self, buffer: bytes | memoryview):
        self.contexts = EliasFano(buffer)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.shifts = EliasFano(buffer, self.pointers.end)
        self.words = EliasFano(buffer, self.shifts.end)
        self.codes = np.frombuffer(buffer, "<u2", self.words.n, self.words.end)

    @staticmethod
    def pack(context: np.ndarray, word: np.ndarray, code: np.ndarray) -> bytes:
        """From distinct (context, word) in ascending order."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(word)) - 1
        width = word[last] + 1 if len(first) else word
        shift = np.cumsum(width) - width
        return b"".join(EliasFano.pack(v) for v in (
            context[first], np.append(first, len(word)), shift, word + np.repeat(shift, np.diff(np.append(first, len(word))))
        )) + code.astype("<u2").tobytes()

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of each (context, word), -1 where it isn't there; a context is
        looked up once for neighbours that share it."""
        n = self.contexts.n
        out = np.full(len(context), -1)
        if not n or not len(context):
            return out
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        c = self.contexts.find(context[first])
        ok = (c >= 0)[of]
        c, of = np.maximum(c, 0), of[ok]
        i = self.words.find(word[ok] + self.shifts.access(c)[of])
        # earlier contexts' words are all below the shift; those of later ones are behind the pointer
        out[ok] = np.where(i < self.pointers.access(c + 1)[of], i, -1)
        return out
