"""Elias-Fano sequences over numpy arrays: monotone numbers in about 2 + log2(range / count) bits each.

A number is split into low bits, packed, and a high part, written in unary into a bit vector with a
directory of counts before each of its words. All queries take arrays of positions or values and work without a loop per element.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LOW_MASKS = [U((1 << k) - 1) for k in range(65)]
CHUNK = 1 << 15
NEAR = 4  # a range of at most so many positions is compared value by value, low bits first
FEW = 1024  # so many questions cost less in one general search than in several passes over short ranges
# Byte-wise arithmetic inside a 64-bit word: ones, high bits, and bit masks for the counts of bits.
EACH, TOP = U(0x0101010101010101), U(0x8080808080808080)
TWOS, FOURS, HALVES = U(0x5555555555555555), U(0x3333333333333333), U(0x0F0F0F0F0F0F0F0F)


def _places_in_bytes() -> np.ndarray:
    """[byte * 8 + k]: place of the k-th one in a byte (0 where it has fewer)."""
    table = np.zeros((256, 8), np.int64)
    for byte in range(256):
        places = [i for i in range(8) if byte >> i & 1]
        table[byte, : len(places)] = places
    return table.ravel()


IN_BYTE = _places_in_bytes()


def _place_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one of each word: its byte by sums over the bytes before, then by table."""
    sums = word - ((word >> U(1)) & TWOS)
    sums = (sums & FOURS) + ((sums >> U(2)) & FOURS)
    sums = ((sums + (sums >> U(4))) & HALVES) * EACH  # byte i: ones in bytes 0..i
    k = k.astype(U)
    byte = np.bitwise_count((((k * EACH) | TOP) - sums) & TOP).astype(U) << U(3)  # 8 x bytes whose sum is at most k
    k -= ((sums << U(8)) >> byte) & U(255)
    return byte.astype(np.int64) + IN_BYTE[((((word >> byte) & U(255)) << U(3)) | k).astype(np.int64)]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fields of ``width`` bits, one after the other, in 64-bit words (one spare word at the end)."""
    words = np.zeros((len(values) * width + 63) // 64 + 1, U)
    if width:
        at = np.arange(len(values), dtype=U) * U(width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        np.bitwise_or.at(words, word, values << shift)
        over = shift + U(width) > 64
        np.bitwise_or.at(words, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return words


class EliasFano:
    """``arrays`` are low, high and directory, which may lie in a mapped file."""

    def __init__(self, n: int, width: int, arrays: dict[str, np.ndarray]):
        self.n, self.width = n, width
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.zeros = None

    @staticmethod
    def of(values: np.ndarray, universe: int) -> EliasFano:
        """``values`` must not decrease and lie below ``universe``."""
        values = values.astype(U)
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = _pack(values & LOW_MASKS[width], width)
        top = (values >> U(width)) if width < 64 else np.zeros(n, U)
        at = top + np.arange(n, dtype=U)
        size = int(at[-1]) + 1 if n else 0
        size = (size + 1 + (universe >> width) - (int(top[-1]) if n else 0)) // 64 + 2
        high = np.zeros(size, U)
        np.bitwise_or.at(high, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        ones = ones.astype(np.int32 if n < 1 << 31 and size < 1 << 25 else np.int64)
        return EliasFano(n, width, {"low": low, "high": high, "ones": ones})

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        value = self.low[word] >> shift
        over = (shift + U(self.width) > 64).nonzero()[0]
        value[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return value & LOW_MASKS[self.width]

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero in the bit vector."""
        if ones:
            directory = self.ones
        else:
            if self.zeros is None:
                self.zeros = (np.arange(len(self.ones), dtype=self.ones.dtype) << 6) - self.ones
            directory = self.zeros
        word = directory.searchsorted(k.astype(directory.dtype), side="right") - 1
        bits = self.high[word]
        return word * 64 + _place_in_word(bits if ones else ~bits, k - directory[word])

    def _two(self, k: np.ndarray, ones: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k-th and the next one or zero: the second is sought only where the word of the first holds no other."""
        at = self._select(k, ones)
        word = at >> 6
        bits = self.high[word] if ones else ~self.high[word]
        rest = bits & ~((U(2) << (at & 63).astype(U)) - U(1))
        after = (word << 6) + np.bitwise_count((rest & (~rest + U(1))) - U(1))
        far = (rest == 0).nonzero()[0]
        if len(far):
            after[far] = self._select(k[far] + 1, ones)
        return at, after

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at positions i and i + 1."""
        places = self._two(i, True)
        low = [self._low(i), self._low(i + 1)]
        return tuple((((a - b).astype(U) << U(self.width)) | x).astype(np.int64) for a, b, x in zip(places, (i, i + 1), low, strict=True))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions, as int64 where they fit."""
        top = (self._select(i, True) - i).astype(U)
        return (top << U(self.width)) | self._low(i) if self.width < 64 else self._low(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Position of each x among positions [lo, hi), or -1: the successor of x is looked up and compared."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        x = x.astype(U)
        wide = np.arange(len(x))
        if lo is not None:
            small = (hi - lo <= NEAR) & (len(x) > FEW)
            for step in range(NEAR):
                live = (small & (lo + step < hi) & (out < 0)).nonzero()[0]
                if not len(live):
                    break
                at = lo[live] + step
                alike = (self._low(at) == x[live] & LOW_MASKS[self.width]).nonzero()[0]
                live, at = live[alike], at[alike]
                equal = self.get(at) == x[live]
                out[live[equal]] = at[equal]
            wide = (~small).nonzero()[0]
        for at in range(0, len(wide), CHUNK):
            part = wide[at : at + CHUNK]
            out[part] = self._find(x[part], None if lo is None else lo[part], None if hi is None else hi[part])
        return out

    def _find(self, x, lo, hi):
        top = (x >> U(self.width)).astype(np.int64) if self.width < 64 else np.zeros(len(x), np.int64)
        # Values with this high part lie between two zeros; before the first high part there is none.
        before, after = self._two(np.maximum(top - 1, 0), False)
        first = top == 0
        start, end = np.where(first, 0, before - (top - 1)), np.where(first, before, after - top)
        if lo is not None:
            start, end = np.maximum(start, lo), np.minimum(end, hi)
        start, stop, low = start, np.minimum(end, self.n), x & LOW_MASKS[self.width]
        limit = stop.copy()
        live = (start < stop).nonzero()[0]
        while len(live):
            middle = (start[live] + stop[live]) >> 1
            less = self._low(middle) < low[live]
            start[live[less]] = middle[less] + 1
            stop[live[~less]] = middle[~less]
            live = live[start[live] < stop[live]]
        found = (start < limit).nonzero()[0]
        hit = self._low(start[found]) == low[found]
        out = np.full(len(x), -1, np.int64)
        out[found[hit]] = start[found[hit]]
        return out
