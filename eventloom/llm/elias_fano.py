"""Elias-Fano coding of ascending integers, with a sampled select structure.

n values up to u take about 2 + log2(u / n) bits each: the low bits in a packed
array, the high bits in unary.  ``select(i)`` starts from every SAMPLE-th one.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBQQ")


def encode(values: np.ndarray) -> bytes:
    """Bytes of an ascending sequence of non-negative integers (ties allowed)."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if not n:
        return _HEAD.pack(0, 0, 0, 0, 0)
    if (v[1:] < v[:-1]).any():
        raise ValueError("values must ascend")
    u = int(v[-1]) + 1
    low = max(0, (u // n).bit_length() - 1)
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    highs = np.packbits(high, bitorder="little").tobytes()
    marks = ones[::SAMPLE].astype("<u4" if len(high) < 1 << 32 else "<u8")
    return _HEAD.pack(n, u, low, len(lows), len(highs)) + lows + highs + marks.tobytes()


class Reader:
    """Reads what encode() wrote; keeps the bytes, not a table of offsets."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, self.u, self.low, nl, nh = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        self.lows = np.frombuffer(data, np.uint8, nl, at)
        self.highs = np.frombuffer(data, np.uint8, nh, at + nl)
        kind = np.dtype("<u4" if self.u // (1 << self.low) + self.n + 1 < 1 << 32 else "<u8")
        count = -(-self.n // SAMPLE)
        self.marks = np.frombuffer(data, kind, count, at + nl + nh)
        self.end = at + nl + nh + count * kind.itemsize

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        first = i * self.low
        a, b = first >> 3, (first + self.low + 7) >> 3
        word = int.from_bytes(self.lows[a:b].tobytes(), "little") >> (first & 7)
        return word & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest mark before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.marks[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        bits = np.unpackbits(self.highs[byte : byte + 1], bitorder="little")
        bits[: at & 7] = 0
        base = byte
        while True:
            ones = np.flatnonzero(bits)
            if left < len(ones):
                at = base * 8 + int(ones[left])
                return ((at - i) << self.low) | self._low(i)
            left -= len(ones)
            base += len(bits) // 8
            bits = np.unpackbits(self.highs[base : base + 64], bitorder="little")

    def values(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Values lo to hi (exclusive), from the mark before lo on; no other value is decoded."""
        hi = self.n if hi is None else min(hi, self.n)
        if lo >= hi:
            return np.zeros(0, np.int64)
        mark = lo // SAMPLE
        byte, ones, found = int(self.marks[mark]) >> 3, [], 0
        want = hi - mark * SAMPLE
        while found < want:
            bits = np.unpackbits(self.highs[byte : byte + 4096], bitorder="little")
            if not found and not ones:
                bits[: int(self.marks[mark]) & 7] = 0
            ones.append(np.flatnonzero(bits) + 8 * byte)
            found += len(ones[-1])
            byte += 4096
        at = np.concatenate(ones)[lo - mark * SAMPLE : want]
        out = (at - np.arange(lo, hi)).astype(np.int64) << self.low
        if self.low:
            a, b = lo * self.low >> 3, (hi * self.low + 7) >> 3
            bits = np.unpackbits(self.lows[a:b], bitorder="little")[lo * self.low - 8 * a :][: (hi - lo) * self.low].reshape(hi - lo, self.low)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return out
