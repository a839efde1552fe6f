"""Elias-Fano code of a non-decreasing sequence: about 2 + log2(greatest / count) bits a value, with direct access.

The low bits of the values lie side by side. The high bits are written in unary: the i-th one bit stands at (value >> low) + i,
so that selecting it gives the value back. The place of every 64th one bit is kept, as 32-bit numbers, for that selection.
Values are unsigned 64-bit numbers; those from 2 ** 63 on come back as the signed numbers with the same bits.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 64
HEAD = struct.Struct("<QQB")


class EliasFano:
    def __init__(self, count: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.count, self.top, self.low_bits, self.low, self.high, self.marks = count, top, low_bits, low, high, marks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width].ravel(), bitorder="little")
        places = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, top, width, low, np.packbits(bits, bitorder="little"), places[::STEP].astype("<u4"))

    def tobytes(self) -> bytes:
        return HEAD.pack(self.count, self.top, self.low_bits) + self.marks.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        n, top, width = HEAD.unpack_from(data)
        at = HEAD.size
        marks = np.frombuffer(data, "<u4", -(-n // STEP), at)
        at += marks.nbytes
        low = np.frombuffer(data, np.uint8, -(-n * width // 8), at)
        return cls(n, top, width, low, np.frombuffer(data, np.uint8, offset=at + len(low)), marks)

    def _low(self, first: int, last: int) -> np.ndarray:
        """The low bits of values first to last - 1."""
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low_bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def values(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Values first to last - 1, read from the marked place before them on."""
        last = self.count if last is None else min(last, self.count)
        if first >= last:
            return np.array([], np.int64)
        block, end = first // STEP, -(-last // STEP)
        start = int(self.marks[block])
        stop = int(self.marks[end]) if end < len(self.marks) else len(self.high) * 8
        bits = np.unpackbits(self.high[start // 8 : stop // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits) + start // 8 * 8
        ones = ones[ones >= start][first - block * STEP :][: last - first]
        return ((ones - np.arange(first, last)) << self.low_bits) | self._low(first, last)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        return int(self.values(i, i + 1)[0])

    def __len__(self) -> int:
        return self.count
