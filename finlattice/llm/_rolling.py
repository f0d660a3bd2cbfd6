"""Numpy rolling hashes over UTF-8 bytes: the hash of any byte span in O(1) after one prefix sum.

A text's bytes are mapped to random 64-bit values and summed with powers of an odd base modulo
2**64; a span's hash is the difference of two prefix sums, shifted back by the inverse power and
mixed.  Equal spans always have equal hashes, wherever they stand and in whichever text.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_EMPTY = np.zeros(0, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(14, (n - 1).bit_length())
        table = np.empty(size, np.uint64)
        table[0] = 1
        have, step = 1, base
        while have < size:  # table[have:2*have] = table[:have] * base**have
            table[have : 2 * have] = table[:have] * np.uint64(step)
            step = step * step & _MASK
            have *= 2
        _powers[base] = table
    return table


class Spans:
    """Span hashes of one byte string."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        n = len(self.bytes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * _power_table(_BASE, n + 1)[:n], out=self.sums[1:])
        self._back = _power_table(_INVERSE, n + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self._back[starts])


class Words(Spans):
    """The words of a text (split at ASCII white space), joined by single spaces, with n-gram hashes."""

    def __init__(self, data: bytes):
        joined = b" ".join(data.split())
        super().__init__(joined)
        if joined:
            gaps = np.flatnonzero(self.bytes == 32)
            self.starts = np.concatenate(([0], gaps + 1))
            self.ends = np.concatenate((gaps, [len(joined)]))
        else:
            self.starts = self.ends = _EMPTY
        self.n = len(self.starts)

    def grams(self, n: int) -> np.ndarray:
        """One hash per window of n words; empty when the text has fewer."""
        if n > self.n:
            return np.zeros(0, np.uint64)
        return self.hash(self.starts[: self.n - n + 1], self.ends[n - 1 :])

    def code_points(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.concatenate(([0], np.cumsum((self.bytes & 0xC0) != 0x80)))
        return lead[self.ends] - lead[self.starts]


def repeated(hashes: np.ndarray) -> np.ndarray:
    """True where a value occurs at least twice."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        order = np.argsort(hashes)
        same = np.diff(hashes[order]) == 0
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def covered(flags: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for each of n words that a flagged window of `width` words covers."""
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    steps[at] += 1
    np.subtract.at(steps, at + width, 1)
    return np.cumsum(steps[:n]) > 0
