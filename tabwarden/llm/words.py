"""Words and lines of whole columns of text, as flat arrays of bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tabwarden.llm.arrow import constants, mixed

#: A word is a run of bytes other than these: the blank and \\x09 to \\x0D.
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
LINE_END = np.arange(256) == 10
#: The first byte of a character; all others go on one.
HEAD = (np.arange(256) & 0xC0) != 0x80
AS_IS = np.arange(256, dtype=np.uint8)
_BYTE = constants(71, 256)
_STEP = np.uint64(0xD1342543DE82EF95)
_LENGTH = constants(73, 1)[0]


def among(chars: str) -> np.ndarray:
    """Whether each byte is one of these ASCII characters."""
    return np.isin(np.arange(256), [ord(c) for c in chars])


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _STEP, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the values of each row of a ragged array."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[off])


class Runs:
    """Maximal runs of bytes that are not in ``stops``, none over the end of a row.

    ``start`` and ``size`` are in bytes; ``off`` holds the n + 1 offsets of the rows among the runs.
    """

    def __init__(self, raw: np.ndarray, off: np.ndarray, stops: np.ndarray) -> None:
        self.inside = ~stops[raw]
        opens = self.inside.copy()
        opens[1:] &= ~self.inside[:-1]
        heads = off[:-1][off[:-1] < len(raw)]
        opens[heads] = self.inside[heads]
        self.raw, self.start = raw, np.flatnonzero(opens)
        self.off = np.searchsorted(self.start, off)
        before = np.concatenate(([0], np.cumsum(self.inside)))
        self.at = before[self.start]
        self.size = np.diff(np.append(self.at, before[-1]))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def hashes(self, written: np.ndarray = AS_IS) -> np.ndarray:
        """64-bit hash of each run, its bytes as ``written`` says."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        kept = written[self.raw[self.inside]]
        place = np.arange(len(kept)) - np.repeat(self.at, self.size)
        h = np.add.reduceat(_BYTE[kept] * powers(int(self.size.max()))[place], self.at)
        return mixed(h + self.size.astype(np.uint64) * _LENGTH)


def first_of_each(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of (row, key) pairs, where a new pair begins in it, and the size of each pair's run."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    begin = np.flatnonzero(fresh)
    return order, begin, np.diff(np.append(begin, len(order)))


def fingerprints(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two longs for each text: a 128-bit digest of its bytes."""
    data = memoryview(np.ascontiguousarray(raw))
    digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist()))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).astype(np.int64))
