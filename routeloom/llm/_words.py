"""Vectorised word splitting and hashing over the bytes of Arrow string columns.

Separators are ASCII everywhere in this subpackage, so splitting UTF-8 bytes and
splitting code points give the same words. Hashes depend on the bytes alone and are
the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Everything in ASCII but digits and letters.
NON_ALNUM = tuple(b for b in range(0x80) if not chr(b).isalnum())

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser that spreads 64-bit values; another salt gives an independent value."""
    h = h + np.uint64((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def _codes(fold_case: bool) -> np.ndarray:
    x = mix(np.arange(1, 257, dtype=np.uint64), 7)
    if fold_case:
        x[ord("A") : ord("Z") + 1] = x[ord("a") : ord("z") + 1]
    return x


_CODES = {f: _codes(f) for f in (False, True)}


class Words:
    """The words of some rows: byte starts and ends, hashes, and the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: tuple[int, ...] = SPACES, fold_case: bool = False):
        n = len(data)
        self.data, self.offsets = data, offsets
        inside = np.ones(256, bool)
        inside[list(separators)] = False
        w = np.zeros(n + 2, bool)
        w[1:-1] = inside[data]
        start, end = w[1:-1] & ~w[:-2], w[1:-1] & ~w[2:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        cuts = cuts[w[cuts] & w[cuts + 1]]
        start[cuts] = True
        end[cuts - 1] = True
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        power, inverse = _grown(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[fold_case][data] * power[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))
        #: Row r has the words first[r] to first[r + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    @classmethod
    def joined(cls, parts: list[Words]) -> Words:
        """The rows of several, one after another."""
        if not parts:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        out = cls.__new__(cls)
        before = np.cumsum([0, *(len(p.data) for p in parts)])
        words = np.cumsum([0, *(len(p) for p in parts)])
        out.data, out.hashes, out.counts = (np.concatenate([getattr(p, a) for p in parts]) for a in ("data", "hashes", "counts"))
        out.starts, out.ends = (np.concatenate([getattr(p, a) + n for p, n in zip(parts, before, strict=False)]) for a in ("starts", "ends"))
        out.offsets = np.concatenate([*(p.offsets[:-1] + n for p, n in zip(parts, before, strict=False)), before[-1:]])
        out.first = np.concatenate([*(p.first[:-1] + n for p, n in zip(parts, words, strict=False)), words[-1:]])
        return out

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def grams(self, k: int, salt: int = 1) -> np.ndarray:
        """Hashes of the k words that start at each word (rows aren't heeded; see fits)."""
        return spans(self.hashes, np.arange(max(0, len(self) - k + 1)), k, salt)

    def fits(self, k: int) -> np.ndarray:
        """Which of the grams lie within one row."""
        return np.arange(max(0, len(self) - k + 1)) + k <= np.repeat(self.first[1:], self.counts)[: max(0, len(self) - k + 1)]


def spans(hashes: np.ndarray, starts: np.ndarray, length: np.ndarray | int, salt: int = 1) -> np.ndarray:
    """Hashes of the stretches of length words from starts on."""
    n = len(hashes)
    power, inverse = _grown(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes, salt) * power[:n], out=sums[1:])
    return mix((sums[starts + length] - sums[starts]) * inverse[starts] + np.uint64(salt))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width values in a row."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def pieces(column: pa.Array, target: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of about target bytes; null counts as empty, a long row stays whole."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def scan(column: pa.Array, separators: tuple[int, ...] = SPACES, fold_case: bool = False, target: int = 1 << 18) -> Iterator[tuple[int, int, Words]]:
    for i, j, data, offsets in pieces(column, target):
        yield i, j, Words(data, offsets, separators, fold_case)
