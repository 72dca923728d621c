"""Whole-text token ids from a public tokenizer whose pre-tokens never hold white space.

Such a tokenizer (word_bpe_49k) gives a text the ids of its parts, one after another. The
bytes of many texts are cut into parts with array operations. Where a stretch between blanks
has ASCII and Latin-1 letters only (U+00C0 to U+00FF but for two signs), the tokenizer's
rules are plain: letters are lowered, and parts are runs of letters, single digits and runs
of signs. A stretch with anything else, or one that may hold a special token, is one part as
it is. Arrow's dictionary encoding finds the different parts of a slice, and each worker
hands the tokenizers library those that it doesn't remember. The memory holds about `limit`
parts; results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from routeloom.llm._words import pieces

#: A stretch of its own id that stands between others; stretches that hold it are encoded alone.
_MARK = b"\x01"
_SPACE, _LETTER, _DIGIT, _SIGN = 0, 1, 2, 3


def _kinds() -> np.ndarray:
    out = np.full(256, _SIGN, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[[b for b in range(0x80) if chr(b).isalpha()]] = _LETTER
    out[0x30:0x3A] = _DIGIT
    out[0x80:] = _LETTER
    return out


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 0x20
    return out


_KIND, _LOWER = _kinds(), _lower()


def _cut(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, lowered where the parts are plain, where parts start, and which aren't plain; rows are the places where a row starts."""
    n = len(data)
    kind, low = _KIND[data], _LOWER[data]
    before = np.zeros(n, np.uint8)
    before[1:] = kind[:-1]
    first = np.zeros(n + 3, bool)
    first[rows[rows < n]] = True
    before[first[:n]] = _SPACE
    start = (kind != before) & (kind != _SPACE) | (kind == _DIGIT)
    # a single apostrophe and the letters of a contraction after it are one part
    q = np.flatnonzero((data == 0x27) & start)
    if len(q):
        ahead = np.zeros(n + 3, np.uint8)
        ahead[:n] = np.where(kind == _LETTER, low, 0)
        one, two = np.where(first[q + 1], 0, ahead[q + 1]), ahead[q + 2]
        two[first[q + 1] | first[q + 2]] = 0
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, size in ((q[short], 2), (q[long & ~short], 3)):
            start[at + 1] = False
            rest = at + size
            rest = rest[rest < n]
            start[rest] |= kind[rest] == _LETTER
    odd = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")) & ~first[1:n])
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        lead = data[high] == 0xC3
        follows = np.zeros(n + 1, bool)
        follows[high[lead] + 1] = True
        byte, after = data[high], follows[high]
        upper = after & (byte <= 0x9E) & (byte != 0x97)
        low[high[upper]] += 0x20
        odd = np.concatenate([odd, high[~lead & (~after | (byte == 0x97) | (byte == 0xB7))]])
    if len(odd):
        bounds = np.flatnonzero((kind != _SPACE) & (before == _SPACE))
        ends = np.flatnonzero((kind != _SPACE) & np.append((before == _SPACE)[1:] | (kind == _SPACE)[1:], True)) + 1
        own = np.unique(np.searchsorted(bounds, odd, "right") - 1)
        inside = np.zeros(n + 1, np.int8)
        inside[bounds[own]] += 1
        np.subtract.at(inside, ends[own], 1)
        inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
        low[inside] = data[inside]
        start[inside] = False
        start[bounds[own]] = True
        starts = np.flatnonzero(start)
        return low, starts, inside[starts]
    starts = np.flatnonzero(start)
    return low, starts, np.zeros(len(starts), bool)


class Encoder:
    """Maps texts to their ids as little-endian uint16 arrays."""

    def __init__(self, path: str, limit: int = 250_000, together: int = 4096, window: int = 1 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.together, self.window = Tokenizer.from_file(path), limit, together, window
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        # plain parts are normalised and cut already: the same model, with nothing but blanks to part them
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # printed ASCII is its own byte-level spelling
        self.printed = Tokenizer(self.tokenizer.model)
        self.printed.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        # the memory: parts, and their ids one after another
        self.names, self.ids, self.sizes = pa.array([], pa.binary()), np.zeros(0, "<u2"), np.zeros(0, np.int64)
        mark = self._encode(self.tokenizer, _MARK)
        self.mark = int(mark[0]) if len(mark) == 1 else None

    @staticmethod
    def _encode(tokenizer, data: bytes) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([data.decode()], add_special_tokens=False)[0].ids, "<u2")

    def _plain(self, parts: pa.Array, tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that hold no blank and are their own pre-token, and each one's number of them."""
        ids = self._encode(tokenizer or self.plain, b" ".join(parts.to_pylist()))
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(parts):
            return ids, np.diff(ends, prepend=0)
        return self._singly(self.plain, parts)

    def _odd(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for stretches of any kind."""
        own = parts.to_pylist()
        if self.mark is None or any(_MARK in s for s in own):
            return self._singly(self.tokenizer, parts)
        ids = self._encode(self.tokenizer, (b" " + _MARK + b" ").join(own))
        marks = ids == self.mark
        sizes = np.diff(np.flatnonzero(np.concatenate([[True], marks, [True]]))) - 1
        return ids[~marks], sizes

    def _singly(self, tokenizer, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = [self._encode(tokenizer, s) for s in parts.to_pylist()]
        return np.concatenate(own), np.array([len(x) for x in own])

    def _learn(self, names: pa.Array, odd: np.ndarray) -> np.ndarray:
        """Adds parts to the memory and tells each one's place there; odd tells those that aren't plain."""
        new = [self.names], [self.ids], [self.sizes]
        printed = pc.match_substring_regex(names, "^[!-~]+$").to_numpy(zero_copy_only=False) & ~odd
        kinds = [np.flatnonzero(x) for x in (printed, ~printed & ~odd, odd)]
        places = np.empty(len(names), np.int32)
        places[np.concatenate(kinds)] = np.arange(len(names), dtype=np.int32) + len(self.names)
        for which, encode, together in zip(kinds, (lambda x: self._plain(x, self.printed), self._plain, self._odd), (self.together, self.together, 256), strict=True):
            own = names.take(pa.array(which))
            for i in range(0, len(own), together):
                part = own.slice(i, together)
                for a, b in zip(new, (part, *encode(part)), strict=True):
                    a.append(b)
        self.names, self.ids, self.sizes = pa.concat_arrays(new[0]), np.concatenate(new[1]), np.concatenate(new[2])
        return places

    def _forget(self) -> None:
        """Keeps the newer half of a full memory, and no part that is very long."""
        first = max(0, len(self.names) - self.limit // 2)
        kept = pc.binary_length(self.names).to_numpy() <= 64
        kept[:first] = False
        self.ids = self.ids[np.repeat(kept, self.sizes)]
        self.names, self.sizes = self.names.filter(pa.array(kept)), self.sizes[kept]

    def _window(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a stretch of bytes, where its parts start, and each one's number of ids."""
        low, starts, odd = _cut(data, rows)
        if not len(starts):
            return np.zeros(0, "<u2"), starts, np.zeros(0, np.int64)
        whole = _KIND[data] != _SPACE
        at = np.cumsum(whole, dtype=np.int32)
        offsets = np.append(at[starts] - 1, at[-1:])
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[whole])]).dictionary_encode()
        which, names = parts.indices.to_numpy(), parts.dictionary
        found = pc.fill_null(pc.index_in(names, self.names), -1).to_numpy(zero_copy_only=False)
        new = found < 0
        if new.any():
            is_odd = np.zeros(len(names), bool)
            is_odd[which[odd]] = True
            found = found.copy()
            found[new] = self._learn(names.filter(pa.array(new)), is_odd[new])
        firsts = (np.cumsum(self.sizes) - self.sizes)[found].astype(np.int32)
        n = self.sizes[found].astype(np.int32)[which]
        ends = np.cumsum(n, dtype=np.int32)
        out = self.ids[np.repeat(firsts[which] - ends + n, n) + np.arange(ends[-1], dtype=np.int32)]
        if len(self.names) > self.limit:
            self._forget()
        return out, starts, n

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of UTF-8 bytes, one row after another, and each row's number of them."""
        out, counts, begin = [], np.zeros(len(offsets) - 1, np.int64), 0
        while begin < len(data):
            end = min(len(data), begin + self.window)
            if end < len(data):
                # cut at a blank, however far away: a part never reaches beyond it
                blank = np.flatnonzero(_KIND[data[begin:end]] == _SPACE)
                step = self.window
                while not len(blank) and end < len(data):
                    more = min(len(data), end + step)
                    blank = np.flatnonzero(_KIND[data[end:more]] == _SPACE) + (end - begin)
                    end = more
                end = begin + int(blank[-1]) + 1 if len(blank) else len(data)
            i, j = np.searchsorted(offsets, (begin, end))
            ids, starts, n = self._window(data[begin:end], offsets[i:j] - begin)
            row = np.searchsorted(offsets, starts + begin, "right") - 1
            counts += np.bincount(row, n, len(counts)).astype(np.int64)
            out.append(ids)
            begin = end
        return np.concatenate(out) if out else np.zeros(0, "<u2"), counts

    def encode(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_bytes(data, np.array([0, len(data)]))[0]

    def rest(self) -> None:
        """Gives back what a task has needed; the memory stays for the next one."""
        pa.default_memory_pool().release_unused()


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int, target: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, of about `target` bytes of text, one row at least, with the ids of all their texts and each one's number of them; end_id ends a text."""
    e = encoder(path)
    for b in batches:
        for i, j, data, offsets in pieces(b.column("text"), target):
            ids, n = e.encode_bytes(data, offsets)
            yield b.slice(i, j - i), np.insert(ids, np.cumsum(n), end_id), n + 1
    e.rest()


def binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Arrow's binary array of stretches of `sizes` values each, without a copy of each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError("one text's ids take more than an Arrow array can hold")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary file."""
    return Encoder(path)
