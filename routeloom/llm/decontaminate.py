"""Benchmark decontamination with a generalised suffix automaton of the test items.

Each item's normalised words go into one automaton whose states are classes of word
sequences with the same end positions. Documents stream through it: every word moves to a
longer match or falls back along suffix links, so the longest match that ends at each word is
known. A match of at least `window` words (or of a whole item that has fewer) marks its
words; the state tells which items it came from.

The automaton is built over blocks of items with at most `block_words` words (one item at
least), so what is broadcast has a fixed bound; with more items there are more blocks, and
the documents pass one block after another.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.llm._common import materialise
from routeloom.llm._words import NON_ALNUM, Words, pieces

#: Words are runs of digits, letters and anything beyond ASCII, with A-Z lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


class Automaton:
    """States as dicts from word number to state; state 0 is the empty match."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[int]] = [set()]
        whole: list[tuple[int, int, int]] = []
        for number, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.words.setdefault(w, len(self.words)), own)
                own[last].add(number)
            if 0 < len(words) < window:
                whole.append((last, len(words), number))
        order = sorted(range(len(self.link)), key=self.length.__getitem__, reverse=True)
        for v in order:
            if v and self.link[v] > 0:
                own[self.link[v]] |= own[v]
        #: Items of the states whose matches can be as long as a window.
        self.items = [tuple(own[v]) if self.length[v] >= window else () for v in range(len(own))]
        #: Short items that end where a state's matches end: (words, items), those of its suffixes too.
        short: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        ends: dict[int, list[tuple[int, int]]] = {}
        for v, n, number in whole:
            ends.setdefault(v, []).append((n, number))
        for v in reversed(order):
            if v:
                short[v] = tuple(ends.get(v, ())) + (short[self.link[v]] if self.link[v] > 0 else ())
        self.short = short
        self.least = min([window if len(w) >= window else len(w) for _, w in items if w], default=window)
        self.hashes, self.numbers = _hashed(list(self.words))

    def _extend(self, last: int, w: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q, own)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        own.append(set())
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q, own)
        return cur

    def _split(self, p: int, w: int, q: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        own.append(set())
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        link[q] = copy
        return copy

    def matches(self, words: list[int]):
        """(end, length, items) of what a run of known words matches, windows and short items."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = have = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                have = length[state]
            state = nxt[state].get(w, 0)
            have = have + 1 if state else 0
            v = state
            if have >= window:
                while length[link[v]] >= window:
                    v = link[v]
                yield i + 1, have, self.items[v]
            for n, number in self.short[state]:
                if n <= have:
                    yield i + 1, n, (number,)


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words, as the documents' words are hashed, and each one's number."""
    data = [w.encode() for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    h = Words(np.frombuffer(b"".join(data), np.uint8), offsets, NON_ALNUM, True).hashes
    order = np.argsort(h)
    return h[order], order.astype(np.int32)


def _runs(a: Automaton, w: Words) -> list[tuple[int, int, list[int]]]:
    """Stretches (start, end, word numbers) of words that the automaton knows, each within one row, long enough to match."""
    if not len(a.hashes) or not len(w):
        return []
    at = np.minimum(np.searchsorted(a.hashes, w.hashes), len(a.hashes) - 1)
    known = a.hashes[at] == w.hashes
    edge = np.zeros(len(w) + 1, bool)
    edge[w.first] = True
    opens, closes = known.copy(), known.copy()
    opens[1:] &= ~known[:-1] | edge[1:-1]
    closes[:-1] &= ~known[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = ends - starts >= a.least
    return [(s, e, a.numbers[at[s:e]].tolist()) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]


def _stream(box):
    kinds = {"n_words": pa.int64(), "begins": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "items": pa.list_(pa.string())}

    def run(batches):
        a: Automaton = box.value
        for b in batches:
            before = [b.column(c).to_pylist() for c in ("begins", "ends", "items")] if "begins" in b.schema.names else None
            out: list[list] = [[], [], [], []]
            for i, j, data, offsets in pieces(b.column("text")):
                w = Words(data, offsets, NON_ALNUM, True)
                hits: dict[int, list] = {}
                for s, e, numbers in _runs(a, w):
                    r = int(np.searchsorted(w.first, s, "right")) - 1
                    own = hits.setdefault(r, [[], [], set()])
                    for stop, n, found in a.matches(numbers):
                        own[0].append(s + stop - n - w.first[r])
                        own[1].append(s + stop - w.first[r])
                        own[2].update(a.names[k] for k in found)
                for r in range(j - i):
                    n = int(w.counts[r])
                    begins, ends, items = hits.get(r, ([], [], set()))
                    if before:
                        begins, ends, items = begins + before[0][i + r], ends + before[1][i + r], list(items) + before[2][i + r]
                    if begins:
                        hit = np.zeros(n + 1, np.int32)
                        np.add.at(hit, begins, 1)
                        np.add.at(hit, ends, -1)
                        x = np.diff(np.cumsum(hit) > 0, prepend=False).nonzero()[0]
                        begins, ends = x[::2], x[1::2]
                    for o, v in zip(out, (n, begins, ends, sorted(items)), strict=True):
                        o.append(v)
            keep = [c for c in b.schema.names if c not in kinds]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(v, t) for v, t in zip(out, kinds.values(), strict=True)], keep + list(kinds))

    return run


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 50_000, text: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, extra columns, n_words, begins, ends, items; with text: text too), one for each row of docs.

    begins and ends are word positions (end exclusive) of the stretches inside occurrences of
    a window; items are the ids, as sorted strings, of the items with an occurring window.
    Null and empty texts have no words; items without words match nothing, equal items each
    count, an item without id is named "null". Rows with equal doc_id stay apart. An empty
    table of items finds nothing.
    """
    sized = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = sized.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = int(total // (5 * block_words)) + 1
    found = docs.select("doc_id", *extra, "text")
    for n in range(blocks):
        block = sized if blocks == 1 else sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        own = [(r.item_id, words_of(r.text)) for r in block.orderBy("item_id", "text").toLocalIterator()]
        box = docs.sparkSession.sparkContext.broadcast(Automaton(own, window))
        kinds = {f.name: f.dataType.simpleString() for f in found.schema} | {"n_words": "long", "begins": "array<long>", "ends": "array<long>", "items": "array<string>"}
        found = found.mapInArrow(_stream(box), ", ".join(f"{k} {v}" for k, v in kinds.items()))
        if n + 1 < blocks:
            found = materialise(found, "matched")
    return found if text else found.drop("text")


def _remove(batches):
    for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
        out = []
        for text, begins, ends in zip(b.column("text").to_pylist(), b.column("begins").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if begins:
                at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
                last, kept = 0, []
                for s, e in zip(begins, ends, strict=True):
                    kept.append(text[last : at[s][0]])
                    last = at[e - 1][1]
                text = "".join([*kept, text[last:]])
            out.append(text)
        names = b.schema.names
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names], names)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.8, extra: tuple[str, ...] = (), block_words: int = 50_000) -> DataFrame:
    """docs' rows (doc_id, extra, text) without the stretches that match test items.

    A stretch goes if it is as long as a window (or a whole shorter item); a document goes
    whole if more than max_coverage of its words would. Others keep their text to the letter.
    """
    found = find_contamination(docs, items, window, block_words, True, extra)
    hit = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    left = found.filter(hit <= F.col("n_words") * F.lit(max_coverage)).select("doc_id", *extra, "text", "begins", "ends")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.schema)
    return left.mapInArrow(_remove, kinds).drop("begins", "ends")
