"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, and how often.

Byte offsets where tokens of both end cut a text into groups of A ids and B ids. A corpus has
many groups but far fewer different ones: those of a slice of texts get numbers of their own,
a dictionary over all slices interns them by their ids, the links of a group (its A and B
tokens whose bytes overlap) are expanded once for each different group and multiplied by its
frequency, and what follows for a group goes back to the slices by the group's key.

Neither tokenizer has a token across a blank that follows something else (the vocabulary of
B is looked through for that), so texts are cut there into chunks, and each worker hands the
libraries those chunks that it doesn't remember. Results don't depend on the memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm._common import MEASURED, materialise, meet, scope, tokenizer_path
from routeloom.llm._words import pieces

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: What a sentence piece has for a blank.
_BLANK = "▁"
#: First byte, and least and greatest second byte, of all white space beyond ASCII, and of more: after these, a blank is no place to cut.
_WIDE = ((0xC2, 0x80, 0xA0), (0xE1, 0x9A, 0x9A), (0xE2, 0x80, 0x81), (0xE3, 0x80, 0x80))


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The two tokenizers, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _bytes_of_letters()
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace(_BLANK, " ").encode())
        #: Whether blanks that follow something else part the tokens of B.
        self.parted = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A ids and B ids of chunks that begin with a blank (B adds it, so it gets the rest, but adds none to nothing)."""
        a = [x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return a, [ids if c != " " else [self.b.piece_to_id(_BLANK)] for c, ids in zip(chunks, b, strict=True)]


@lru_cache(2)
def vocabulary(a_path: str, b_path: str) -> Vocabulary:
    """One for each worker process and pair of files."""
    return Vocabulary(a_path, b_path)


class Aligner:
    """Maps chunks to the groups of their tokens; forgets all when it has remembered `limit` chunks."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 300_000):
        self.v, self.limit = vocabulary, limit
        self._clear()

    def _clear(self) -> None:
        self.names = pa.array([], pa.binary())
        # of chunks: number of groups (-1: bytes differ), A and B tokens, and the groups' numbers one after another
        self.sizes, self.n_a, self.n_b, self.groups = (np.zeros(0, np.int64) for _ in range(4))
        self.keys: list[str] = []
        self.number: dict[str, int] = {}

    def _learn(self, names: pa.Array) -> None:
        v, raw = self.v, names.to_pylist()
        a, b = v.encode([x.decode() for x in raw])
        sizes, groups = np.zeros(len(raw), np.int64), []
        for i, (x, p, q) in enumerate(zip(raw, a, b, strict=True)):
            if b"".join([v.a_bytes[t] for t in p]) != x or b"".join([v.b_bytes[t] for t in q]) != x:
                sizes[i] = -1
                continue
            own = cut(p, q, v)
            sizes[i] = len(own)
            for key in own:
                n = self.number.setdefault(key, len(self.keys))
                if n == len(self.keys):
                    self.keys.append(key)
                groups.append(n)
        self.names = pa.concat_arrays([self.names, names])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.n_a = np.concatenate([self.n_a, np.fromiter(map(len, a), np.int64, len(a))])
        self.n_b = np.concatenate([self.n_b, np.fromiter(map(len, b), np.int64, len(b))])
        self.groups = np.concatenate([self.groups, np.array(groups, np.int64)])

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts' bytes: whether each has tokens, A tokens, B tokens, groups, and the numbers of all their groups in order."""
        if len(self.names) > self.limit:
            self._clear()
        rows = len(offsets) - 1
        lengths = np.diff(offsets)
        # a blank before each text
        spaced = np.insert(data, offsets[:-1], 0x20)
        begin = offsets[:-1] + np.arange(rows)
        starts = _cuts(spaced, begin) if self.v.parted else begin
        row = np.searchsorted(begin, starts, "right") - 1
        some = lengths[row] > 0
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(spaced)).astype(np.int32)), pa.py_buffer(spaced)])
        parts, row = parts.filter(pa.array(some)).dictionary_encode(), row[some]
        which, names = parts.indices.to_numpy(), parts.dictionary
        found = pc.index_in(names, self.names)
        if found.null_count:
            before = len(self.names)
            self._learn(names.filter(found.is_null()))
            learnt = pc.add(pc.index_in(names, self.names.slice(before)), pa.scalar(before, pa.int32()))
            found = pc.coalesce(found, learnt)
        at = found.to_numpy(zero_copy_only=False)[which]
        bad = np.bincount(row[self.sizes[at] < 0], minlength=rows) > 0
        good = (lengths > 0) & ~bad
        at, row = at[good[row]], row[good[row]]
        n_a, n_b, n_groups = (np.bincount(row, x[at], rows).astype(np.int64) for x in (self.n_a, self.n_b, np.maximum(self.sizes, 0)))
        own = np.maximum(self.sizes, 0)
        firsts, n = np.cumsum(own) - own, own[at]
        total = int(n.sum())
        groups = self.groups[np.repeat(firsts[at] - (np.cumsum(n) - n), n) + np.arange(total)]
        return good, n_a, n_b, n_groups, groups


def _cuts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where chunks start: at rows, and at blanks that follow no white space."""
    blank = data == 0x20
    solid = data > 0x20
    for lead, low, high in _WIDE:
        at = np.flatnonzero(data[:-1] == lead)
        at = at[(data[at + 1] >= low) & (data[at + 1] <= high)]
        for k in (1, 2):
            solid[np.minimum(at + k, len(data) - 1)] = False
    start = np.zeros(len(data), bool)
    start[1:] = blank[1:] & solid[:-1]
    start[rows] = True
    return np.flatnonzero(start)


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, as vocabulary()."""
    return Aligner(vocabulary(a_path, b_path))


def cut(a: list[int], b: list[int], v: Vocabulary) -> list[str]:
    """The groups of two encodings of the same bytes, as decimal ids: A's, a bar, B's."""
    if len(a) == len(b) == 1:
        return [f"{a[0]}|{b[0]}"]
    out, i, j, left = [], 0, 0, 0
    begin = (0, 0)
    while i < len(a) or j < len(b):
        # left: by how many bytes A is ahead
        if left <= 0 and i < len(a):
            left += len(v.a_bytes[a[i]])
            i += 1
        else:
            left -= len(v.b_bytes[b[j]])
            j += 1
        if left == 0 and j > begin[1]:
            out.append(",".join(map(str, a[begin[0] : i])) + "|" + ",".join(map(str, b[begin[1] : j])))
            begin = (i, j)
    return out


def links_of(key: str, v: Vocabulary) -> dict[tuple[int, int], int]:
    """How often each pair of an A id and a B id is linked in a group: from the end of a token on, of either, the next pair overlaps."""
    a, b = ([int(t) for t in x.split(",")] for x in key.split("|"))
    out: dict[tuple[int, int], int] = {}
    i, j, p, q = 0, 0, len(v.a_bytes[a[0]]), len(v.b_bytes[b[0]])
    while True:
        pair = a[i], b[j]
        out[pair] = out.get(pair, 0) + 1
        if p == q:
            # the end of the group
            return out
        if p < q:
            i += 1
            p += len(v.a_bytes[a[i]])
        else:
            j += 1
            q += len(v.b_bytes[b[j]])


def _links(a_path: str, b_path: str):
    """Rows (key, freq, a, b, times) of the links of groups (key, freq)."""

    def run(batches):
        v = vocabulary(a_path, b_path)
        for batch in batches:
            at, rows = [], []
            for n, key in enumerate(batch.column("key").to_pylist()):
                for (a, b), times in links_of(key, v).items():
                    at.append(n)
                    rows.append((a, b, times))
            if rows:
                place = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(place) for c in ("key", "freq")), *(pa.array(x) for x in np.array(rows, np.int64).T)], ["key", "freq", "a", "b", "times"])

    return run


def _slices(a_path: str, b_path: str, target: int):
    """A row (slice, docs, which, times, keys, freqs, holders) for each stretch of texts.

    docs has a struct for each text, with the number of its different groups; which and times
    list those, one text after another, as 32-bit numbers of a place in keys and how often.
    """

    def run(batches):
        from pyspark import TaskContext

        own_aligner, slices = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, data, offsets in pieces(batch.column("text"), target):
                good, n_a, n_b, n_groups, groups = own_aligner.slice(data, offsets)
                first = np.cumsum(n_groups) - n_groups
                here = np.zeros(len(own_aligner.keys), np.int64)
                here[groups] = 1
                names, local = np.flatnonzero(here), (np.cumsum(here) - 1)[groups]
                keys = pa.array([own_aligner.keys[k] for k in names], pa.string())
                hashes = _digests(keys, local, first, n_groups, good)
                # the different groups of each text
                pairs, times = np.unique(np.repeat(np.arange(j - i), n_groups) * max(1, len(names)) + local, return_counts=True)
                own, which = np.divmod(pairs, max(1, len(names)))
                different = np.bincount(own, minlength=j - i)
                freqs, holders = np.bincount(local, minlength=len(names)), np.bincount(which, minlength=len(names))
                docs = pa.StructArray.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), *(pa.array(x) for x in (n_a, n_b, n_groups)), pa.array(hashes), pa.array(different.astype(np.int32))], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "different"]
                )
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in (docs, keys, freqs.astype(np.int64), holders.astype(np.int64))]
                packed = [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (which, times)]
                yield pa.RecordBatch.from_arrays([pa.array([slices]), lists[0], *packed, *lists[1:]], ["slice", "docs", "which", "times", "keys", "freqs", "holders"])
                slices += 1
        pa.default_memory_pool().release_unused()

    return run


def _digests(keys: pa.Array, local: np.ndarray, first: np.ndarray, n_groups: np.ndarray, good: np.ndarray, most: int = 1 << 20) -> list[str]:
    """Hex SHA-256 of each text's groups joined by semicolons; '' for texts without tokens."""
    ended = pc.binary_join_element_wise(keys, pa.scalar(""), ";")
    out = []
    for begin, n, some in zip(first.tolist(), n_groups.tolist(), good.tolist(), strict=True):
        if not some:
            out.append("")
            continue
        h, end = hashlib.sha256(), begin + n
        for at in range(begin, end, most):
            stop = min(end, at + most)
            own = ended.take(pa.array(local[at:stop]))
            _, offsets, data = own.buffers()
            ends = np.frombuffer(offsets, np.int32)
            h.update(memoryview(data)[ends[0] : ends[len(own)] - (stop == end)])
        out.append(h.hexdigest())
    return out


def _summed(doc: str):
    """Rows of documents from their slice and what is known of its groups, rows (docs, which, times, found) with found (place, best, total)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs, found = batch.column("docs")[row].values, batch.column("found")[row].values
                which, times = (np.frombuffer(batch.column(c)[row].as_buffer(), "<i4") for c in ("which", "times"))
                ends = np.cumsum(docs.field("different").to_numpy(), dtype=np.int64)
                sums = []
                for c in ("best", "total"):
                    value = np.zeros(0 if found is None else len(found), np.int64)
                    if len(value):
                        value[found.field("place").to_numpy()] = found.field(c).to_numpy()
                    upto = np.concatenate([[0], np.cumsum(value[which] * times)])
                    sums.append(pa.array(upto[ends] - upto[np.concatenate([[0], ends[:-1]])]))
                n_a, n_b, n_groups = (docs.field(c) for c in ("n_a", "n_b", "n_groups"))
                # in a group, each end of a token but the last parts two links
                links = pc.subtract(pc.add(n_a, n_b), n_groups)
                yield pa.RecordBatch.from_arrays([docs.field("doc_id"), n_a, n_b, n_groups, links, *sums, docs.field("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run, f"doc_id {doc}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Alignment:
    """What alignment finds in a corpus.

    slices: see _slices; groups (key, freq): the different groups, and what their links are
    multiplied by; expanded (key, freq, a, b, times): the links of each; links (a, b, count,
    best): the pairs of ids, and whether count is the highest of its B id.
    """

    slices: DataFrame
    groups: DataFrame
    expanded: DataFrame
    links: DataFrame
    doc_type: str

    def documents(self) -> DataFrame:
        """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each row of the corpus."""
        with scope(self.slices.sparkSession, MEASURED | _SINGLY):
            best = F.when(F.col("best"), F.col("times")).otherwise(0)
            known = meet(self.expanded.drop("freq"), self.links, ["a", "b"], "key").groupBy("key").agg(F.sum(best).alias("best"), F.sum(F.col("times") * F.col("count")).alias("total"))
            places = self.slices.select("slice", F.posexplode("keys").alias("place", "key"))
            back = meet(places, known, ["key"], "slice").groupBy("slice").agg(F.collect_list(F.struct("place", "best", "total")).alias("found"))
            run, schema = _summed(self.doc_type)
            both = self.slices.select("slice", "docs", "which", "times").join(back, "slice", "left").select("docs", "which", "times", "found")
            return materialise(both.mapInArrow(run, schema), "aligned", keep=True)


#: Slices are large rows: one at a time goes to Python.
_SINGLY = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}


def align(docs: DataFrame, multiply: str = "frequency", a: str = A_FILE, b: str = B_FILE, target: int = 1 << 22) -> Alignment:
    """The alignment of all texts of docs by two tokenizers, one over the bytes of a blank and the text, one of pieces that adds the blank.

    A link is a pair of an A token and a B token whose bytes overlap. multiply says what the
    links of a group count for: its "frequency", or the number of "documents" that have it.
    Texts that are null or empty, or that the ids of one tokenizer don't give back to the byte,
    have no tokens. Rows with equal doc_id stay apart; other columns aren't looked at; no rows
    give no rows. target is the size in bytes of the slices in which texts are dealt with; a
    longer text is a slice of its own.
    """
    if multiply not in ("frequency", "documents"):
        raise ValueError("multiply must be frequency or documents")
    doc = docs.schema["doc_id"].dataType.simpleString()
    paths = tokenizer_path(a), tokenizer_path(b)
    shape = f"slice long, docs array<struct<doc_id:{doc},n_a:long,n_b:long,n_groups:long,groups_sha256:string,different:int>>, which binary, times binary, keys array<string>, freqs array<long>, holders array<long>"
    with scope(docs.sparkSession, MEASURED):
        # rows of Python's batches end a slice
        slices = materialise(docs.select("doc_id", "text").mapInArrow(_slices(*paths, target), shape), "slices", keep=True)
        each = slices.select(F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("freqs" if multiply == "frequency" else "holders").alias("n"))))
        groups = materialise(each.groupBy("key").agg(F.sum("n").alias("freq")), "groups", keep=True)
        own = materialise(groups.mapInArrow(_links(*paths), "key string, freq long, a long, b long, times long"), "group-links", keep=True)
        counts = own.groupBy("a", "b").agg(F.sum(F.col("freq") * F.col("times")).alias("count"))
        # a B id has as many A ids at most as A's vocabulary
        links = materialise(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b"))), "links", keep=True)
    return Alignment(slices, groups, own, links, doc)
