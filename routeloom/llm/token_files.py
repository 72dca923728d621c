"""Token-id files coded with a static range asymmetric numeral system.

A table of frequencies, scaled to 2**SCALE and shared by all blocks, comes from counts over
every document. Documents, in ascending order of doc_id, fill blocks of about block_tokens
ids; a block holds whole documents and can be decoded by itself. Within a block the ids are
dealt over `lanes` interleaved coder states, and every `every` rows of lanes a checkpoint
holds the states, the place in the stream and a checksum of the ids up to the next one, so
that parts of a block can be decoded alone too. Another checksum covers the payload.

On storage, the files are two Parquet datasets, which every Spark store can hold: `table`
(id, frequency) and `blocks` (first id's place, the documents' ids and lengths, payload).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import materialise, scope, tokenizer_path
from routeloom.llm._tokens import binary, encoded

SCALE = 20
_LOW = np.uint64(1 << 31)
_32, _SCALE, _MASK = np.uint64(32), np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
_HEAD = "<4sIIIII"  # magic, ids, lanes, rows between checkpoints, words, checksum of the rest
_MARK = "<II"  # place in the stream, checksum of the ids up to the next checkpoint; states follow
_MAGIC = b"RLa2"


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 where there is a count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint64)
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * (1 << SCALE) / total), 0).astype(np.int64)
    over = int(f.sum()) - (1 << SCALE)
    while over:  # the largest ones take the difference
        k = int(f.argmax())
        step = min(over, f[k] - max(1, f[k] // 2)) if over > 0 else over
        if over > 0 and step <= 0:
            raise ValueError("more ids than the scale has room for")
        f[k] -= step
        over -= step
    return f.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks with one table of frequencies."""

    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(self.f)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int = 4096, every: int = 128) -> bytes:
        n = len(ids)
        lanes = max(1, min(lanes, n))
        rows = -(-n // lanes)
        padded = np.full(rows * lanes, ids[0] if n else 0, np.int64)
        padded[:n] = ids
        grid = padded.reshape(rows, lanes)
        x = np.full(lanes, _LOW, np.uint64)
        out, marks, words = [], [], 0
        for t in range(rows - 1, -1, -1):
            f, c = self.f[grid[t]], self.c[grid[t]]
            full = x >= ((_LOW >> _SCALE) << _32) * f
            if full.any():
                out.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                words += len(out[-1])
                x[full] >>= _32
            q = x // f
            x = (q << _SCALE) + (x - q * f) + c
            if t % every == 0:
                marks.append((words, x.copy()))
        stream = np.concatenate(out[::-1]).tobytes() if out else b""
        raw, each = memoryview(ids.astype("<u4").tobytes()), 4 * every * lanes
        body = b"".join(struct.pack(_MARK, words - at, zlib.crc32(raw[k * each : (k + 1) * each])) + states.astype("<u8").tobytes() for k, (at, states) in enumerate(reversed(marks))) + stream
        return struct.pack(_HEAD, _MAGIC, n, lanes, every, words, zlib.crc32(body)) + body

    def decode(self, payload: bytes, first_mark: int = 0, end_mark: int | None = None) -> np.ndarray:
        """The ids from one checkpoint to another; all of them unless told."""
        size = struct.calcsize(_HEAD)
        magic, n, lanes, every, words, body_sum = struct.unpack(_HEAD, payload[:size])
        body = memoryview(payload)[size:]
        if magic != _MAGIC or zlib.crc32(body) != body_sum:
            raise ValueError("a block is damaged")
        rows = -(-n // lanes)
        marks = -(-rows // every)
        head = struct.calcsize(_MARK)
        each = head + 8 * lanes
        stream = np.frombuffer(body, "<u4", words, marks * each)
        end_mark = marks if end_mark is None else min(end_mark, marks)
        t0, t1 = first_mark * every, min(rows, end_mark * every)
        if t0 >= t1:
            return np.zeros(0, np.uint32)
        at = struct.unpack_from(_MARK, body, first_mark * each)[0]
        x = np.frombuffer(body, "<u8", lanes, first_mark * each + head).astype(np.uint64)
        out = np.empty((t1 - t0, lanes), np.uint32)
        for t in range(t1 - t0):
            slot = x & _MASK
            s = self.symbol[slot]
            out[t] = s
            x = self.f[s] * (x >> _SCALE) + slot - self.c[s]
            low = x < _LOW
            k = int(np.count_nonzero(low))
            if k:
                x[low] = (x[low] << _32) | stream[at : at + k]
                at += k
        ids = out.reshape(-1)[: n - t0 * lanes]
        raw, step = memoryview(ids.astype("<u4").tobytes()), 4 * every * lanes
        for k in range(first_mark, end_mark):
            if zlib.crc32(raw[(k - first_mark) * step : (k - first_mark + 1) * step]) != struct.unpack_from(_MARK, body, k * each)[1]:
                raise ValueError("a block's ids don't match their checksum")
        return ids

    def section(self, payload: bytes) -> int:
        """How many ids lie between two checkpoints of a block."""
        _, _, lanes, every, _, _ = struct.unpack(_HEAD, payload[: struct.calcsize(_HEAD)])
        return lanes * every


_TOKENS = ["doc_id", "part", "start", "n", "ids", "counts"]


def _tokenise(path: str, end_id: int):
    """A row for each document, and a last one with the partition's counts of every id."""

    def run(batches):
        part, start, kind = TaskContext.get().partitionId(), 0, None
        counts = np.zeros(1 << 16, np.int64)
        for b, ids, n in encoded(batches, path, end_id):
            counts += np.bincount(ids, minlength=1 << 16)
            ends = start + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n), pa.array(n), binary(ids.astype("<u2"), n), pa.nulls(len(n), pa.list_(pa.int64()))], _TOKENS)
            start, kind = int(ends[-1]), b.column("doc_id").type
        if start:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([part]), pa.array([0]), pa.array([start]), pa.nulls(1, pa.binary()), pa.array([counts], pa.list_(pa.int64()))], _TOKENS)

    return run


def _sum(batches):
    """One row with the sum of the partition's arrays of counts."""
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        total += b.column("counts").flatten().to_numpy().reshape(-1, 1 << 16).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["counts"])


def _total(sums: DataFrame, arrays: int, fan_in: int = 64) -> np.ndarray:
    """Sum of arrays of counts, in turns in which a task adds about fan_in of them."""
    sums = sums.select("counts")
    while arrays > 1:
        arrays = -(-arrays // fan_in)
        sums = sums.repartition(arrays).mapInArrow(_sum, "counts array<long>")
    row = sums.first()
    return np.array(row[0] if row else np.zeros(1 << 16), np.int64)


def _encode(box, doc_type: pa.DataType, block_tokens: int):
    def block(coder, start, docs, ids):
        lengths = [len(x) // 2 for x in ids]
        payload = coder.encode(np.frombuffer(b"".join(ids), "<u2"))
        return pa.RecordBatch.from_arrays([pa.array([start]), pa.array([docs], pa.list_(doc_type)), pa.array([lengths], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["start", "doc_ids", "lengths", "payload"])

    def run(batches):
        frequencies, bases = box.value
        coder = Coder(frequencies)
        first, after, docs, ids = 0, -1, [], []
        for b in batches:
            starts = b.column("start").to_numpy() + np.array([bases[p] for p in b.column("part").to_pylist()], np.int64)
            for s, d, n, x in zip(starts.tolist(), b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if ids and (s != after or s + n - first > block_tokens):
                    yield block(coder, first, docs, ids)
                    docs, ids = [], []
                if not ids:
                    first = s
                docs.append(d)
                ids.append(x)
                after = s + n
        if ids:
            yield block(coder, first, docs, ids)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, block_tokens: int = 1 << 20, part_bytes: int = 1 << 26) -> None:
    """Writes the ids of every text (null counts as empty), each followed by end_id, to path.

    Documents are in ascending order of doc_id, null first, equal ones in the order of their
    texts. A document over block_tokens has a block of its own. Texts are dealt over so many tasks
    that one has about part_bytes. Other columns, whatever their names, aren't looked at.
    """
    spark = docs.sparkSession
    doc = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    with scope(spark):
        # blocks and starts rest on the order within partitions: both keys decide it, so a task run again gives the same
        ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
        tokens = materialise(ordered.mapInArrow(_tokenise(tokenizer_path(tokenizer), end_id), f"doc_id {doc}, part long, start long, n long, ids binary, counts array<long>"), "tokens")
        sums = tokens.filter("counts IS NOT NULL")
        sizes = sums.select("part", "n").orderBy("part").collect()  # one row for each partition
        frequencies = scaled(_total(sums, len(sizes)))
        ends = np.cumsum([r[1] for r in sizes]).tolist()
        bases = {r[0]: e - r[1] for r, e in zip(sizes, ends, strict=True)}
        tokens = tokens.filter("counts IS NULL").drop("counts")
        spark.createDataFrame([(int(i), int(frequencies[i])) for i in np.flatnonzero(frequencies)], "id int, frequency long").coalesce(1).write.parquet(f"{path}/table")
        kind = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
        box = spark.sparkContext.broadcast((frequencies, bases))
        tokens.mapInArrow(_encode(box, kind, block_tokens), f"start long, doc_ids array<{doc}>, lengths array<long>, payload binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _decode(box, first: int | None, last: int | None):
    def run(batches):
        coder = Coder(box.value)
        for b in batches:
            for k in range(b.num_rows):
                start, lengths, payload = b.column("start")[k].as_py(), b.column("lengths")[k].values.to_numpy(), b.column("payload")[k].as_py()
                ends = np.cumsum(lengths)
                i = 0 if first is None else int(np.searchsorted(ends, first - start, "right"))
                j = len(ends) if last is None else int(np.searchsorted(ends - lengths, last - start, "left"))
                if i >= j:
                    continue
                # from the checkpoint before the first document asked for to that after the last one
                each = coder.section(payload)
                mark = int(ends[i] - lengths[i]) // each
                ids = coder.decode(payload, mark, -(-int(ends[j - 1]) // each)).astype("<u4")
                lengths, ends = lengths[i:j], ends[i:j]
                own = ids[int(ends[0] - lengths[0]) - mark * each : int(ends[-1]) - mark * each]
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[k].values.slice(i, j - i), pa.array(start + ends - lengths), pa.array(lengths), binary(own, lengths)], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids), one for each document; ids are little-endian unsigned 32-bit numbers.

    With first and last, only documents that have an id at one of the places first to last - 1
    of all ids; of their blocks, only what lies between the checkpoints around them is decoded.
    """
    frequencies = np.zeros(1 << 16, np.uint64)
    for i, f in spark.read.parquet(f"{path}/table").collect():  # at most 2**16 rows
        frequencies[i] = f
    blocks = spark.read.parquet(f"{path}/blocks")
    doc = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    if last is not None:
        blocks = blocks.filter(F.col("start") < last)
    if first is not None:
        blocks = blocks.filter(F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x) > first)
    return blocks.mapInArrow(_decode(spark.sparkContext.broadcast(frequencies), first, last), f"doc_id {doc}, start long, n_tokens long, ids binary")
