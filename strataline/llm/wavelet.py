"""Token files: one wavelet matrix per shard, with access, counting and occurrence lookup on the packed bit-planes."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .encode import encoder, text_runs

#: A shard is closed when it holds this many ids or more; documents are not divided.
SHARD_IDS = 1 << 18
#: Bits between two stored counts of ones.
BLOCK = 512


class WaveletMatrix:
    """A sequence of ids as bit-planes, highest bit first; each plane orders its ids by the planes above, zeros before ones.

    ``planes`` are packed bits, ``zeros`` the zeros per plane, ``ranks`` the
    ones before every ``BLOCK`` bits. ``access``, ``rank`` and ``select`` read
    one block per plane.
    """

    def __init__(self, n: int, bits: int, planes: np.ndarray, zeros: np.ndarray, ranks: np.ndarray):
        self.n, self.bits, self.planes, self.zeros, self.ranks = n, bits, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        if n and int(ids.max()) >> bits:
            raise ValueError(f"an id needs more than {bits} bits")
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        width = -(-n // BLOCK) * BLOCK // 8
        planes, zeros, ranks = np.zeros((bits, width), np.uint8), np.zeros(bits, np.int64), np.zeros((bits, width * 8 // BLOCK), np.uint32)
        for level in range(bits):
            bit = (now >> now.dtype.type(bits - 1 - level)).astype(np.uint8)
            bit &= 1
            bit = bit.view(bool)
            packed = np.packbits(bit)
            planes[level, :len(packed)] = packed
            ones = np.bitwise_count(planes[level]).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            ranks[level] = np.cumsum(ones, dtype=np.uint32) - ones
            zeros[level] = n - int(ones.sum())
            now = np.concatenate([np.compress(~bit, now), np.compress(bit, now)])  # several times as fast as indexing with bits
        return cls(n, bits, planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        return b"".join([np.array([self.n, self.bits], "<u8").tobytes(), self.zeros.astype("<i8").tobytes(), self.ranks.astype("<u4").tobytes(), self.planes.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        n, bits = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        blocks = -(-n // BLOCK)
        at = 16 + 8 * bits
        zeros = np.frombuffer(raw, "<i8", bits, 16)
        ranks = np.frombuffer(raw, "<u4", bits * blocks, at).reshape(bits, blocks)
        planes = np.frombuffer(raw, np.uint8, bits * blocks * BLOCK // 8, at + 4 * bits * blocks).reshape(bits, -1)
        return cls(n, bits, planes, zeros, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        if block == self.ranks.shape[1]:
            return self.n - int(self.zeros[level])
        bits = np.unpackbits(self.planes[level, block * BLOCK // 8:(block * BLOCK + rest + 7) // 8])
        return int(self.ranks[level, block]) + int(bits[:rest].sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level, i >> 3]) >> 7 - (i & 7) & 1

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            value = value << 1 | bit
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, value: int, begin: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            b, e = self._ones(level, begin), self._ones(level, end)
            if value >> self.bits - 1 - level & 1:
                begin, end = int(self.zeros[level]) + b, int(self.zeros[level]) + e
            else:
                begin, end = begin - b, end - e
        return begin, end

    def count(self, value: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id occurs in positions begin to end."""
        b, e = self._range(value, begin, self.n if end is None else end)
        return e - b

    def select(self, value: int, k: int) -> int:
        """The position of the k-th occurrence (from 0) of an id; -1 if there is none."""
        begin, end = self._range(value, 0, self.n)
        if k >= end - begin:
            return -1
        i = begin + k
        for level in reversed(range(self.bits)):
            bit = value >> self.bits - 1 - level & 1
            i = self._find(level, i - int(self.zeros[level]) if bit else i, bit)
        return i

    def _find(self, level: int, k: int, bit: int) -> int:
        """The position of the k-th bit of this value in a plane."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level, block * BLOCK // 8:(block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def all(self) -> np.ndarray:
        """All ids in order, rebuilt from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            now[int(self.zeros[level]):] |= kind(1 << self.bits - 1 - level)
            up = np.empty(self.n, kind)
            up[np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])] = now
            now = up
        return now


SHARDS = "part int, shard int, start long, n_ids long, doc_ids array<long>, doc_ids_count array<long>, matrix binary"
_SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                     ("doc_ids_count", pa.list_(pa.int64())), ("matrix", pa.binary())])


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, vocabulary: int = 50_257, shard_ids: int = SHARD_IDS) -> None:
    """Encode all documents, in ascending doc_id order, into wavelet-matrix shards under ``path``.

    Texts are dealt to ranges of doc_id and sorted there, before they are
    encoded, so that encoding happens once. A task streams its documents and
    holds one shard at a time; ``start`` counts ids inside the task's range.
    ``part`` rises with the ranges. A null or empty text is the end id alone;
    rows without a doc_id come first; rows that repeat one stand side by side,
    in an order that depends on their text alone.
    """
    bits = max(1, int(vocabulary - 1).bit_length())
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        shard, start, held, names, raw = 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal shard, start, held, names, raw
            ids = np.frombuffer(b"".join(raw), "<u4")
            row = [part, shard, start, len(ids), names, [len(r) // 4 for r in raw], WaveletMatrix.build(ids, bits).to_bytes()]
            shard, start, held, names, raw = shard + 1, start + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SHARDS)], schema=_SHARDS)

        for ids, texts in text_runs(batches):
            for doc, got in zip(ids, enc.encode(texts)):
                names.append(doc)
                raw.append(got + end)
                held += len(raw[-1]) // 4
                if held >= shard_ids:
                    yield close()
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id"))
    rows = rows.sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    rows.select("doc_id", "text").mapInArrow(work, SHARDS).write.option("compression", "snappy").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """Per document in the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read back from the bit-planes.

    Range totals are one row per writing task; their running sum is the only
    unpartitioned window.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    ranges = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start"))

    kinds = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                part, start, names, counts, matrix = (b.column(k)[row].as_py() for k in range(5))
                raw = WaveletMatrix.from_bytes(matrix).all().astype("<u4").tobytes()
                ends = np.cumsum(counts)
                begins = ends - counts
                crc = [zlib.crc32(raw[4 * i:4 * j]) for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(begins + start), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], schema=kinds)

    rows = shards.select("part", "start", "doc_ids", "doc_ids_count", "matrix").mapInArrow(work, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(ranges, "part").select("doc_id", (F.col("start") + F.col("range_start")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the shards (into the shared folder if no path is given) and read the documents back."""
    spark = docs.sparkSession
    path = path or os.path.join(shared_folder(spark), "token-shards", uuid.uuid4().hex)
    write_token_shards(docs, path, tokenizer, **options)
    return read_documents(spark, path)
