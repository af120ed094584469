"""Packing documents into training sequences: sum-of-squares online packing in each partition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .encode import encoder, text_runs

#: Windows that a partition keeps open; a piece that would open one more is cut to close one.
OPEN_WINDOWS = 32


class Packer:
    """Windows of ``size`` tokens, filled online.

    A piece goes to the fill level that makes the sum of the squared counts of
    open windows per level smallest (sum-of-squares rule); ``count`` is that
    level array. Documents longer than a window are cut into full windows and
    one rest. When ``most`` windows are open and the rule asks for a new one,
    the piece is cut to close a window, by the same rule: the level whose
    closing lowers the sum most; what is left of the piece is put like any
    other. So memory is bounded, and at most ``most`` windows are open at the
    end. They are joined and cut into full windows, then one window per power
    of two of what is left, which needs no padding.
    """

    def __init__(self, size: int = 1024, most: int = OPEN_WINDOWS):
        self.size, self.most = size, most
        self.count = np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open, self.n_closed, self.by_rule = 0, 0, 0  # by_rule: tokens in windows that the rule has filled
        self.out: list[tuple] = []

    def _close(self, window: list) -> None:
        at = 0
        for doc, start, ids, total in window:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.n_closed, at, ids))
            at += n
        self.n_closed += 1

    def _level(self, n: int, new: bool = True) -> int:
        """The fill level for a piece of n tokens; 0 is a new window (or, without ``new``, no level). Of equal ones the fullest."""
        c, most = self.count, self.size
        best, at = 2 * int(c[n]) + 1 if new else np.iinfo(np.int64).max - 1, 0
        if most - n > 1:
            here = c[1:most - n]
            change = np.where(here > 0, 2 * (c[n + 1:most] - here) + 2, np.iinfo(np.int64).max)
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                best, at = int(change[k]), k + 1
        if c[most - n] and 1 - 2 * int(c[most - n]) <= best:
            at = most - n
        return at

    def _closable(self, n: int) -> int:
        """The level whose window a part of a piece of n tokens closes, with most windows on it; 0 if n is too small for all. Of equal ones the fullest."""
        c = self.count[self.size - n + 1:self.size][::-1]
        return self.size - 1 - int(np.argmax(c)) if len(c) and c.max() else 0

    def _put(self, piece: tuple, n: int) -> None:
        at, cut = self._level(n), 0
        if not at and self.n_open >= self.most:
            at = cut = self._closable(n)
            at = at or self._level(n, new=False)  # what closes no window fits into any
        rest = None
        if cut:
            doc, start, ids, total = piece
            n = self.size - cut
            piece, rest = (doc, start, ids[:4 * n], total), (doc, start + n, ids[4 * n:], total)
        if at:
            window = self.open[at].pop()
            self.count[at] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if at + n == self.size:
            self.by_rule += self.size
            self._close(window)
        else:
            self.open[at + n].append(window)
            self.count[at + n] += 1
            self.n_open += 1
        if rest:
            self._put(rest, len(rest[2]) // 4)

    def add(self, doc, ids: bytes) -> None:
        """One document with all its ids."""
        total, step = len(ids) // 4, 4 * self.size
        whole = total // self.size * step
        for b in range(0, whole, step):
            self._close([(doc, b // 4, ids[b:b + step], total)])
        if whole < len(ids):
            self._put((doc, whole // 4, ids[whole:], total), (len(ids) - whole) // 4)

    def finish(self) -> None:
        """Close what is open: full windows, then powers of two."""
        pieces = [p for level in self.open for window in level for p in window]
        rest = sum(len(p[2]) for p in pieces) // 4
        self.open = [[] for _ in range(self.size + 1)]
        self.count[:] = 0
        self.n_open = 0
        room = lambda: self.size if rest >= self.size else 1 << rest.bit_length() - 1
        window, free = [], room() if rest else 0
        for doc, start, ids, total in pieces:
            while ids:
                part = ids[:4 * free]
                window.append((doc, start, part, total))
                n = len(part) // 4
                ids, start, free, rest = ids[len(part):], start + n, free - n, rest - n
                if not free:
                    self._close(window)
                    window, free = [], room() if rest else 0

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens; one row per piece.

    A document is its ids and ``end_id``. Each id lies in exactly one piece, and
    the offsets of a sequence's pieces run on from 0. All sequences are full but
    for at most one per power of two below ``size`` and partition, which need no
    padding either. Rows are packed where they are read: nothing is shuffled,
    and a partition that is computed again gives the same sequences. The
    partition is in the upper bits of ``sequence_id``.

    A null or empty text is the end id alone. Rows that repeat a doc_id (or have
    none) are documents of their own. Other columns are not read. ``with_ids``
    adds the ids of each piece as ``ids`` (little-endian unsigned 32-bit). An
    empty table gives an empty table.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    names = schema.fieldNames()
    kinds = pa.schema([pa.field(n, pa.binary() if n == "ids" else pa.int64()) for n in names])

    def batch(rows: list[tuple], base: int) -> pa.RecordBatch:
        cols = list(zip(*rows))
        cols[5] = [base + s for s in cols[5]]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(cols[:len(names)])], schema=kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, base = encoder(tokenizer), Packer(size), TaskContext.get().partitionId() << 40
        for ids, texts in text_runs(batches):
            for doc, got in zip(ids, enc.encode(texts)):
                packer.add(doc, got + end)
            if packer.out:
                yield batch(packer.take(), base)
        packer.finish()
        if packer.out:
            yield batch(packer.take(), base)

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
