"""Hard negatives by a secondary-sort shuffle of (anchor, descending score, id) keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ball_tree import _matrix, _small, _valid, exact_product
from .common import settle

#: Vectors per shard and anchors per block: a task holds the scores of one such pair, 16 MB.
SHARD_ROWS, BLOCK_ANCHORS = 8_192, 256
_LONG = np.iinfo(np.int64)


def labelled(embeddings: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v) with v the components floor(scale * x), without rows that take no part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _valid(F.col("e")))
    return rows.select("vec_id", "label", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


_PACKED = "dim int, n int, ids binary, labels binary, kind string, rows binary"


def _packed(vectors: DataFrame, most: int) -> DataFrame:
    """Vectors of one length together in id order, up to ``most`` per row, gathered where they lie."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("rows", pa.binary())])

    def row(dim: int, parts: list) -> pa.RecordBatch:
        ids, labels, mat = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(ids, kind="stable")
        kind, raw = _small(mat[by])
        values = (dim, len(ids), ids[by].astype("<i8").tobytes(), labels[by].astype("<i8").tobytes(), kind, raw)
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            ids, labels, lists = np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2)
            sizes = np.asarray(lists.value_lengths())
            for dim in np.unique(sizes).tolist():
                mine, at = np.flatnonzero(sizes == dim), 0
                mat = _matrix(lists.take(pa.array(mine)), dim) if dim else np.zeros((len(mine), 0), np.int64)
                while at < len(mine):
                    parts = held.setdefault(dim, [])
                    have = sum(len(p[0]) for p in parts)
                    n = min(most - have, len(mine) - at)
                    parts.append((ids[mine[at:at + n]], labels[mine[at:at + n]], mat[at:at + n]))
                    at += n
                    if have + n == most:
                        yield row(dim, held.pop(dim))
        for dim in sorted(held):
            yield row(dim, held[dim])

    return vectors.select("vec_id", "label", "v").mapInArrow(work, _PACKED)


def _pairs(blocks: DataFrame, shards: DataFrame) -> DataFrame:
    """Each anchor block with each shard of its vector length, dealt by shard: a shard travels once, the (small) blocks go to all slots."""
    names = {c: f"a_{c}" for c in ("dim", "n", "ids", "labels", "kind", "rows")}
    slots = max(1, shards.count())
    placed = shards.withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(slots)).cast("int"))
    copies = blocks.withColumnsRenamed(names).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return copies.join(placed, "slot").filter(F.col("a_dim") == F.col("dim"))


def window(positive: np.ndarray | int, low: int = 30, high: int = 90):
    """The scores s with low * positive <= 100 * s <= high * positive, as (least, most), without products that pass 64 bits."""
    q, r = positive // 100, positive % 100
    return low * q - (-low * r) // 100, high * q + (high * r) // 100


def keys(anchors: np.ndarray, scores: np.ndarray, kind: int, ids: np.ndarray) -> np.ndarray:
    """Rows of 25 bytes whose order is (anchor, descending score, positives first, id); all numbers are 64-bit and signed."""
    out = np.empty((len(anchors), 25), np.uint8)
    flip = np.uint64(1 << 63)
    out[:, 0:8] = (anchors.astype(np.int64).view(np.uint64) ^ flip).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:16] = (~(scores.astype(np.int64).view(np.uint64) ^ flip)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 16] = kind
    out[:, 17:25] = (ids.astype(np.int64).view(np.uint64) ^ flip).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out


def unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, kind, id) of the rows that :func:`keys` made."""
    flip = np.uint64(1 << 63)
    word = lambda a, b: np.ascontiguousarray(raw[:, a:b]).view(">u8").reshape(-1).astype(np.uint64)
    return (word(0, 8) ^ flip).view(np.int64), (~word(8, 16) ^ flip).view(np.int64), raw[:, 16], (word(17, 25) ^ flip).view(np.int64)


def _key_batch(anchors, scores, kind: int, ids) -> pa.RecordBatch:
    anchors = np.asarray(anchors, np.int64)
    raw = keys(anchors, np.asarray(scores, np.int64), kind, np.asarray(ids, np.int64))
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(25), len(anchors), [None, pa.py_buffer(raw.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(anchors), fixed.cast(pa.binary())], ["anchor_id", "key"])


def _read(b: pa.RecordBatch, r: int, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: b.column(b.schema.get_field_index(prefix + c))[r].as_py()
    ids = np.frombuffer(get("ids"), "<i8")
    return ids, np.frombuffer(get("labels"), "<i8"), np.frombuffer(get("rows"), get("kind")).reshape(len(ids), get("dim"))


def _leading(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the first ones of equal scores."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        return np.concatenate([above, level[:k - len(above)]])
    return np.arange(len(scores))


def _positive_keys(pairs: DataFrame, k: int) -> DataFrame:
    """Keys of what can be a positive: per pair of block and shard and anchor the first k rows of its label."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (a_ids, a_labels, a), (ids, labels, x) = _read(b, r, "a_"), _read(b, r, "")
                product, out = exact_product(a, x), []
                for label in np.intersect1d(a_labels, labels).tolist():
                    mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
                    for i, scores in zip(mine.tolist(), product(a[mine], x[theirs])):
                        other = ids[theirs] != a_ids[i]
                        at, scores = theirs[other], scores[other]
                        best = _leading(scores, k)
                        out.append((np.full(len(best), a_ids[i]), scores[best], ids[at[best]]))
                if out:
                    yield _key_batch(*(np.concatenate(c) for c in list(zip(*out))[:2]), 0, np.concatenate([o[2] for o in out]))

    return pairs.mapInArrow(work, "anchor_id long, key binary")


def _negative_keys(pairs: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Keys of what can be a negative: per pair of block and shard and per positive window the first k rows of other labels in it.

    The first k of a window over all shards are among these, and whatever else
    stands between them is in range too, so windows may share their rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (a_ids, a_labels, a), (ids, labels, x) = _read(b, r, "a_"), _read(b, r, "")
                at = b.schema.get_field_index("windows")
                windows = b.column(at)[r].as_py()
                scores, out = exact_product(a, x)(a, x), []
                for i, found in enumerate(windows):
                    positives = sorted({p for p in found if p >= 0})  # the window of a negative score is empty
                    if not positives:
                        continue
                    row = scores[i]
                    lows, highs = window(np.array(positives, np.int64), low, high)
                    able = np.flatnonzero((row >= lows.min()) & (row <= highs.max()) & (labels != a_labels[i]) & (ids != a_ids[i]))
                    if not len(able):
                        continue
                    down = able[np.argsort(-row[able], kind="stable")]
                    falling = -row[down]
                    first, last = np.searchsorted(falling, -highs, "left"), np.searchsorted(falling, -lows, "right")
                    wanted = np.unique(np.concatenate([np.arange(f, min(f + k, e)) for f, e in zip(first, np.maximum(first, last))]))
                    if len(wanted):
                        best = down[wanted.astype(np.int64)]
                        out.append((np.full(len(best), a_ids[i]), row[best], ids[best]))
                if out:
                    yield _key_batch(*(np.concatenate(c) for c in list(zip(*out))[:2]), 1, np.concatenate([o[2] for o in out]))

    return pairs.mapInArrow(work, "anchor_id long, key binary")


def _in_order(keys_of: DataFrame) -> DataFrame:
    """The secondary sort: an anchor's keys in one partition, each partition sorted by the packed key."""
    return keys_of.repartition("anchor_id").sortWithinPartitions("key").select("key")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        if b.num_rows:
            c = b.column(0)
            raw = np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, 25)
            yield unpacked(raw)


_POSITIVES = "anchor_id long, place int, positive_id long, positive_score long"


def _first_positives(sorted_keys: DataFrame, k: int) -> DataFrame:
    """The first k keys of every anchor, read as they pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for anchors, scores, _, ids in _stream(batches):
            out = []
            for a, s, i in zip(anchors.tolist(), scores.tolist(), ids.tolist()):
                n = n + 1 if a == last else 1
                last = a
                if n <= k:
                    out.append((a, n, i, s))
            if out:
                a, n_, i, s = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n_, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["anchor_id", "place", "positive_id", "positive_score"])

    return sorted_keys.mapInArrow(work, _POSITIVES)


def _emitted(sorted_keys: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """One pass over sorted keys: a positive opens a window, a negative goes to the open windows that hold it.

    A window's scores are at most the positive's own, and positives come first
    among equal scores, so a window is open before its first negative passes.
    A window closes when it has k rows or the score falls below it. An anchor
    holds its few open windows, never its rows.
    """
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, []
        for anchors, scores, kinds, ids in _stream(batches):
            out = []
            for a, s, kind, i in zip(anchors.tolist(), scores.tolist(), kinds.tolist(), ids.tolist()):
                if a != last:
                    last, open_ = a, []
                if kind == 0:
                    least, most = window(s, low, high)
                    if least <= most:
                        open_.append([least, most, i, s, 0])
                    continue
                for w in open_:
                    if w[0] <= s <= w[1]:
                        w[4] += 1
                        out.append((a, w[2], w[4], i, w[3], s))
                if open_:
                    open_ = [w for w in open_ if w[4] < k and w[0] <= s]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "rank" else pa.int64()) for n, c in zip(names, zip(*out))], names)

    return sorted_keys.mapInArrow(work, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _with_windows(blocks: DataFrame, positives: DataFrame) -> DataFrame:
    """Blocks with the positive scores of each of their anchors, in the block's order."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = np.frombuffer(b.column(1)[r].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * len(ids), pa.int64()), pa.array(ids), pa.array(range(len(ids)), pa.int32())], ["block", "anchor_id", "pos"])

    of = positives.groupBy("anchor_id").agg(F.collect_list("positive_score").alias("s"))
    rows = blocks.select("block", "ids").mapInArrow(unpack, "block long, anchor_id long, pos int").join(of, "anchor_id", "left")
    lists = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("s", F.array().cast("array<bigint>")).alias("s")))).alias("l"))
    return blocks.join(lists.select("block", F.col("l.s").alias("windows")), "block")


def hard_negatives(embeddings: DataFrame, anchors: Column, label: Column | str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, shard_rows: int = SHARD_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """For each row where ``anchors`` holds and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Components become floor(scale * x); a score is the integer
    inner product with the anchor; higher scores come first, ties by the
    smaller vec_id. Rows with a null vec_id or label, a null vector or a null
    or non-finite component take no part. Rows with the anchor's vec_id are
    neither its positives nor its negatives; an anchor id that occurs more than
    once is asked once, with its least (label, vector), and any other repeated
    row counts each time. Vectors of different lengths don't meet. Positives
    with a negative score have an empty window. An empty table gives an empty
    table, and columns other than those named are not read.

    Scores are made in pairs of anchor block and shard, on two passes: rows of
    the same label give positives, rows of other labels negatives. Each pass
    packs (anchor, descending score, id) into keys, keeps of a shard only what
    could be among an anchor's results, and sends those keys through one
    shuffle that is sorted inside its partitions. An iterator reads each
    partition once; an anchor's rows are never held together.
    """
    rows = labelled(embeddings, F.col(label) if isinstance(label, str) else label, scale)
    shards = settle(_packed(rows, shard_rows).withColumn("shard", F.monotonically_increasing_id()))
    asked = rows.filter(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    blocks = settle(_packed(asked, block_anchors).withColumn("block", F.monotonically_increasing_id()))
    first = settle(_first_positives(_in_order(_positive_keys(_pairs(blocks, shards), positives)), positives))
    opened = _with_windows(blocks, first)

    def positive_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _key_batch(b.column(0), b.column(2), 0, b.column(1))

    marks = first.select("anchor_id", "positive_id", "positive_score").mapInArrow(positive_keys, "anchor_id long, key binary")
    found = _negative_keys(_pairs(opened, shards), negatives, low, high)
    return _emitted(_in_order(marks.unionByName(found)), negatives, low, high)
