"""Exact top-k search by inner product: ball-tree branch and bound per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Vectors per shard and per leaf, and queries per block: they bound what one row of the joined tables holds.
SHARD_ROWS, LEAF_ROWS, BLOCK_QUERIES = 16_384, 128, 512


class BallTree:
    """Vectors in leaves of a binary tree; every node knows a ball around its vectors.

    ``order`` permutes the rows so that a node's rows are contiguous. No inner
    product of q with a row of a node is above q . centre + |q| * radius.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        self.rows, self.ids = rows, ids
        self.begin, self.end, self.left, self.centre, self.radius = [], [], [], [], []
        x = rows.astype(np.float64)
        order = np.arange(len(rows))
        todo = [(0, len(rows))]
        while todo:
            later = []
            for b, e in todo:
                part = x[order[b:e]]
                centre = part.mean(axis=0)
                away = np.sqrt(((part - centre) ** 2).sum(axis=1))
                self.begin.append(b)
                self.end.append(e)
                self.centre.append(centre)
                self.radius.append(float(away.max()) if e > b else 0.0)
                if e - b > leaf:
                    self.left.append(-1)
                    # Split between two far points at the median, so that many equal rows still halve.
                    one = part[int(away.argmax())]
                    two = part[int(((part - one) ** 2).sum(axis=1).argmax())]
                    side = np.argsort(part @ (two - one), kind="stable")
                    order[b:e] = order[b:e][side]
                    mid = (b + e) // 2
                    later += [(b, mid), (mid, e)]
                else:
                    self.left.append(-2)
            first = len(self.begin)
            for node in range(first - len(todo), first):
                if self.left[node] == -1:
                    self.left[node] = first
                    first += 2
            todo = later
        self.rows, self.ids = rows[order], ids[order]
        self.left = [max(n, -1) for n in self.left]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Per query the best k of the shard that can still count, as (score, id), best first.

        ``floor`` has scores that k rows elsewhere reach for sure: nodes whose
        bound is below are not opened, and as a query finds k rows of its own
        here its floor rises. Each query takes the node of the highest bound
        next; queries that take the same leaf in the same round share one
        matrix product. Bounds equal to the floor are opened, as the smaller id
        wins a tie.
        """
        exact = exact_product(queries, self.rows)
        bound = queries.astype(np.float64) @ self.centre.T + np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))[:, None] * self.radius
        bound = np.maximum(bound + 1e-9 * (1 + np.abs(bound)), -(2.0**63))  # rounding; no score is below a long
        floor = floor.astype(np.float64).tolist()
        found: list[list[tuple[int, int]]] = [[] for _ in queries]
        heaps = [[(-row[0], 0)] for row in bound.tolist()]
        active = range(len(queries))
        while active:
            leaves: dict[int, list[int]] = {}
            for q in active:
                heap = heaps[q]
                while heap and -heap[0][0] >= floor[q]:
                    node = heapq.heappop(heap)[1]
                    child = self.left[node]
                    if child < 0:
                        leaves.setdefault(node, []).append(q)
                        break
                    for c in (child, child + 1):
                        if bound[q, c] >= floor[q]:
                            heapq.heappush(heap, (-bound[q, c], c))
            active = []
            for node, some in leaves.items():
                b, e = self.begin[node], self.end[node]
                scores = exact(queries[some], self.rows[b:e])
                ids = self.ids[b:e]
                keep = (scores >= np.array([floor[q] for q in some])[:, None]) & (ids[None, :] != own[some][:, None])
                for j, q in enumerate(some):
                    hit = np.flatnonzero(keep[j])
                    if len(hit):
                        best = sorted(found[q] + list(zip(scores[j, hit].tolist(), ids[hit].tolist())), key=lambda x: (-x[0], x[1]))[:k]
                        found[q] = best
                        if len(best) == k:
                            floor[q] = max(floor[q], float(best[-1][0]))
                active += some
        return found


def exact_product(a: np.ndarray, b: np.ndarray):
    """A product of integer matrices without rounding, in the fastest numbers that hold all sums; what no long holds becomes the nearest one."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**53:
        return lambda x, y: (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if top < 2.0**63:
        return lambda x, y: x.astype(np.int64) @ y.astype(np.int64).T
    most = (1 << 63) - 1
    return lambda x, y: np.array([[max(-most, min(most, sum(map(int.__mul__, p, q)))) for q in y.tolist()] for p in x.tolist()], np.int64).reshape(len(x), len(y))


def _valid(c: Column) -> Column:
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def scaled(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v) with v the components floor(scale * x); rows without an id or with a null, or with null or non-finite components, are left out."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _valid(F.col("e")))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, dim)


def _small(x: np.ndarray) -> tuple[str, bytes]:
    """The bytes of a matrix in the narrowest integers that hold it."""
    top = int(np.abs(x).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


_PACKED = "part int, dim int, n int, kind string, ids binary, rows binary"


def packed(vectors: DataFrame, most: int) -> DataFrame:
    """Vectors of one length together, up to ``most`` per row, gathered where they lie: nothing is shuffled."""
    kinds = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("rows", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}

        def row(dim: int) -> pa.RecordBatch:
            ids, mats = zip(*held.pop(dim))
            kind, raw = _small(np.concatenate(mats))
            ids = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, dim, len(ids), kind, ids.astype("<i8").tobytes(), raw), kinds)], schema=kinds)

        for b in batches:
            ids, lists = np.asarray(b.column(0)), b.column(1)
            sizes = np.asarray(lists.value_lengths())
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                mat = _matrix(lists.take(pa.array(mine)), dim) if dim else np.zeros((len(mine), 0), np.int64)
                at = 0
                while at < len(mine):
                    have = sum(len(i) for i, _ in held.get(dim, []))
                    n = min(most - have, len(mine) - at)
                    held.setdefault(dim, []).append((ids[mine[at:at + n]], mat[at:at + n]))
                    at += n
                    if have + n == most:
                        yield row(dim)
        for dim in sorted(held):
            yield row(dim)

    return vectors.mapInArrow(work, _PACKED)


def _load(dim: int, kind: str, ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(rows, kind).reshape(len(ids), dim)


def _searched(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): of every (query block, shard) pair what its queries find there."""
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, BallTree] = {}
        for b in batches:
            for r in range(b.num_rows):
                shard, dim, kind, ids, rows, q_kind, q_ids, q_rows, floors = (b.column(c)[r].as_py() for c in range(9))
                if shard not in trees:
                    if len(trees) == 4:
                        del trees[next(iter(trees))]
                    trees[shard] = BallTree(*_load(dim, kind, ids, rows)[::-1])
                tree = trees[shard]
                q, mat = _load(dim, q_kind, q_ids, q_rows)
                floor = np.frombuffer(floors, "<f8") if floors else np.full(len(q), -np.inf)
                flat = [(a, i, s) for a, best in zip(q.tolist(), tree.search(mat, q, floor, k)) for s, i in best]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], schema=kinds)

    cols = ("shard", "dim", "kind", "ids", "rows", "q_kind", "q_ids", "q_rows", "floors")
    return pairs.select(*cols).mapInArrow(work, "query_id long, vec_id long, score long")


def _floors(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Blocks with the k-th score that each of their queries has already reached (-inf where fewer were found)."""
    kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids = np.frombuffer(b.column(1)[r].as_py(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * len(ids), pa.string()), pa.array(ids), pa.array(range(len(ids)), pa.int32())], ["block", "query_id", "pos"])

    rows = blocks.select("block", "q_ids").mapInArrow(unpack, "block string, query_id long, pos int").join(kth, "query_id", "left")
    lists = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.col("s").cast("double"), F.lit(float("-inf"))).alias("s")))).alias("l"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(x, "<f8").tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["block", "floors"])

    return blocks.join(lists.select("block", F.col("l.s").alias("s")).mapInArrow(pack, "block string, floors binary"), "block")


def top_k(embeddings: DataFrame, queries: Column, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """For each row where ``queries`` holds, the ``k`` other rows with the highest integer inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x); ties go to the smaller vec_id; fewer
    than k candidates give fewer rows. Candidates are all rows but those of the
    query's own vec_id. Rows without an id, null vectors and vectors with a
    null, NaN or infinite component take no part. Vectors of different lengths
    don't meet; those of length 0 score 0 with each other. A repeated vec_id is
    a candidate each time, and a query once (its first vector in array order).
    An empty table gives an empty table; other columns are not read.

    Shards are runs of vectors as they lie in the table. Queries are packed in
    blocks, each block first searches one shard, and the k-th score found there
    goes with it to all others, so their trees are cut early. A pair of block
    and shard is one row of an equi-join, and gives at most k rows per query.
    """
    rows = scaled(embeddings, scale)
    shards = settle(packed(rows, shard_rows).withColumn("shard", F.concat_ws("/", "part", "dim", F.monotonically_increasing_id())))
    asked = rows.filter(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = settle(packed(asked, block_queries).select(
        F.concat_ws("/", "part", "dim", F.monotonically_increasing_id()).alias("block"), "dim", F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")))
    # Shards are dealt to as many slots as there are shards; a block first goes to one slot, then to all the others.
    slots = max(1, shards.count())
    placed = shards.withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(slots)).cast("int")).withColumnRenamed("dim", "s_dim")
    home = F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")
    first = blocks.withColumn("slot", home).withColumn("floors", F.lit(None).cast("binary")).join(placed, "slot").filter(F.col("dim") == F.col("s_dim"))
    seeds = settle(_searched(first, k))
    rest = _floors(blocks, seeds, k).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).filter(F.col("slot") != home)
    found = _searched(rest.join(placed, "slot").filter(F.col("dim") == F.col("s_dim")), k).unionByName(seeds)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
