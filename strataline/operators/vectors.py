"""Exact nearest vectors over blocks that know a ball around their vectors, so that most pairs of blocks are never shipped."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import settle

#: Vectors of a block, queries of a block, balls compared at once, and places that vectors are gathered around: they bound what a task holds.
BLOCK_ROWS, BLOCK_QUERIES, CHUNK, PIVOTS = 8_192, 512, 1_024, 1_024
CELLS = 4_000_000
#: Numbers in the vectors of a group of queries or a slice of the base: what a task of the search holds.
HELD = 1 << 23

_PACK = pa.schema([("grp", pa.string()), ("blk", pa.int64()), ("n", pa.int64()), ("centre", pa.binary()), ("radius", pa.float64()), ("first", pa.float64()), ("last", pa.float64()),
                   ("ids", pa.binary()), ("ats", pa.binary()), ("vecs", pa.binary())])
PACK = "grp string, blk long, n long, centre binary, radius double, first double, last double, ids binary, ats binary, vecs binary"
_BALL = ["grp", "blk", "n", "centre", "radius", "first", "last"]


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def scores(base: np.ndarray, asked: np.ndarray, metric: str) -> np.ndarray:
    """Larger is better, one row per query, nine places."""
    if metric == "l2":
        return np.round(-(np.square(asked).sum(1)[:, None] + np.square(base).sum(1)[None, :] - 2 * asked @ base.T), 9)
    return np.round(unit(asked) @ unit(base).T, 9)


def bounds(q_centre: np.ndarray, q_radius: np.ndarray, centre: np.ndarray, radius: np.ndarray, metric: str) -> np.ndarray:
    """No vector in ball j scores more with a query in ball i than entry (i, j): Cauchy-Schwarz for products, the triangle inequality for distances."""
    if metric == "l2":
        apart = np.sqrt(np.maximum(0, np.square(q_centre).sum(1)[:, None] + np.square(centre).sum(1)[None, :] - 2 * q_centre @ centre.T))
        near = np.maximum(0, apart * (1 - 1e-9) - q_radius[:, None] - radius[None, :])
        top = -near * near
    else:
        size = lambda m: np.linalg.norm(m, axis=1)
        top = q_centre @ centre.T + size(q_centre)[:, None] * radius[None, :] + q_radius[:, None] * (size(centre) + radius)[None, :]
    return top + 1e-8 * (1 + np.abs(top))  # rounding here and in the scores


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(-1, dim)


def blocks(rows: DataFrame, pivots: np.ndarray, metric: str, most: int) -> DataFrame:
    """Vectors (grp, id, at, vec) in packs of up to ``most`` neighbours of one group, each with its ball and its span of ``at``.

    A vector belongs to the cell of its nearest pivot. Cells are dealt to ranges
    of (group, cell, hash), so a large one spans many tasks, and packed as they
    pass. Where pivots lie changes the time, never the result.
    """
    dim = pivots.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = np.square(pivots).sum(1) / 2
        for b in batches:
            m = _matrix(b.column("vec"), dim)
            m = m if metric == "l2" else unit(m)
            cell = np.argmax(m @ pivots.T - half, axis=1).astype(np.int32) if len(m) else np.zeros(0, np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * dim), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("grp"), pa.array(cell), b.column("id"), b.column("at"), flat], ["grp", "cell", "id", "at", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key, held, n = 0, None, [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, held, n
            ids, ats, m = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(ids, kind="stable")
            ids, ats, m = ids[by], ats[by], m[by]
            centre = m.mean(axis=0)
            radius = float(np.sqrt(np.square(m - centre).sum(1).max())) * (1 + 1e-9)
            row = [key[0], (TaskContext.get().partitionId() << 33) + made, len(ids), centre.tobytes(), radius, float(ats.min()), float(ats.max()), ids.tobytes(), ats.tobytes(), m.tobytes()]
            made, held, n = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PACK)], schema=_PACK)

        for b in batches:
            if not b.num_rows:
                continue
            grp, cell = b.column("grp").to_pylist(), b.column("cell").to_pylist()
            ids, ats, m = np.asarray(b.column("id"), np.int64), np.asarray(b.column("at"), np.float64), _matrix(b.column("vec"), dim)
            at = 0
            while at < len(ids):
                if key != (grp[at], cell[at]):
                    if held:
                        yield close()
                    key = (grp[at], cell[at])
                end = at + 1
                while end < len(ids) and end - at < most - n and cell[end] == key[1] and grp[end] == key[0]:
                    end += 1
                held.append((ids[at:end], ats[at:end], m[at:end]))
                n += end - at
                at = end
                if n == most:
                    yield close()
        if held:
            yield close()

    placed = rows.select("grp", "id", "at", "vec").mapInArrow(place, "grp string, cell int, id long, at double, vec array<double>")
    dealt = placed.repartitionByRange("grp", "cell", F.xxhash64("id")).sortWithinPartitions("grp", "cell")
    return settle(dealt.mapInArrow(pack, PACK))


def largest(df: DataFrame) -> int:
    """Rows of the largest group."""
    return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _balls(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([np.frombuffer(c, "<f8") for c in pdf["centre"]]), pdf["radius"].to_numpy()


def _meeting(asked: DataFrame, base: DataFrame, body, schema: str) -> DataFrame:
    """Balls of query blocks against balls of base blocks of the same group, some thousand at once; no vector is read here.

    Only a group of more blocks than ``CHUNK`` needs parts, however many groups there are.
    """
    parts = lambda df: max(1, math.ceil(largest(df) / CHUNK))
    n_q, n_b = parts(asked), parts(base)
    deal = lambda n: F.pmod(F.xxhash64("blk"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumns({"qc": deal(n_q), "bc": every(n_b)}).groupBy("grp", "qc", "bc")
    right = base.select(*_BALL).withColumns({"bc": deal(n_b), "qc": every(n_q)}).groupBy("grp", "qc", "bc")
    empty = lambda: pd.DataFrame({c.split()[0]: pd.Series(dtype="float64" if c.endswith("double") else "int64") for c in schema.split(", ")})
    return left.cogroup(right).applyInPandas(lambda q, b: body(q, b) if len(q) and len(b) else empty(), schema)


def _able(q: pd.DataFrame, b: pd.DataFrame, max_age: float | None) -> np.ndarray:
    """Which block pairs can hold a vector that is not younger than a query and at most ``max_age`` older."""
    if max_age is None:
        return np.ones((len(q), len(b)), bool)
    return (b["first"].to_numpy()[None, :] <= q["last"].to_numpy()[:, None]) & (b["last"].to_numpy()[None, :] >= q["first"].to_numpy()[:, None] - max_age)


def nearest_blocks(asked: DataFrame, base: DataFrame, metric: str, max_age: float | None = None) -> DataFrame:
    """(qblk, bblk): for every query block the base block with the highest bound."""

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        top = np.where(_able(q, b, max_age), bounds(*_balls(q), *_balls(b), metric), -np.inf)
        at = top.argmax(axis=1)
        rows = pd.DataFrame({"qblk": q["blk"].to_numpy(), "bblk": b["blk"].to_numpy()[at], "top": top[np.arange(len(q)), at]})
        return rows[np.isfinite(rows["top"])]

    found = _meeting(asked.select(*_BALL), base, best, "qblk long, bblk long, top double")
    return found.groupBy("qblk").agg(F.max(F.struct("top", "bblk")).alias("m")).select("qblk", F.col("m.bblk").alias("bblk"))


def reaching_blocks(asked: DataFrame, base: DataFrame, floors: DataFrame, metric: str, max_age: float | None = None) -> DataFrame:
    """(qblk, bblk): block pairs whose bound reaches the k-th score that every query of the block has already, but for the pair that gave it.

    ``floors`` has qblk, bblk (the block searched first) and floor.
    """

    def reach(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        top = bounds(*_balls(q), *_balls(b), metric)
        go = _able(q, b, max_age) & (top >= q["floor"].to_numpy()[:, None]) & (b["blk"].to_numpy()[None, :] != q["bblk"].to_numpy()[:, None])
        i, j = np.nonzero(go)
        return pd.DataFrame({"qblk": q["blk"].to_numpy()[i], "bblk": b["blk"].to_numpy()[j]})

    with_floor = asked.select(*_BALL).join(floors.withColumnRenamed("qblk", "blk"), "blk")
    return _meeting(with_floor, base, reach, "qblk long, bblk long")


def _raw(base: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray], metric: str) -> np.ndarray:
    """Scores before they are rounded, of vectors that :func:`_ready` has prepared."""
    if metric == "l2":
        s = asked[1][:, None] + base[1][None, :]
        s -= 2 * asked[0] @ base[0].T
        return np.negative(s, out=s)
    return asked[0] @ base[0].T


def _ready(raw, dim: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a pack as the metric needs them, and their squares."""
    m = np.frombuffer(raw, "<f8").reshape(-1, dim)
    m = m if metric == "l2" else unit(m)
    return m, np.square(m).sum(1)


class _Best:
    """The best ``k`` hits so far of the queries of one block."""

    def __init__(self, qid: np.ndarray, at: np.ndarray, vecs: tuple[np.ndarray, np.ndarray], k: int):
        self.qid, self.at, self.vecs, self.k = qid, at, vecs, k
        self.score, self.id = np.full((len(qid), k), -np.inf), np.zeros((len(qid), k), np.int64)

    def meet(self, ids: np.ndarray, at: np.ndarray, base: tuple[np.ndarray, np.ndarray], metric: str, max_age: float | None) -> None:
        """Take in a block of vectors: only those near or above a query's k-th score are rounded and sorted, ties by id."""
        strip = max(1, CELLS // len(ids))
        for i in range(0, len(self.qid), strip):
            s = _raw(base, (self.vecs[0][i:i + strip], self.vecs[1][i:i + strip]), metric)
            if max_age is not None:
                age = self.at[i:i + strip, None] - at[None, :]
                s[(age < 0) | (age > max_age)] = -np.inf
            held = self.score[i:i + strip]
            least = held[:, -1].copy()
            new = np.flatnonzero(np.isneginf(least))
            if s.shape[1] > self.k and len(new):
                part = np.where(np.isfinite(s[new]), s[new], -np.inf)
                least[new] = np.partition(part, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            least -= np.where(np.isfinite(least), 1e-8 * (1 + np.abs(least)), 0)
            row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf) & (s < np.inf))
            if not len(row):
                continue
            r, c = np.nonzero(np.isfinite(held))
            row, value, name = np.concatenate([row, r]), np.concatenate([np.round(s[row, col], 9), held[r, c]]), np.concatenate([ids[col], self.id[i + r, c]])
            by = np.lexsort((name, -value, row))
            row, value, name = row[by], value[by], name[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, value, name, place = (x[place < self.k] for x in (row, value, name, place))
            self.score[i + row, place], self.id[i + row, place] = value, name

    def rows(self, qblk: int) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(self.score))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), qblk, np.int64)), pa.array(self.qid[row]), pa.array(self.id[row, col]), pa.array(self.score[row, col])], ["qblk", "qid", "id", "score"])


def _grid(asked: DataFrame, base: DataFrame, dim: int) -> tuple[int, int]:
    """(groups of queries, slices of vectors) whose product gives every core some cells and of which none holds more than ``HELD`` numbers."""
    size = lambda df: df.agg(F.sum("n"), F.count(F.lit(1))).first()
    (n_q, packs_q), (n_b, packs_b) = size(asked), size(base)
    n_q, n_b = n_q or 1, n_b or 1
    cells = 3 * asked.sparkSession.sparkContext.defaultParallelism
    groups = max(math.ceil(math.sqrt(cells * n_q / n_b)), math.ceil(n_q * dim / HELD))
    groups = max(1, min(groups, packs_q))
    return groups, max(1, min(max(math.ceil(cells / groups), math.ceil(n_b * dim / HELD)), packs_b))


def _searched(pairs: DataFrame, asked: DataFrame, base: DataFrame, k: int, metric: str, dim: int, max_age: float | None) -> DataFrame:
    """(qblk, qid, id, score): the best k rows per query among the paired blocks of every slice, ties by id.

    A task holds the query blocks of one cell of a grid (:func:`_grid`) and
    streams the base blocks of that cell past them, each with the query blocks
    that it is paired with. So a vector is shipped once per group or slice that
    needs it, not once per pair of blocks, and a query leaves a task with k hits.
    """
    schema = "qblk long, qid long, id long, score double"
    groups, slices = _grid(asked, base, dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for b in batches:
            for r in range(b.num_rows):
                if b.column("cell")[r].as_py() != cell:
                    yield from (best.rows(blk) for blk, best in held.items())
                    cell, held = b.column("cell")[r].as_py(), {}
                ids, ats = (np.frombuffer(b.column(c)[r].as_buffer(), t) for c, t in (("ids", "<i8"), ("ats", "<f8")))
                vecs = _ready(b.column("vecs")[r].as_buffer(), dim, metric)
                wanted = b.column("wanted")[r].as_py()
                if wanted is None:
                    held[b.column("blk")[r].as_py()] = _Best(ids, ats, vecs, k)
                else:
                    for blk in wanted:
                        held[blk].meet(ids, ats, vecs, metric, max_age)
        yield from (best.rows(blk) for blk, best in held.items())

    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    placed = settle(pairs.select("qblk", "bblk", (part("qblk", groups) * slices + part("bblk", slices)).cast("int").alias("cell")))
    pack = [F.col(c) for c in ("ids", "ats", "vecs")]
    queries = placed.select("cell", F.col("qblk").alias("blk")).distinct().join(asked, "blk").select("cell", "blk", F.lit(None).cast("array<long>").alias("wanted"), *pack)
    wanted = placed.groupBy("cell", F.col("bblk").alias("blk")).agg(F.collect_list("qblk").alias("wanted"))  # at most the query blocks of a group
    rows = queries.unionByName(wanted.join(base, "blk").select("cell", "blk", "wanted", *pack))
    # Null comes first: queries stand before the vectors that pass them.
    dealt = rows.repartitionById(groups * slices, F.col("cell")).sortWithinPartitions("cell", F.col("wanted").isNotNull(), "blk")
    return dealt.mapInArrow(work, schema)


def _floors(asked: DataFrame, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qblk, bblk, floor): the least k-th score of a block's queries; nothing if one of them has fewer than k hits yet."""
    kth = found.groupBy("qblk", "qid").agg(F.count(F.lit(1)).alias("hits"), F.min("score").alias("s")).filter(F.col("hits") >= k)
    low = kth.groupBy("qblk").agg(F.count(F.lit(1)).alias("full"), F.min("s").alias("s"))
    of = asked.select(F.col("blk").alias("qblk"), "n").join(low, "qblk", "left").join(first, "qblk", "left")
    return of.select("qblk", F.coalesce("bblk", F.lit(-1)).alias("bblk"), F.when(F.col("full") == F.col("n"), F.col("s")).otherwise(F.lit(float("-inf"))).alias("floor"))


def usable(df: DataFrame, name: str, dim: int, group: str | None, max_age: float | None) -> DataFrame:
    """(grp, id, at, vec) without null vectors; a vector of another length is an error."""
    grp = (F.col(group).cast("string") if group else F.lit("")).alias("grp")
    at = (F.col("at").cast("double") if max_age is not None else F.lit(0.0)).alias("at")
    vec = F.when(F.size("vec") == dim, F.col("vec").cast("array<double>")).otherwise(F.raise_error(F.lit(f"a vector doesn't have {dim} components")))
    return df.filter(F.col("vec").isNotNull()).select(grp, F.col(name).cast("long").alias("id"), at, vec.alias("vec"))


def pivots_of(base: DataFrame, metric: str, dim: int) -> np.ndarray:
    """Vectors at hash-chosen rows, one per quarter block of the largest group and ``PIVOTS`` at most: a bounded sample that only says which vectors lie together."""
    n = largest(base)
    want = min(PIVOTS, max(1, math.ceil(4 * n / BLOCK_ROWS))) if n > BLOCK_ROWS else 1
    rows = base.orderBy(F.xxhash64("id"), "id").limit(want).select("vec").collect()
    m = np.array([r.vec for r in rows], np.float64).reshape(-1, dim) if rows else np.zeros((1, dim))
    return m if metric == "l2" else unit(m)


def vector_top_k(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", dim: int = 64, group: str | None = None,
                 max_age: float | None = None) -> DataFrame:
    """Exact nearest vectors: (qid, id, score, rank), optionally only inside the same ``group``.

    With ``max_age`` both sides carry ``at``, and only vectors that are not
    younger than the query and at most that much older count.

    Vectors and queries are packed in blocks of neighbours. Each query block
    first searches the base block of the highest bound; then the balls of all
    blocks are compared, a few numbers each, and only pairs that can still give
    one of the first k are shipped and searched. Rows with a null vector are
    left out; a vector of another length than ``dim`` is an error.
    """
    asked, held = usable(queries, "qid", dim, group, max_age), usable(base, "id", dim, group, max_age)
    pivots = pivots_of(held, metric, dim)
    q, b = blocks(asked, pivots, metric, BLOCK_QUERIES), blocks(held, pivots, metric, BLOCK_ROWS)
    first = settle(nearest_blocks(q, b, metric, max_age))
    seeds = settle(_searched(first, q, b, k, metric, dim, max_age))
    rest = reaching_blocks(q, b, _floors(q, first, seeds, k), metric, max_age)
    found = seeds.unionByName(_searched(rest, q, b, k, metric, dim, max_age)).drop("qblk")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)
