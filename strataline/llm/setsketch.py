"""Near-duplicate documents: SetSketch registers, banded, estimated by joint likelihood, and verified on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import components
from .encode import runs

#: Registers (a prime, so that every element visits all of them in an order of its own), and how they are banded.
#: Two sets of similarity 0.85 share no band of five registers with a probability of (1 - 0.85^5)^25 = 4e-7; at 0.8 it is 5e-5.
REGISTERS, BANDS, BAND = 127, 25, 5
#: Base and rate of the register scale.
BASE, RATE = 1.001, 20.0
#: Documents per block of a verification, about.
BLOCK_DOCS = 128
#: A pair is not verified if its likelihood at the threshold is e^-UNLIKELY of the largest or less.
UNLIKELY = 20.0

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POWER, _INVERSE = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles.

    A-Z are lower-cased and words are runs of other than ASCII white space. A
    shingle is ``words`` words in a row; a text of fewer words is one shingle,
    and one without words has none. A shingle's hash is that of its bytes, read
    off the running sums of one polynomial over all texts.
    """
    lists = [(t or "").encode().lower().split() for t in texts]
    flat = [w for ws in lists for w in ws]
    if not flat:
        return [np.zeros(0, np.uint64) for _ in texts]
    raw = np.frombuffer(b" ".join(flat), np.uint8)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    letters = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
    up, down = _powers(_POWER, len(raw)), _powers(_INVERSE, len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(letters[raw] * up[:-1])])

    def hashed(b: np.ndarray, e: np.ndarray) -> np.ndarray:
        return _mixed((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * _GOLD)

    out, at = [], 0
    every = hashed(begins[:len(flat) - words + 1], ends[words - 1:]) if len(flat) >= words else None
    for ws in lists:
        n = len(ws)
        if n >= words:
            out.append(np.unique(every[at:at + n - words + 1]))
        elif n:
            out.append(hashed(begins[at:at + 1], ends[at + n - 1:at + n]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of each set, (sets, REGISTERS) in 16 bits; the sketch of a union is the larger of each register.

    An element draws exponential points in rising order, one for each register
    in an order of its own; a register keeps the least point, on a scale of
    exponentially spaced steps. An element is done when its points have passed
    all registers of its set, so large sets cost little more than one point an
    element. All sets are worked on together, a round of points at a time.
    """
    m = REGISTERS
    least = np.full((len(sets), m), np.inf)
    if sets and sum(map(len, sets)):
        h = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = (h % np.uint64(m)).astype(np.int64)
        stride = ((h >> np.uint64(20)) % np.uint64(m - 1)).astype(np.int64) + 1
        x = np.zeros(len(h))
        flat = least.reshape(-1)
        for j in range(m):
            r = _mixed(h + np.uint64((j + 1) * int(_GOLD) & (1 << 64) - 1))
            x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (RATE * (m - j))
            np.minimum.at(flat, owner * m + place, x)
            alive = x < least.max(axis=1)[owner]
            if not alive.all():
                h, owner, place, stride, x = h[alive], owner[alive], place[alive], stride[alive], x[alive]
            if not len(h):
                break
            place = (place + stride) % m
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / math.log(BASE))
    return np.clip(k, 0, 65_535).astype(np.uint16)


def _log_share(x: np.ndarray) -> np.ndarray:
    """The probability that a register of one set is above the other's, for a part x of the elements; never 0."""
    return np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE), 1e-12)


def log_likelihood(above: np.ndarray, below: np.ndarray, equal: np.ndarray, u: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joint log likelihood of a similarity j, given how many registers of the first set are above, below and equal to the second's; u is the first's share of both sizes."""
    v = 1 - u
    p, q = _log_share(np.maximum(u - v * j, 0)), _log_share(np.maximum(v - u * j, 0))
    return above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))


def estimate(above: np.ndarray, below: np.ndarray, equal: np.ndarray, u: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The similarity of the largest joint likelihood, by golden-section search (it has one maximum)."""
    low, high = np.zeros_like(u), np.minimum(u / (1 - u), (1 - u) / u)
    g = (math.sqrt(5) - 1) / 2
    for _ in range(rounds):
        a, b = high - g * (high - low), low + g * (high - low)
        left = log_likelihood(above, below, equal, u, a) > log_likelihood(above, below, equal, u, b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows of two sketch matrices may have a similarity of ``percent`` or more, by size and by likelihood."""
    equal = np.array([(row == b).sum(axis=1) for row in a])
    above = np.array([(row > b).sum(axis=1) for row in a])
    x, y = n_a[:, None].astype(np.float64), n_b[None, :].astype(np.float64)
    ok = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
    i, j = np.nonzero(ok)
    t = percent / 100
    d0, dp = equal[i, j].astype(np.float64), above[i, j].astype(np.float64)
    dm = REGISTERS - d0 - dp
    u = n_a[i] / (n_a[i] + n_b[j])
    best = estimate(dp, dm, d0, u)
    at = np.minimum(t, np.minimum(u / (1 - u), (1 - u) / u))
    keep = (best >= t) | (log_likelihood(dp, dm, d0, u, at) >= log_likelihood(dp, dm, d0, u, best) - UNLIKELY)
    out = np.zeros(ok.shape, bool)
    out[i[keep], j[keep]] = True
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def block_links(left: list[tuple], right: list[tuple] | None, percent: int) -> list[tuple[int, int]]:
    """Links (document, smallest document it is connected with here) of one block, or between two.

    Members are (document, size, sketch, hashes). Likely pairs are verified on
    full sets, the most alike first; a pair already connected needs no look.
    """
    other = left if right is None else right
    regs = [np.array([np.frombuffer(m[2], "<u2") for m in side]) for side in (left, other)]
    sizes = [np.array([m[1] for m in side]) for side in (left, other)]
    likely = plausible(regs[0], regs[1], sizes[0], sizes[1], percent)
    if right is None:
        likely = np.triu(likely, 1)
    i, j = np.nonzero(likely)
    alike = np.array([(regs[0][p] == regs[1][q]).sum() for p, q in zip(i, j)])
    sets: dict[tuple[int, int], np.ndarray] = {}
    root: dict[int, int] = {}

    def find(d: int) -> int:
        while root.setdefault(d, d) != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    def hashes(side: int, k: int) -> np.ndarray:
        if (side, k) not in sets:
            sets[side, k] = np.frombuffer((left, other)[side][k][3], "<u8")
        return sets[side, k]

    for p, q in zip(i[np.argsort(-alike, kind="stable")].tolist(), j[np.argsort(-alike, kind="stable")].tolist()):
        a, b = find(left[p][0]), find(other[q][0])
        if a == b:
            continue
        common = _common(hashes(0, p), hashes(0 if right is None else 1, q))
        if 100 * common >= percent * (left[p][1] + other[q][1] - common):
            root[max(a, b)] = min(a, b)
    return [(d, find(d)) for d in root if find(d) != d]


def sketch_rows(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit digest of the shingle set (c1, c2) and its sketch (null for an empty set)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sketch", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in runs(texts, 1_000_000):
                sets = shingle_sets(texts[i:j])
                regs = sketches(sets)
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist() for s in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[i:j], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()), pa.array([r.astype("<u2").tobytes() if len(s) else None for s, r in zip(sets, regs)], pa.binary())], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_shingles long, c1 long, c2 long, sketch binary")


def _bucket_groups(classes: DataFrame) -> DataFrame:
    """(node, root): classes that are connected by shared bands. Any two similar sets are in one group."""
    bands = classes.select("rep", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    buckets = bands.select("rep", F.xxhash64("band", F.expr(f"substring(sketch, band * {2 * BAND} + 1, {2 * BAND})")).alias("bucket"))
    shared = settle(buckets.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter(F.col("first") != F.col("last")).drop("last"))
    stars = buckets.join(shared, "bucket").filter(F.col("rep") != F.col("first")).groupBy("rep").agg(F.collect_set("first").alias("firsts"), F.min("first").alias("b"))
    # A class and the heads of its (at most BANDS) bands all go under the least of them; copies share heads, so few edges are left.
    edges = stars.select(F.explode(F.concat("firsts", F.array("rep"))).alias("a"), "b").filter(F.col("a") != F.col("b"))
    return components(edges.distinct())


def _blocks(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Members of groups with their full sets, gathered in blocks of about BLOCK_DOCS documents of like size."""
    kinds = pa.schema([("g", pa.int64()), ("z", pa.int32()), ("i", pa.int32()), ("doc", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("hashes", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(6).to_pylist()
            for i, j in runs(texts, 1_000_000):
                sets = shingle_sets(texts[i:j])
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(6)), pa.array([s.tobytes() for s in sets], pa.binary())], schema=kinds)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    rows = members.join(texts, "doc").select("g", "z", "i", "doc", "n", "sketch", "text")
    sets = rows.mapInArrow(work, "g long, z int, i int, doc long, n long, sketch binary, hashes binary")
    return sets.groupBy("g", "z", "i").agg(F.collect_list(F.struct("doc", "n", "sketch", "hashes")).alias("members"))


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) from rows of ``members`` and ``others`` (null: within members)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(value):
            return None if value is None else [(m["doc"], m["n"], m["sketch"], m["hashes"]) for m in value]

        for b in batches:
            for r in range(b.num_rows):
                links = block_links(side(b.column(0)[r].as_py()), side(b.column(1)[r].as_py()), percent)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return pairs.select("members", "others").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept.

    Documents are linked if their sets of 5-word shingles (see
    :func:`shingle_sets`) have a similarity of ``percent`` or more; a
    component is named by its smallest doc_id, whose row is the one kept.

    Equal sets are one class from the start. Classes that share a band of
    registers are put in one group; groups are cut into blocks of documents of
    like size, and each block meets itself and those blocks of its group whose
    sizes allow a link. In a block pair, likely pairs (joint likelihood of the
    registers) are verified on full sets; only as many links leave it as connect
    what is connected. So large groups of copies are neither gathered in one
    task nor emitted as pairs, and all links between groups' members are seen.

    A null or empty text, or one without words, has no shingles, is linked
    with nothing and kept. Rows that repeat a doc_id are one document: all are
    kept or none. Rows without a doc_id are not linked: component_id is null
    and they are kept. Other columns are not read. An empty table gives an empty table.
    """
    rows = settle(sketch_rows(docs))
    real = rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = settle(real.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("sketch").alias("sketch")))
    groups = _bucket_groups(classes)
    step = -math.log(percent / 100)
    members = groups.join(classes, F.col("node") == F.col("rep")).select(
        F.col("root").alias("g"), F.floor(F.log(F.col("n")) / step + 1e-9).cast("int").alias("z"), F.col("node").alias("doc"), "n", "sketch")
    members = settle(members)
    parts = settle(members.groupBy("g", "z").agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).cast("int").alias("parts")))
    placed = members.join(parts, ["g", "z"]).withColumn("i", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).drop("parts")
    blocks = settle(_blocks(docs, placed))

    # A block meets the later blocks of its size band and all blocks of the next; a band is as wide as a link can reach.
    begin = F.when(F.col("z2") == F.col("z"), F.col("i") + 1).otherwise(0)
    left = blocks.select("g", "z", "i", F.explode(F.array("z", F.col("z") + 1)).alias("z2"))
    meets = left.join(parts.select("g", F.col("z").alias("z2"), "parts"), ["g", "z2"]).filter(begin < F.col("parts"))
    meets = meets.withColumn("i2", F.explode(F.sequence(begin, F.col("parts") - 1)))
    pairs = meets.join(blocks, ["g", "z", "i"]).join(
        blocks.select("g", F.col("z").alias("z2"), F.col("i").alias("i2"), F.col("members").alias("others")), ["g", "z2", "i2"])
    alone = blocks.filter(F.size("members") > 1).withColumn("others", F.lit(None).cast(blocks.schema["members"].dataType))
    links = settle(_linked(alone, percent).unionByName(_linked(pairs, percent)))
    roots = components(links)
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("root", "rep").alias("component_id"))
    named = settle(named)
    joined = real.join(named, ["c1", "c2"]).select("doc_id", "n_shingles", "component_id")
    rest = rows.filter((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, columns unchanged; rows without a doc_id stay."""
    gone = near_duplicates(docs, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_nd_doc")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_nd_doc"), "left_anti")
