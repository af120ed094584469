"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are phrases, an edge is a phrase of ``LONGEST`` words that leads from its
first words to its last ones, and its weight is how often it occurs. Texts are
cut at piece ends, so every word position gives one edge, or near the end of
its piece a shorter stump; all shorter counts follow from these by flow: what
occurs at a node leaves it by an edge or ends there with its piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, worker_state

#: Words of an edge; hash buckets of the filter (a bitmap of 8 MB, whatever the input); bytes of text that a task takes at once; words that a worker
#: remembers, and bucket numbers and edges that a task sums before it sends them.
LONGEST, BUCKETS_LOG2, CHUNK, KNOWN_WORDS, HELD_BUCKETS, HELD_GRAMS = 5, 26, 2_000_000, 300_000, 6_000_000, 200_000
# Characters that end a piece, besides line feed to carriage return.
PIECE_ENDS = ".,;:!?"

_TABLE = bytes(10 if chr(i) in PIECE_ENDS or 10 <= i <= 13 else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_EMPTY, _END = 0, 1


class _Words(dict):
    """Numbers for words as they come, with a 64-bit hash each."""

    def __init__(self):
        self.names: list[bytes] = []
        self._hashes = np.zeros(1024, np.uint64)
        for w in (b"", b"\n"):
            self[w]

    def __missing__(self, word: bytes) -> int:
        at = len(self.names)
        self.names.append(word)
        if at == len(self._hashes):
            self._hashes = np.concatenate([self._hashes, np.zeros(at, np.uint64)])
        self._hashes[at] = xxhash.xxh3_64_intdigest(word)
        self[word] = at
        return at

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        return self._hashes[codes]


def _known() -> _Words:
    held = worker_state("collocation_words", lambda: [_Words()])
    if len(held[0].names) > KNOWN_WORDS:
        held[0] = _Words()
    return held[0]


def _codes(texts: list[bytes], words: _Words) -> np.ndarray:
    """Word numbers of texts of UTF-8 bytes; piece ends are ``_END``."""
    plain = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
    parts = plain.split(b" ")
    codes = np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))
    return codes[codes != _EMPTY]


def _buckets(hashes: np.ndarray, lang: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, and of pairs of neighbours."""
    shift = np.uint64(64 - BUCKETS_LOG2)
    mixed = (hashes ^ np.uint64(lang)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    pairs = (mixed[:-1] * np.uint64(0xD6E8FEB86659FD93) + mixed[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed * np.uint64(0xD6E8FEB86659FD93) >> shift, (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> shift


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, _Words]]:
    """(lang, hash of lang, word numbers, words) of some texts of one lang, whole texts each."""
    held, size = {}, 0

    def out():
        for lang, texts in held.items():
            words = _known()
            yield lang, xxhash.xxh3_64_intdigest(lang.encode()), _codes(texts, words), words

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            if text.is_valid:
                raw = text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size > CHUNK:
                    yield from out()
                    held, size = {}, 0
    yield from out()


def _bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, c): occurrences of the words and pairs of neighbours of each bucket, summed by task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            buckets, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(counts)], ["bucket", "c"])

        for _, salt, codes, words in _chunks(batches):
            one, two = _buckets(words.hashes(codes), salt)
            real = codes != _END
            held += [one[real].astype(np.int32), two[real[:-1] & real[1:]].astype(np.int32)]
            size += len(held[-2]) + len(held[-1])
            if size > HELD_BUCKETS:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return texts.mapInArrow(work, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def _bitmap(texts: DataFrame, least: int) -> np.ndarray:
    """One bit per bucket: whether its words and pairs together occur ``least`` times. Its size does not depend on the texts."""
    page = 16
    often = _bucket_counts(texts).filter(F.col("c") >= least)
    pages = often.groupBy(F.shiftright("bucket", page).alias("page")).agg(F.collect_list(F.col("bucket").bitwiseAND((1 << page) - 1)).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for at in b.column(1):
                bits = np.zeros(1 << page, bool)
                bits[np.asarray(at.values)] = True
                raw.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["page", "bits"])

    out = np.zeros(1 << BUCKETS_LOG2 - 3, np.uint8)
    for r in pages.mapInArrow(pack, "page int, bits binary").collect():
        width = 1 << page - 3
        out[r.page * width:(r.page + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def _stumps(codes: np.ndarray, reach: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first places, counts) of the distinct phrases of k words that start where the reach is k, exactly."""
    at = np.flatnonzero(reach > 0)
    ids = codes[at]
    for k in range(1, LONGEST + 1):
        if k > 1:
            more = reach[at] >= k
            at = at[more]
            ids = ids[more] * size + codes[at + k - 1]
        if not len(at):
            return
        # Numbers of distinct prefixes, so that the next key stays below size squared.
        _, first, ids = np.unique(ids, return_index=True, return_inverse=True)
        n = np.bincount(ids[reach[at] == k], minlength=len(first))
        yield k, at[first[n > 0]], n[n > 0]


def edges(texts: DataFrame, least: int) -> DataFrame:
    """(lang, gram, k, c): the edges and stumps of all texts (lang, text) with their weights, and a row of k = 0 with the number of words.

    A phrase with ``least`` occurrences has only words and pairs with as many,
    so edges are cut before pairs whose bucket has fewer: counts of all phrases
    that pass stay whole, and the long tail never leaves its task.
    """
    bits = texts.sparkSession.sparkContext.broadcast(_bitmap(texts, least))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes, int], int] = {}

        def batch() -> pa.RecordBatch:
            langs, grams, ks = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.binary()).cast(pa.string()), pa.array(ks, pa.int32()), pa.array(held.values(), pa.int64())], ["lang", "gram", "k", "c"])

        for lang, salt, codes, words in _chunks(batches):
            held[lang, b"", 0] = held.get((lang, b"", 0), 0) + int((codes != _END).sum())
            one, two = _buckets(words.hashes(codes), salt)
            often = lambda b: (bits.value[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1
            able = (often(one) == 1) & (codes != _END)
            pair = np.zeros(len(codes) + LONGEST, bool)
            pair[:max(0, len(codes) - 1)] = (often(two) == 1) & able[:-1] & able[1:]
            reach, on = able.astype(np.int8), able.copy()
            for k in range(LONGEST - 1):
                on = on & pair[k:k + len(codes)]
                reach += on
            for k, places, n in _stumps(codes, reach, len(words.names)):
                rows = codes[places[:, None] + np.arange(k)].tolist()
                for row, c in zip(rows, n.tolist()):
                    key = lang, b" ".join(map(words.names.__getitem__, row)), k
                    held[key] = held.get(key, 0) + c
            if len(held) > HELD_GRAMS:
                yield batch()
                held.clear()
        if held:
            yield batch()

    return settle(texts.mapInArrow(work, "lang string, gram string, k int, c long").groupBy("lang", "gram", "k").agg(F.sum("c").alias("c")))


def _first_words(gram: str, k: int):
    return F.substring_index(gram, " ", k)


def _last_words(gram: str):
    """A phrase without its first word."""
    return F.expr(f"substr({gram}, instr({gram}, ' ') + 1)")


def flows(edge_weights: DataFrame) -> list[DataFrame]:
    """Per length 1 to LONGEST the nodes (lang, phrase, f, most_out): how often they occur, and the greatest flow out by one edge.

    A node's occurrences are the flows of the edges that leave it plus the
    stumps that end there with their piece, level by level from the longest.
    """
    level = edge_weights.filter(F.col("k") == LONGEST).select("lang", F.col("gram").alias("phrase"), F.col("c").alias("f"), F.lit(0).cast("long").alias("most_out"))
    out = [settle(level)]
    for k in range(LONGEST - 1, 0, -1):
        leaving = out[0].select("lang", _first_words("phrase", k).alias("phrase"), "f", F.col("f").alias("edge"))
        ending = edge_weights.filter(F.col("k") == k).select("lang", F.col("gram").alias("phrase"), F.col("c").alias("f"), F.lit(0).cast("long").alias("edge"))
        out.insert(0, settle(leaving.unionByName(ending).groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.max("edge").alias("most_out"))))
    return out


def compacted(levels: list[DataFrame], least: int, percent: int = 100) -> DataFrame:
    """(lang, phrase, k, f, inside) of all phrases with ``least`` occurrences; ``inside``: an edge next to it has at least ``percent`` % of its flow.

    At 100 % that is a node inside a unary path: one edge takes, or brings, all
    that passes, and the path is one phrase. A longer phrase around it occurs
    at least as often in between, so the two neighbouring edges decide.
    """
    rows = [lv.filter(F.col("f") >= least).withColumn("k", F.lit(k)) for k, lv in enumerate(levels, 1)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    every = settle(every)
    into = every.filter(F.col("k") > 1).groupBy("lang", _last_words("phrase").alias("phrase")).agg(F.max("f").alias("most_in"))
    joined = every.join(into, ["lang", "phrase"], "left")
    most = F.greatest("most_out", F.coalesce("most_in", F.lit(0)))
    # An edge below ``least`` is no phrase that could hold this one.
    return joined.select("lang", "phrase", "k", "f", ((most >= least) & (100 * most >= percent * F.col("f"))).alias("inside"))


def passages(levels: list[DataFrame], least: int) -> DataFrame:
    """(lang, passage, n_words, f): maximal unary paths of the graph, as long as they go.

    An edge is unary if all that passes its first node leaves by it and all
    that passes its second node comes by it. Paths are joined by doubling:
    every node points ahead, and a round doubles how far, so the rounds grow
    with the logarithm of the longest path. A path lies in one piece of text
    whole, so no passage is longer than a piece.
    """
    nodes = levels[-2].select("lang", F.col("phrase").alias("node"), "f")
    arcs = levels[-1].filter(F.col("f") >= least).select("lang", "phrase", "f", _first_words("phrase", LONGEST - 1).alias("a"), _last_words("phrase").alias("b"))
    same = lambda end: arcs.join(nodes.withColumnRenamed("node", end), ["lang", end, "f"], "left_semi").select("lang", "phrase")
    unary = arcs.join(same("a"), ["lang", "phrase"]).join(same("b"), ["lang", "phrase"]).select("lang", "phrase", "f", "a", "b")
    unary = settle(unary)
    # far: the node that is known ahead, at a distance of d edges; done: it leads nowhere further.
    ends = unary.select("lang", F.col("b").alias("node")).join(unary.select("lang", F.col("a").alias("node")), ["lang", "node"], "left_anti")
    state = unary.select("lang", "a", F.col("b").alias("far"), F.lit(1).cast("long").alias("d"), "f")
    state = settle(state.join(ends.select("lang", F.col("node").alias("far"), F.lit(True).alias("done")), ["lang", "far"], "left").withColumn("done", F.coalesce("done", F.lit(False))))
    while state.filter("NOT done").limit(1).count():
        ahead = state.select("lang", F.col("a").alias("far"), F.col("far").alias("far2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        state = settle(state.join(ahead, ["lang", "far"], "left").select(
            "lang", "a", F.coalesce("far2", "far").alias("far"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), "f", (F.col("done") | F.coalesce("done2", F.lit(False))).alias("done")))
    paths = state.groupBy("lang", "far", "f").agg(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("at"), F.substring_index("a", " ", 1).alias("w")))).alias("l"))
    text = F.concat_ws(" ", F.concat_ws(" ", F.col("l.w")), F.col("far"))
    return paths.select("lang", text.alias("passage"), (F.size("l") + LONGEST - 1).cast("long").alias("n_words"), "f")


def words_by_lang(docs: DataFrame) -> DataFrame:
    """(lang, text) with ``und`` for a null lang."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def collocations(docs: DataFrame, least: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to 5 words of every lang: lang, rank, phrase, a, l, r, n, score.

    a is how often the phrase occurs (``least`` times or more), n counts all
    words of the lang, and the cut after the first words with the least
    floor(1000 * a * n / (l * r)) gives score, l and r; of equal ones the
    shortest first part. A phrase goes if a longer phrase around it has at
    least ``percent`` % of its occurrences. Order: score, then a, descending,
    then the phrase by its UTF-8 bytes. Products are decimals of 38 digits.

    Null and empty texts have no words, a null lang is ``und`` (together with
    texts that say so), texts are read whole, repeated rows count each time, an
    empty table gives an empty table, and columns other than lang and text are
    not read.
    """
    texts = words_by_lang(docs)
    weights = edges(texts, least)
    phrases = settle(compacted(flows(weights), least, percent))
    words = weights.filter("k = 0").select("lang", F.col("c").alias("n"))
    kept = phrases.filter("k > 1 AND NOT inside").join(words, "lang").select("lang", "phrase", "k", F.col("f").alias("a"), "n")
    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - k)")})
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score").withColumn("rank", rank).filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
