"""Language identification: averaged hashed subword embeddings with a linear softmax, trained here by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_worker_state, settle
from .encode import runs

#: Subwords are byte strings of these lengths inside <word>.
GRAMS = (2, 3, 4, 5)
BUCKETS = 1 << 16
#: Labelled texts per language that the classifier is fitted on (about; drawn by a hash of doc_id), a fourth of them for calibration.
SAMPLE = 400
#: Beyond so many languages each has fewer of the texts, so that their number stays; LEAST are drawn of any (or all that it has).
FULL_SAMPLES, LEAST = 64, 8
#: Numbers in a matrix of texts and languages that is worked on at a time.
CELLS = 2_000_000
#: A worker's table of word scores is dropped when it holds more words.
KNOWN_WORDS = 400_000
NONE = "und"


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every subword of the words."""
    raw = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    who, what = [], []
    for n in GRAMS:
        if len(raw) < n:
            break
        h = np.full(len(raw) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + raw[k:len(raw) - n + 1 + k]
        inside = owner[:len(h)] == owner[n - 1:]
        h ^= h >> np.uint64(29)
        who.append(owner[:len(h)][inside])
        what.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48))[inside].astype(np.int64) % BUCKETS)
    return np.concatenate(who), np.concatenate(what)


def word_list(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


@dataclass
class Model:
    languages: list[str]
    vectors: np.ndarray  # (BUCKETS, columns): embeddings, or embeddings times output weights if there are no more languages than dimensions
    weights: np.ndarray  # (languages, columns): output weights, or ones on the diagonal
    sharpness: float  # what the softmax's input is multiplied with, from calibration
    floor: float  # scores below it are rejected


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _row_blocks(n: int, columns: int) -> list[tuple[int, int]]:
    step = max(1, CELLS // max(1, columns))
    return [(i, min(n, i + step)) for i in range(0, n, step)]


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], held: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], dim: int = 16,
          epochs: int = 8, rate: float = 2.0, reject: float = 0.005, seed: int = 7) -> Model:
    """Fit on bags (language, buckets, counts); calibrate sharpness and rejection on ``held``.

    A document is the mean of its subwords' vectors, as each step sees it;
    the step size falls linearly to 0. Sharpness is the one with the least loss
    on ``held``; the floor is the score that ``reject`` of its rightly named
    texts stay below.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    weights = np.zeros((len(languages), dim))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            y, buckets, counts = bags[k]
            share = counts / counts.sum()
            hidden = share @ vectors[buckets]
            error = _softmax(weights @ hidden)
            error[y] -= 1
            step = rate * (1 - done / steps)
            back = weights.T @ error
            weights -= step * np.outer(error, hidden)
            vectors[buckets] -= step * share[:, None] * back
            done += 1
    if len(languages) <= dim:
        vectors, weights = vectors @ weights.T, np.eye(len(languages))
    vectors = vectors.astype(np.float32)
    held = held or bags
    if not held:
        return Model(languages, vectors, weights, 1.0, 0.0)
    x = np.array([(c / c.sum()) @ vectors[b] for _, b, c in held])
    y = np.array([k for k, _, _ in held], dtype=np.int64)

    def loss(s: float) -> float:
        return sum(float(-np.log(_softmax(s * (x[i:j] @ weights.T))[np.arange(j - i), y[i:j]] + 1e-12).sum()) for i, j in _row_blocks(len(y), len(languages)))

    best = min(np.geomspace(0.05, 20, 60), key=loss)
    right = []
    for i, j in _row_blocks(len(y), len(languages)):
        p = _softmax(best * (x[i:j] @ weights.T))
        right.append(p.max(axis=1)[p.argmax(axis=1) == y[i:j]])
    right = np.concatenate(right)
    return Model(languages, vectors, weights, float(best), float(np.quantile(right, reject)) if len(right) else 0.0)


def _held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; without a doc_id null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of documents whose :func:`_held_out` isn't 1.

    Languages are counted over all such documents that have a word, and all are
    learned. Of each, about ``sample`` texts (fewer beyond FULL_SAMPLES languages,
    one at least) are drawn by a hash of doc_id; tasks turn them, and three
    short spans of each (so that short texts are learned too), into bags of
    buckets, and only these bags reach the driver.
    """
    rows = docs.filter((_held_out(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\S"))
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    counts = settle(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_lid_n"), F.min(draw).alias("_lid_first")))
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 1)), 1.0, 0.0)
    sample = min(sample, max(LEAST, FULL_SAMPLES * sample // len(languages)))
    chosen = (draw < 1.2 * sample / F.col("_lid_n")) | (draw == F.col("_lid_first"))
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(counts), "lang")
    kinds = pa.schema([("place", pa.float64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for place, doc, lang, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                words = word_list(text)
                rng = np.random.default_rng(abs(doc))
                spans = [words]
                for _ in range(3):
                    n = int(rng.integers(2, 25))
                    at = int(rng.integers(0, max(1, len(words) - n)))
                    spans.append(words[at:at + n])
                for span in spans:
                    if span:
                        u, c = np.unique(subwords(span)[1], return_counts=True)
                        out.append((place, doc, lang, u.astype("<i4").tobytes(), c.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds) if out else pa.RecordBatch.from_pylist([], schema=kinds)

    bags = rows.filter(chosen).select(draw.alias("place"), F.col("doc_id").cast("long"), "lang", "text").mapInArrow(
        work, "place double, doc_id long, lang string, buckets binary, counts binary")
    # A doc_id that many rows repeat fills the sample of its own language alone.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "buckets"))
    got = bags.withColumn("rank", rank).filter(F.col("rank") <= 8 * sample).drop("rank").collect()
    got.sort(key=lambda r: (r["place"], r["doc_id"], r["lang"], bytes(r["buckets"])))
    number = {name: k for k, name in enumerate(languages)}
    sets: tuple[list, list] = ([], [])
    for r in got:
        sets[r["doc_id"] % 4 == 3].append((number[r["lang"]], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["counts"], "<i4")))
    trained = {k for k, _, _ in sets[0]}
    sets[0].extend(bag for bag in sets[1] if bag[0] not in trained)
    return train(sets[0], sets[1], languages)


class Judge:
    """Scores whole texts; the score sums of each word are worked out once per worker task."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[bytes, int] = {}
        self.sums = np.zeros((0, model.vectors.shape[1] + 1))

    def _learn(self, words: list[bytes]) -> None:
        if len(self.place) > KNOWN_WORDS:
            self.place, self.sums = {}, self.sums[:0]
        new = sorted(set(words).difference(self.place))
        if not new:
            return
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        who, what = subwords(new)
        rows = np.empty((len(new), self.sums.shape[1]))
        for k in range(self.model.vectors.shape[1]):
            rows[:, k] = np.bincount(who, self.model.vectors[what, k], len(new))
        rows[:, -1] = np.bincount(who, minlength=len(new))
        self.sums = np.concatenate([self.sums, rows])

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lists = [word_list(t) for t in texts]
        flat = [w for ws in lists for w in ws]
        self._learn(flat)
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
        sums = np.zeros((len(texts), self.sums.shape[1]))
        full = np.flatnonzero(sizes)
        if len(full):
            begins = (np.cumsum(sizes) - sizes)[full]
            sums[full] = np.add.reduceat(self.sums[at], begins, axis=0)
        x = sums[:, :-1] / np.maximum(sums[:, -1:], 1)
        names, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i, j in _row_blocks(len(texts), len(self.model.weights)):
            p = _softmax(self.model.sharpness * (x[i:j] @ self.model.weights.T))
            names[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
        known = [bool(self.model.languages) and bool(t) and any(map(str.isalpha, t)) for t in texts]
        langs = [self.model.languages[k] if ok else NONE for k, ok in zip(names.tolist(), known)]
        scores = np.where(known, np.clip(score, 0, 1), 0.0)
        return langs, scores.tolist(), [ok and s >= self.model.floor for ok, s in zip(known, scores.tolist())]


def _judged(docs: DataFrame, sample: int) -> DataFrame:
    """``docs`` plus ``_lid``, a struct of lang_pred, score and accepted."""
    model = fit(docs, sample)
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.vectors, model.weights, model.sharpness, model.floor))

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drop_worker_state()
        judge = Judge(Model(*sent.value))
        for texts in batches:
            texts = [t if isinstance(t, str) else None for t in texts]
            found: tuple[list, list, list] = ([], [], [])
            for i, j in runs(texts):
                for into, part in zip(found, judge.judge(texts[i:j])):
                    into.extend(part)
            yield pd.DataFrame(dict(zip(("lang_pred", "score", "accepted"), found)))

    return docs.withColumn("_lid", predict("text"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` plus lang_pred, score and accepted (columns of those names are replaced).

    The model is learned from ``docs`` (see :func:`fit`); a prediction reads the
    text alone. ``lang_pred`` is a learned language; a text that is null or has
    no letter is ``und`` with score 0 and not accepted, and so is every text if
    no labelled text was there to learn from. ``accepted`` is whether the score
    reaches the calibrated floor. Rows that repeat a doc_id are judged each for
    itself; rows without one are judged and never learned from. An empty table
    gives an empty table.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    return _judged(docs, sample).select(*kept, "_lid.lang_pred", "_lid.score", "_lid.accepted")


def accepted_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that :func:`identify` accepts, columns unchanged."""
    return _judged(docs, sample).filter("_lid.accepted").select(*docs.columns)


def language_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out (false without a doc_id), lang_pred, score, accepted."""
    out = identify(docs.select("doc_id", "lang", "text"), sample)
    return out.select("doc_id", F.coalesce(_held_out(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
