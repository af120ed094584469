"""Quality rules whose cutoffs are chosen under a bound on false rejections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, settle

SYMBOLS = "#*$%&|<>"
#: Lower ends of the strata, in words. Texts below the first fail the base rules.
BANDS = (50, 200, 1_000, 5_000)

#: Rules: a score and its candidate cutoffs, from the loosest to the strictest. A text is rejected at a score of the cutoff or more.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [round(3.0 * 0.85**k, 6) for k in range(40)]),
    "calls": ("n_calls / n_words", [round(3.0 * 0.85**k, 6) for k in range(40)]),
    "same_lines": ("n_dup_lines / greatest(n_lines, 1)", [round(1.0 - 0.025 * k, 6) for k in range(39)]),
    "same_words": ("n_repeat_words / n_words", [round(0.5 - 0.0125 * k, 6) for k in range(39)]),
    "long_words": ("word_chars / n_words", [round(40.0 * 0.95**k, 6) for k in range(45)]),
    "short_words": ("n_words / word_chars", [round(1.0 * 0.95**k, 6) for k in range(45)]),
}

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_calls")


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the list."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    v = len(number)
    if v < 2_000_000:
        code = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        code = pair[:-1] * v + ids[2:]
    ordered = np.sort(code)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    hit = twice[np.minimum(np.searchsorted(twice, code), len(twice) - 1)] == code
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= hit
    return int(covered.sum())


def _features(t: str | None) -> tuple[int, ...]:
    t = t or ""
    words = t.encode().split()  # splits at ASCII white space
    lines = [x for x in t.split("\n") if x.strip(BLANKS)]
    return (len(words), len(t) - sum(map(t.count, BLANKS)), sum(map(t.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), t.count("!") + t.count("?"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``FEATURES`` of every whole text; a null text has none of anything."""
    kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", *FEATURES)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], schema=kinds) if rows else pa.RecordBatch.from_pylist([], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ", ".join(f"{n} long" for n in ("doc_id", *FEATURES)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _band() -> Column:
    return sum((F.col("n_words") >= b).cast("int") for b in BANDS[1:])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exactly: the terms from k downwards, as a ratio to the largest, until they vanish."""
    if k >= n:
        return 1.0
    top = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    if k > n * p:  # sum the other side, where the terms fall
        term = total = top * (n - k) / (k + 1) * p / (1 - p)
        i = k + 1
        while i < n and term > total * 1e-17:
            term *= (n - i) / (i + 1) * p / (1 - p)
            total += term
            i += 1
        return max(0.0, 1.0 - total)
    term = total = top
    while k > 0 and term > total * 1e-17:
        term *= k / (n - k + 1) * (1 - p) / p
        total += term
        k -= 1
    return min(1.0, total)


def choose_cutoffs(counts: dict[tuple[int, str, int], int], alpha: float, delta: float) -> dict[tuple[int, str], float]:
    """The strictest safe cutoff per (stratum, rule), from counts of good texts per (stratum, rule, cutoffs reached).

    With probability 1 - delta at least, no stratum loses more than ``alpha`` of
    its good texts: each rule may take ``alpha`` over the number of rules, and a
    cutoff is safe if as few rejections as were seen would be rarer than its
    share of ``delta`` at a higher rate (the exact binomial bound). ``delta`` is
    divided over strata and rules; along a rule, cutoffs are tested from the
    loosest on and the first failure ends it, so the order needs no further share.
    """
    share, level, out = alpha / len(RULES), delta / (len(RULES) * len(BANDS)), {}
    for band in range(len(BANDS)):
        for rule, (_, cuts) in RULES.items():
            reached = [counts.get((band, rule, k), 0) for k in range(len(cuts) + 1)]
            n = sum(reached)
            for k, cut in enumerate(cuts):
                rejected = sum(reached[k + 1:])
                if not n or binomial_tail(rejected, n, share) > level:
                    break
                out[band, rule] = cut
    return out


def score_counts(scored: DataFrame, labels: DataFrame) -> dict[tuple[int, str, int], int]:
    """Good labelled texts per (stratum, rule, number of cutoffs reached): at most strata x rules x cutoffs rows reach the driver."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).filter(F.col("q") == 1)
    rows = scored.filter(~base_failed()).join(good.select(F.col("doc_id").alias("_good")), F.col("doc_id") == F.col("_good"))

    def n_reached(score: str, cuts: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.expr(score)))

    reached = F.array(*[F.struct(F.lit(rule).alias("rule"), n_reached(score, cuts).alias("k")) for rule, (score, cuts) in RULES.items()])
    found = rows.select(_band().alias("band"), F.explode(reached).alias("x")).groupBy("band", "x.rule", "x.k").count()
    return {(r["band"], r["rule"], r["k"]): r["count"] for r in found.collect()}


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """Per row: doc_id, the features, ``base_failed`` and ``kept``.

    Cutoffs are learned from all documents with a label (quality 1 is good;
    of several labels of a document the best counts), by :func:`choose_cutoffs`
    on strata of text length. Where labels are too few to prove a cutoff safe,
    the rule rejects nothing. A null or empty text has no words and fails the
    base rules. Rows that repeat a doc_id are judged each for itself; rows
    without one are judged but can't be labelled. An empty table gives an empty table.
    """
    scored = settle(features(docs))
    cuts = choose_cutoffs(score_counts(scored, labels), alpha, delta)
    bad = F.lit(False)
    for (band, rule), cut in cuts.items():
        bad = bad | ((_band() == band) & (F.expr(RULES[rule][0]) >= cut))
    failed = base_failed()
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.when(failed, F.lit(False)).otherwise(bad))
