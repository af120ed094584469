"""Coherence scores of segments against the segments before them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons
from ..functions.text import count_hits, sentences

#: Rows whose tokens are compared at once.
COMPARED_ROWS = 256
WORD = r"([\p{L}\p{N}_]+)"
CAPITAL = r"(?<![\p{L}\p{N}_])([A-Z][a-z]+)(?![\p{L}\p{N}_])"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def _lcs(a, b) -> int:
    """Longest common subsequence with one big integer per row of the table."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    row = 0
    for w in b:
        x = row | where.get(w, 0)
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def _f1(generated: pa.Array, reference: pa.Array) -> pa.Array:
    """F1 of token lists; words become numbers and lists become Python's some rows at a time, however many a batch has."""
    out = []
    for at in range(0, len(generated), COMPARED_ROWS):
        sides = [x.slice(at, COMPARED_ROWS) for x in (generated, reference)]
        codes = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode().indices.to_numpy()
        ends = np.cumsum(np.concatenate([np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64) for x in sides]))
        lists = np.split(codes, ends[:-1])
        for g, r in zip(lists, lists[len(sides[0]):]):
            n = _lcs(g.tolist(), r.tolist()) if len(g) and len(r) else 0
            p, q = (n / len(g), n / len(r)) if n else (0.0, 0.0)
            out.append(2 * p * q / (p + q) if n else 0.0)
    return pa.array(out, pa.float64())


def rouge_l(generated: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of two token arrays, in Arrow batches."""
    return F.arrow_udf(_f1, T.DoubleType())(generated, reference)


def _share(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def _pairs(t: Column) -> Column:
    return F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))


def lexical(df: DataFrame, context: str = "context", first: int | None = None) -> DataFrame:
    """Unigram, bigram and subsequence overlap with context and the last three segments; adds overlap, rouge_l, lexical.

    The subsequence is that of the whole texts, or of their first so many tokens.
    """
    ref = F.concat_ws(" ", F.col(context), F.array_join("prev", " "))
    d = df.withColumns({"_g": tokens(F.col("text")), "_r": tokens(ref)})
    empty = (F.size("_g") == 0) | (F.size("_r") == 0)
    bi = F.when(F.size("_g") > 1, _share(_pairs(F.col("_g")), _pairs(F.col("_r")))).otherwise(0.0)
    d = d.withColumns({"overlap": F.when(empty, F.lit(None).cast("double")).otherwise(_share(F.col("_g"), F.col("_r")) * 0.3 + bi * 0.3),
                       "rouge_l": rouge_l(F.col("_g"), F.col("_r")) if first is None else rouge_l(F.slice("_g", 1, first), F.slice("_r", 1, first))})
    return d.withColumn("lexical", F.coalesce(F.col("overlap") + F.col("rouge_l") * 0.4, F.lit(0.5))).drop("_g", "_r")


def discourse(text: Column, prev: Column, names: list[str]) -> Column:
    """Known names, few new names, names shared with the last two segments (two texts, oldest first)."""
    known = count_hits(F.lower(text), [n.lower() for n in names]) / max(1, len(names))
    caps = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(CAPITAL), F.lit(1)))
    found = caps(text)
    fresh = F.size(F.filter(found, lambda n: ~n.isin(*lexicons.NOT_NEW)))
    before = F.array_join(F.slice(prev, F.greatest(F.size(prev) - 1, F.lit(1)), 2), " ")
    shared = F.when((before == "") | (F.size(found) == 0), 0.5).otherwise(F.size(F.array_intersect(found, caps(before))) / F.size(found))
    return (known if names else F.lit(0.5)) * 0.4 + F.greatest(F.lit(0.0), 1 - fresh * 0.15) * 0.3 + shared * 0.3


def temporal(text: Column) -> Column:
    low = F.lower(text)
    t = tokens(text)
    count = lambda ws: F.size(F.filter(t, lambda w: w.isin(*ws)))
    past, present = count(lexicons.PAST_WORDS), count(lexicons.PRESENT_WORDS)
    tense = F.when(past + present > 0, F.greatest(past, present) / (past + present)).otherwise(0.7)
    order = F.least(F.lit(1.0), count_hits(low, lexicons.SEQUENCE_WORDS) / 3)
    off = sum((F.when(low.rlike(p), w).otherwise(0.0) for p, w in lexicons.TIME_PENALTIES), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), tense * 0.5 + order * 0.3 + 0.2 + off))


def voice(text: Column, prev: Column) -> Column:
    """Sentence length, point of view and vocabulary against the last three segments; one without any."""
    ref = F.array_join(prev, " ")
    long = lambda x: F.filter(sentences(x), lambda s: F.length(s) > 10)
    mean = lambda s: F.aggregate(F.transform(s, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))), F.lit(0), lambda a, x: a + x) / F.size(s)
    a, b = mean(long(text)), mean(long(ref))
    length = F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(b, F.lit(1.0)))

    def view(x):
        t = tokens(x)
        i, they = F.size(F.filter(t, lambda w: w.isin(*lexicons.FIRST_PERSON))), F.size(F.filter(t, lambda w: w.isin(*lexicons.THIRD_PERSON)))
        return i / (i + they + 1)

    def variety(x):
        t = tokens(x)
        return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.array_distinct(t)) / F.size(t))

    pov = 1 - F.abs(view(text) - view(ref))
    vocab = 1 - F.least(F.abs(variety(text) - variety(ref)) * 2, F.lit(1.0))
    return (F.when(F.size(prev) == 0, 1.0).when((F.size(long(text)) == 0) | (F.size(long(ref)) == 0), 0.5)
            .otherwise(length * 0.3 + pov * 0.5 + vocab * 0.2))


def semantic(overall: Column, mean: Column, variance: Column) -> Column:
    """From the whole-text cosine and the mean and variance of the best sentence cosines."""
    return F.least(F.lit(1.0), overall * 0.6 + mean * 0.3 + F.greatest(F.lit(0.0), 0.1 - variance))


def composite(df: DataFrame) -> DataFrame:
    total = sum((F.col(c) * w for c, w in lexicons.COHERENCE_WEIGHTS.items()), F.lit(0.0))
    return df.withColumn("composite", total)


def compare_approaches(scored: DataFrame, by: str = "story") -> DataFrame:
    return scored.groupBy(by).pivot("approach", lexicons.APPROACHES).agg(F.avg("composite"))
