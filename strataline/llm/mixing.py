"""Mixing sources to target weights: capped water-filling and seeded repetitions, with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle

#: Source tables up to this many rows are sent to all executors; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000


def _mark(doc_id: Column, seed: int) -> Column:
    """A seeded order of documents that depends on doc_id alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source"), size.alias("size"), _mark(F.col("doc_id"), seed).alias("mark"))


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Targets per source from (source, source_size): weights are dealt to sources in code point order, null last.

    All targets add up to ``share`` times all sizes. A source stops at
    ``epochs`` times its size and the excess goes to the others by weight, until
    none is above. That fixed point is found in one pass: sources are sorted by
    the water level at which they fill up, and the first level is taken that
    the ones still open can hold. There is one row per source here, already
    summed, so the ordered windows run over a table of sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", deal).withColumn("cap", F.col("source_size") * epochs)
    level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(0, Window.unboundedFollowing)
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(onward),
        "total": F.sum("source_size").over(everything) * F.lit(share),
        "rank": F.row_number().over(level),
    })
    # The first source that its share doesn't overfill; from it on all targets follow the same level.
    left = F.col("total") - F.col("full")
    s = s.withColumn("stop", F.min(F.when(F.col("weight") * left / F.col("open") <= F.col("cap"), F.struct("rank", left.alias("left"), "open"))).over(everything))
    target = F.when(F.col("stop").isNull() | (F.col("rank") < F.col("stop.rank")), F.col("cap").cast("double")).otherwise(
        F.col("weight") * F.col("stop.left") / F.col("stop.open"))
    return s.select("source", "source_size", target.alias("target"))


def _cutoffs(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``cut``: documents whose mark is at most it are repeated once more than the others of their source.

    The words still wanted are met by a prefix of the seeded order. Its end is
    found by sums over 256 bins of the mark, then 256 finer bins inside the one
    that holds the end, then the marks inside that: no source is ever sorted
    whole, and each step shuffles sums alone.
    """
    state = sources.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumns({"prefix": F.lit(""), "done": F.lit(0)})
    for width in (2, 4, 32):
        inside = sized.join(_few(state.select(F.col("source").alias("_s"), "prefix", "done", "need")),
                            F.col("source").eqNullSafe(F.col("_s")) & F.col("mark").startswith(F.col("prefix"))).drop("_s")
        bins = inside.groupBy("source", "prefix", "done", "need", F.substring("mark", 1, width).alias("bin")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin")) + F.col("done")
        bins = bins.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("words"))
        if width < 32:
            # The bin that holds the wanted number; what lies before it is taken whole.
            held = bins.filter((F.col("below") <= F.col("need")) & (F.col("need") < F.col("upto")))
            ends = held.groupBy("source").agg(F.min_by("bin", "bin").alias("b"), F.min_by("below", "bin").alias("d"))
        else:
            # The nearest end: a document is in if the middle of its words is.
            ends = bins.filter(F.col("below") + F.col("words") / 2 <= F.col("need")).groupBy("source").agg(F.max("bin").alias("b"), F.lit(0).alias("d"))
        ends = ends.select(F.col("source").alias("_s"), F.col("b").alias("_b"), F.col("d").alias("_d"))
        joined = state.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
        if width < 32:
            state = joined.withColumns({"prefix": F.coalesce("_b", "prefix"), "done": F.coalesce("_d", "done")}).drop("_s", "_b", "_d")
        else:
            # No document of the last bin is in: everything before the bin still is.
            state = joined.withColumn("cut", F.coalesce("_b", "prefix")).drop("_s", "_b", "_d")
        state = settle(state)
    return state


def _few(sources: DataFrame) -> DataFrame:
    """The source table with a broadcast hint if it was counted to be small."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def mixture(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Per source: source_size, target, ``whole`` repetitions and the ``cut`` below which one more is taken."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = water_fill(sizes, weights, share, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = settle(sources.withColumn("whole", F.floor(rate)))
    return _cutoffs(sized, sources).select("source", "source_size", "target", "whole", "cut")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 20) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target and ``times``, how often the mix takes it.

    Size is the number of words; a null text has none. Rows of a null source
    form a source of their own. Rows that repeat a doc_id share its place in the
    seeded order and so are taken equally often. ``times`` is at most ``epochs``.
    A source of size 0 has target 0. An empty table gives an empty table.
    """
    sized = settle(_sized(docs, seed))
    plan = _few(mixture(sized, weights, share, epochs).withColumnRenamed("source", "_s"))
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", _times().alias("times"))


def _times() -> Column:
    return F.col("whole") + F.when(F.col("mark") <= F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: int = 20) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as :func:`mix_plan` takes it, columns unchanged.

    Only the table of sources is joined to the texts, which stay where they are.
    """
    sized = settle(_sized(docs, seed))
    plan = mixture(sized, weights, share, epochs).select(*[F.col(c).alias(f"_mx_{c}") for c in ("source", "whole", "cut")])
    extra = F.when(_mark(F.col("doc_id"), seed) <= F.col("_mx_cut"), 1).otherwise(0)
    out = docs.join(_few(plan), F.col("source").eqNullSafe(F.col("_mx_source")))
    out = out.withColumn("_mx_n", (F.col("_mx_whole") + extra).cast("int")).filter(F.col("_mx_n") > 0)
    return out.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_n")))).select(*docs.columns)
