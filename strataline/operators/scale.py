"""Ordered work inside groups that may be very large.

A plain ``Window.partitionBy(key)`` puts a whole group into one task. The
helpers here deal rows to ranges of (group, order), work inside these slices,
and combine slice totals, so one hot key never lands in one task. Slices are
written tables, so a lost executor reads the same ones again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import intermediate

#: Rows of a slice of a large table, and slices that a task of a later step holds on average.
SLICE_ROWS, TASK_SLICES = 250_000, 2
#: Hash buckets in which :func:`heavy` looks for large keys; bits of a bitmap of :func:`marks` as a power of two.
BUCKETS, MARK_BITS = 1 << 14, 27


def settle(df: DataFrame, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write an intermediate result that several later steps read, and read it back.

    A parquet table in the shared folder outlives executors, is read column by
    column, and gives the planner its true size for join choices. With ``by``,
    readers that filter on that column read its wanted partitions only; it must
    have few values. ``codec`` is parquet's compression, by default the session's.
    """
    spark = df.sparkSession
    path = intermediate(spark, "tables")
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_slice``: rows dealt to ranges of (keys, order), written once and read by all later steps.

    A large group spans as many ranges as its size asks for, a range holds many
    small groups, and rows equal in keys and order are in one range. So no task
    grows with a group, and slice numbers rise with the order inside each group.
    A large table has as many ranges as its rows ask for, so a range does not
    grow with the table either.
    """
    rows = settle(df)  # ranges are found from a sample, so ``df`` would be evaluated twice
    dealt = rows.repartitionByRange(*_beyond(rows, SLICE_ROWS), *[F.col(c) for c in (*keys, *order)])
    return settle(dealt.withColumn("_slice", F.spark_partition_id()))


def _beyond(rows: DataFrame, size: int) -> list[int]:
    """The number of tasks of ``size`` rows for a written table, if it is above the session's shuffle partitions; else nothing."""
    n = math.ceil(rows.count() / size)
    return [n] if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []


def heavy(rows: DataFrame, key: str, most: int, n: Column | None = None) -> DataFrame | None:
    """(key, n) of the keys with more than ``most`` rows (or a sum of ``n`` above it), None if there are none.

    Rows are counted per hash bucket first, and per key only in buckets that hold
    more than ``most``, so the counts of the many small keys are not shuffled.
    """
    kept = rows.select(key, (F.lit(1).cast("double") if n is None else n.cast("double")).alias("n"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"))
    full = settle(kept.groupBy("_bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("_bucket"))
    if full.isEmpty():
        return None
    found = settle(kept.join(F.broadcast(full), "_bucket", "left_semi").groupBy(key).agg(F.sum("n").alias("n")).filter(F.col("n") > most))
    return None if found.isEmpty() else found


def _mark(key: str) -> tuple[Column, Column, Column]:
    """(row, word in the row, mask of four bits in the word) of a key."""
    hashed, mask = F.xxhash64(key), F.lit(0).cast("long")
    at = hashed.bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    for shift in (32, 38, 44, 50):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(hashed, shift).bitwiseAND(F.lit(63)).cast("int")))
    return F.shiftright(at, 9), F.shiftright(at, 6).bitwiseAND(F.lit(7)).cast("int"), mask


def marks(keys: DataFrame, key: str) -> DataFrame:
    """Bitmap of the hashes of a column (a Bloom filter by words), 512 bits a row: 16 MB at most, whatever the keys.

    Of other keys it holds one in a thousand by five million keys, one in a
    hundred by twelve million, and the more the less it sorts out beyond.
    """
    row, word, mask = _mark(key)
    rows = keys.select(row.alias("_row"), word.alias("_word"), mask.alias("_mask"))
    words = [F.bit_or(F.when(F.col("_word") == i, F.col("_mask")).otherwise(F.lit(0).cast("long"))).alias(f"_w{i}") for i in range(8)]
    return settle(rows.groupBy("_row").agg(*words).select("_row", F.array(*[f"_w{i}" for i in range(8)]).alias("_words")))


def marked(df: DataFrame, key: str, bits: DataFrame, name: str) -> DataFrame:
    """Add the boolean ``name``: false only where ``key`` is none of the keys of :func:`marks`. It keeps rows from a shuffle, an exact join has to follow."""
    row, word, mask = _mark(key)
    held = F.col("_words")[F.col("_word")].bitwiseAND(F.col("_mask")) == F.col("_mask")
    hashed = df.withColumns({"_row": row, "_word": word, "_mask": mask})
    return hashed.join(F.broadcast(bits), "_row", "left").select(*df.columns, F.coalesce(held, F.lit(False)).alias(name))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums of ``sums`` in ``order``; ``order`` must be unique in a group.

    The input is evaluated once: sums inside slices, plus the totals of the
    slices before, of which a group has one row per slice.
    """
    base = sliced(df.withColumns({f"_v_{n}": c for n, c in sums.items()}), keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = totals.select(*keys, "_slice", *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums])
    many = _beyond(base, TASK_SLICES * SLICE_ROWS)
    dealt = base.repartition(*many, *keys, "_slice") if many else base
    out = dealt.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(offsets, [*keys, "_slice"])
    out = out.withColumns({n: F.col(f"_r_{n}") + F.col(f"_o_{n}") for n in sums})
    return out.drop("_slice", *[f"_{p}_{n}" for p in "vro" for n in sums])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Number rows 1.. inside each group."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def blocked(df: DataFrame, keys: list[str], position: str, back: int = 0, ahead: int = 0,
            size: int = 10_000) -> DataFrame:
    """Cut numbered groups into blocks that overlap by the rows a bounded frame needs.

    Adds ``_block`` and ``_own``. Windows over (keys, _block) with frames up to
    ``back`` rows before or ``ahead`` rows after see the same rows as over the
    whole group, for rows with ``_own``; drop the others afterwards.
    """
    assert max(back, ahead) < size
    at = F.floor(F.col(position) / size)
    options = [F.struct(at.alias("b"), F.lit(True).alias("o"))]
    if back:
        options.append(F.when(F.pmod(F.col(position), F.lit(size)) >= size - back,
                              F.struct((at + 1).alias("b"), F.lit(False).alias("o"))))
    if ahead:
        options.append(F.when(F.pmod(F.col(position), F.lit(size)) < ahead,
                              F.struct((at - 1).alias("b"), F.lit(False).alias("o"))))
    return (df.withColumn("_p", F.explode(F.array_compact(F.array(*options))))
            .withColumns({"_block": F.col("_p.b"), "_own": F.col("_p.o")}).drop("_p"))


def with_prior(df: DataFrame, keys: list[str], order: list[str], prefix: str = "prev_") -> DataFrame:
    """Rows with all columns of the row before in their group; the first row of a group is left out."""
    rows = settle(numbered(df, keys, order))
    before = rows.select(*keys, (F.col("rn") + 1).alias("rn"), *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])
    return rows.join(before, [*keys, "rn"])


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Add ``prev``: the values of the n rows before, oldest first. Joins on (keys, position), so no group is gathered."""
    rows = settle(numbered(df, keys, order))
    ahead = rows.select(*keys, F.col("rn").alias("_at"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_j"))
    lists = ahead.groupBy(*keys, (F.col("_at") + F.col("_j")).alias("rn")).agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_l"))
    out = rows.join(lists, [*keys, "rn"], "left")
    return out.withColumn("prev", F.coalesce(F.transform("_l", lambda x: x["_v"]), F.array().cast("array<string>"))).drop("_l")


def value_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per distinct value: ``cnt`` rows, ``upto`` rows at or below it."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    return running(counts, keys, [value], {"upto": F.col("cnt")})


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Sizes are written first: the planner then knows that a few groups are few
    rows, and does not shuffle all values to one task per group for the join.
    """
    runs = value_runs(df, keys, value)
    size = settle(df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    runs = runs.join(size, keys)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        for tag, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("upto") - F.col("cnt") <= idx) & (idx < F.col("upto"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
    out = runs.groupBy(*keys, "_n").agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)
