"""Line deduplication with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, settle


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc, pos, h1, h2) for each line whose normalised form has at least ``min_chars`` code points.

    A key is carried as two 64-bit hashes of the normalised line, so that the
    tables stay small and a false meeting is out of reach (128 bits).
    """
    lines = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("doc"), F.posexplode(_lines(ascii_lower(F.col("text")))).alias("pos", "line"))
    keyed = lines.select("doc", "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select("doc", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def dropped_positions(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, gone): the positions of the lines each document loses, for documents that lose any.

    A frequent line may sit in a third of all documents: its documents are
    counted by (key, document) first and then by key, both with partial sums,
    and the join back to the lines is one whose large keys Spark splits.
    """
    keys = settle(line_keys(docs, min_chars))
    shared = keys.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("keeper"))
    shared = settle(shared.filter(F.col("n") >= min_docs).drop("n"))
    lost = keys.join(shared, ["h1", "h2"]).filter(F.col("doc") != F.col("keeper"))
    return lost.groupBy("doc").agg(F.collect_set("pos").alias("gone"))


def _thinned(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``docs`` plus ``_ld_text``, ``_ld_lines`` and ``_ld_dropped``."""
    gone = dropped_positions(docs, min_chars, min_docs)
    joined = docs.join(gone.select(F.col("doc").alias("_ld_doc"), F.col("gone").alias("_ld_gone")), F.col("doc_id") == F.col("_ld_doc"), "left")
    lines = _lines(F.col("text"))
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    text = F.when(F.col("_ld_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(F.array_except(places, F.col("_ld_gone")), lambda i: F.get(lines, i)), "\n"))
    dropped = F.coalesce(F.size(F.array_intersect(places, F.col("_ld_gone"))), F.lit(0))
    return joined.withColumns({"_ld_text": text, "_ld_lines": F.size(lines).cast("long"), "_ld_dropped": dropped.cast("long")})


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines found in many documents; the largest doc_id that holds a line keeps all its copies.

    Texts are cut at line feeds. A line's key is the line without ASCII white
    space at its ends and with A-Z lower-cased. Lines whose key has at least
    ``min_chars`` code points and occurs in at least ``min_docs`` documents go,
    except in the largest doc_id; the other lines stay, joined by line feeds.

    Returns the columns of ``docs`` with ``text`` replaced, plus ``n_lines``
    (before) and ``n_dropped``; columns of those names are replaced. A null or
    empty text is one empty line and gives an empty text. Rows without a doc_id
    count as no document and keep their lines. Rows that repeat a doc_id count
    as one document and lose the union of their positions, which are the same
    for true repeats. An empty table gives an empty table.
    """
    kept = [F.col("_ld_text").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _thinned(docs, min_chars, min_docs).select(*kept, F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"))


def without_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the texts that :func:`line_dedup` leaves, columns unchanged."""
    return _thinned(docs, min_chars, min_docs).select(*[F.col("_ld_text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
