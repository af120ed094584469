"""Batch retrieval: BM25, exact vector search, rank fusion, caches."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import any_hit, count_hits, head, tokens, words
from ..session import is_written
from .scale import blocked, numbered, settle
from .vectors import vector_top_k

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of a block of documents and of queries: they bound what a task holds.
BLOCK_DOCS, BLOCK_QUERIES = 4_096, 512
#: Blocks that a query searches before it knows how much a hit must score.
FIRST_BLOCKS = 4
#: Documents whose words are counted at once.
COUNTED_ROWS = 256


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """First k rows per group; Spark keeps only k rows per group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, terms) in, a row (doc, dl, term, tf) per document and different term out; rows are counted a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, COUNTED_ROWS):
            b = batch.slice(at, COUNTED_ROWS)
            lists = b.column("terms")
            term = lists.flatten().dictionary_encode()
            length = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            width = max(1, len(term.dictionary))
            met, tf = np.unique(np.repeat(np.arange(len(length)), length) * width + np.asarray(term.indices, np.int64), return_counts=True)
            row = met // width
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row)), pa.array(length[row].astype(np.int32)), term.dictionary.take(pa.array(met % width)), pa.array(tf.astype(np.int64))],
                                             ["doc", "dl", "term", "tf"])


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, dl, term, tf); the length rides along, so no join is needed.

    A document's terms are counted where it is read. Only documents whose key
    occurs again are shuffled, as rows of one key and length count together.
    """
    t = docs.select(F.col(doc).alias("doc"), F.col(text).alias("_text"))
    again = settle(t.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc").alias("_doc")))
    kind = dict(t.dtypes)["doc"]
    count = lambda d: d.select("doc", tokens(F.col("_text")).alias("terms")).mapInArrow(_counted, f"doc {kind}, dl int, term string, tf long")
    if again.isEmpty():
        return count(t)
    same = F.col("doc").eqNullSafe(F.col("_doc"))
    once, more = count(t.join(again, same, "left_anti")), count(t.join(again, same, "left_semi"))
    return once.unionByName(more.groupBy("doc", "dl", "term").agg(F.sum("tf").alias("tf")))


def term_statistics(post: DataFrame) -> DataFrame:
    """(term, df, idf, avgdl): negative idf is replaced by epsilon times the mean idf."""
    size = post.groupBy("doc", "dl").agg(F.count(F.lit(1)).alias("_u")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    dfs = settle(post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))).join(F.broadcast(size), F.lit(True))
    raw = dfs.withColumn("raw", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.join(F.broadcast(mean), F.lit(True)).select(
        "term", "df", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def _term_scores(q: pd.DataFrame, p: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k documents of one block per query of one block, by a table of queries and documents that a term at a time is added to."""
    qids, qi = np.unique(q["qid"].to_numpy(), return_inverse=True)
    docs, di = np.unique(p["doc"].to_numpy(), return_inverse=True)
    score, met = np.zeros((len(qids), len(docs))), np.zeros((len(qids), len(docs)), bool)
    weight, asked = (q["qtf"] * q["idf"]).to_numpy(), q.groupby("term", sort=True).indices
    for term, rows in p.groupby("term", sort=True).indices.items():
        if term in asked:
            at = np.ix_(qi[asked[term]], di[rows])
            score[at] += weight[asked[term]][:, None] * p["gain"].to_numpy()[rows][None, :]
            met[at] = True
    score = np.where(met, np.round(score, 9), -np.inf)
    top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # documents rise, so ties go to the smaller one
    value = np.take_along_axis(score, top, axis=1).ravel()
    rows = pd.DataFrame({"qid": np.repeat(qids, top.shape[1]), "doc": docs[top].ravel(), "score": value})
    return rows[np.isfinite(value)]


def bounded_blocks(asked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, db, top): no document of block ``db`` scores more for the query than ``top``.

    A term adds at most its weight times the greatest gain it has in the block
    (block-max); a term of negative weight adds nothing at best. Some numbers
    per query and block that share a term; no document is named.
    """
    most = wanted.groupBy("term", "db").agg(F.max("gain").alias("most"))
    part = F.greatest(F.col("qtf") * F.col("idf"), F.lit(0.0)) * F.col("most")
    return asked.join(most, "term").groupBy("qid", "db").agg((F.sum(part) * (1 + 1e-9) + 1e-8).alias("top"))


def _scored(pairs: DataFrame, asked: DataFrame, wanted: DataFrame, k: int, n_q: int) -> DataFrame:
    """(qid, doc, score): the best ``k`` documents of every (query, block) pair; postings go to those query blocks alone that ask for their block."""
    placed = pairs.select("qid", "db").withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int"))
    left = asked.join(placed, "qid").groupBy("qb", "db")
    blocks = placed.select(F.col("qb").alias("qb"), F.col("db").alias("db")).distinct()
    right = wanted.join(blocks, "db").groupBy("qb", "db")
    return left.cogroup(right).applyInPandas(
        lambda q, p: _term_scores(q, p, k) if len(q) and len(p) else pd.DataFrame({"qid": [], "doc": [], "score": []}), "qid long, doc long, score double")


def bm25_scores(queries: DataFrame, post: DataFrame, stats: DataFrame, k: int, qid: str = "qid", text: str = "query") -> DataFrame:
    """(qid, doc, score): enough of the documents that share a term with a query to hold its first ``k``.

    Postings of asked terms are dealt to blocks of about ``BLOCK_DOCS``
    documents. Each query first searches the ``FIRST_BLOCKS`` of its highest
    bounds (:func:`bounded_blocks`). The k-th score found there is a floor, and it
    goes on to those blocks alone whose bound reaches it; a query with fewer
    than ``k`` hits so far goes to all blocks that share a term. So neither a
    (query, document) pair nor a posting that cannot count is shuffled, and a
    term found in a third of all documents is spread over all blocks.
    """
    asked = settle(queries.select(F.col(qid).cast("long").alias("qid"), F.explode(tokens(F.col(text))).alias("term")).groupBy("qid", "term").agg(
        F.count(F.lit(1)).alias("qtf")).join(stats.select("term", "idf"), "term"))
    length = stats.agg(F.first("avgdl").alias("avgdl"))  # one row
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = lambda df, c, size: max(1, math.ceil((df.agg(F.approx_count_distinct(c)).first()[0] or 0) / size))
    n_q, n_d = parts(queries, qid, BLOCK_QUERIES), parts(post, "doc", BLOCK_DOCS)
    wanted = settle(post.join(asked.select("term").distinct(), "term", "left_semi").join(F.broadcast(length), F.lit(True)).select(
        F.col("doc").cast("long").alias("doc"), "term", gain.alias("gain")).withColumn("db", F.pmod(F.xxhash64("doc"), F.lit(n_d)).cast("int")))
    tops = settle(bounded_blocks(asked, wanted))
    first = settle(top_k(tops, ["qid"], [F.desc("top"), "db"], FIRST_BLOCKS))
    seeds = settle(_scored(first, asked, wanted, k, n_q))
    floors = top_k(seeds, ["qid"], [F.desc("score")], k).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).select("qid", "floor")
    rest = tops.join(first.select("qid", "db"), ["qid", "db"], "left_anti").join(floors, "qid", "left").filter(F.col("floor").isNull() | (F.col("top") >= F.col("floor")))
    return seeds.unionByName(_scored(rest, asked, wanted, k, n_q))


_STORED: dict[tuple, tuple[str, str]] = {}


def stored_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of a table of files, written once per state of those files and read again by later queries.

    Files are known by path, length and time of change, so a changed table gets
    an index of its own. :func:`~strataline.session.forget_intermediates`
    removes stored indexes with all else.
    """
    spark = docs.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    state = []
    for name in sorted(docs.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        state.append((name, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, doc, text, tuple(state))
    found = _STORED.get(key)
    if found and all(is_written(spark, p) for p in found):
        return tuple(spark.read.parquet(p) for p in found)
    post = settle(postings(docs, doc, text))
    stats = settle(term_statistics(post))
    _STORED[key] = tuple(os.path.dirname(df.inputFiles()[0]) for df in (post, stats)) if post.inputFiles() and stats.inputFiles() else ()
    if not _STORED[key]:
        del _STORED[key]
    return post, stats


def bm25_top_k(queries: DataFrame, post: DataFrame, stats: DataFrame, k: int, keep_zero: bool = False) -> DataFrame:
    """Ranked hits per query; optionally filled with zero-score documents up to k."""
    hits = top_k(bm25_scores(queries, post, stats, k), ["qid"], [F.desc("score"), "doc"], k)
    if not keep_zero:
        return hits.filter(F.col("score") > 0)
    short = queries.select("qid").join(hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k), "qid", "left_anti")
    # At most k hits can be among the first 2k documents, so these always suffice.
    spare = post.select("doc").distinct().orderBy("doc").limit(2 * k)
    fill = short.join(F.broadcast(spare), F.lit(True)).join(hits.select("qid", "doc"), ["qid", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(hits.drop("rank").unionByName(fill), ["qid"], [F.desc("score"), "doc"], k)


def fuse(lists: list[tuple[DataFrame, Column | float]], key: str, k: int, rrf_k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists (qid, key, rank)."""
    parts = [d.select("qid", key, ((F.lit(w) if isinstance(w, (int, float)) else w) / (rrf_k + F.col("rank"))).alias("part")) for d, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fused = out.groupBy("qid", key).agg(F.round(F.sum("part"), 9).alias("score"))
    return top_k(fused, ["qid"], [F.desc("score"), key], k)


def fuse_by_prefix(semantic: DataFrame, lexical: DataFrame, docs: DataFrame, k: int, sem_w: float = 0.5, lex_w: float = 0.5, chars: int | None = None) -> DataFrame:
    """Fusion keyed by content, or its first ``chars`` characters, so copies add up; the first content seen is kept."""
    sem_w, lex_w = sem_w / (sem_w + lex_w), lex_w / (sem_w + lex_w)
    d = docs.select(F.col("doc_id").alias("doc"), head("text", chars).alias("key"))
    lists = semantic.select("qid", "doc", "rank", F.lit(0).alias("src"), F.lit(sem_w).alias("w")).unionByName(
        lexical.select("qid", "doc", "rank", F.lit(1).alias("src"), F.lit(lex_w).alias("w"))).join(d, "doc")
    # The last entry of the semantic list wins over earlier ones; lexical ones only fill gaps.
    place = F.struct("src", F.when(F.col("src") == 0, -F.col("rank")).otherwise(F.col("rank")))
    fused = lists.groupBy("qid", "key").agg(F.round(F.sum(F.col("w") / (60 + F.col("rank"))), 9).alias("score"), F.min_by("doc", place).alias("doc"))
    return top_k(fused, ["qid"], [F.desc("score"), "key"], k).drop("key")


def question_weights(df: DataFrame, text: str) -> DataFrame:
    """Lexical and semantic weight from specific against conceptual words."""
    q = F.lower(text)
    s, c = count_hits(q, lexicons.SPECIFIC_WORDS), count_hits(q, lexicons.CONCEPTUAL_WORDS)
    return df.withColumns({"w_bm25": F.when(s > c, 0.65).when(c > s, 0.30).otherwise(0.4),
                           "w_semantic": F.when(s > c, 0.35).when(c > s, 0.70).otherwise(0.6)})


def question_type(df: DataFrame, text: str) -> DataFrame:
    n = F.size(words(F.col(text)))
    kind = F.when(n <= 3, "keyword").when(any_hit(F.lower(text), lexicons.CONCEPT_INDICATORS) | (n >= 8), "conceptual").otherwise("mixed")
    sem = F.when(kind == "keyword", 0.3).when(kind == "conceptual", 0.7).otherwise(0.5)
    return df.withColumns({"query_type": kind, "semantic_weight": sem, "lexical_weight": F.round(1 - sem, 6)})


def _compose(f, g):
    """g after f, for maps x -> clamp(s*x + d, lo, hi) with s = 1 or -1."""
    clamp = lambda v: F.least(F.greatest(v, g.lo), g.hi)
    a, b = g.s * f.lo + g.d, g.s * f.hi + g.d
    return F.struct((g.s * f.s).alias("s"), (g.s * f.d + g.d).alias("d"), clamp(F.least(a, b)).alias("lo"), clamp(F.greatest(a, b)).alias("hi"))


def adaptive_weights(feedback: DataFrame, by: str, order: str, rate: float = 0.1, least: int = 5, recent: int = 20) -> DataFrame:
    """Weights per question type after all ratings; input (by, order, rating 1-5, semantic_weight).

    Whether a rating moves the weight depends only on the last ``recent``
    ratings, and every move is a map x -> clamp(+-x + d) on [0, 1]. Such maps
    compose into one of the same form, so blocks of ratings are composed in
    parallel and the few block results in order.
    """
    rows = numbered(feedback.withColumn("r", F.col("rating") / 5.0), [by], [order])
    cut = blocked(rows, [by], "rn", back=recent - 1)
    w = Window.partitionBy(by, "_block").orderBy("rn").rowsBetween(-(recent - 1), 0)
    high, low = F.when(F.col("semantic_weight") > 0.5, F.col("r")), F.when(F.col("semantic_weight") <= 0.5, F.col("r"))
    seen = cut.withColumns({"m": F.round(F.avg("r").over(w), 9), "hi_m": F.round(F.avg(high).over(w), 9), "lo_m": F.round(F.avg(low).over(w), 9)}).filter("_own")
    moves = seen.filter((F.col("rn") >= least) & (F.col("m") < 0.6))
    both = F.col("hi_m").isNotNull() & F.col("lo_m").isNotNull()
    up = F.col("hi_m") > F.col("lo_m")
    step = F.struct(F.when(both, 1.0).otherwise(-1.0).alias("s"), F.when(both, F.when(up, rate).otherwise(-rate)).otherwise(1.0).alias("d"),
                    F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    level = moves.select(by, F.col("rn").alias("at"), step.alias("f"))
    same = F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("d"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    fold = lambda: F.aggregate(F.array_sort(F.collect_list(F.struct("at", "f"))), same, lambda acc, x: _compose(acc, x.f))
    for size in (10_000, 10_000):  # bounded lists per block, twice
        level = level.groupBy(by, F.floor(F.col("at") / size).alias("at")).agg(fold().alias("f"))
    final = level.groupBy(by).agg(fold().alias("f"))
    base = F.when(F.col(by) == "keyword", 0.3).when(F.col(by) == "conceptual", 0.7).otherwise(0.5)
    tally = rows.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.avg("r").alias("avg_rating")).join(final, by, "left")
    sem = F.coalesce(F.least(F.greatest(F.col("f.s") * base + F.col("f.d"), F.col("f.lo")), F.col("f.hi")), base)
    return tally.select(by, "samples", "avg_rating", sem.alias("semantic_weight"), (1 - sem).alias("lexical_weight"))


def expand_queries(df: DataFrame, text: str, strategy: str) -> DataFrame:
    """Sub-queries of an expansion strategy (at most four), as an array."""
    q = F.col(text)
    make = lambda names: F.array(*[F.concat(*[F.lit(p) if p != "{q}" else q for p in _pieces(t)]) for t in names])
    subs = make(lexicons.EXPANSIONS[strategy])
    if strategy == "moderate":
        trend = F.lower(q).contains("trend") | F.lower(q).contains("change")
        subs = F.when(trend, F.concat(make(lexicons.EXPANSIONS["moderate_trend"]), subs)).otherwise(subs)
    return df.withColumn("sub_queries", F.slice(subs, 1, 4))


def _pieces(template: str) -> list[str]:
    head, tail = template.split("{q}")
    return [p for p in (head, "{q}", tail) if p]


def persona_boost(df: DataFrame, score: Column, persona: str, age_days: str = "age_days", citations: str = "citations") -> Column:
    """Score times recency and citation factors of a persona; missing metadata leaves it unchanged."""
    _, _, recency, _, cites, _, _ = lexicons.PERSONAS[persona]
    fresh = 1 + recency * (1 - F.least(F.col(age_days) / 365, F.lit(1.0)))
    known = F.least(1 + cites * F.col(citations) / 100, F.lit(2.0))
    return score * F.coalesce(fresh, F.lit(1.0)) * F.coalesce(known, F.lit(1.0))


def focus_keywords(text: Column, strategy: str) -> Column:
    w = words(text)
    if strategy == "conservative":
        first = lambda x: F.substring(x, 1, 1)
        return F.slice(F.filter(w, lambda x: ((F.upper(first(x)) == first(x)) & (F.lower(first(x)) != first(x))) | (F.length(x) > 8)), 1, 5)
    stops = lexicons.STOP_MODERATE if strategy == "moderate" else lexicons.STOP_AGGRESSIVE
    kept = F.filter(F.transform(w, F.lower), lambda x: ~x.isin(*stops))
    return F.slice(kept, 1, 7) if strategy == "moderate" else kept


def persona_search(queries: DataFrame, post: DataFrame, stats: DataFrame, q_vecs: DataFrame, d_vecs: DataFrame, meta: DataFrame,
                   persona: str, k: int) -> DataFrame:
    """Main and expanded queries fused, merged with decay, boosted by metadata, top k."""
    lex_w, sem_w, _, _, _, strategy, _ = lexicons.PERSONAS[persona]

    def weighted(qs: DataFrame, vecs: DataFrame, n: int) -> DataFrame:
        lex = bm25_top_k(qs, post, stats, n).select("qid", "doc", "rank")
        sem = vector_top_k(vecs, d_vecs, n).select("qid", F.col("id").alias("doc"), "rank")
        return fuse([(lex, lex_w), (sem, sem_w)], "doc", n)

    main = weighted(queries, q_vecs, 2 * k).select("qid", "doc", "score")
    merged = main
    if strategy == "aggressive":
        subs = expand_queries(queries, "query", strategy).select("qid", F.posexplode("sub_queries").alias("pos", "query"))
        coded = subs.select((F.col("qid") * 10 + F.col("pos")).alias("qid"), "query")
        sub_vecs = q_vecs.select(F.explode(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda p: F.col("qid") * 10 + p)).alias("qid"), "vec")
        found = weighted(coded, sub_vecs, k).select(F.floor(F.col("qid") / 10).alias("qid"), "doc", (F.col("score") * 0.7).alias("score"))
        merged = main.unionByName(found).groupBy("qid", "doc").agg(F.max("score").alias("score"))
    rated = merged.join(meta, "doc")
    rated = rated.withColumn("score", F.round(persona_boost(rated, F.col("score"), persona), 9))
    return top_k(rated.select("qid", "doc", "score"), ["qid"], [F.desc("score"), "doc"], k)


def first_per_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """First row per exact content: only hashes and order keys are shuffled, with partial minima."""
    key = F.sha2(content, 256)
    first = df.groupBy(key.alias("_h")).agg(F.min(order).alias(order))
    return df.join(first.drop("_h"), order, "left_semi")


def merge_results(docs: DataFrame, web: DataFrame, mode: str = "hybrid") -> DataFrame:
    parts = {"docs": [docs], "web": [web]}.get(mode, [docs, web])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def context_blocks(results: DataFrame, limit: int = 1500) -> DataFrame:
    tag = F.when(F.col("kind") == "document", "[LOCAL DOC]").otherwise("[WEB SEARCH]")
    return results.withColumn("block", F.concat(
        F.lit("--- SOURCE "), F.col("rank").cast("string"), F.lit(" "), tag, F.lit(" ---\nTitle: "), F.col("title"),
        F.lit("\nURL: "), F.coalesce("url", F.lit("N/A")), F.lit("\nContent: "), F.substring("content", 1, limit)))


def cache_lookup(queries: DataFrame, cache: DataFrame, ttl_seconds: int = 3600, threshold: float = 0.95, dim: int = 64) -> DataFrame:
    """Best live cache entry per query, or a miss.

    Time is cut into TTL wide slots and a query looks into its own slot and the
    one before; inside a slot the vector search keeps one entry per query, so
    no list of pairs is made however many entries a slot holds.
    """
    slot = lambda c: F.floor(c / ttl_seconds)
    asked = queries.select("qid", "vec", F.col("epoch").alias("at"), F.explode(F.array(slot(F.col("epoch")), slot(F.col("epoch")) - 1)).alias("slot"))
    held = cache.select(F.col("entry").alias("id"), "vec", F.col("epoch").alias("at"), slot(F.col("epoch")).alias("slot"))
    best = vector_top_k(asked, held, 1, dim=dim, group="slot", max_age=float(ttl_seconds)).filter(F.col("score") >= threshold)
    return queries.select("qid").join(best, "qid", "left").select("qid", F.col("id").alias("entry"), F.col("score").alias("similarity"), F.col("id").isNotNull().alias("hit"))


def compact_cache(accesses: DataFrame, capacity: int, key: str = "key", at: str = "at") -> DataFrame:
    """Keys that stay: the most recently used ones up to the capacity."""
    last = accesses.groupBy(key).agg(F.max(at).alias("last_used"), F.count(F.lit(1)).alias("uses"))
    return last.orderBy(F.desc("last_used"), key).limit(capacity)


def exact_lookup(queries: DataFrame, l1: DataFrame, l2: DataFrame, text: str = "query") -> DataFrame:
    """Join on SHA-256 of the query; the first level wins, second-level hits are to be promoted."""
    k = queries.withColumn("key", F.sha2(text, 256))
    j = k.join(l1.select("key", F.col("value").alias("v1")), "key", "left").join(l2.select("key", F.col("value").alias("v2")), "key", "left")
    level = F.when(F.col("v1").isNotNull(), "l1").when(F.col("v2").isNotNull(), "l2").otherwise("miss")
    return j.select(*queries.columns, F.coalesce("v1", "v2").alias("value"), level.alias("level"), (level == "l2").alias("promote"))


def projection(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """First two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({"x": F.col("_p")[0], "y": F.col("_p")[1]}).drop("_v", "_p")
