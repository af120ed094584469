"""Retrieval queries: passages ask, documents and vectors answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import sentences, words
from ..operators import retrieval as re_
from ..operators.scale import settle
from .q_meta import rounded, sql6
from .registry import cte, query

c = F.col
WORDS = "list_filter(string_split_regex({0},'\\s+'), lambda x: x<>'')"
lw = lambda s: WORDS.format(f"lower({s})")

cte("query_set", f"SELECT item_id AS qid, array_to_string({WORDS.format('text')},' ') AS query FROM benchmark")
cte("bm_tok", f"SELECT doc_id AS doc, {lw('text')} AS t FROM documents")
cte("bm_post", "SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(t) AS dl, unnest(t) AS term FROM bm_tok) GROUP BY 1,2,3", once=True)
cte("bm_raw", "SELECT term, df, avgdl, n_docs, ln((n_docs-df+0.5)/(df+0.5)) AS raw FROM (SELECT term, count(*) AS df FROM bm_post GROUP BY 1), (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM (SELECT DISTINCT doc, dl FROM bm_post))", once=True)
cte("bm_stats", "SELECT term, df, avgdl, CASE WHEN raw<0 THEN 0.25*mean ELSE raw END AS idf FROM bm_raw, (SELECT avg(raw) AS mean FROM bm_raw)", once=True)


def bm_sql(queries):
    return f"""SELECT qid, doc, round(sum(qtf*idf*tf*2.5/(tf+1.5*(0.25+0.75*dl/avgdl))),9) AS score FROM (
 SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({lw('query')}) AS term FROM {queries}) GROUP BY 1,2) JOIN bm_stats USING (term) JOIN bm_post USING (term) GROUP BY 1,2"""


cte("bm_scores", bm_sql("query_set"))
cte("bm_ranked", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM bm_scores WHERE score>0")


def query_set(t):
    return t.benchmark.select(c("item_id").alias("qid"), F.array_join(words(c("text")), " ").alias("query"))


def index(t):
    """Postings and statistics of the documents, stored once per state of the table."""
    return re_.stored_index(t.documents)


@query("r1_bm25_index", f"SELECT term, df, {sql6('idf', 'avgdl')} FROM bm_stats")
def _(t):
    return rounded(index(t)[1])


@query("r2_bm25_top_k", f"SELECT qid, doc, CAST(rank AS INT) AS rank, {sql6('score')} FROM bm_ranked WHERE rank<=10")
def _(t):
    post, stats = index(t)
    return rounded(re_.bm25_top_k(query_set(t), post, stats, 10))


@query("r2_bm25_with_zero_scores", f"""SELECT qid, doc, CAST(rank AS INT) AS rank, {sql6('score')} FROM (SELECT q.qid, d.doc_id AS doc, coalesce(s.score,0) AS score, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(s.score,0) DESC, d.doc_id) AS rank
 FROM (SELECT qid+1000 AS qid, string_split(query,' ')[8]||'zz '||string_split(query,' ')[1] AS query FROM query_set) q CROSS JOIN (SELECT doc_id FROM documents WHERE len(string_split_regex(text,'\\s+'))>0) d LEFT JOIN ({bm_sql("(SELECT qid+1000 AS qid, string_split(query,' ')[8]||'zz '||string_split(query,' ')[1] AS query FROM query_set)")}) s ON s.qid=q.qid AND s.doc=d.doc_id) WHERE rank<=25""")
def _(t):
    post, stats = index(t)
    w = F.split("query", " ")
    asked = query_set(t).select((c("qid") + 1000).alias("qid"), F.concat(w[7], F.lit("zz "), w[0]).alias("query"))
    return rounded(re_.bm25_top_k(asked, post, stats, 25, keep_zero=True).select("qid", "doc", "rank", "score"))


DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
NORM = "sqrt(list_dot_product({0}.embedding::DOUBLE[],{0}.embedding::DOUBLE[]))"
COS = f"round({DOT}/({NORM.format('a')}*{NORM.format('b')}),9)"


def vecs(t, name="id"):
    return t.embeddings.select(c("vec_id").alias(name), c("embedding").alias("vec"))


@query("r3_vector_top_k", f"SELECT qid, id, CAST(rank AS INT) AS rank, {sql6('score')} FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b) WHERE rank<=5")
def _(t):
    return rounded(re_.vector_top_k(vecs(t, "qid"), vecs(t), 5))


@query("r4_vector_top_k_l2", f"SELECT qid, id, CAST(rank AS INT) AS rank, {sql6('sqrt(d) AS distance')} FROM (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, greatest(0.0, round({NORM.format('a')}*{NORM.format('a')}+{NORM.format('b')}*{NORM.format('b')}-2*{DOT},9)) AS d FROM embeddings a, embeddings b)) WHERE rank<=5")
def _(t):
    hits = re_.vector_top_k(vecs(t, "qid"), vecs(t), 5, "l2")
    return rounded(hits.select("qid", "id", "rank", F.sqrt(F.greatest(-c("score"), F.lit(0.0))).alias("distance")))


cte("sem_ranked", f"SELECT qid, doc, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS doc, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) a, (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) b) WHERE rank<=30")


def both_lists(t, n):
    """Lexical and semantic lists of every passage; a passage and a document own the vector of their number."""
    post, stats = index(t)
    lex = re_.bm25_top_k(query_set(t), post, stats, n).select("qid", "doc", "rank")
    q = vecs(t, "qid").join(t.benchmark.select(c("item_id").alias("qid")), "qid", "left_semi")
    d = vecs(t).join(t.documents.select(c("doc_id").alias("id")), "id", "left_semi")
    return lex, re_.vector_top_k(q, d, n).select("qid", c("id").alias("doc"), "rank")


def rrf_sql(n, lex, sem, k, join=""):
    return f"""SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM (SELECT qid, doc, round(sum(p),9) AS score FROM (
 SELECT qid, doc, {lex}/(60+rank) AS p FROM bm_ranked {join} WHERE rank<={n} UNION ALL SELECT qid, doc, {sem}/(60+rank) FROM sem_ranked {join} WHERE rank<={n}) GROUP BY 1,2)"""


@query("r5_rank_fusion", f"SELECT qid, doc, CAST(rank AS INT) AS rank, {sql6('score')} FROM ({rrf_sql(20, 'w_bm25', 'w_semantic', 10, 'JOIN qweights USING (qid)')}) WHERE rank<=10")
def _(t):
    lex, sem = both_lists(t, 20)
    w = re_.question_weights(query_set(t), "query").select("qid", "w_bm25", "w_semantic")
    return rounded(re_.fuse([(lex.join(w, "qid"), c("w_bm25")), (sem.join(w, "qid"), c("w_semantic"))], "doc", 10))


@query("r6_prefix_fusion", f"""SELECT qid, doc, CAST(rank AS INT) AS rank, {sql6('score')} FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM (
 SELECT qid, key, round(sum(w/(60+rank)),9) AS score, arg_min(doc, [src, CASE WHEN src=0 THEN -rank ELSE rank END]) AS doc FROM (
 SELECT qid, doc, rank, 1 AS src, 0.5 AS w FROM bm_ranked WHERE rank<=15 UNION ALL SELECT qid, doc, rank, 0, 0.5 FROM sem_ranked WHERE rank<=15) JOIN (SELECT doc_id AS doc, text AS key FROM documents) USING (doc) GROUP BY 1,2)) WHERE rank<=5""")
def _(t):
    lex, sem = both_lists(t, 15)
    return rounded(re_.fuse_by_prefix(sem, lex, t.documents, 5))


def hits_sql(col, ws):
    return "(" + "+".join(f"contains(lower({col}),'{w}')::INT" for w in ws) + ")"


S, C = hits_sql("query", lexicons.SPECIFIC_WORDS), hits_sql("query", lexicons.CONCEPTUAL_WORDS)
cte("qweights", f"SELECT qid, CASE WHEN {S}>{C} THEN 0.65::DOUBLE WHEN {C}>{S} THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS w_bm25, CASE WHEN {S}>{C} THEN 0.35::DOUBLE WHEN {C}>{S} THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS w_semantic FROM query_set")


@query("r7_question_weights", f"SELECT conv_id, turn, CASE WHEN s>c THEN 0.65::DOUBLE WHEN c>s THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS w_bm25, CASE WHEN s>c THEN 0.35::DOUBLE WHEN c>s THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS w_semantic FROM (SELECT conv_id, turn, {S.replace('query', 'text')} AS s, {C.replace('query', 'text')} AS c FROM requests)")
def _(t):
    from .q_experiments import requests
    return re_.question_weights(requests(t), "text").drop("text")


SENT_ROWS = "SELECT conv_id, turn, role, unnest(p) AS q, unnest(range(0,len(p)))::INT AS sent FROM (SELECT conv_id, turn, role, list_filter(list_transform(regexp_split_to_array(text,'[.!?]+'), lambda x: regexp_replace(x,'^\\s+|\\s+$','','g')), lambda x: x<>'') AS p FROM conversations)"
cte("questions", SENT_ROWS)
cte("qtypes", f"""SELECT *, CASE query_type WHEN 'keyword' THEN 0.3::DOUBLE WHEN 'conceptual' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS semantic_weight, CASE query_type WHEN 'keyword' THEN 0.7::DOUBLE WHEN 'conceptual' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS lexical_weight FROM (
 SELECT conv_id, turn, sent, CASE WHEN n<=3 THEN 'keyword' WHEN {hits_sql('q', lexicons.CONCEPT_INDICATORS)}>0 OR n>=8 THEN 'conceptual' ELSE 'mixed' END AS query_type FROM (
 SELECT conv_id, turn, sent, q, len({WORDS.format('q')}) AS n FROM questions))""")


def questions(t):
    """Every sentence of every turn is a question."""
    return t.conversations.select("conv_id", "turn", "role", F.posexplode(sentences(c("text"))).alias("sent", "q"))


@query("r8_question_type", "SELECT * FROM qtypes")
def _(t):
    return re_.question_type(questions(t).drop("role"), "q").drop("q")


RATED = "SELECT event_id, (['keyword','conceptual','mixed'])[user_id%3+1] AS kind, 1.0+CAST(floor(value) AS BIGINT)%5 AS rating, CASE WHEN user_id%3=1 AND event_id%4000<2000 THEN 0.4 ELSE (event_id%10)/10 END AS w FROM events"


@query("r9_adaptive_weights", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY event_id) AS rn FROM ({RATED})),
 m AS (SELECT kind, rn, rating, round(avg(rating/5) OVER w,9) AS m, round(avg(CASE WHEN w>0.5 THEN rating/5 END) OVER w,9) AS h, round(avg(CASE WHEN w<=0.5 THEN rating/5 END) OVER w,9) AS l FROM r WINDOW w AS (PARTITION BY kind ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 d AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY rn) AS i, h, l FROM m WHERE rn>=5 AND m<0.6),
 s AS (SELECT kind, 0::BIGINT AS i, CASE kind WHEN 'keyword' THEN 0.3::DOUBLE WHEN 'conceptual' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS sem FROM (SELECT DISTINCT kind FROM r)
  UNION ALL SELECT s.kind, d.i, CASE WHEN h IS NOT NULL AND l IS NOT NULL THEN CASE WHEN h>l THEN least(1.0,sem+0.1) ELSE greatest(0.0,sem-0.1) END ELSE 1-sem END FROM s JOIN d ON d.kind=s.kind AND d.i=s.i+1)
SELECT kind, samples, {sql6('avg_rating', 'sem AS semantic_weight', '1-sem AS lexical_weight')} FROM (SELECT kind, arg_max(sem, i) AS sem FROM s GROUP BY 1) JOIN (SELECT kind, count(*) AS samples, avg(rating/5) AS avg_rating FROM r GROUP BY 1) USING (kind)""")
def _(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("keyword", "conceptual", "mixed")]), (c("user_id") % 3 + 1).cast("int"))
    f = t.events.select(kind.alias("kind"), "event_id", (1.0 + F.floor("value") % 5).alias("rating"),
                        F.when((c("user_id") % 3 == 1) & (c("event_id") % 4000 < 2000), 0.4).otherwise(c("event_id") % 10 / 10).alias("semantic_weight"))
    return rounded(re_.adaptive_weights(f, "kind", "event_id"))


META = "SELECT doc_id AS doc, CASE WHEN doc_id%4<>0 THEN doc_id%500 END AS age_days, CASE WHEN doc_id%3<>0 THEN doc_id%150 END AS citations FROM documents"


def doc_meta(t):
    return t.documents.select(c("doc_id").alias("doc"), F.when(c("doc_id") % 4 != 0, c("doc_id") % 500).alias("age_days"), F.when(c("doc_id") % 3 != 0, c("doc_id") % 150).alias("citations"))


cte("sub_set", "SELECT qid*10+pos AS qid, CASE pos WHEN 0 THEN query||' fundamentals' WHEN 1 THEN query||' applications' WHEN 2 THEN query||' related concepts' ELSE 'Alternatives to '||query END AS query FROM query_set, (SELECT unnest([0,1,2,3]) AS pos)")
cte("sub_ranked", f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM ({bm_sql('sub_set')}) WHERE score>0")
BOOST = "*coalesce(1+0.2*(1-least(age_days/365,1.0)),1)*coalesce(least(1+0.5*citations/100,2.0),1)"


@query("r10_persona_search", f"""WITH main AS ({rrf_sql(10, '0.4', '0.6', 10)}), sub AS (SELECT qid//10 AS qid, doc, score*0.7 AS score FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM (
 SELECT qid, doc, round(sum(p),9) AS score FROM (SELECT qid, doc, 0.4/(60+rank) AS p FROM sub_ranked WHERE rank<=5 UNION ALL SELECT qid*10+pos, doc, 0.6/(60+rank) FROM sem_ranked, (SELECT unnest([0,1,2,3]) AS pos) WHERE rank<=5) GROUP BY 1,2)) WHERE rank<=5),
 m AS (SELECT qid, doc, max(score) AS score FROM (SELECT qid, doc, score FROM main WHERE rank<=10 UNION ALL SELECT * FROM sub) GROUP BY 1,2),
 b AS (SELECT qid, doc, round(score{BOOST},9) AS score FROM m JOIN ({META}) USING (doc))
SELECT qid, doc, CAST(rank AS INT) AS rank, {sql6('score')} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM b) WHERE rank<=5""")
def _(t):
    post, stats = index(t)
    q = vecs(t, "qid").join(t.benchmark.select(c("item_id").alias("qid")), "qid", "left_semi")
    d = vecs(t).join(t.documents.select(c("doc_id").alias("id")), "id", "left_semi")
    return rounded(re_.persona_search(query_set(t), post, stats, q, d, doc_meta(t), "educator", 5))


@query("r11_recency_citation_boost", f"SELECT doc, {sql6('1.0' + BOOST + ' AS factor')} FROM ({META})")
def _(t):
    m = doc_meta(t)
    return rounded(m.select("doc", re_.persona_boost(m, F.lit(1.0), "educator").alias("factor")))


MOD, AGG = [", ".join(f"'{w}'" for w in x) for x in (lexicons.STOP_MODERATE, lexicons.STOP_AGGRESSIVE)]


@query("r12_focus_keywords", f"""SELECT item_id, array_to_string(list_slice(list_filter({WORDS.format('text')}, lambda x: (upper(x[1])=x[1] AND lower(x[1])<>x[1]) OR length(x)>8),1,5),' ') AS conservative,
 array_to_string(list_slice(list_filter({lw('text')}, lambda x: x NOT IN ({MOD})),1,7),' ') AS moderate, len(list_filter({lw('text')}, lambda x: x NOT IN ({AGG}))) AS aggressive FROM benchmark""")
def _(t):
    x = c("text")
    return t.benchmark.select("item_id", F.array_join(re_.focus_keywords(x, "conservative"), " ").alias("conservative"), F.array_join(re_.focus_keywords(x, "moderate"), " ").alias("moderate"), F.size(re_.focus_keywords(x, "aggressive")).cast("long").alias("aggressive"))


@query("r13_first_per_content", "SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn=1")
def _(t):
    return re_.first_per_content(t.documents, "text", "doc_id").select("doc_id", "n_chars")


@query("r14_rerank", f"SELECT qid, id, CAST(rank AS INT) AS rank, {sql6('score')} FROM (SELECT a.label AS qid, b.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY a.label ORDER BY {COS} DESC, b.vec_id) AS rank FROM (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) a JOIN embeddings b ON a.label=b.label) WHERE rank<=5")
def _(t):
    lead = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("lead"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    j = t.embeddings.join(lead, "label").select(c("label").alias("qid"), c("vec_id").alias("id"), F.round(dot(c("lead"), c("embedding")) / F.sqrt(dot(c("lead"), c("lead"))) / F.sqrt(dot(c("embedding"), c("embedding"))), 9).alias("score"))
    return rounded(re_.top_k(j, ["qid"], [F.desc("score"), "id"], 5))


MERGED = "SELECT 'document' AS kind, doc_id AS id, source AS title, NULL AS url, text AS content, doc_id*2 AS rank FROM documents UNION ALL SELECT 'web', page_id, regexp_extract(html,'<title>([^<]*)</title>',1), url, html, page_id*2+1 FROM pages"


def merged(t):
    d = t.documents.select(F.lit("document").alias("kind"), c("doc_id").alias("id"), c("source").alias("title"), F.lit(None).cast("string").alias("url"), c("text").alias("content"), (c("doc_id") * 2).alias("rank"))
    w = t.pages.select(F.lit("web").alias("kind"), c("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "url", c("html").alias("content"), (c("page_id") * 2 + 1).alias("rank"))
    return re_.merge_results(d, w)


@query("r15_merged_context", f"SELECT kind, id, '--- SOURCE '||rank||' '||CASE kind WHEN 'document' THEN '[LOCAL DOC]' ELSE '[WEB SEARCH]' END||' ---'||chr(10)||'Title: '||title||chr(10)||'URL: '||coalesce(url,'N/A')||chr(10)||'Content: '||content[:1500] AS block FROM ({MERGED})")
def _(t):
    return re_.context_blocks(merged(t)).select("kind", "id", "block")


@query("r16_fact_rows", f"SELECT qid, doc, CAST(rank AS INT) AS rank, {sql6('score')}, source, lang FROM bm_ranked JOIN documents ON doc=doc_id WHERE rank<=10")
def _(t):
    post, stats = index(t)
    hits = re_.bm25_top_k(query_set(t), post, stats, 10)
    return rounded(hits.join(t.documents.select(c("doc_id").alias("doc"), "source", "lang"), "doc")).select("qid", "doc", "rank", "score", "source", "lang")


@query("r17_query_response", f"""SELECT qid, query, w_bm25, w_semantic, count(*) AS sources, string_agg(doc::VARCHAR, ',' ORDER BY rank) AS docs FROM ({rrf_sql(10, 'w_bm25', 'w_semantic', 5, 'JOIN qweights USING (qid)')}) JOIN query_set USING (qid) JOIN qweights USING (qid) WHERE rank<=5 GROUP BY 1,2,3,4""")
def _(t):
    lex, sem = both_lists(t, 10)
    w = re_.question_weights(query_set(t), "query")
    best = re_.fuse([(lex.join(w, "qid"), c("w_bm25")), (sem.join(w, "qid"), c("w_semantic"))], "doc", 5)
    rows = best.groupBy("qid").agg(F.count(F.lit(1)).alias("sources"), F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("l"))  # five per query
    return w.join(rows, "qid").select("qid", "query", "w_bm25", "w_semantic", "sources", F.array_join(F.transform("l", lambda x: x.doc.cast("string")), ",").alias("docs"))


@query("r18_cache_lookup", f"""SELECT q.qid, coalesce(x.entry,-1) AS entry, {sql6('coalesce(x.sim,0) AS similarity')}, x.entry IS NOT NULL AS hit FROM (SELECT vec_id AS qid FROM embeddings) q LEFT JOIN (
 SELECT qid, entry, sim FROM (SELECT a.vec_id AS qid, b.vec_id AS entry, {COS} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE b.vec_id*60<=a.vec_id*60-60 AND a.vec_id*60-60-b.vec_id*60<=3540 AND {COS}>=0.3) WHERE rn=1) x USING (qid)""")
def _(t):
    asked = t.embeddings.select(c("vec_id").alias("qid"), c("embedding").alias("vec"), (c("vec_id") * 60 - 60).alias("epoch"))
    held = t.embeddings.select(c("vec_id").alias("entry"), c("embedding").alias("vec"), (c("vec_id") * 60).alias("epoch"))
    out = re_.cache_lookup(asked, held, 3540, 0.3)
    return rounded(out.select("qid", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "hit"))


@query("r19_cache_compaction", "SELECT user_id AS key, count(*) AS uses FROM events GROUP BY 1 ORDER BY max(event_id) DESC, 1 LIMIT 100")
def _(t):
    return re_.compact_cache(t.events.select(c("user_id").alias("key"), c("event_id").alias("at")), 100).select("key", "uses")


@query("r20_exact_lookup", """SELECT e.event_id, coalesce(a.v, b.v, -1) AS value, CASE WHEN a.v IS NOT NULL THEN 'l1' WHEN b.v IS NOT NULL THEN 'l2' ELSE 'miss' END AS level FROM events e
 LEFT JOIN (SELECT 'user '||c_custkey AS q, c_custkey AS v FROM customer WHERE c_custkey%3=0) a ON a.q='user '||e.user_id LEFT JOIN (SELECT 'user '||c_custkey AS q, -2-c_custkey AS v FROM customer WHERE c_custkey%3=1) b ON b.q='user '||e.user_id""")
def _(t):
    key = F.sha2(F.concat(F.lit("user "), c("c_custkey").cast("string")), 256).alias("key")
    l1 = t.customer.filter("c_custkey % 3 = 0").select(key, c("c_custkey").alias("value"))
    l2 = t.customer.filter("c_custkey % 3 = 1").select(key, (-2 - c("c_custkey")).alias("value"))
    asked = t.events.select("event_id", F.concat(F.lit("user "), c("user_id").cast("string")).alias("query"))
    return re_.exact_lookup(asked, l1, l2).select("event_id", F.coalesce("value", F.lit(-1)).alias("value"), "level")


@query("r21_cache_statistics", f"SELECT event_type, count(DISTINCT user_id) AS size, count(*) FILTER (user_id%3=0) AS hits, count(*) FILTER (user_id%3<>0) AS misses, {sql6('count(*) FILTER (user_id%3=0)/count(*) AS hit_rate')} FROM events GROUP BY 1")
def _(t):
    g = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("size"), F.count_if(c("user_id") % 3 == 0).alias("hits"), F.count_if(c("user_id") % 3 != 0).alias("misses"))
    return rounded(g.withColumn("hit_rate", F.when(c("hits") + c("misses") > 0, c("hits") / (c("hits") + c("misses"))).otherwise(0.0)))


@query("r22_projection")
def _(t):
    return re_.projection(t.embeddings).select("vec_id", "label", "x", "y")


@query("r23_context_tail", "SELECT conv_id, string_agg('[Chapter '||(turn+1)||']'||chr(10)||text, chr(10)||chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn<=5 GROUP BY 1")
def _(t):
    last = re_.top_k(t.conversations, ["conv_id"], [F.desc("turn")], 5)
    parts = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))  # five per story
    return parts.select("conv_id", F.array_join(F.transform("l", lambda x: F.concat(F.lit("[Chapter "), (x.turn + 1).cast("string"), F.lit("]\n"), x.text)), "\n\n").alias("context"))
