"""Text preparation and answer evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons
from ..operators import retrieval, textprep as tp
from .q_meta import rounded, sql6
from .q_retrieval import COS, WORDS, lw, questions
from .registry import cte, query

c = F.col
NL = "chr(10)"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("t1_word_chunks", f"""SELECT doc_id||'_chunk_'||i AS chunk_id, doc_id, CAST(i AS INT) AS chunk_index, CAST(s AS INT) AS start_word, CAST(least(s+512,n) AS INT) AS end_word, text FROM (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s)-1 AS i FROM (SELECT doc_id, len(w) AS n, s, array_to_string(list_slice(w,s+1,s+512),' ') AS text FROM (
  SELECT doc_id, w, unnest(range(0,len(w),462)) AS s FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents))) WHERE length(text)>20)""")
def _(t):
    return tp.word_chunks(t.documents)


@query("t2_recursive_chunks")
def _(t):
    return tp.recursive_chunks(t.documents)


@query("t3_semantic_chunks", f"""WITH s AS (SELECT doc_id, text AS whole, x, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, text, {STRIP.format('unnest(p)')} AS x, unnest(range(0,len(p))) AS o FROM (
  SELECT doc_id, text, string_split(replace(text,{NL},' '),'. ') AS p FROM documents)) WHERE x<>''),
 v AS (SELECT *, list_distinct({lw('x')}) AS v FROM s),
 b AS (SELECT *, CASE WHEN i>1 AND round(len(list_intersect(lag(v) OVER w, v))/sqrt(len(lag(v) OVER w)::DOUBLE*len(v)),9)>=0.35 THEN 0 ELSE 1 END AS b FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i)-1 AS g FROM b)
SELECT doc_id, CAST(g AS INT) AS chunk_index, CASE WHEN n=1 THEN any_value(whole) ELSE string_agg(x, '. ' ORDER BY i)||'.' END AS text FROM g GROUP BY doc_id, g, n""")
def _(t):
    return tp.semantic_chunks(t.documents, threshold=0.35)


def _redact_sql(src):
    inner = f"SELECT doc_id, {src} AS x, 0 AS n FROM documents"
    for name, pat in lexicons.PII:
        p = pat.replace("'", "''")
        inner = f"SELECT doc_id, regexp_replace(x, '{p}', '[REDACTED_{name.upper()}]', 'g') AS x, n+len(regexp_extract_all(x, '{p}')) AS n FROM ({inner})"
    return inner


# Keys and numbers that the texts lack are appended from the document number.
PLANT = "text||' key-'||md5(doc_id::VARCHAR)||' id '||(100+doc_id%900)||'-'||(10+doc_id%90)||'-'||(1000+doc_id%9000)"


def planted(t):
    d = c("doc_id")
    num = lambda lo, m: (lo + d % m).cast("string")
    return t.documents.select("doc_id", F.concat("text", F.lit(" key-"), F.md5(d.cast("string")), F.lit(" id "), num(100, 900), F.lit("-"), num(10, 90), F.lit("-"), num(1000, 9000)).alias("text"))


@query("t4_redaction", f"SELECT doc_id, md5(x) AS redacted_md5, CAST(n AS INT) AS findings FROM ({_redact_sql(PLANT)})")
def _(t):
    text, n = tp.redact(c("text"))
    return planted(t).select("doc_id", F.md5(text).alias("redacted_md5"), n.alias("findings"))


W5 = "regexp_extract_all(text,'[\\p{L}\\p{N}_]+')"
SYL = "list_sum(list_transform(list_transform(w, lambda x: lower(x)), lambda x: CASE WHEN length(x)<=3 THEN 1 ELSE greatest(1, len(regexp_extract_all(x,'[aeiouy]+'))-CASE WHEN x[-1]='e' THEN 1 ELSE 0 END) END))"


@query("t5_profile", f"""SELECT doc_id, {sql6('CASE WHEN ok THEN g ELSE 0 END AS reading_grade_level', 'CASE WHEN ok THEN k/n ELSE 0 END AS lexical_diversity', 'CASE WHEN ok THEN n/s ELSE 0 END AS avg_sentence_length')},
 CASE WHEN NOT ok THEN 'Unknown' WHEN g>14 THEN 'High' WHEN g>10 THEN 'Advanced' ELSE 'Baseline' END AS complexity_label FROM (SELECT *, n>0 AND s>0 AS ok, 0.39*(n/s)+11.8*(syl/n)-15.59 AS g FROM (
 SELECT doc_id, len(w) AS n, len(list_distinct(list_transform(w, lambda x: lower(x)))) AS k, {SYL} AS syl, len(list_filter(string_split(text,'.'), lambda x: {STRIP.format('x')}<>'')) AS s FROM (SELECT doc_id, text, {W5} AS w FROM documents)))""")
def _(t):
    return tp.profile(t.documents.select("doc_id", "text"), digits=(6, 6, 6)).drop("text")


@query("t6_difficulty", f"SELECT conv_id, turn, sent, CASE WHEN len({WORDS.format('q')})<4 THEN 'Incomplete' WHEN role='user' THEN 'Complex' ELSE 'Standard' END AS difficulty FROM questions")
def _(t):
    q = questions(t)
    return q.select("conv_id", "turn", "sent", tp.difficulty(c("q"), F.when(c("role") == "user", "cross_document").otherwise("single")).alias("difficulty"))


# Answers cite sources by number; each document answers with its own words.
ANSWER = "text||' ['||(doc_id%5+1)||']. See [Source '||(doc_id%7+1)||'] and ['||(doc_id%5+1)||']! '||text"
cte("answers", f"SELECT doc_id AS answer_id, {ANSWER} AS text FROM documents")
cte("cited_sources", "SELECT doc_id AS answer_id, r AS rank, source||'.txt' AS source_file, CASE WHEN doc_id%2=0 THEN (r*3)::VARCHAR END AS page, text AS content FROM documents, (SELECT unnest(range(1,6)) AS r)")


def answers(t):
    n = lambda m: (c("doc_id") % m + 1).cast("string")
    return t.documents.select(c("doc_id").alias("answer_id"), F.concat("text", F.lit(" ["), n(5), F.lit("]. See [Source "), n(7), F.lit("] and ["), n(5), F.lit("]! "), "text").alias("text"))


@query("t7_citations", r"""SELECT a.answer_id, CAST(a.rank AS INT) AS rank, source_file AS file, coalesce(page,'N/A') AS page, content[:200]||'...' AS snippet FROM (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text,'\[(?:Source\s*)?(\d+)\]',1))::INT AS rank FROM answers) a JOIN cited_sources s USING (answer_id, rank)""")
def _(t):
    src = t.documents.select(c("doc_id").alias("answer_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"), F.concat("source", F.lit(".txt")).alias("source_file"), "doc_id", c("text").alias("content"))
    src = src.withColumn("page", F.when(c("doc_id") % 2 == 0, (c("rank") * 3).cast("string"))).drop("doc_id")
    return tp.resolve_citations(answers(t), src)


SENT = "list_filter(list_transform(regexp_split_to_array(text,'[.!?]+'), lambda x: " + STRIP.format("x") + "), lambda x: length(x)>10)"
COVER = f"CASE WHEN len({SENT})>0 THEN len(list_filter({SENT}, lambda x: regexp_matches(x,'\\[\\d+\\]')))/len({SENT}) ELSE 0 END"
CITES = r"len(list_distinct(regexp_extract_all(text,'\[(\d+)\]',1)))"


@query("t8_citation_coverage", f"SELECT answer_id, {sql6(COVER + ' AS coverage')}, CAST({CITES} AS INT) AS citations FROM answers")
def _(t):
    return rounded(answers(t).select("answer_id", tp.citation_coverage(c("text")).alias("coverage"), tp.citation_count(c("text")).alias("citations")))


@query("t9_faithfulness", f"SELECT label, count(*) AS sentences, {sql6('avg(m) AS faithfulness')} FROM (SELECT a.label, a.vec_id, max({COS}) AS m FROM embeddings a JOIN embeddings b ON a.label=b.label WHERE a.vec_id%2=1 AND b.vec_id%2=0 GROUP BY 1,2) GROUP BY 1")
def _(t):
    e = t.embeddings.select("vec_id", "label", c("embedding").alias("vec"))
    best = retrieval.vector_top_k(e.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "qid"), e.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "id"), 1, group="label")
    j = best.join(e.select(c("vec_id").alias("qid"), "label"), "qid")
    return rounded(j.groupBy("label").agg(F.count(F.lit(1)).alias("sentences"), F.avg("score").alias("faithfulness")))


RULES = "list_filter([CASE WHEN f<0.5 THEN 'low faithfulness' END, CASE WHEN r<0.6 THEN 'low relevance' END, CASE WHEN s=0 THEN 'no sources' END, CASE WHEN " + CITES + "=0 AND length(text)>100 THEN 'no citations' END, CASE WHEN len(" + WORDS.format("text") + ")<20 THEN 'very short' END], lambda x: x IS NOT NULL)"


@query("t10_composite_evaluation", f"SELECT conv_id, turn, {sql6('f*0.5+r*0.3+cov*0.2 AS overall')}, array_to_string({RULES},',') AS warnings FROM (SELECT conv_id, turn, text, ((conv_id+turn)%10)/10 AS f, ((conv_id*3+turn)%10)/10 AS r, (turn%5)/5 AS cov, turn%3 AS s FROM conversations)")
def _(t):
    d = t.conversations.select("conv_id", "turn", c("text").alias("response"), ((c("conv_id") + c("turn")) % 10 / 10).alias("faithfulness"), ((c("conv_id") * 3 + c("turn")) % 10 / 10).alias("relevance"), (c("turn") % 5 / 5).alias("coverage"), (c("turn") % 3).alias("n_sources"))
    return rounded(tp.composite_evaluation(d).select("conv_id", "turn", "overall", F.array_join("warnings", ",").alias("warnings")))


@query("t11_evaluation_summary", "SELECT source, count(*) AS n, round(avg(quality),2) AS faithfulness, round(avg(toxic),2) AS relevance, round(avg(quality-toxic),2)+0.0 AS clarity FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(t):
    j = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 2).alias("faithfulness"), F.round(F.avg("toxic"), 2).alias("relevance"), (F.round(F.avg(c("quality") - c("toxic")), 2) + F.lit(0.0)).alias("clarity"))


@query("t12_persona_scores", "SELECT doc_id, persona, round(quality*a+toxic*b+0.5*d,6)+0.0 AS score FROM labels, (VALUES " + ",".join(f"('{p}',{w[0]}::DOUBLE,{w[1]}::DOUBLE,{w[2]}::DOUBLE)" for p, (*_, w) in lexicons.PERSONAS.items()) + ") v(persona,a,b,d)")
def _(t):
    d = t.labels.select("doc_id", c("quality").alias("faithfulness"), c("toxic").alias("relevance"), F.lit(0.5).alias("coverage"))
    return rounded(tp.persona_scores(d).select("doc_id", "persona", "score"))


@query("t13_qa_pairs", f"SELECT doc_id, 'Explain the key points from the following text: '||text[:100]||'...' AS instruction, text AS output FROM documents WHERE {STRIP.format('text')}<>''")
def _(t):
    return tp.qa_pairs(t.documents, ["doc_id"])


cte("turn_pairs", "SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output FROM conversations u LEFT JOIN conversations a ON a.conv_id=u.conv_id AND a.turn=u.turn+1 AND a.role='assistant' WHERE u.role='user'")


@query("t14_training_prompts", f"SELECT conv_id, turn, '### Instruction:'||{NL}||instruction||{NL}||{NL}||'### Response:'||{NL}||coalesce(output,'') AS text FROM turn_pairs")
def _(t):
    return tp.turn_pairs(t.conversations).select("conv_id", "turn", tp.training_prompt(c("instruction"), c("output")).alias("text"))


@query("t15_instruction_statistics", f"SELECT count(*) AS total_samples, CAST(trunc(avg(len({WORDS.format('instruction')}))) AS BIGINT) AS avg_instruction_length, CAST(trunc(avg(len({WORDS.format('output')}))) AS BIGINT) AS avg_output_length, true AS format_valid FROM turn_pairs WHERE output IS NOT NULL")
def _(t):
    return tp.instruction_statistics(tp.turn_pairs(t.conversations).filter("output IS NOT NULL"))


@query("t16_samples", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn LIMIT 5 OFFSET 3")
def _(t):
    return t.conversations.orderBy("conv_id", "turn").offset(3).limit(5).select("conv_id", "turn", "role")
