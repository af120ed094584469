"""Consistency, coherence and telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons
from ..operators import arcs, coherence as co, consistency as cs, entities as en, plot, retrieval, telemetry as tm, textprep
from ..operators.scale import settle, with_previous
from .q_graph import NAMES_OF, SENTS, lit
from .q_meta import rounded, sql6
from .q_narrative import HITS, MOOD
from .q_retrieval import COS, WORDS
from .registry import cte, query
from .stories import NAMES, PLACES

c = F.col
KEYS = "story, chapter, approach"

cte("seg_names", f"SELECT DISTINCT lower(unnest({NAMES_OF.format('text')})) AS name FROM segments")
cte("v_names", f"""SELECT {KEYS}, 'name_inconsistency' AS "check", 'minor' AS severity, 'Mixed name references: '||min(name)||' and '||max(name) AS detail FROM (SELECT DISTINCT {KEYS}, name FROM (SELECT {KEYS}, unnest(list_concat(l, list_transform(l, lambda n: split_part(n,' ',1)))) AS name FROM (
 SELECT {KEYS}, list_transform({NAMES_OF.format('text')}, lambda n: lower(n)) AS l FROM segments)) WHERE name IN (SELECT name FROM seg_names)) GROUP BY {KEYS}, split_part(name,' ',1) HAVING count(*)>1""")
cte("prev3", "SELECT *, lower(coalesce(concat_ws(' ', lag(text,3) OVER w, lag(text,2) OVER w, lag(text,1) OVER w),'')) AS before, concat_ws(' ', lag(text,3) OVER w, lag(text,2) OVER w, lag(text,1) OVER w) AS ref, concat_ws(' ', lag(text,2) OVER w, lag(text,1) OVER w) AS ref2, lag(text) OVER w AS last FROM segments WINDOW w AS (PARTITION BY story ORDER BY chapter)")


def _again(tail, ends):
    return f"len(list_filter(regexp_extract_all(before,'(\\w+) {tail}',1), lambda s: " + " OR ".join(f"contains(lower(text), s||' {e}')" for e in ends) + "))>0"


TESTS = [("alive then dead", _again("was alive", ["was dead", "had been dead"])), ("dead then alive", _again("was dead", ["was alive", "is alive"])), ("trusted then hated", _again("trusted", ["hated", "distrusted"])),
         ("morning then night", "contains(before,'in the morning') AND contains(lower(text),'at night')"), ("bright then dark", "(contains(before,'it was bright') OR contains(before,'it was sunny')) AND (contains(lower(text),'it was dark') OR contains(lower(text),'it was night'))")]
cte("v_contra", " UNION ALL ".join(f"SELECT {KEYS}, 'contradiction' AS \"check\", 'major' AS severity, '{n}' AS detail FROM prev3 WHERE {w}" for n, w in TESTS))
TOK = "regexp_extract_all(lower({0}),'[\\p{{L}}\\p{{N}}_]+')"
cte("v_time", f"SELECT {KEYS}, 'temporal_error' AS \"check\", 'minor' AS severity, 'before with future tense' AS detail FROM segments WHERE list_contains({TOK.format('text')},'before') AND (contains(lower(text),'will') OR contains(lower(text),'going to')) AND regexp_matches(lower(text),'before.*will')")
cte("v_ties", " UNION ALL ".join(f"SELECT s.story, s.chapter, s.approach, 'relationship_violation' AS \"check\", 'major' AS severity, '{p.replace(chr(39), chr(39) * 2)} contradicts {r} of '||t.a||' '||t.b AS detail FROM segments s JOIN ties t ON t.relation='{r}' AND contains(lower(text),t.a) AND contains(lower(text),t.b) WHERE contains(lower(text),'{p.replace(chr(39), chr(39) * 2)}')"
                                 for r, ps in lexicons.CONTRARY_BEHAVIOUR.items() for p in ps))
LOWN = lit([n.lower() for n in NAMES])
cte("ties", f"SELECT DISTINCT lower(source) AS a, lower(target) AS b, relation FROM relations WHERE lower(source) IN {LOWN} AND lower(target) IN {LOWN}")
cte("latest_mood", f"SELECT story, name, arg_max(emotion, chapter) AS emotion FROM (SELECT story, chapter, name, {MOOD} AS emotion FROM named) GROUP BY 1,2")
cte("v_state", " UNION ALL ".join(f"SELECT n.story, n.chapter, n.approach, 'character_state_violation' AS \"check\", 'major' AS severity, n.name||' acts {p} despite being {e}' AS detail FROM named n JOIN latest_mood l USING (story, name) WHERE l.emotion='{e}' AND contains(lower(text),'{p}')"
                                  for e, ps in lexicons.CONTRARY_EMOTION.items() for p in ps))
cte("located", f"SELECT source AS name, arg_max(target, [story, chapter, ord]) AS place FROM relations WHERE relation='LOCATED_IN' AND target IN {lit(PLACES)} AND source IN {lit(NAMES)} GROUP BY 1")
cte("v_place", f"SELECT n.story, n.chapter, n.approach, 'location_impossibility' AS \"check\", 'critical' AS severity, n.name||' in '||there||' but established in '||lower(place) AS detail FROM (SELECT *, unnest(list_filter({[p.lower() for p in PLACES]!r}, lambda p: contains(lower(text),p))) AS there FROM named WHERE {' OR '.join(f'''contains(lower(text),'{x}')''' for x in lexicons.STATIC_PLACES)}) n JOIN located l ON l.name=n.name WHERE there<>lower(place)")
cte("violations", " UNION ALL ".join(f"SELECT * FROM {v}" for v in ("v_names", "v_contra", "v_time", "v_ties", "v_state", "v_place")))


def checks(t):
    s = t.segments
    m = plot.mentions(s, NAMES)
    rel = settle(en.pattern_relations(s.select("story", "chapter", "text")))
    ties = rel.filter(F.initcap("source").isin(*NAMES) & F.initcap("target").isin(*NAMES))
    mood = arcs.observed_states(s, NAMES, ["story", "chapter"]).groupBy("story", "name").agg(F.max_by("emotion", "chapter").alias("emotion"))
    place = rel.filter((c("relation") == "LOCATED_IN") & c("target").isin(*PLACES) & c("source").isin(*NAMES)).groupBy(c("source").alias("name")).agg(F.max_by("target", F.struct("story", "chapter", "ord")).alias("place"))
    return {
        "names": lambda: cs.name_variants(s, s.select(F.explode(en.names(c("text"))).alias("name"))),
        "contra": lambda: cs.contradictions(with_previous(s, ["story"], ["chapter"], "text", 3)),
        "time": lambda: cs.temporal_errors(s), "ties": lambda: cs.relationship_violations(s, m, ties),
        "state": lambda: cs.state_violations(s, m, mood), "place": lambda: cs.location_violations(s, m, place, PLACES)}


for _name, _key in (("n9_name_variants", "names"), ("n10_contradictions", "contra"), ("n11_temporal_errors", "time"), ("n12_relationship_violations", "ties"), ("n13_state_violations", "state"), ("n14_location_violations", "place")):
    query(_name, f"SELECT * FROM v_{_key}")(lambda t, k=_key: checks(t)[k]())


def all_checks(t):
    out = None
    for make in checks(t).values():
        out = make() if out is None else out.unionByName(make())
    return settle(out)


CHECKS = ["name_inconsistency", "contradiction", "temporal_error", "relationship_violation", "character_state_violation", "location_impossibility"]


@query("n15_consistency_report", "SELECT story, count(*) AS total, " + ", ".join(f"count(*) FILTER (\"check\"='{x}') AS {x}" for x in CHECKS) + ", " + ", ".join(f"count(*) FILTER (severity='{x}') AS {x}" for x in lexicons.SEVERITY_WEIGHTS)
       + ", round(greatest(0.0::DOUBLE,1-sum(CASE severity WHEN 'critical' THEN 0.3::DOUBLE WHEN 'major' THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END)),6)+0.0 AS score FROM violations GROUP BY 1")
def _(t):
    return rounded(cs.report(all_checks(t)))


@query("n15_prevented", "SELECT DISTINCT story, detail FROM violations WHERE approach='unified' EXCEPT SELECT story, detail FROM violations WHERE approach='graph'")
def _(t):
    return cs.prevented(all_checks(t))


cte("lex", f"SELECT story, chapter, {TOK.format('text')} AS g, {TOK.format('concat_ws(chr(32), method, ref)')} AS r FROM prev3")
BIG = lambda x: f"list_distinct(list_transform(range(1,len({x})), lambda i: {x}[i]||' '||{x}[i+1]))"
# Longest common subsequence as the longest rising run of places in r, over the words of g: the ends of the best runs are kept in order.
SPOTS = "flatten(list_transform(g, lambda w: list_reverse_sort(list_filter(range(1,len(r)+1), lambda j: r[j]=w))))"
LCS = f"len(list_reduce(list_concat([[]::BIGINT[]], list_transform({SPOTS}, lambda j: [j])), lambda ends, j: list_concat(list_concat(list_filter(ends, lambda e: e<j[1]), j), list_slice(list_filter(ends, lambda e: e>=j[1]), 2, len(ends)))))"
cte("lexical", f"""SELECT story, chapter, 0.3*len(list_intersect(list_distinct(g),list_distinct(r)))/greatest(1,len(list_distinct(g)))+0.3*CASE WHEN len(g)>1 THEN len(list_intersect({BIG('g')},{BIG('r')}))/greatest(1,len({BIG('g')})) ELSE 0 END AS overlap, g, r FROM lex""")


def scored(t):
    s = with_previous(t.segments, ["story"], ["chapter"], "text", 3)
    return s.withColumns({"discourse": co.discourse(c("text"), c("prev"), NAMES), "temporal": co.temporal(c("text")), "voice": co.voice(c("text"), c("prev"))})


@query("n16_lexical_overlap", f"SELECT story, chapter, {sql6('overlap::DOUBLE AS overlap')} FROM lexical")
def _(t):
    s = with_previous(t.segments, ["story"], ["chapter"], "text", 3)
    return rounded(co.lexical(s, "method").select("story", "chapter", "overlap"))


cte("rouge", f"SELECT story, chapter, CASE WHEN l=0 THEN 0 ELSE 2*(l/len(g))*(l/len(r))/(l/len(g)+l/len(r)) END AS rouge_l FROM (SELECT *, {LCS} AS l FROM lex)")


@query("n17_rouge_l", "SELECT story, chapter, round(rouge_l,6)+0.0 AS rouge_l, round(overlap+rouge_l*0.4,6)+0.0 AS lexical FROM rouge JOIN lexical USING (story, chapter)")
def _(t):
    s = with_previous(t.segments, ["story"], ["chapter"], "text", 3)
    return rounded(co.lexical(s, "method").select("story", "chapter", "rouge_l", "lexical"))


CAP = "list_distinct(regexp_extract_all(regexp_replace({0},'([^\\p{{L}}\\p{{N}}_])','\\1\\1','g'),'(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][a-z]+)(?:$|[^\\p{{L}}\\p{{N}}_])',1))"


cte("s_discourse", f"""SELECT story, chapter, {sql6('''len(list_filter(''' + repr([n.lower() for n in NAMES]) + ''', lambda n: contains(lower(text),n)))/10*0.4+greatest(0.0,1-len(list_filter(f, lambda n: n NOT IN ''' + lit(lexicons.NOT_NEW) + '''))*0.15)*0.3+CASE WHEN ref2='' OR len(f)=0 THEN 0.5 ELSE len(list_intersect(f,p))/len(f) END*0.3 AS discourse''')} FROM (SELECT *, {CAP.format('text')} AS f, {CAP.format('ref2')} AS p FROM prev3)""")


@query("n18_discourse", "SELECT * FROM s_discourse")
def _(t):
    return rounded(scored(t).select("story", "chapter", "discourse"))


CNT = lambda ws: f"len(list_filter(tk, lambda w: w IN {lit(ws)}))"


cte("s_temporal", f"""SELECT story, chapter, {sql6('''greatest(0.0,least(1.0,CASE WHEN a+b>0 THEN greatest(a,b)/(a+b) ELSE 0.7 END*0.5+least(1.0,''' + HITS(lexicons.SEQUENCE_WORDS) + '''/3)*0.3+0.2''' + "".join(f"+CASE WHEN regexp_matches(lower(text),'{p}') THEN {w} ELSE 0 END" for p, w in lexicons.TIME_PENALTIES) + '''))::DOUBLE AS temporal''')} FROM (SELECT *, {CNT(lexicons.PAST_WORDS)} AS a, {CNT(lexicons.PRESENT_WORDS)} AS b FROM (SELECT *, {TOK.format('text')} AS tk FROM segments))""")


@query("n19_temporal", "SELECT * FROM s_temporal")
def _(t):
    return rounded(t.segments.select("story", "chapter", co.temporal(c("text")).alias("temporal")))


LONG = lambda x: "list_filter(" + SENTS.format(x) + ", lambda x: length(x)>10)"
MEAN = lambda x: f"list_avg(list_transform({LONG(x)}, lambda x: len({WORDS.format('x')})))"
VIEW = lambda x: f"(len(list_filter({x}, lambda w: w IN {lit(lexicons.FIRST_PERSON)}))/(len(list_filter({x}, lambda w: w IN {lit(lexicons.FIRST_PERSON)}))+len(list_filter({x}, lambda w: w IN {lit(lexicons.THIRD_PERSON)}))+1))"
TTR = lambda x: f"(len(list_distinct({x}))/len({x}))"


cte("s_voice", f"""SELECT story, chapter, {sql6('''CASE WHEN last IS NULL THEN 1.0 WHEN len(''' + LONG('text') + ''')=0 OR len(''' + LONG('ref') + ''')=0 THEN 0.5 ELSE greatest(0.0,1-abs(ma-mb)/greatest(mb,1.0))*0.3+(1-abs(''' + VIEW('g') + '-' + VIEW('r') + '''))*0.5+(1-least(abs(''' + TTR('g') + '-' + TTR('r') + ''')*2,1.0))*0.2 END::DOUBLE AS voice''')} FROM (
 SELECT *, {MEAN('text')} AS ma, {MEAN('ref')} AS mb, {TOK.format('text')} AS g, {TOK.format('ref')} AS r FROM prev3)""")


@query("n20_voice", "SELECT * FROM s_voice")
def _(t):
    return rounded(scored(t).select("story", "chapter", "voice"))


BEST = f"SELECT a.label, a.vec_id, max({COS}) AS m FROM embeddings a JOIN embeddings b ON a.label=b.label WHERE a.vec_id%2=1 AND b.vec_id%2=0 GROUP BY 1,2"


cte("s_semantic", f"SELECT label, {sql6('least(1.0,o*0.6+x*0.3+greatest(0.0,0.1-v)) AS semantic')} FROM (SELECT label, avg(m) AS x, var_pop(m) AS v FROM ({BEST}) GROUP BY 1) JOIN (SELECT a.label, {COS} AS o FROM (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) a JOIN (SELECT label, arg_max(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) b USING (label)) USING (label)")


def semantic_scores(t):
    """Semantic coherence per label: sentences are the odd vectors of a label, their context the even ones."""
    e = t.embeddings.select("vec_id", "label", c("embedding").alias("vec"))
    best = retrieval.vector_top_k(e.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "qid"), e.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "id"), 1, group="label")
    stats = best.join(e.select(c("vec_id").alias("qid"), "label"), "qid").groupBy("label").agg(F.avg("score").alias("x"), F.var_pop("score").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    ends = e.groupBy("label").agg(F.min_by("vec", "vec_id").alias("a"), F.max_by("vec", "vec_id").alias("b"))
    o = ends.select("label", F.round(dot(c("a"), c("b")) / F.sqrt(dot(c("a"), c("a"))) / F.sqrt(dot(c("b"), c("b"))), 9).alias("o"))
    return rounded(stats.join(o, "label").select("label", co.semantic(c("o"), c("x"), c("v")).alias("semantic")))


@query("n21_semantic", "SELECT * FROM s_semantic")
def _(t):
    return semantic_scores(t)


def parts(t):
    """All five parts; a story owns the vectors of its label, and without any its semantic part is neutral."""
    s = co.lexical(scored(t), "method").withColumn("label", (c("story") % 10).cast("int"))
    s = s.join(semantic_scores(t), "label", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.5)))
    return s.withColumns({p: F.round(p, 6) + F.lit(0.0) for p in ("lexical", "discourse", "temporal", "voice")})


cte("scores", "SELECT story, chapter, approach, 0.25*coalesce(semantic,0.5)+0.2*round(overlap+rouge_l*0.4,6)+0.25*discourse+0.15*temporal+0.15*voice AS composite FROM segments JOIN lexical USING (story, chapter) JOIN (SELECT story, chapter, rouge_l FROM rouge) USING (story, chapter) JOIN s_discourse USING (story, chapter) JOIN s_temporal USING (story, chapter) JOIN s_voice USING (story, chapter) LEFT JOIN s_semantic ON label=story%10")


# Both sides round each part to six digits before it is weighted.
@query("n22_composite", "SELECT story, chapter, approach, round(composite,9)+0.0 AS composite FROM scores")
def _(t):
    return co.composite(parts(t)).select("story", "chapter", "approach", (F.round("composite", 9) + F.lit(0.0)).alias("composite"))


@query("n22_approach_comparison", "SELECT story, " + ", ".join(f"round(avg(composite) FILTER (approach='{a}'),9)+0.0 AS {a}" for a in lexicons.APPROACHES) + " FROM scores GROUP BY 1")
def _(t):
    out = co.compare_approaches(co.composite(parts(t)))
    return out.select("story", *[(F.round(a, 9) + F.lit(0.0)).alias(a) for a in lexicons.APPROACHES])


def log(t):
    return t.events.select("event_id", "event_type", c("value").alias("latency"), (c("user_id") % 3 == 0).alias("cached"), (c("user_id") % 11).alias("results"),
                           F.when(c("event_id") % 4 == 0, c("value") / 100).alias("evaluation"), (c("event_type") == "error").alias("error"), "user_id", "ts")


@query("l1_query_summary", f"SELECT event_type, count(*) AS total, {sql6('avg((user_id%3=0)::INT) AS hit_rate', 'avg(value) AS mean_latency', 'avg(user_id%11) AS mean_results', 'avg(CASE WHEN event_id%4=0 THEN value/100 END) AS mean_evaluation')}, count(*) FILTER (event_type='error') AS errors FROM events GROUP BY 1")
def _(t):
    return rounded(tm.query_summary(log(t), ["event_type"]))


@query("l2_recent_queries", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def _(t):
    return tm.recent(log(t), "event_id").select("event_id", "event_type")


@query("l3_latency", f"SELECT event_type, count(*) AS n, {sql6('avg(value) AS mean')}, round(list_sort(list(value))[floor(0.95*count(*))::BIGINT+1],6)+0.0 AS p95 FROM events GROUP BY 1")
def _(t):
    return rounded(tm.latency(log(t), ["event_type"], "latency")).select("event_type", "n", "mean", "p95")


@query("l4_run_summary", f"SELECT user_id AS run_id, count(*) AS steps, {sql6('min(value) AS min_loss', 'max(value) AS max_loss', 'avg(value) AS avg_loss', 'arg_max(value, event_id) AS final_loss')}, CAST(floor(epoch(max(ts)))-floor(epoch(min(ts))) AS BIGINT) AS duration FROM events GROUP BY 1")
def _(t):
    m = t.events.select(c("user_id").alias("run_id"), c("event_id").alias("step"), c("value").alias("loss"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', date_trunc('SECOND', ts))").alias("seconds"))
    return rounded(tm.run_summary(m))


@query("l5_system_row", f"SELECT (SELECT count(*) FROM events) AS queries, (SELECT count(*) FROM events WHERE user_id%3=0) AS cache_hits, (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM (SELECT unnest(range(0,len(w),462)) AS s, w FROM (SELECT {WORDS.format('text')} AS w FROM documents)) WHERE length(array_to_string(list_slice(w,s+1,s+512),' '))>20) AS chunks, round((SELECT count(*) FROM events WHERE user_id%3=0)/(SELECT count(*) FROM events),6) AS hit_rate")
def _(t):
    return rounded(tm.system_row(log(t), t.documents, textprep.word_chunks(t.documents)))


@query("l6_narrative_dashboard", "SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(*) FROM segments) AS segments, (SELECT count(DISTINCT character) FROM char_states) AS characters_tracked")
def _(t):
    return tm.narrative_dashboard(t.g_nodes, t.g_edges, t.segments, t.char_states)
