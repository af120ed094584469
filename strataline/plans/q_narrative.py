"""Arc, plot, trope and feedback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons
from ..operators import arcs, feedback as fb, plot
from ..operators.scale import settle, with_previous
from ..sources import sinks
from .q_graph import SENTS, lit
from .q_meta import rounded, sql6
from .q_retrieval import WORDS
from .q_text import STRIP
from .registry import cte, query
from .stories import NAMES, TYPES

c = F.col
SHIFT = "CASE " + " ".join(f"WHEN pe='{a}' AND emotion='{b}' THEN {w}" for (a, b), w in lexicons.SHIFT_WEIGHTS.items()) + " ELSE 0.5 END"
EXC = lambda a, b: f"len(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
cte("moves", f"""SELECT * FROM (SELECT *, list_sum(list_filter([we,wg,wr,wk,wp], lambda x: x IS NOT NULL))/len(list_filter([we,wg,wr,wk,wp], lambda x: x IS NOT NULL)) AS magnitude FROM (
 SELECT character, pc AS from_chapter, chapter AS to_chapter, CASE WHEN emotion<>pe THEN {SHIFT} END::DOUBLE AS we, CASE WHEN g>0 THEN least(0.7+0.1*g,1.0) END::DOUBLE AS wg, CASE WHEN rel>0.3 THEN least(rel,1.0) END::DOUBLE AS wr, CASE WHEN k>0 THEN 0.8 END::DOUBLE AS wk, CASE WHEN phase<>pp THEN 0.9 END::DOUBLE AS wp FROM (
 SELECT *, {EXC('pg', 'goals')}+{EXC('goals', 'pg')} AS g, {EXC('knowledge', 'pk')} AS k, round({'+'.join(f'abs(coalesce(r_{t},0)-coalesce(p_{t},0))' for t in TYPES)},6) AS rel FROM (
 SELECT *, lag(chapter) OVER w AS pc, lag(emotion) OVER w AS pe, lag(goals) OVER w AS pg, lag(knowledge) OVER w AS pk, lag(phase) OVER w AS pp, {','.join(f'lag(r_{t}) OVER w AS p_{t}' for t in TYPES)} FROM char_states WINDOW w AS (PARTITION BY character ORDER BY chapter)) WHERE pc IS NOT NULL)))
 WHERE round(magnitude,9)>=0.4""")
KIND = "CASE WHEN wk IS NOT NULL THEN 'revelation' WHEN wp IS NOT NULL THEN 'arc_progression' WHEN wg IS NOT NULL AND we IS NOT NULL THEN 'growth' WHEN wr>0.7 THEN 'reversal' WHEN wr IS NOT NULL THEN 'relationship_shift' ELSE 'gradual_change' END"


@query("n1_arc_transitions", f"SELECT character, from_chapter, to_chapter, {KIND} AS transformation, round(magnitude,9) AS magnitude FROM moves")
def _(t):
    return arcs.transitions(t.char_states).withColumn("magnitude", F.round("magnitude", 9))


CHAP_EV = "SELECT day(o_orderdate) AS chapter, o_orderkey AS seq, 'Order#'||o_orderkey AS name FROM orders"


@query("n2_trigger_events", f"""WITH l AS (SELECT chapter, arg_max(name, seq) AS name FROM ({CHAP_EV}) GROUP BY 1) SELECT m.character, m.from_chapter, m.to_chapter, coalesce(arg_max(l.name, l.chapter),'unknown_catalyst') AS trigger FROM moves m LEFT JOIN l ON l.chapter BETWEEN m.from_chapter AND m.to_chapter GROUP BY 1,2,3""")
def _(t):
    ev = t.orders.select(F.dayofmonth("o_orderdate").cast("long").alias("chapter"), c("o_orderkey").alias("seq"), F.concat(F.lit("Order#"), c("o_orderkey").cast("string")).alias("name"))
    return arcs.trigger_events(arcs.transitions(t.char_states), ev).select("character", "from_chapter", "to_chapter", "trigger")


RS = "round(" + "+".join(f"coalesce(r_{t},0)" for t in TYPES) + ",6)"
GOOD = lit(lexicons.POSITIVE_EMOTIONS)


@query("n3_trajectory", f"""SELECT character, n, CASE WHEN n<3 THEN 'early_development' WHEN up>down THEN 'ascending_arc' WHEN down>up THEN 'descending_arc' ELSE 'flat_arc' END AS trajectory FROM (
 SELECT character, n, (b.g>a.g)::INT+(b.r>a.r)::INT+(b.e IN {GOOD})::INT AS up, (b.g<a.g)::INT+(b.r<a.r)::INT+(a.e IN {GOOD} AND b.e NOT IN {GOOD})::INT AS down FROM (
 SELECT character, count(*) AS n, arg_min({{'e': emotion, 'g': len(goals), 'r': {RS}}}, chapter) AS a, arg_max({{'e': emotion, 'g': len(goals), 'r': {RS}}}, chapter) AS b FROM char_states GROUP BY 1))""")
def _(t):
    return arcs.trajectory(t.char_states)


@query("n4_relationship_evolution", " UNION ALL ".join(f"SELECT character, chapter, '{x}' AS other, r_{x}+0.0 AS strength FROM char_states WHERE r_{x} IS NOT NULL" for x in TYPES))
def _(t):
    return rounded(arcs.relationship_evolution(t.char_states))


@query("n5_arc_themes", """SELECT DISTINCT character, theme FROM (SELECT *, row_number() OVER (PARTITION BY character, kind ORDER BY n DESC, theme) AS rn FROM (
 SELECT character, 0 AS kind, theme, count(*) AS n FROM (SELECT character, unnest(goals) AS theme FROM char_states) GROUP BY 1,3 UNION ALL SELECT character, 1, emotion, count(*) FROM char_states GROUP BY 1,3)) WHERE rn<=3""")
def _(t):
    return arcs.themes(t.char_states)


ASK = "SELECT o_custkey%150 AS character, day(o_orderdate) AS chapter, o_orderkey AS request FROM orders"


@query("n6_state_as_of", f"SELECT r.character, r.request, r.chapter AS asked, coalesce(s.chapter,0) AS chapter, s.emotion FROM ({ASK}) r ASOF LEFT JOIN char_states s ON r.character=s.character AND r.chapter>=s.chapter")
def _(t):
    ask = t.orders.select((c("o_custkey") % 150).alias("character"), F.dayofmonth("o_orderdate").cast("long").alias("chapter"), c("o_orderkey").alias("request"))
    out = arcs.state_as_of(ask, settle(t.char_states))
    return out.select("character", "request", "asked", F.coalesce("chapter", F.lit(0)).alias("chapter"), "emotion")


@query("n7_next_phase", "SELECT character, CASE phase WHEN 'setup' THEN 'rising_action' WHEN 'rising_action' THEN 'crisis' WHEN 'crisis' THEN 'climax' ELSE 'resolution' END AS next_phase FROM (SELECT character, arg_max(phase, chapter) AS phase FROM char_states GROUP BY 1)")
def _(t):
    return arcs.latest(t.char_states).select("character", arcs.next_phase(c("phase")).alias("next_phase"))


MOOD = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text),'{w}')" for w in ws) + f" THEN '{m}'" for m, ws in lexicons.EMOTION_WORDS.items()) + " ELSE 'neutral' END"
GOALS = ("list_slice(list_filter(flatten(list_transform(list_filter(string_split(text,'.'), lambda s: contains(lower(s),lower(name))), lambda s: list_filter(["
         + ",".join(f"CASE WHEN contains(lower(s),'{p}') THEN trim(string_split(lower(s),'{p}')[2])[:50] END" for p in lexicons.GOAL_PHRASES) + "], lambda x: x IS NOT NULL))), lambda g: g<>''),1,3)")
cte("named", f"SELECT s.*, unnest(list_filter({NAMES!r}, lambda n: contains(lower(text),lower(n)))) AS name FROM segments s")


@query("n8_observed_states", f"SELECT story, chapter, name, {MOOD} AS emotion, array_to_string({GOALS},'|') AS goals FROM named")
def _(t):
    s = arcs.observed_states(t.segments, NAMES, ["story", "chapter"])
    return s.select("story", "chapter", "name", "emotion", F.array_join("goals", "|").alias("goals"))


@query("n23_approach_metrics", f"""WITH p AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY story ORDER BY chapter),'') AS context FROM segments), q AS (SELECT *, len(list_intersect(list_distinct({WORDS.format('lower(text)')}), list_distinct({WORDS.format('lower(context)')}))) AS o, len(list_filter({NAMES!r}, lambda n: contains(lower(text),lower(n)))) AS m FROM p)
SELECT story, chapter, {sql6('''least(1.0,greatest(0.1,CASE approach WHEN 'unified' THEN least(0.8,0.4+o*0.05) WHEN 'graph' THEN least(0.9,0.5+m*0.08) ELSE least(0.95,0.5+o*0.03+m*0.05) END+CASE WHEN length(text)>500 THEN 0.05 ELSE 0 END+CASE WHEN ''' + ' OR '.join(f"contains(lower(text),'{w}')" for w in lexicons.CONNECTIVES) + ''' THEN 0.03 ELSE 0 END))::DOUBLE AS coherence''',
 '''least(1.0,greatest(0.1,CASE approach WHEN 'unified' THEN 0.8*0.5+m/10*0.3+0.1 WHEN 'graph' THEN least(0.98,0.95+CASE WHEN ''' + ' OR '.join(f"contains(lower(text),'{w}')" for w in lexicons.KIN_WORDS) + ''' THEN 0.05 ELSE 0 END) ELSE 0.88 END))::DOUBLE AS consistency''')} FROM q""")
def _(t):
    s = with_previous(t.segments, ["story"], ["chapter"], "text", 1).withColumn("context", F.array_join("prev", " "))
    return rounded(plot.approach_metrics(s, NAMES, 2).select("story", "chapter", "coherence", "consistency"))


@query("n23_source_diversity", f"SELECT source, {sql6('count(DISTINCT text)/count(*) AS diversity')} FROM documents GROUP BY 1")
def _(t):
    return rounded(plot.source_diversity(t.documents, ["source"], "text"))


@query("n24_fusion_context", f"""WITH u AS (SELECT story, text, row_number() OVER (PARTITION BY story ORDER BY chapter) AS rn FROM segments WHERE approach='unified'), k AS (SELECT DISTINCT story, 0 AS kind, text AS key FROM segments WHERE approach='unified' UNION ALL SELECT DISTINCT story, 1, 'char_'||lower(name) FROM named WHERE approach='graph')
SELECT story, coalesce(semantic,'') AS semantic, {sql6('diversity')} FROM (SELECT story, count(DISTINCT key)/count(*) AS diversity FROM k GROUP BY 1) LEFT JOIN (SELECT story, string_agg(text, chr(10) ORDER BY rn) AS semantic FROM u WHERE rn<=2 GROUP BY 1) USING (story)""")
def _(t):
    ent = plot.mentions(t.segments.filter("approach = 'graph'"), NAMES).select("story", F.concat(F.lit("char_"), F.lower("name")).alias("id"))
    return rounded(plot.fusion_context(t.segments, ent))


def trope_sql():
    out = []
    for name, (cat, keys, anti, need) in lexicons.TROPES.items():
        hits = f"list_filter({keys!r}, lambda k: contains(lower(text),k))"
        no = f" AND NOT ({' OR '.join(f'''contains(lower(text),'{a}')''' for a in anti)})" if anti else ""
        out.append(f"SELECT story, chapter, text, '{name}' AS trope, '{cat}' AS category, round(least(1.0, len({hits})/{need + 2}),6)::DOUBLE AS confidence, {hits} AS hits FROM segments WHERE len({hits})>={need}{no}")
    return " UNION ALL ".join(out)


cte("trope_hits", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story, trope ORDER BY chapter) AS rn FROM ({trope_sql()})) WHERE rn=1")


@query("n25_tropes", f"""SELECT story, trope, category, chapter, confidence, array_to_string(list_transform(list_slice(hits,1,3), lambda k: {STRIP.format("list_filter(string_split(text,'.'), lambda s: contains(lower(s),k))[1]")}[:100]),'|') AS evidence,
 array_to_string(list_slice(list_filter({NAMES!r}, lambda n: contains(lower(text),lower(n))),1,3),',') AS involved FROM trope_hits""")
def _(t):
    return plot.tropes(t.segments, NAMES).withColumns({"evidence": F.array_join("evidence", "|"), "involved": F.array_join("involved", ",")})


CATS = sorted({x for x, *_ in lexicons.TROPES.values()})
H = lambda *x: "(" + " OR ".join(f"list_contains(have,'{i}')" for i in x) + ")"


@query("n26_thematic_summary", f"""SELECT story, total, {', '.join(f'n_{x}' for x in CATS)}, list_min([{','.join(f"{{'n': -n_{x}, 'c': '{x}'}}" for x in CATS)}]).c AS dominant,
 CASE WHEN {H('hero_journey', 'quest_narrative')} THEN 'Epic Adventure' WHEN {H('mystery_reveal')} THEN 'Mystery/Thriller' WHEN {H('love_triangle', 'rivals_to_lovers')} THEN 'Romance/Drama' WHEN {H('good_vs_evil')} THEN 'Classic Fantasy' WHEN {H('internal_conflict')} THEN 'Character Study' WHEN {H('coming_of_age')} THEN 'Coming-of-Age' ELSE 'Mixed Genre' END AS style,
 top, array_to_string(list_slice(list_filter([CASE WHEN {H('hero_journey')} AND NOT {H('sacrifice_theme')} THEN 'add a sacrifice' END, CASE WHEN {H('betrayal')} AND NOT {H('redemption_arc')} THEN 'redeem the betrayer' END, CASE WHEN {H('good_vs_evil')} THEN 'add moral grey areas' END, CASE WHEN n_relationship=0 THEN 'develop relationships' END, CASE WHEN total<3 THEN 'continue the story' END], lambda x: x IS NOT NULL),1,3),'|') AS suggestions
 FROM (SELECT story, count(*) AS total, {', '.join(f"count(*) FILTER (category='{x}') AS n_{x}" for x in CATS)}, list(trope) AS have FROM trope_hits GROUP BY 1) JOIN (SELECT story, string_agg(trope, ',' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY confidence DESC, trope) AS r FROM trope_hits) WHERE r<=5 GROUP BY 1) USING (story)""")
def _(t):
    s = plot.thematic_summary(settle(plot.tropes(t.segments, NAMES)))
    return s.withColumns({"top": F.array_join("top", ","), "suggestions": F.array_join("suggestions", "|")})


SC = "[" + ",".join(f"{{'s': {'+'.join(f'''regexp_matches(lower(s),'{p}')::INT''' for p in ps)}, 'o': {-i}, 'k': '{k}'}}" for i, (k, ps) in enumerate(lexicons.PLOT_PATTERNS.items())) + "]"
cte("points", f"""SELECT story, chapter, seq, CASE WHEN b.s>0 THEN b.k WHEN length(s)>50 AND ({' OR '.join(f"contains(lower(s),'{w}')" for w in lexicons.DEVELOPMENT_WORDS)}) THEN 'development' END AS event_type, array_to_string(list_slice({WORDS.format('s')},1,6),' ') AS title, s[:200] AS description,
 array_to_string(list_filter({NAMES!r}, lambda n: contains(lower(s),lower(n))),',') AS involved, list_filter({lexicons.CAUSAL_WORDS!r}, lambda w: contains(lower(s),w)) AS causal FROM (SELECT *, list_max({SC}) AS b FROM (
 SELECT story, chapter, unnest(p) AS s, unnest(range(0,len(p)))::INT AS seq FROM (SELECT story, chapter, list_filter({SENTS.format('text')}, lambda x: length(x)>20) AS p FROM segments)))""")


def points(t):
    return plot.plot_points(t.segments, NAMES)


@query("n27_plot_points", "SELECT story, chapter, seq, event_type, CASE WHEN length(title)>50 THEN title[:47]||'...' ELSE title END AS title, involved FROM points WHERE event_type IS NOT NULL")
def _(t):
    return points(t).select("story", "chapter", "seq", "event_type", "title", F.array_join("involved", ",").alias("involved"))


cte("links", "SELECT story, chapter, cause, seq AS effect, unnest(causal) AS word FROM (SELECT *, lag(seq) OVER (PARTITION BY story, chapter ORDER BY seq) AS cause FROM points WHERE event_type IS NOT NULL) WHERE cause IS NOT NULL")


@query("n28_causal_links", "SELECT * FROM links")
def _(t):
    return plot.causal_links(points(t))


@query("n29_structure", f"""WITH p AS (SELECT * FROM points WHERE event_type IS NOT NULL), n AS (SELECT story, count(*) AS total_events, max(chapter) AS chapters FROM p GROUP BY 1),
 a AS (SELECT story, CASE WHEN chapter<=greatest(1,chapters//4) THEN 1 WHEN chapter<=greatest(greatest(1,chapters//4)+1,chapters*3//4) THEN 2 ELSE 3 END AS act, event_type, count(*) AS n FROM p JOIN n USING (story) WHERE chapters>=3 GROUP BY 1,2,3),
 b AS (SELECT story, act, arg_min(event_type, {{'n': -n, 't': event_type}}) AS k, CAST(sum(n) AS BIGINT) AS m FROM a GROUP BY 1,2)
SELECT n.story, total_events, chapters, round(total_events/chapters,2) AS events_per_chapter, CASE WHEN total_events/chapters<1 THEN 'slow' WHEN total_events/chapters<2 THEN 'moderate' WHEN total_events/chapters<4 THEN 'fast' ELSE 'very_fast' END AS pacing,
 {', '.join(f"coalesce(b{i}.k,'none') AS act{i}, coalesce(b{i}.m,0) AS act{i}_events" for i in (1, 2, 3))} FROM n {' '.join(f'LEFT JOIN b b{i} ON b{i}.story=n.story AND b{i}.act={i}' for i in (1, 2, 3))}""")
def _(t):
    return plot.structure(settle(points(t)))


@query("n30_timeline_holes", """SELECT story, chapter, seq, 'revelation_without_setup' AS hole FROM points p WHERE event_type='revelation' AND NOT EXISTS (SELECT 1 FROM links l WHERE l.story=p.story AND l.chapter=p.chapter AND l.effect=p.seq)
 UNION ALL SELECT story, chapter, seq, 'unresolved_conflict' FROM points p WHERE event_type='conflict' AND NOT EXISTS (SELECT 1 FROM points r WHERE r.story=p.story AND r.event_type='resolution' AND r.chapter>p.chapter)""")
def _(t):
    p = settle(points(t))
    return plot.timeline_holes(p, settle(plot.causal_links(p)))


EV = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lexicons.EMOTION_VALUES.items()) + " ELSE 0.5 END"


@query("n31_story_health", f"""WITH r AS (SELECT 'relationship_conflict' AS kind, 'high' AS severity, (SELECT count(*) FROM ({" UNION ALL ".join(f"SELECT DISTINCT a.src, a.dst, '{x}' FROM g_edges a JOIN g_edges b ON a.src=b.src AND a.dst=b.dst WHERE a.relation='{x}' AND b.relation='{y}'" for x, y in lexicons.CONFLICTING_PAIRS)})) AS n
 UNION ALL SELECT 'orphaned_event','high',(SELECT count(*) FROM g_nodes WHERE type='EVENT' AND first_appearance>1 AND id NOT IN (SELECT dst FROM g_edges WHERE relation='CAUSED_BY'))
 UNION ALL SELECT 'disappeared_character','medium',(SELECT count(*) FROM (SELECT story, name, max(chapter) AS l FROM named GROUP BY 1,2) JOIN (SELECT story, max(chapter) AS now FROM segments GROUP BY 1) USING (story) WHERE now-l>2)
 UNION ALL SELECT 'chekhovs_gun','medium',(SELECT count(*) FROM g_nodes WHERE type='ARTIFACT' AND 8-first_appearance>=2 AND (SELECT count(*) FROM g_edges WHERE src=id)<2)
 UNION ALL SELECT 'abrupt_change','low',(SELECT count(*) FROM (SELECT emotion, lag(emotion) OVER (PARTITION BY character ORDER BY chapter) AS p FROM char_states) WHERE p IS NOT NULL AND round(abs({EV.format('emotion')}-{EV.format('p')}),6)>0.7)),
 s AS (SELECT CAST(100-20*sum(n) FILTER (severity='high')-5*sum(n) FILTER (severity='medium') AS BIGINT) AS score FROM r)
SELECT kind, severity, n, score, CASE WHEN score>=90 THEN 'Excellent' WHEN score>=70 THEN 'Good' WHEN score>=50 THEN 'Needs Work' ELSE 'Critical' END AS health FROM r, s""")
def _(t):
    return plot.story_health(t.g_nodes, t.g_edges, t.segments, t.char_states, NAMES, 8)


cte("plants", f"SELECT story, chapter, word, {STRIP.format('''list_filter(string_split(text,'.'), lambda s: contains(lower(s),word))[1]''')}[:80] AS hint FROM (SELECT story, chapter, text, unnest(list_filter({lexicons.FORESHADOW_WORDS!r}, lambda w: contains(lower(text),w))) AS word FROM segments)")


@query("n32_foreshadowing", "SELECT story, chapter, word, hint, max(chapter) OVER (PARTITION BY story, word)>chapter AS resolved FROM plants")
def _(t):
    return plot.foreshadowing(t.segments)


HITS = lambda ws: "(" + "+".join(f"contains(lower(text),'{w}')::INT" for w in ws) + ")"
cte("paced", f"""SELECT story, chapter, round(l,2) AS tension_level, word_count, CASE WHEN l>0.7 THEN 'intense' WHEN l<0.3 THEN 'slow' ELSE 'balanced' END AS pacing FROM (SELECT story, chapter, ((t-c)/greatest(1,t+c)+1)/2 AS l, word_count FROM (
 SELECT story, chapter, {HITS(lexicons.TENSION_WORDS)} AS t, {HITS(lexicons.CALM_WORDS)} AS c, len({WORDS.format('text')}) AS word_count FROM segments))""")


@query("n33_pacing", "SELECT * FROM paced")
def _(t):
    return plot.pacing(t.segments)


@query("n33_pacing_issues", "SELECT story, pc AS from_chapter, chapter AS to_chapter, pacing FROM (SELECT *, lag(pacing) OVER w AS pp, lag(chapter) OVER w AS pc FROM paced WINDOW w AS (PARTITION BY story ORDER BY chapter)) WHERE pp=pacing AND pacing IN ('slow','intense')")
def _(t):
    return plot.pacing_issues(plot.pacing(t.segments))


@query("n34_suggestions", f"""WITH x AS (SELECT 'Resolve '||a.name||' vs '||b.name||' conflict' AS title, 'unresolved_conflict' AS kind, least(1.0,(6-chapter)/5)::DOUBLE AS urgency, 0.8::DOUBLE AS impact FROM g_edges e JOIN g_nodes a ON a.id=e.src JOIN g_nodes b ON b.id=e.dst WHERE relation='CONFLICTS_WITH' AND 6-chapter>=2
 UNION ALL SELECT 'Develop '||character||'''s character arc','character_arc_gap',least(1.0,(6-m)/5),0.7 FROM (SELECT character, max(chapter) AS m FROM char_states GROUP BY 1) WHERE 6-m>=2
 UNION ALL SELECT 'Shift '||character||'''s emotional state','character_arc_gap',0.5,0.6 FROM (SELECT character, emotion, row_number() OVER (PARTITION BY character ORDER BY chapter DESC) AS rn FROM char_states) WHERE rn<=3 GROUP BY character HAVING count(*)=3 AND min(emotion)=max(emotion)
 UNION ALL SELECT 'Use the '||name||' '||id,'chekhov_gun',least(1.0,(6-first_appearance)/4),0.8 FROM g_nodes WHERE type='ARTIFACT' AND 6-first_appearance>=2 AND id NOT IN (SELECT src FROM g_edges WHERE dst IN (SELECT id FROM g_nodes WHERE type='EVENT'))
 UNION ALL SELECT 'Return to '||name,'underutilized_location',0.3,0.4 FROM g_nodes LEFT JOIN (SELECT src, max(chapter) AS c FROM g_edges GROUP BY 1) ON src=id WHERE type='LOCATION' AND 6-greatest(first_appearance, coalesce(c,first_appearance))>=3
 UNION ALL SELECT * FROM (SELECT 'Connect '||a.id||' and '||b.id,'relationship_opportunity',0.4,0.6 FROM g_nodes a JOIN g_nodes b ON a.id<b.id WHERE a.type='CHARACTER' AND b.type='CHARACTER' AND 6-a.first_appearance>=1 AND 6-b.first_appearance>=1 AND (a.id,b.id) NOT IN (SELECT (src,dst) FROM g_edges) AND (b.id,a.id) NOT IN (SELECT (src,dst) FROM g_edges) ORDER BY a.id, b.id LIMIT 3000))
SELECT title, kind, (['urgent','high','medium','low'])[p+1] AS priority, {sql6('urgency', 'impact')} FROM (SELECT *, CASE WHEN s>=0.8 THEN 0 WHEN s>=0.6 THEN 1 WHEN s>=0.4 THEN 2 ELSE 3 END AS p FROM (SELECT *, round((urgency+impact)/2,6) AS s FROM x)) ORDER BY p, urgency DESC, impact DESC, title LIMIT 3000""")
def _(t):
    return rounded(plot.suggestions(t.g_nodes, t.g_edges, settle(t.char_states), 6, 3000))


@query("n35_emotion_series", f"SELECT character, chapter, ({EV.format('emotion')})::DOUBLE AS value, phase FROM char_states")
def _(t):
    return t.char_states.select("character", "chapter", arcs.emotion_value(c("emotion")).alias("value"), "phase")


@query("n36_narrative_statistics", f"SELECT story, count(*) AS segments, count(DISTINCT chapter) AS chapters, CAST(sum(len({WORDS.format('text')})) AS BIGINT) AS words, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM segments GROUP BY 1")
def _(t):
    return plot.narrative_statistics(t.segments)


@query("n36_chapter_segments", f"SELECT story, chapter, method, text, len({WORDS.format('text')}) AS words FROM segments WHERE method='assistant'")
def _(t):
    return plot.chapter_segments(t.segments, "assistant")


AVG = "((" + "+".join(lexicons.RATINGS) + ")/5)"


@query("n37_by_approach", f"SELECT approach, count(*) AS n, {sql6(f'avg({AVG}) AS average_rating')}, count(*) FILTER (selected_best) AS best_selections FROM feedback GROUP BY 1")
def _(t):
    return rounded(fb.by_approach(t.feedback))


@query("n38_dimension_matrix", " UNION ALL ".join(f"SELECT '{r}' AS dimension, " + ", ".join(f"round(coalesce(avg({r}) FILTER (approach='{a}'),0),6) AS {a}" for a in lexicons.APPROACHES) + " FROM feedback" for r in lexicons.RATINGS))
def _(t):
    return rounded(fb.dimension_matrix(t.feedback))


@query("n39_trends", f"SELECT seq, approach, {sql6(AVG + ' AS rating')} FROM feedback ORDER BY seq DESC LIMIT 10")
def _(t):
    return rounded(fb.trends(t.feedback))


@query("n39_by_chapter", f"SELECT chapter, {sql6(f'avg({AVG}) AS average')}, count(*) AS n FROM feedback GROUP BY 1")
def _(t):
    return rounded(fb.by_chapter(t.feedback))


_MV = lambda a: f"greatest(0.1, {a[0]}+CASE WHEN approach='{a[1]}' THEN 0.1*(m-3)/2+CASE WHEN selected_best THEN 0.05 ELSE 0 END ELSE 0 END)"


WEIGHTS = f"""WITH RECURSIVE f AS (SELECT story, approach, selected_best, {AVG} AS m, row_number() OVER (PARTITION BY story ORDER BY seq) AS i FROM feedback),
 s AS (SELECT story, 0::BIGINT AS i, 0.33::DOUBLE AS u, 0.33::DOUBLE AS g, 0.34::DOUBLE AS h FROM (SELECT DISTINCT story FROM feedback) UNION ALL
 SELECT story, i, x/(x+y+z), y/(x+y+z), z/(x+y+z) FROM (SELECT s.story, f.i, {_MV(('u', 'unified'))} AS x, {_MV(('g', 'graph'))} AS y, {_MV(('h', 'hybrid'))} AS z FROM s JOIN f ON f.story=s.story AND f.i=s.i+1))
SELECT story, n, {sql6('w.u AS unified', 'w.g AS graph', 'w.h AS hybrid')}, CASE WHEN round(w.u,9)>=round(w.g,9) AND round(w.u,9)>=round(w.h,9) THEN 'unified' WHEN round(w.g,9)>=round(w.h,9) THEN 'graph' ELSE 'hybrid' END AS recommended
 FROM (SELECT story, max(i) AS n, arg_max({{'u': u, 'g': g, 'h': h}}, i) AS w FROM s GROUP BY 1)"""


@query("n40_learned_weights", WEIGHTS)
def _(t):
    return rounded(fb.learned_weights(t.feedback))


@query("n41_improvements", f"""WITH d AS ({" UNION ALL ".join(f"SELECT '{r}' AS dimension, (" + "+".join(f"avg({r}) FILTER (approach='{a}')" for a in lexicons.APPROACHES) + ")/3 AS m FROM feedback" for r in lexicons.RATINGS)})
SELECT 'weak_dimension' AS kind, dimension AS subject, round(m,6) AS value FROM d WHERE m<3 UNION ALL SELECT * FROM (SELECT 'approach_recommendation', approach, round(avg({AVG}),6) FROM feedback GROUP BY approach ORDER BY avg({AVG}) DESC LIMIT 1)""")
def _(t):
    return rounded(fb.improvements(t.feedback))


@query("s21_feedback_round_trip", f"SELECT approach, count(*) AS n, CAST(sum(overall) AS BIGINT) AS overall FROM feedback GROUP BY 1")
def _(t):
    from .q_sources import scratch

    path = scratch(t, "feedback")
    sinks.feedback(t.feedback, path)
    back = t.spark.read.json(path)
    return back.select("approach", "ratings.*").groupBy("approach").agg(F.count(F.lit(1)).alias("n"), F.sum("overall").alias("overall"))
