"""Entity extraction and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons
from ..operators import entities as en, graph as gr
from ..operators.scale import settle
from . import stories
from .q_meta import rounded, sql6
from .q_retrieval import lw
from .q_text import STRIP
from .registry import cte, query

c = F.col


def lit(values):
    return "(" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


# Without look-around: separators are doubled, so that each name can take one on either side.
NAMES_OF = ("list_filter(list_distinct(list_transform(regexp_extract_all(regexp_replace({0},'([^\\p{{L}}\\p{{N}}_])','\\1\\1','g'),'(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z][a-z]+(?:\\s\\s[A-Z][a-z]+)?)(?:$|[^\\p{{L}}\\p{{N}}_])',1), "
            "lambda x: regexp_replace(x,'(\\s)\\s','\\1'))), lambda x: x NOT IN " + lit(lexicons.COMMON_WORDS) + ")")
SENTS = "list_filter(list_transform(regexp_split_to_array({0},'[.!?]+'), lambda x: " + STRIP.format("x") + "), lambda x: x<>'')"

cte("doc_entities", f"SELECT doc_id, lang, unnest({NAMES_OF.format('text')}) AS name FROM documents")


@query("g1_basic_entities", "SELECT doc_id, lang, name, 'char_'||replace(lower(name),' ','_') AS id FROM doc_entities")
def _(t):
    return en.basic_entities(t.documents.select("doc_id", "lang", "text")).select("doc_id", "lang", "name", "id")


@query("g2_canonical_names", "SELECT name, first_value(name) OVER (PARTITION BY lower(split_part(name,' ',1)) ORDER BY length(name) DESC, name) AS canonical FROM (SELECT DISTINCT name FROM doc_entities)")
def _(t):
    e = en.basic_entities(t.documents.select("doc_id", "lang", "text"))
    return en.canonical_names(e)


LABELS = ["PERSON", "GPE", "ORG", "EVENT", "DATE"]
CASES = lambda m, e: "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE {e} END"


@query("g3_entity_ids", f"SELECT p_partkey, {CASES(lexicons.LABEL_PREFIX, chr(39) + 'entity' + chr(39))}||'_'||regexp_replace(lower(p_name||' '||p_brand),'[^a-z0-9]','_','g') AS id, {CASES(lexicons.LABEL_TYPE, 'NULL')} AS type FROM (SELECT *, ({LABELS!r})[p_partkey%5+1] AS label FROM part)")
def _(t):
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (c("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", en.entity_id(F.concat_ws(" ", "p_name", "p_brand"), label).alias("id"), en.entity_type(label).alias("type"))


def _pats():
    out = []
    for i, (p, kind, sure) in enumerate(lexicons.RELATION_PATTERNS):
        q = "(?i)" + p.replace("'", "''")
        out.append(f"SELECT story, chapter, {i} AS ord, unnest(regexp_extract_all(text,'{q}',1)) AS source, unnest(regexp_extract_all(text,'{q}',2)) AS target, '{kind}' AS relation, {sure}::DOUBLE AS confidence FROM segments")
    return " UNION ALL ".join(out)


LIKE = "length({0})>=2 AND upper({0}[1])={0}[1] AND lower({0}[1])<>{0}[1] AND upper({0})<>{0} AND lower({0}) NOT IN " + lit(lexicons.NOT_ENTITY)
cte("relations", f"SELECT *, 'char_'||regexp_replace(lower(source),'[^a-z0-9]','_','g') AS source_id, 'char_'||regexp_replace(lower(target),'[^a-z0-9]','_','g') AS target_id FROM ({_pats()}) WHERE {LIKE.format('source')} AND {LIKE.format('target')}")


@query("g4_pattern_relations", "SELECT story, chapter, source_id, target_id, relation, confidence, count(*) AS n FROM relations GROUP BY ALL")
def _(t):
    r = en.pattern_relations(t.segments.select("story", "chapter", "text"))
    return r.groupBy("story", "chapter", "source_id", "target_id", "relation", "confidence").agg(F.count(F.lit(1)).alias("n"))


VERB = "CASE " + " ".join(f"WHEN verb IN {lit(v)} THEN '{k}'" for k, v in lexicons.VERB_CLASSES) + " END"
VC = dict(lexicons.VERB_CLASSES)


@query("g5_verb_relations", f"SELECT verb, count(*) AS n, {VERB} AS relation, round(least(1.0, 0.5+CASE WHEN verb IN {lit(VC['CONFLICTS_WITH'] + VC['ALLIES_WITH'])} THEN 0.2 ELSE 0 END+CASE WHEN verb IN {lit(VC['FAMILY'])} THEN 0.3 ELSE 0 END)::DOUBLE,6) AS strength FROM (SELECT regexp_replace(unnest({lw('text')}),'[^a-z]','','g') AS verb FROM segments) WHERE {VERB} IS NOT NULL GROUP BY verb")
def _(t):
    return rounded(en.verb_relations(t.segments.select("text")))


cte("sentence_names", f"SELECT story, chapter, sent, s, {NAMES_OF.format('s')} AS names FROM (SELECT story, chapter, unnest(p) AS s, unnest(range(0,len(p))) AS sent FROM (SELECT story, chapter, {SENTS.format('text')} AS p FROM segments))")
# list_distinct keeps no order, so the pairs are compared without direction.
CO = "SELECT story, chapter, sent, least(a,b) AS source, greatest(a,b) AS target, s[:100] AS context FROM (SELECT story, chapter, sent, s, x.n AS a, y.n AS b FROM (SELECT *, unnest(names) AS n FROM sentence_names) x JOIN (SELECT story, chapter, sent, unnest(names) AS n FROM sentence_names) y USING (story, chapter, sent)) WHERE a<b AND lower(a)<>lower(b)"


@query("g6_cooccurrence", CO)
def _(t):
    p = en.cooccurrence(t.segments.select("story", "chapter", "text"))
    return p.select("story", "chapter", c("sent").cast("long").alias("sent"), F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "context")


@query("g7_dedupe_relations", "SELECT source_id, target_id, relation, max(confidence) AS confidence, arg_min(story, [-confidence, story, chapter, ord]) AS story FROM relations GROUP BY 1,2,3")
def _(t):
    r = en.pattern_relations(t.segments.select("story", "chapter", "text"))
    return en.dedupe_relations(r, ["story", "chapter", "ord"]).select("source_id", "target_id", "relation", "confidence", "story")


CLEAN = "list_transform(" + lw("s") + ", lambda x: regexp_replace(x,'[^a-z]','','g'))"
FIRST = lambda values: f"list_filter({CLEAN}, lambda x: x IN {lit(values)})[1]"


@query("g8_keyword_events", f"SELECT story, chapter, sent, coalesce(n,v) AS action, CASE WHEN n IS NOT NULL THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM (SELECT story, chapter, sent, {FIRST(lexicons.EVENT_NOUNS)} AS n, {FIRST(lexicons.EVENT_VERBS)} AS v FROM sentence_names) WHERE n IS NOT NULL OR v IS NOT NULL")
def _(t):
    e = en.keyword_events(t.segments.select("story", "chapter", "text"))
    return e.select("story", "chapter", c("sent").cast("long").alias("sent"), "action", "confidence")


LOWN = [n.lower() for n in stories.NAMES]


@query("g9_trait_words", f"WITH w AS (SELECT story, chapter, sent, unnest(p) AS x, unnest(range(0,len(p))) AS i FROM (SELECT story, chapter, sent, list_transform(string_split_regex(s,'\\s+'), lambda x: regexp_replace(lower(x),'[^a-z]','','g')) AS p FROM sentence_names)) SELECT a.x AS name, b.x AS trait, count(*) AS n FROM w a JOIN w b USING (story, chapter, sent) WHERE a.x IN {lit(LOWN)} AND b.x IN {lit(stories.ADJECTIVES)} AND abs(a.i-b.i)<=5 GROUP BY 1,2")
def _(t):
    return en.trait_words(t.segments.select("text"), stories.NAMES, stories.ADJECTIVES)


@query("g10_mention_graph", "SELECT DISTINCT doc_id::VARCHAR AS src, lower(name) AS dst, 'mentions' AS relation FROM doc_entities")
def _(t):
    return en.mention_graph(t.documents)


@query("g11_entity_upsert", "SELECT o_custkey AS id, max(o_orderkey) AS last_modified, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def _(t):
    return gr.upsert(t.orders.select(c("o_custkey").alias("id"), c("o_orderkey").alias("last_modified"), c("o_orderstatus").alias("status")))


@query("g11_chapter_index", "SELECT first_appearance AS chapter, id FROM g_nodes WHERE type='EVENT'")
def _(t):
    return gr.chapter_index(t.g_nodes)


@query("g12_relationship_insert", f"SELECT edge_id, src, dst, relation, {sql6('strength')}, chapter FROM g_edges")
def _(t):
    return rounded(t.g_edges)


@query("g13_characters", "SELECT id, coalesce(name,id) AS name, coalesce(first_appearance,1) AS first_appearance FROM g_nodes WHERE type='CHARACTER'")
def _(t):
    return gr.by_type(t.g_nodes, "CHARACTER")


cte("near", "SELECT node, next, max(d) AS direction FROM (SELECT src AS node, dst AS next, 'outgoing' AS d FROM g_edges UNION ALL SELECT dst, src, 'incoming' FROM g_edges) GROUP BY 1,2")


@query("g14_neighbourhood", """WITH s AS (SELECT 'r'||r_regionkey AS start FROM region), h1 AS (SELECT start, next AS node, max(direction) AS direction FROM s JOIN near ON node=start WHERE next<>start GROUP BY 1,2),
 h2 AS (SELECT h1.start, n.next AS node, max(n.direction) AS direction FROM h1 JOIN near n ON n.node=h1.node WHERE n.next<>h1.start AND (h1.start, n.next) NOT IN (SELECT (start, node) FROM h1) GROUP BY 1,2)
SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2""")
def _(t):
    return gr.neighbourhood(t.g_nodes.filter("type = 'LOCATION' AND id LIKE 'r%'").select("id"), t.g_edges, 2)


@query("g15_relation_path", """WITH s AS (SELECT 'c'||c_custkey AS start FROM customer), a AS (SELECT start, dst AS node, start AS via FROM s JOIN g_edges ON src=start AND relation='ALLIES_WITH'),
 b AS (SELECT start, dst AS node, f.node AS via FROM (SELECT DISTINCT start, node FROM a) f JOIN g_edges ON src=f.node AND relation='CONFLICTS_WITH')
SELECT start, 1 AS step, node, via FROM a UNION ALL SELECT start, 2, node, via FROM b""")
def _(t):
    return gr.relation_path(gr.by_type(t.g_nodes, "CHARACTER"), t.g_edges, ["ALLIES_WITH", "CONFLICTS_WITH"])


cte("snap_nodes", "SELECT * FROM g_nodes WHERE first_appearance<=3")


@query("g16_snapshot", "SELECT e.edge_id, e.src, e.dst, e.chapter FROM g_edges e WHERE chapter<=3 AND src IN (SELECT id FROM snap_nodes) AND dst IN (SELECT id FROM snap_nodes)")
def _(t):
    return gr.snapshot(t.g_nodes, t.g_edges, 3)[1].select("edge_id", "src", "dst", "chapter")


@query("g17_character_ties", f"SELECT id, other, relation, {sql6('strength')}, direction FROM (SELECT src AS id, dst AS other, relation, strength, 'outgoing' AS direction FROM g_edges UNION ALL SELECT dst, src, relation, strength, 'incoming' FROM g_edges) WHERE id IN (SELECT id FROM g_nodes WHERE type='CHARACTER')")
def _(t):
    return rounded(gr.ties_of(t.g_nodes, t.g_edges))


@query("g18_statistics", """SELECT CASE WHEN grouping(type)=1 THEN 'nodes' ELSE 'nodes by type' END AS measure, coalesce(type,'') AS key, count(*) AS n FROM g_nodes GROUP BY GROUPING SETS ((), (type))
UNION ALL SELECT CASE WHEN grouping(relation)=1 THEN 'edges' ELSE 'edges by relation' END, coalesce(relation,''), count(*) FROM g_edges GROUP BY GROUPING SETS ((), (relation)) UNION ALL SELECT 'chapters','',count(DISTINCT first_appearance) FROM g_nodes WHERE type='EVENT'""")
def _(t):
    return gr.statistics(t.g_nodes, t.g_edges)


@query("g19_conflicting_pairs", " UNION ALL ".join(f"SELECT DISTINCT a.src, a.dst, '{x}' AS first, '{y}' AS second FROM g_edges a JOIN g_edges b ON a.src=b.src AND a.dst=b.dst WHERE a.relation='{x}' AND b.relation='{y}'" for x, y in lexicons.CONFLICTING_PAIRS))
def _(t):
    return gr.conflicting_pairs(t.g_edges)


@query("g20_orphaned_events", "SELECT id, name, first_appearance FROM g_nodes WHERE type='EVENT' AND first_appearance>1 AND id NOT IN (SELECT dst FROM g_edges WHERE relation='CAUSED_BY')")
def _(t):
    return gr.orphaned_events(t.g_nodes, t.g_edges).select("id", "name", "first_appearance")


cte("first_edges", "SELECT src, dst, arg_min(relation, edge_id) AS relation, arg_min(strength, edge_id) AS strength FROM g_edges GROUP BY 1,2")


@query("g21_indirect_paths", f"""WITH a AS (SELECT src, dst, relation, strength FROM first_edges WHERE src IN (SELECT id FROM g_nodes WHERE type='CHARACTER')),
 b AS (SELECT a.src AS source, f.dst AS target, a.src||'>'||a.dst||'>'||f.dst AS path, a.relation||','||f.relation AS relations, 2 AS hops, a.dst AS m, a.strength*f.strength AS weight FROM a JOIN first_edges f ON f.src=a.dst WHERE f.dst<>a.src),
 d AS (SELECT b.source, f.dst AS target, b.path||'>'||f.dst AS path, b.relations||','||f.relation AS relations, 3 AS hops, weight*f.strength AS weight FROM b JOIN first_edges f ON f.src=b.target WHERE f.dst<>b.source AND f.dst<>b.m)
SELECT source, target, path, relations, hops, round(weight,6)+0.0 AS weight FROM (SELECT source, target, path, relations, hops, weight FROM b UNION ALL SELECT * FROM d) WHERE round(weight,9)>=0.3""")
def _(t):
    p = gr.indirect_paths(gr.by_type(t.g_nodes, "CHARACTER").select("id"), t.g_edges)
    return rounded(p.select("source", "target", F.array_join("path", ">").alias("path"), F.array_join("relations", ",").alias("relations"), "hops", "weight"))


@query("g21_path_table", f"""WITH a AS (SELECT src, dst, strength FROM first_edges WHERE src IN (SELECT id FROM g_nodes WHERE type='CHARACTER')),
 b AS (SELECT a.src AS source, f.dst AS target, a.dst AS m, a.strength*f.strength AS w FROM a JOIN first_edges f ON f.src=a.dst WHERE f.dst<>a.src),
 d AS (SELECT b.source, f.dst AS target, b.target AS pred, w*f.strength AS w FROM b JOIN first_edges f ON f.src=b.target WHERE f.dst<>b.source AND f.dst<>b.m)
SELECT source, target, hops, pred, count(*) AS n_paths, round(max(w),6)+0.0 AS best FROM (SELECT source, target, 2 AS hops, m AS pred, w FROM b UNION ALL SELECT source, target, 3, pred, w FROM d) WHERE round(w,9)>=0.3 GROUP BY ALL""")
def _(t):
    return rounded(gr.path_table(gr.by_type(stories.g_nodes(t), "CHARACTER").select("id"), t.g_edges))


READ = "CASE relations " + " ".join(f"WHEN '{a},{b}' THEN replace(replace(replace('{x.replace(chr(39), chr(39) * 2)}','{{0}}',n0),'{{1}}',n1),'{{2}}',n2)" for (a, b), x in gr.READINGS.items()) + " ELSE n0||' connected to '||n2||' through '||n1 END"


@query("g21_path_readings", f"""SELECT path, {READ} AS reading FROM (SELECT a.src||'>'||a.dst||'>'||f.dst AS path, a.relation||','||f.relation AS relations, x.name AS n0, y.name AS n1, z.name AS n2 FROM first_edges a JOIN first_edges f ON f.src=a.dst AND f.dst<>a.src
 JOIN g_nodes x ON x.id=a.src AND x.type='CHARACTER' JOIN g_nodes y ON y.id=a.dst JOIN g_nodes z ON z.id=f.dst WHERE round(a.strength*f.strength,9)>=0.3)""")
def _(t):
    nodes = settle(t.g_nodes.select("id", "name", "type"))
    p = gr.indirect_paths(nodes.filter("type = 'CHARACTER'").select("id"), t.g_edges, 2, names=nodes)
    p = p.withColumns({f"n{i}": c("names")[i] for i in range(3)})
    return gr.readings(p, ("n0", "n1", "n2")).select(F.array_join("path", ">").alias("path"), "reading")


PAIRS = "SELECT 'c'||c_custkey AS a, 'c'||(c_custkey+5) AS b FROM customer WHERE c_custkey+5 IN (SELECT c_custkey FROM customer)"


@query("g22_hidden_connections", f"""WITH p AS ({PAIRS}), e1 AS (SELECT a, b, dst AS x, strength AS w FROM p JOIN first_edges ON src=a WHERE dst<>b), e2 AS (SELECT a, b, x, dst AS m, w*strength AS w FROM e1 JOIN first_edges ON src=x WHERE dst<>a),
 e3 AS (SELECT a, b, x, m, dst AS y, w*strength AS w FROM e2 JOIN first_edges ON src=m WHERE m<>b AND dst NOT IN (a,x)), e4 AS (SELECT a, b, x, m, y, dst AS z, w*strength AS w FROM e3 JOIN first_edges ON src=y WHERE y<>b AND dst=b)
SELECT a, b, path, hops, round(w,6)+0.0 AS weight FROM (SELECT a, b, a||'>'||x||'>'||b AS path, 2 AS hops, w FROM e2 WHERE m=b UNION ALL SELECT a, b, a||'>'||x||'>'||m||'>'||b, 3, w FROM e3 WHERE y=b UNION ALL SELECT a, b, a||'>'||x||'>'||m||'>'||y||'>'||b, 4, w FROM e4)""")
def _(t):
    k = t.customer.select("c_custkey")
    pairs = k.join(k.select((c("c_custkey") - 5).alias("c_custkey")), "c_custkey", "left_semi").select(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("a"), F.concat(F.lit("c"), (c("c_custkey") + 5).cast("string")).alias("b"))
    return rounded(gr.hidden_connections(pairs, t.g_edges).withColumn("path", F.array_join("path", ">")))


cte("triangles", """SELECT members, min(k)[1] AS a, min(k)[2] AS b, min(k)[3] AS c FROM (SELECT DISTINCT array_to_string(list_sort([x.src, x.dst, y.dst]),',') AS members, [x.src, x.dst, y.dst] AS k FROM g_edges x JOIN g_edges y ON y.src=x.dst AND y.relation='ALLIES_WITH' JOIN g_edges z ON z.src=x.src AND z.dst=y.dst AND z.relation='CONFLICTS_WITH' WHERE x.relation='ALLIES_WITH') GROUP BY 1""")


@query("g23_conflict_triangles", "SELECT * FROM triangles")
def _(t):
    return gr.conflict_triangles(t.g_nodes, t.g_edges)


@query("g24_causal_chains", """WITH RECURSIVE ce AS (SELECT DISTINCT src, dst FROM g_edges WHERE relation='CAUSED_BY'), r AS (SELECT id AS event, id AS last, [id] AS path, 0 AS d FROM g_nodes WHERE type='EVENT'
 UNION ALL SELECT r.event, ce.src, list_append(r.path, ce.src), d+1 FROM r JOIN ce ON ce.dst=r.last WHERE d<5 AND NOT list_contains(r.path, ce.src))
SELECT event, last AS root_cause, d AS depth, array_to_string(list_reverse(path),' led to ') AS narrative FROM r WHERE d>0 AND (d=5 OR last NOT IN (SELECT dst FROM ce))""")
def _(t):
    return gr.causal_chains(t.g_nodes.filter("type = 'EVENT'").select("id"), t.g_edges)


cte("hidden", """SELECT a, b FROM (WITH l AS (SELECT DISTINCT src, dst FROM g_edges WHERE src<>dst), ch AS (SELECT id FROM g_nodes WHERE type='CHARACTER'), w2 AS (SELECT DISTINCT x.src AS a, y.dst AS b FROM l x JOIN l y ON y.src=x.dst WHERE x.src IN (SELECT id FROM ch)),
 w3 AS (SELECT DISTINCT a, y.dst AS b FROM w2 JOIN l y ON y.src=w2.b), u AS (SELECT * FROM w2 UNION SELECT * FROM w3)
 SELECT a, b FROM u WHERE a<b AND b IN (SELECT id FROM ch) AND (a,b) NOT IN (SELECT (src,dst) FROM l) AND (b,a) NOT IN (SELECT (src,dst) FROM l))""")


@query("g25_revealed_connections", "SELECT id, count(*) AS n_links, min(other) AS least FROM (SELECT a AS id, b AS other FROM hidden UNION ALL SELECT b, a FROM hidden) GROUP BY 1")
def _(t):
    return gr.revealed_connections(stories.g_nodes(t), t.g_edges)


@query("g25_plot_complications", """SELECT 'character_tension' AS kind, 'high' AS priority, a AS first, c AS second FROM triangles UNION ALL
SELECT 'reveal_connection','medium',a,b FROM hidden UNION ALL
SELECT 'unresolved_event','low',id,'' FROM g_nodes WHERE type='EVENT' AND id NOT IN (SELECT src FROM g_edges WHERE src<>dst)""")
def _(t):
    return gr.plot_complications(stories.g_nodes(t), t.g_edges)


EV = "SELECT 'o'||o_orderkey AS id, lpad(o_orderkey::VARCHAR,12,'0') AS sid, 'Order '||lpad(o_orderkey::VARCHAR,9,'0') AS name, 'Shipment after order '||lpad((o_orderkey-CASE WHEN o_orderkey%3=0 THEN 1 ELSE 0 END)::VARCHAR,9,'0') AS description, CAST(o_orderkey//40 AS INT) AS chapter FROM orders"


@query("g26_causal_inference", f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY chapter, id) AS rn FROM ({EV})), p AS (SELECT src AS id, arg_min(dst, edge_id) AS place FROM g_edges WHERE relation='LOCATED_IN' GROUP BY 1), x AS (SELECT e.*, place FROM e LEFT JOIN p USING (id)),
 i AS (SELECT DISTINCT src, dst FROM g_edges), j AS (SELECT a.id AS cause, b.id AS effect, a.name, b.description, b.chapter, a.place AS pa, b.place AS pb, (SELECT count(*) FROM i u JOIN i v ON u.src=v.src WHERE u.dst=a.id AND v.dst=b.id) AS shared FROM x a JOIN x b ON b.rn BETWEEN a.rn+1 AND a.rn+4),
 s AS (SELECT *, round(CASE WHEN contains(lower(description),lower(name)) THEN 0.6 ELSE 0 END+0.3*least(shared,3)+CASE WHEN pa IS NOT DISTINCT FROM pb THEN 0.1 ELSE 0 END,6) AS strength FROM j)
SELECT cause, effect, least(strength,1.0)::DOUBLE AS strength, chapter, shared FROM s WHERE strength>=0.5""")
def _(t):
    o = c("o_orderkey")
    pad = lambda x: F.lpad(x.cast("string"), 9, "0")
    ev = t.orders.select(F.concat(F.lit("o"), o.cast("string")).alias("id"), F.concat(F.lit("Order "), pad(o)).alias("name"),
                         F.concat(F.lit("Shipment after order "), pad(o - F.when(o % 3 == 0, 1).otherwise(0))).alias("description"), F.floor(o / 40).cast("int").alias("chapter"))
    return gr.causal_inference(ev, t.g_edges)


def role_sql():
    pos = "chapter/greatest(1,total)"
    extra = {"setup": f"CASE WHEN {pos}<0.2 THEN 0.3 ELSE 0 END", "complication": f"CASE WHEN {pos}>=0.2 AND {pos}<0.8 THEN 0.2 ELSE 0 END", "reversal": f"CASE WHEN {pos}>=0.2 AND {pos}<0.8 THEN 0.1 ELSE 0 END",
             "climax": f"CASE WHEN {pos}>=0.8 THEN 0.3 ELSE 0 END", "resolution": f"CASE WHEN {pos}>=0.8 THEN 0.2 ELSE 0 END"}
    score = lambda r, ws: "round((" + "+".join(f"(contains(lower(text),'{w}') OR action='{w}')::INT" for w in ws) + f")*0.5+{extra[r]},6)::DOUBLE"
    return "[" + ",".join(f"{{'s': {score(r, ws)}, 'o': {-i}, 'r': '{r}'}}" for i, (r, ws) in enumerate(lexicons.ROLE_WORDS.items())) + "]"


@query("g27_event_roles", f"SELECT story, chapter, CASE WHEN b.s>0.3 THEN b.r ELSE 'unknown' END AS role, CASE WHEN b.s>0.3 THEN least(1.0,b.s) ELSE 0 END::DOUBLE AS confidence FROM (SELECT story, chapter, list_max({role_sql()}) AS b FROM (SELECT *, CASE WHEN chapter%3=0 THEN 'met' ELSE method END AS action, (chapter+story%5)::BIGINT AS total FROM segments))")
def _(t):
    s = t.segments.withColumns({"action": F.when(c("chapter") % 3 == 0, "met").otherwise(c("method")), "total": c("chapter") + c("story") % 5})
    return gr.event_role(s, "text", "action", "chapter", "total").select("story", "chapter", "role", "confidence")


T_ = lambda k: f"(SELECT id FROM g_nodes WHERE type='{k}')"


@query("g28_graph_views", f"""SELECT 'full' AS view, edge_id FROM g_edges WHERE chapter<=4 AND src IN (SELECT id FROM g_nodes WHERE first_appearance<=4) AND dst IN (SELECT id FROM g_nodes WHERE first_appearance<=4)
UNION ALL SELECT 'characters', edge_id FROM g_edges WHERE src IN {T_('CHARACTER')} AND dst IN {T_('CHARACTER')} UNION ALL SELECT 'events', edge_id FROM g_edges WHERE src IN {T_('EVENT')} AND dst IN {T_('EVENT')}
UNION ALL SELECT 'locations', edge_id FROM g_edges WHERE relation='LOCATED_IN' AND src IN (SELECT id FROM g_nodes) AND dst IN {T_('LOCATION')}""")
def _(t):
    views = gr.graph_views(t.g_nodes, t.g_edges, 4)
    out = None
    for name, df in views.items():
        part = df.select(F.lit(name).alias("view"), "edge_id")
        out = part if out is None else out.unionByName(part)
    return out
