"""Story segments and the entity graph, derived from the tables, with their SQL twins.

Conversation turns become story segments; sentences about fixed names are added
to each by its number, so that every word list has something to find. Customers,
suppliers, places, orders and parts become a graph; relations follow from keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import cte

NAMES = ["Aria", "Borin", "Cela", "Doran", "Elin", "Farid", "Gwen", "Hugo", "Isla", "Jarek"]
SENTENCES = [
    "{A} and {B} were friends.", "{A} and {B} were rivals at the court.", "{A} was {B}'s brother.", "{A} loved {B} and {B} feared {A}.",
    "{A} hated {B} because the secret was revealed.", "{A} trusted {B} before the battle and will return.", "{A} worked with {B} to find the ancient map.",
    "{A} fought against {B} in a decisive battle.", "{A} went to Northvale and {B} arrived at Southmere.", "{A} lived in Eastwick when {B} was in Northvale.",
    "Suddenly {A} discovered the hidden truth about {B}.", "{A} was alive but {B} was dead.", "{A} was dead while {B} was alive.",
    "It was bright in the morning and {A} smiled.", "It was dark at night and {A} cried and begged {B}.", "{A} wanted to save {B} from the evil villain.",
    "{A} hesitated, torn between {B} and home.", "{A} shouted with rage and attacked {B}.", "Finally {A} and {B} reconciled and peace ended the war.",
    "{A} first met {B} at the threshold of destiny, a reluctant hero chosen for adventure.", "{A} must hurry before the deadline, it was too late for {B}.",
    "Therefore {A} was betrayed and lost all power to {B}.", "{A} calmly helped {B}, gently and without hesitation.", "An omen, a warning and a prophecy promised danger to {A}.",
    "{A} Stone met {B} Vale in a quiet, peaceful rest.", "Meanwhile {A} had to choose, and {B} celebrated the victory against all odds.",
    "{A} was brave and clever while {B} was cruel.", "{A} planned to atone and make amends, full of regret toward {B}.",
    "The family would belong together, a bond to protect {A} at any cost or sacrifice.", "{A} despised {B} and gave up, I think we lost our way.",
]
N_S, N_N = len(SENTENCES), len(NAMES)
PLACES = ["Northvale", "Southmere", "Eastwick"]
ADJECTIVES = ["brave", "clever", "cruel", "quiet", "peaceful", "reluctant", "ancient", "hidden", "dark", "bright", "evil", "young"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def segments(conversations: DataFrame) -> DataFrame:
    """(story, chapter, method, approach, seq, text)."""
    v, t = F.col("conv_id"), F.col("turn")
    def line(i: int) -> Column:
        s = _pick(SENTENCES, v * (7 + 2 * i) + t * (3 + i) + 11 * i)
        s = F.replace(s, F.lit("{A}"), _pick(NAMES, v + t + i))
        return F.replace(s, F.lit("{B}"), _pick(NAMES, v * 3 + t * 2 + i + 1))
    return conversations.select(
        v.alias("story"), (t + 1).alias("chapter"), F.col("role").alias("method"), _pick(["unified", "graph", "hybrid"], v + t).alias("approach"),
        F.concat_ws(" ", F.concat(F.col("text"), F.lit(".")), *[line(i) for i in range(4)]).alias("text"))


def _q(values) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _line_sql(i: int) -> str:
    s = f"({_q(SENTENCES)})[(conv_id*{7 + 2 * i}+turn*{3 + i}+{11 * i})%{N_S}+1]"
    return f"replace(replace({s},'{{A}}',({_q(NAMES)})[(conv_id+turn+{i})%{N_N}+1]),'{{B}}',({_q(NAMES)})[(conv_id*3+turn*2+{i}+1)%{N_N}+1])"


cte("segments", "SELECT conv_id AS story, turn+1 AS chapter, role AS method, (['unified','graph','hybrid'])[(conv_id+turn)%3+1] AS approach, concat_ws(' ', text||'.', "
    + ", ".join(_line_sql(i) for i in range(4)) + ") AS text FROM conversations")


def g_nodes(t) -> DataFrame:
    """(id, type, name, first_appearance)."""
    row = lambda df, p, key, kind, name, first: df.select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"),
                                                          F.col(name).alias("name"), first.cast("int").alias("first_appearance"))
    year = F.year("o_orderdate") - 1991
    orders = t.orders.withColumn("_name", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")))
    return (row(t.customer, "c", "c_custkey", "CHARACTER", "c_name", F.col("c_custkey") % 5 + 1)
            .unionByName(row(t.supplier, "s", "s_suppkey", "FACTION", "s_name", F.col("s_suppkey") % 4 + 1))
            .unionByName(row(t.nation, "n", "n_nationkey", "LOCATION", "n_name", F.col("n_nationkey") % 6 + 1))
            .unionByName(row(t.region, "r", "r_regionkey", "LOCATION", "r_name", F.lit(1)))
            .unionByName(row(orders, "o", "o_orderkey", "EVENT", "_name", year))
            .unionByName(row(t.part, "p", "p_partkey", "ARTIFACT", "p_name", F.col("p_partkey") % 8 + 1)))


cte("g_nodes", """SELECT 'c'||c_custkey AS id, 'CHARACTER' AS type, c_name AS name, CAST(c_custkey%5+1 AS INT) AS first_appearance FROM customer
UNION ALL SELECT 's'||s_suppkey, 'FACTION', s_name, CAST(s_suppkey%4+1 AS INT) FROM supplier UNION ALL SELECT 'n'||n_nationkey, 'LOCATION', n_name, CAST(n_nationkey%6+1 AS INT) FROM nation
UNION ALL SELECT 'r'||r_regionkey, 'LOCATION', r_name, 1 FROM region UNION ALL SELECT 'o'||o_orderkey, 'EVENT', 'Order#'||o_orderkey, CAST(year(o_orderdate)-1991 AS INT) FROM orders
UNION ALL SELECT 'p'||p_partkey, 'ARTIFACT', p_name, CAST(p_partkey%8+1 AS INT) FROM part""")

# Character ties: step to the other key, relation, modulus, remainder, strength.
TIES = [(1, "ALLIES_WITH", 1, 0, 0.9), (1, "CONFLICTS_WITH", 5, 0, 0.7), (2, "CONFLICTS_WITH", 3, 0, 0.8), (3, "TRUSTS", 4, 0, 0.6), (3, "DISTRUSTS", 8, 0, 0.5),
        (4, "LOVES", 6, 0, 0.95), (4, "HATES", 12, 0, 0.4), (7, "FEARS", 10, 3, 0.65), (11, "FAMILY", 9, 1, 0.85)]


def g_edges(t) -> DataFrame:
    """(edge_id, src, dst, relation, strength, chapter)."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    chapter = F.year("o_orderdate") - 1991
    known = t.customer.select(F.col("c_custkey").alias("_known"))
    def made(tag, src, dst, rel, strength, ch, keep=F.lit(True)):
        st = strength.cast("double") if not isinstance(strength, float) else F.lit(strength)
        return F.when(keep, F.struct(F.concat(F.lit(tag + ":"), src, F.lit(">"), dst).alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(rel).alias("relation"),
                                     st.alias("strength"), ch.cast("int").alias("chapter")))
    # All edges of a table come from one scan of it.
    spread = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("e")).filter("e IS NOT NULL").select("e.*")
    cust, order = s("c", k), s("o", o)
    # Keys are looked up before edges are made of them: keys are shuffled, texts are not.
    kinds = F.array(*[F.when(k % mod == rem, F.struct(F.lit(i).alias("i"), (k + step).alias("to"))) for i, (step, _, mod, rem, _) in enumerate(TIES)])
    ties = t.customer.select(k, F.explode(kinds).alias("_t")).filter("_t IS NOT NULL").select(k, "_t.*").join(known, F.col("to") == F.col("_known"), "left_semi")
    ties = spread(ties, *[made(str(20 + i), cust, s("c", F.col("to")), rel, w, k % 5 + 1, F.col("i") == i) for i, (_, rel, _, _, w) in enumerate(TIES)])
    side = t.orders.select(o, chapter.cast("int").alias("_year")).join(known, F.floor(o / 6) == F.col("_known"), "left_semi")
    side = spread(side, made("16", s("c", F.floor(o / 6)), order, "PARTICIPATED_IN", 0.4, F.col("_year")))
    parts = [
        side,
        spread(t.customer, made("10", cust, s("n", F.col("c_nationkey")), "LOCATED_IN", 0.9, k % 5 + 1)),
        spread(t.supplier, made("11", s("s", F.col("s_suppkey")), s("n", F.col("s_nationkey")), "LOCATED_IN", 0.9, F.col("s_suppkey") % 4 + 1)),
        spread(t.nation, made("12", s("n", F.col("n_nationkey")), s("r", F.col("n_regionkey")), "LOCATED_IN", 1.0, F.lit(1))),
        spread(t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey")), made("13", cust, s("s", k), "MEMBER_OF", 0.7, F.lit(2))),
        spread(t.customer.join(t.part, F.col("c_custkey") == F.col("p_partkey")), made("14", s("p", k), cust, "OWNED_BY", 0.5, k % 8 + 1)),
        spread(t.orders, made("15", s("c", F.col("o_custkey")), order, "PARTICIPATED_IN", 0.5 + o % 5 / 10, chapter),
               made("17", s("o", o - 1), order, "CAUSED_BY", 0.6 + o % 4 / 10, chapter, o % 8 != 0),
               made("18", order, s("n", F.floor(o / 6) % 25), "LOCATED_IN", 0.8, chapter, o % 4 != 0)),
    ]
    out = ties
    for p in parts:
        out = out.unionByName(p)
    return out


_E = "SELECT '{tag}:'||{src}||'>'||{dst} AS edge_id, {src} AS src, {dst} AS dst, '{rel}' AS relation, ({w})::DOUBLE AS strength, CAST({ch} AS INT) AS chapter FROM {frm}"
_YR = "year(o_orderdate)-1991"
_P = [("10", "'c'||c_custkey", "'n'||c_nationkey", "LOCATED_IN", "0.9", "c_custkey%5+1", "customer"),
      ("11", "'s'||s_suppkey", "'n'||s_nationkey", "LOCATED_IN", "0.9", "s_suppkey%4+1", "supplier"),
      ("12", "'n'||n_nationkey", "'r'||n_regionkey", "LOCATED_IN", "1.0", "1", "nation"),
      ("13", "'c'||c_custkey", "'s'||c_custkey", "MEMBER_OF", "0.7", "2", "customer JOIN supplier ON c_custkey=s_suppkey"),
      ("14", "'p'||c_custkey", "'c'||c_custkey", "OWNED_BY", "0.5", "c_custkey%8+1", "customer JOIN part ON c_custkey=p_partkey"),
      ("15", "'c'||o_custkey", "'o'||o_orderkey", "PARTICIPATED_IN", "0.5+(o_orderkey%5)/10", _YR, "orders"),
      ("17", "'o'||(o_orderkey-1)", "'o'||o_orderkey", "CAUSED_BY", "0.6+(o_orderkey%4)/10", _YR, "orders WHERE o_orderkey%8<>0"),
      ("18", "'o'||o_orderkey", "'n'||((o_orderkey//6)%25)", "LOCATED_IN", "0.8", _YR, "orders WHERE o_orderkey%4<>0"),
      ("16", "'c'||(o_orderkey//6)", "'o'||o_orderkey", "PARTICIPATED_IN", "0.4", _YR, "orders WHERE o_orderkey//6 IN (SELECT c_custkey FROM customer)")]
_P += [(str(20 + i), "'c'||c_custkey", f"'c'||(c_custkey+{st})", rel, str(w), "c_custkey%5+1", f"customer WHERE c_custkey%{m}={r} AND c_custkey+{st} IN (SELECT c_custkey FROM customer)")
       for i, (st, rel, m, r, w) in enumerate(TIES)]
cte("g_edges", " UNION ALL ".join(_E.format(tag=a, src=b, dst=c, rel=d, w=e, ch=f, frm=g) for a, b, c, d, e, f, g in _P))

TYPES = ["click", "error", "purchase", "signup", "view"]
MOODS = ["hopeful", "desperate", "angry", "conflicted", "neutral", "resolved", "happy", "terrified"]


def char_states(events: DataFrame) -> DataFrame:
    """(character, chapter, emotion, goals, relationships, knowledge, phase): one state per user and day."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    per = events.groupBy(F.col("user_id").alias("character"), (day + 1).cast("long").alias("chapter")).agg(
        F.sum("event_id").alias("s"), *[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(f"a_{t}") for t in TYPES],
        *[F.max(F.when(F.col("event_type") == t, F.col("value"))).alias(f"m_{t}") for t in TYPES])
    there = lambda c, test: F.array_compact(F.array(*[F.when(test(F.col(f"{c}_{t}")), F.lit(t)) for t in TYPES]))
    ties = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"a_{t}").isNotNull(), F.struct(F.lit(t), F.round(F.col(f"a_{t}") / 100, 6))) for t in TYPES])))
    from ..operators.arcs import phase_of

    return per.select("character", "chapter", _pick(MOODS, F.col("s")).alias("emotion"), there("a", lambda x: x > 40).alias("goals"), ties.alias("relationships"),
                      there("m", lambda x: x > 100).alias("knowledge"), phase_of(F.col("chapter")).alias("phase"))


cte("char_states", f"""SELECT character, chapter, ({_q(MOODS)})[s%{len(MOODS)}+1] AS emotion, list_filter([{','.join(f"CASE WHEN a_{t}>40 THEN '{t}' END" for t in TYPES)}], lambda x: x IS NOT NULL) AS goals,
 list_filter([{','.join(f"CASE WHEN m_{t}>100 THEN '{t}' END" for t in TYPES)}], lambda x: x IS NOT NULL) AS knowledge, CASE WHEN chapter<=3 THEN 'setup' WHEN chapter<=8 THEN 'rising_action' WHEN chapter<=12 THEN 'crisis' WHEN chapter<=15 THEN 'climax' ELSE 'resolution' END AS phase,
 {','.join(f'round(a_{t}/100,6) AS r_{t}' for t in TYPES)} FROM (SELECT user_id AS character, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))+1 AS chapter, CAST(sum(event_id) AS BIGINT) AS s,
 {','.join(f"avg(value) FILTER (event_type='{t}') AS a_{t}, max(value) FILTER (event_type='{t}') AS m_{t}" for t in TYPES)} FROM events GROUP BY 1,2)""")


def feedback(events: DataFrame) -> DataFrame:
    """(story, seq, chapter, approach, five ratings, selected_best)."""
    e = F.col("event_id")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    from ..functions.lexicons import APPROACHES, RATINGS

    return events.select(F.col("user_id").alias("story"), e.alias("seq"), (day + 1).cast("long").alias("chapter"), _pick(APPROACHES, e).alias("approach"),
                         *[(1 + F.floor(F.col("value") * (i + 1)) % 5).alias(r) for i, r in enumerate(RATINGS)], (e % 4 == 0).alias("selected_best"))


cte("feedback", "SELECT user_id AS story, event_id AS seq, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))+1 AS chapter, (['unified','graph','hybrid'])[event_id%3+1] AS approach, "
    + ", ".join(f"1+CAST(floor(value*{i + 1}) AS BIGINT)%5 AS {r}" for i, r in enumerate(["overall", "consistency", "creativity", "character_authenticity", "plot_coherence"])) + ", event_id%4=0 AS selected_best FROM events")
