"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import functions as F

from .common import documents

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


LOWER = f"translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
BLANK_SQL = r"E' \t\n\x0b\x0c\r'"


@query("op1_line_dedup", f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, {LOWER % f"trim(line, {BLANK_SQL})"} AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op1_line_dedup(spark, sf_dir):
    from .line_dedup import line_dedup

    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query("op3_mixing", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('20:' || coalesce(doc_id::VARCHAR, 'null')) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight
    FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(2 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still, sum(source_size) OVER () * 1.5::DOUBLE AS total
    FROM s WINDOW w AS (ORDER BY (2 * source_size)::DOUBLE / weight, source ASC NULLS LAST)),
p AS (SELECT min(rank) AS stop, min_by(total - filled, rank) AS remaining, min_by(still, rank) AS open_weight FROM o
    WHERE weight * (total - filled) / still <= 2 * source_size),
t AS (SELECT source, source_size, CASE WHEN stop IS NULL OR rank < stop THEN (2 * source_size)::DOUBLE
    ELSE weight * remaining / open_weight END AS target FROM o, p),
f AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM t),
m AS (SELECT source, mark, sum(size) AS words FROM d GROUP BY source, mark),
r AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY mark) - words AS below FROM m),
e AS (SELECT r.source, r.mark, CASE WHEN below + words / 2.0 <= target - whole * source_size AND below < target - whole * source_size THEN 1 ELSE 0 END AS extra
    FROM r JOIN f ON r.source IS NOT DISTINCT FROM f.source)
SELECT d.doc_id, d.size, f.source_size, f.target, (d.size * (f.whole + e.extra))::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source JOIN e ON d.mark = e.mark AND d.source IS NOT DISTINCT FROM e.source
""")
def op3_mixing(spark, sf_dir):
    from .mixing import mix_plan

    out = mix_plan(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


@query("op4_token_shards")
def op4_token_shards(spark, sf_dir):
    import public_tokenizers

    from .wavelet import token_shards

    return token_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_packing")
def op10_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    from .quality import quality_rules

    out = quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    from .langid import language_rows

    return language_rows(documents(spark, sf_dir))


@query("op2_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
""")
def op2_top_k(spark, sf_dir):
    from .ball_tree import top_k

    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


@query("op8_near_dedup", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER % "coalesce(text, '')"}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM w),
u AS (SELECT DISTINCT doc_id, hash(s) AS s FROM s),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS reached FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
""")
def op8_near_dedup(spark, sf_dir):
    from .setsketch import near_duplicates

    return near_duplicates(documents(spark, sf_dir), percent=85)


def _license_oracle() -> str:
    from .licenses import oracle

    return oracle()


@query("op5_license_scan", _license_oracle())
def op5_license_scan(spark, sf_dir):
    from .licenses import license_scan

    out = license_scan(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "licenses", "sentence_ids", "line_sentence_ids")


@query("op12_hard_negatives", """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT * FROM n WHERE rank <= 10
""")
def op12_hard_negatives(spark, sf_dir):
    from .hard_negatives import hard_negatives

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, moved)


#: Rules of the query: the longest one that fits decides.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _url_oracle() -> str:
    from .host_reputation import LEAST, MOST, SUFFIXES, WEAK

    words = r"nullif(trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g')), '')"
    text = r"regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<h1>.*?</h1>', '', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    pick = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{{'name': '{h}{p}', 'verdict': '{v}'}}}}"
                              for h, p, v in sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[0] + r[1]))) + " END"
    pick = pick.replace("{{", "{").replace("}}", "}")
    spread = "sum(n)::BIGINT AS n, sum(x)::BIGINT AS x, count(*) FILTER (n > 0) AS k, sum(n::DOUBLE * n) AS nn, sum(CASE WHEN n > 0 THEN x::DOUBLE * x / n END) AS xx"
    strength = f"""(SELECT CASE WHEN NOT (k > p AND total > k) THEN {WEAK}::DOUBLE WHEN (a - b) / (k - p) <= (bad - a) / (total - k) THEN {MOST}::DOUBLE
        ELSE least({MOST}::DOUBLE, greatest({LEAST}::DOUBLE, (total - c) / (k - p) * ((bad - a) / (total - k)) / ((a - b) / (k - p) - (bad - a) / (total - k)))) END FROM
        (SELECT count(*) AS p, sum(k) AS k, sum(n)::DOUBLE AS total, sum(x)::DOUBLE AS bad, sum(xx) AS a, sum(x::DOUBLE * x / n) AS b, sum(nn / n) AS c FROM %s WHERE n > 0)) AS m"""
    # The rising series of the incomplete beta function at 1/2; its terms fall once their number passes the larger parameter.
    below = """list_sum(list_transform(range(0, (4 * (a + b) + 400)::BIGINT), lambda j:
        exp(lgamma(a + b + j) - lgamma(b) - lgamma(a + 1 + j) + (a + b + j) * ln(0.5::DOUBLE))))"""
    return rf"""
WITH u AS (SELECT page_id, html, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
g AS (SELECT page_id, {LOWER % "regexp_extract(rest, '^[^/?#]*', 0)"} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {words.format(text)} AS item FROM u),
y AS (SELECT doc_id, max(greatest(1 - quality, toxic)) > 0 AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
o AS (SELECT {words.format('text')} AS item, bool_or(bad) AS bad FROM documents JOIN y USING (doc_id) GROUP BY 1),
c AS (SELECT host, count(bad) AS n, coalesce(sum(bad::BIGINT), 0)::BIGINT AS x FROM (SELECT DISTINCT host, item FROM g) LEFT JOIN o USING (item) GROUP BY host),
z AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$|\.$', '') AS bare FROM c),
q AS (SELECT *, string_split(bare, '.') AS l FROM z),
f AS (SELECT *, CASE WHEN len(l) >= 2 AND l[-2] || '.' || l[-1] IN {SUFFIXES!r} THEN 2 ELSE 1 END AS w, regexp_full_match(bare, '[0-9.]+') OR contains(bare, '[') AS numeric_host FROM q),
h AS MATERIALIZED (SELECT host, n, x, CASE WHEN numeric_host THEN bare ELSE array_to_string(l[greatest(len(l) - w, 1):], '.') END AS domain,
    CASE WHEN numeric_host THEN '' ELSE array_to_string(l[greatest(len(l) - w + 1, 1):], '.') END AS suffix FROM f),
d AS MATERIALIZED (SELECT suffix, domain, {spread} FROM h GROUP BY ALL),
s AS MATERIALIZED (SELECT suffix, {spread} FROM d GROUP BY ALL),
t AS MATERIALIZED (SELECT {spread} FROM s),
ms AS (SELECT suffix, (m * mean + x) / (m + n) AS mean FROM s, (SELECT (coalesce(x, 0) + 1) / (coalesce(n, 0) + 2)::DOUBLE AS mean FROM t), (SELECT {strength % 't'})),
md AS (SELECT suffix, domain, (m * mean + x) / (m + n) AS mean FROM d JOIN ms USING (suffix), (SELECT {strength % 's'})),
mh AS (SELECT host, n, x, m * mean + x AS a, m * (1 - mean) + n - x AS b FROM h JOIN md USING (suffix, domain), (SELECT {strength % 'd'})),
v AS (SELECT host, n, x, round(a / (a + b), 6) AS bad_rate, round({below}, 9) AS likely FROM mh),
r AS (SELECT *, {pick} AS rule FROM g)
SELECT page_id, r.host, path, rule.name AS rule, coalesce(rule.verdict, CASE WHEN likely < 1 - 0.95::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, n AS n_labelled, x AS n_bad, bad_rate, round(likely, 6) AS likely_below
FROM r JOIN v ON v.host = r.host
"""


@query("op13_url_filters", _url_oracle())
def op13_url_filters(spark, sf_dir):
    from .host_reputation import Rule, article_key, labelled_texts, url_verdicts

    outcomes = labelled_texts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), article_key(F.col("html")), outcomes, [Rule(*r) for r in URL_RULES])


@query("op11_collocations", rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER % "text"}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM w WHERE len(w) >= {k}" for k in range(1, 6))}),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT lang, regexp_replace(phrase, ' [^ ]*$', '') AS phrase, f FROM f WHERE k > 1 UNION ALL SELECT lang, regexp_replace(phrase, '^[^ ]* ', '') AS phrase, f FROM f WHERE k > 1),
i AS (SELECT lang, phrase, max(f) AS longer FROM x GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN i USING (lang, phrase) WHERE k > 1 AND NOT coalesce(longer >= f.f, false)),
s AS (SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS p FROM c),
o AS (SELECT s.lang, s.phrase, a, l.f AS l, r.f AS r, n, cut, 1000::HUGEINT * a * n // (l.f * r.f) AS score FROM s JOIN n USING (lang)
    JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(p[:cut], ' ') JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(p[cut + 1:], ' ')),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM b)
SELECT * FROM q WHERE rank <= 2000
""")
def op11_collocations(spark, sf_dir):
    from .collocations import collocations

    return collocations(documents(spark, sf_dir))
