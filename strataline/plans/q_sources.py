"""Source and sink queries: derived tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as en, experiments as ex, meta, retrieval
from ..session import intermediate
from ..sources import readers, sinks
from .q_meta import rounded, sql6
from .q_retrieval import index, vecs
from .relations import r6
from .registry import cte, query

c = F.col


def scratch(t, name: str) -> str:
    """A new folder per run next to the checkpoints."""
    return intermediate(t.spark, "runs", name)


COUNTS = ["control_conversions", "control_total", "treatment_conversions", "treatment_total"]


@query("s1_csv_scan", f"SELECT study_id, metric, {', '.join(COUNTS)}, CASE WHEN covariate%2=0 THEN 'NA' ELSE 'EU' END AS segment FROM studies_events")
def _(t):
    path = scratch(t, "experiments")
    seg = F.when(c("covariate") % 2 == 0, "NA").otherwise("EU").alias("segment")
    t.studies_events.select("study_id", "metric", *COUNTS, seg).write.option("header", True).csv(path)
    types = "study_id string, metric string, " + ", ".join(f"{x} bigint" for x in COUNTS) + ", segment string"
    return readers.experiment_csv(t.spark, path, types).drop("source_file")


FILES = "SELECT metric, CASE WHEN metric='view' THEN 0 ELSE control_total END AS control_total FROM studies_events"


@query("s3_status_report", f"SELECT metric||'.csv' AS source_file, count(*) AS rows, count(*) FILTER (control_total>150 AND metric NOT IN ('error','signup')) AS valid_rows, CASE WHEN metric IN ('error','signup') THEN 'Error' WHEN count(*) FILTER (control_total>150)=0 THEN 'Warning' ELSE 'Success' END AS status FROM ({FILES}) GROUP BY metric")
def _(t):
    """Files of five metrics: one without a needed column, one that is no table, one without a valid row."""
    path = scratch(t, "experiments")
    s = t.studies_events.withColumn("control_total", F.when(c("metric") == "view", 0).otherwise(c("control_total"))).select("study_id", "metric", *COUNTS)
    out = lambda df: df.write.mode("append").partitionBy("metric").option("header", True).csv(path)
    out(s.filter("metric NOT IN ('error', 'signup')"))
    out(s.filter("metric = 'error'").drop("control_total"))
    s.filter("metric = 'signup'").select("metric", F.concat(F.lit("torn "), F.hash("study_id").cast("string")).alias("value")).write.mode("append").partitionBy("metric").text(path)
    lines = readers.file_lines(t.spark, path).withColumn("source_file", F.concat(F.regexp_extract("path", "metric=([^/]+)/", 1), F.lit(".csv")))
    return readers.status_report(readers.checked_lines(lines, "study_id", COUNTS, c("fields")["control_total"].cast("long") > 150))


@query("s4_changed_content", "SELECT doc_id, md5(text) AS hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id%3=0)")
def _(t):
    d = t.documents.select("doc_id", F.md5("text").alias("hash"))
    return readers.changed(d, d.filter("doc_id % 3 = 0"), ["hash"]).select("doc_id", "hash")


@query("s5_document_ingest", "SELECT source AS folder, sum(length(text)+1)::BIGINT AS chars FROM documents GROUP BY 1")
def _(t):
    """Text files below one folder per source; a document and a line feed after the other, and one file of blanks."""
    path = scratch(t, "texts")
    t.documents.select("source", "text").write.partitionBy("source").text(path)
    t.spark.range(1).select(F.lit("none").alias("source"), F.lit("  ").alias("text")).write.mode("append").partitionBy("source").text(path)
    files = readers.text_files(t.spark, path).filter(c("text").rlike(r"\S"))
    return files.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("folder")).agg(F.sum(F.length("text")).cast("long").alias("chars"))


@query("s6_rows_as_text", "SELECT n_regionkey AS sheet, n_nationkey AS pos, 1 AS part, concat_ws(' | ', n_nationkey::VARCHAR, CASE WHEN n_nationkey%4<>0 THEN n_name END) AS line FROM nation UNION ALL SELECT DISTINCT n_regionkey, -1, 0, '## Sheet: '||n_regionkey FROM nation")
def _(t):
    n = t.nation.select(c("n_regionkey").alias("sheet"), c("n_nationkey").alias("pos"), "n_nationkey", F.when(c("n_nationkey") % 4 != 0, c("n_name")).alias("n_name"))
    return readers.rows_as_text(n, "sheet", ["pos"], ["n_nationkey", "n_name"]).withColumn("pos", F.coalesce("pos", F.lit(-1)))


@query("s7_markdown_table", "SELECT -2 AS line, '| n_name | n_regionkey |' AS text UNION ALL SELECT -1, '| --- | --- |' UNION ALL SELECT n_nationkey, '| '||coalesce(CASE WHEN n_nationkey%4<>0 THEN n_name END,'')||' | '||coalesce(CASE WHEN n_nationkey%8<>0 THEN n_regionkey::VARCHAR END,'')||' |' FROM nation WHERE n_nationkey%8<>0")
def _(t):
    n = t.nation.select("n_nationkey", F.when(c("n_nationkey") % 4 != 0, c("n_name")).alias("n_name"), F.when(c("n_nationkey") % 8 != 0, c("n_regionkey")).alias("n_regionkey"))
    return readers.markdown_lines(n, "n_nationkey", ["n_name", "n_regionkey"])


def json_lines(t):
    """Conversation turns as JSON lines, some broken, some without an output."""
    k = c("conv_id") + c("turn")
    body = F.to_json(F.struct(c("role").alias("instruction"), F.when(k % 5 != 0, c("text")).alias("output")))
    return t.conversations.select("conv_id", "turn", F.when(k % 7 == 0, F.concat(F.lit("{broken "), body)).otherwise(body).alias("value"))


@query("s8_jsonl_valid", "SELECT conv_id, turn, role AS instruction, text AS output FROM conversations WHERE (conv_id+turn)%7<>0 AND (conv_id+turn)%5<>0")
def _(t):
    good, _ = readers.instruction_lines(json_lines(t))
    return good.select("conv_id", "turn", "instruction", "output")


@query("s8_jsonl_issues", "SELECT conv_id, turn, CASE WHEN (conv_id+turn)%7=0 THEN 'invalid JSON' ELSE 'missing instruction or output' END AS issue FROM conversations WHERE (conv_id+turn)%7=0 OR (conv_id+turn)%5=0")
def _(t):
    return readers.instruction_lines(json_lines(t))[1].select("conv_id", "turn", "issue")


@query("s9_instruction_csv", "SELECT role AS instruction, md5(text) AS output FROM conversations")
def _(t):
    path = scratch(t, "pairs")
    t.conversations.select(c("role").alias("prompt"), F.md5("text").alias("answer"), "turn").write.option("header", True).csv(path)
    return readers.instruction_csv(t.spark, path, "prompt", "answer")


@query("s10_record_issues", "SELECT role AS instruction, count(*) AS n FROM conversations WHERE turn%3=0 GROUP BY 1")
def _(t):
    rows = t.conversations.select(c("role").alias("instruction"), F.when(c("turn") % 3 != 0, c("text")).alias("output"))
    return readers.instruction_records(rows)[1].groupBy("instruction").agg(F.count(F.lit(1)).alias("n"))


@query("s11_sinks_round_trip", "SELECT role AS instruction, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def _(t):
    path = scratch(t, "samples")
    sinks.jsonl(t.conversations.select(c("role").alias("instruction"), c("text").alias("output")), path)
    back = t.spark.read.schema("instruction string, output string").json(path)
    return back.groupBy("instruction").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("output")).alias("chars"))


@query("s12_metrics_reload", f"SELECT 'run-'||(user_id%5) AS run_id, event_id AS step, {sql6('value AS loss')} FROM events")
def _(t):
    path = scratch(t, "metrics")
    e = t.events.select(F.concat(F.lit("run-"), (c("user_id") % 5).cast("string")).alias("run_id"), F.struct(c("event_id").alias("step"), c("value").alias("loss")).alias("m"), F.floor(c("event_id") / 500).alias("part"))
    # One file entry per run and stretch of steps, so no run is gathered whole.
    e.groupBy("run_id", "part").agg(F.collect_list("m").alias("metrics")).drop("part").write.json(path)
    return rounded(readers.metrics_json(t.spark, path)).select("run_id", "step", "loss")


@query("s13_catalog_load", "SELECT metric AS dataset_id, count(*) AS rows, CAST(sum(total_n) AS BIGINT) AS total_n, true AS matches FROM studies_events GROUP BY 1")
def _(t):
    base = scratch(t, "catalog")
    s = t.studies_events.select("metric", "study_id", "total_n")
    s.write.partitionBy("metric").option("header", True).csv(f"{base}/data")
    entries = s.groupBy(c("metric").alias("dataset_id")).agg(F.count(F.lit(1)).alias("row_count")).withColumn("file_path", F.concat(F.lit("data/metric="), "dataset_id"))
    # The catalog is one JSON array with an entry per data set.
    entries.agg(F.to_json(F.collect_list(F.struct("dataset_id", "row_count", "file_path")))).write.text(f"{base}/catalog.json")
    found = readers.catalog_tables(t.spark, f"{base}/catalog.json", base).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(c("total_n").cast("long")).alias("total_n"))
    return found.join(t.spark.read.option("multiLine", True).json(f"{base}/catalog.json"), "dataset_id").select("dataset_id", "rows", "total_n", (c("rows") == c("row_count")).alias("matches"))


@query("s14_experiment_archive", f"SELECT 'exp_'||study_id||'_20240201000000' AS archive_id, metric, {sql6('effect')} FROM studies_events")
def _(t):
    path = scratch(t, "archive")
    sinks.archive_experiments(t.studies_events.select("study_id", "metric", "effect"), path, "2024-02-01 00:00:00")
    return t.spark.read.parquet(path).select("archive_id", "metric", r6("effect"))


@query("s15_analysis_archive", f"SELECT metric, k AS n_studies, {sql6('re_effect')} FROM pool_ev")
def _(t):
    path, s = scratch(t, "analyses"), t.studies_events
    sinks.archive_analysis(meta.pool(s, ["metric"]).select("metric", "re_effect"), s, ["metric"], path, "2024-02-01 00:00:00")
    members = t.spark.read.parquet(f"{path}/members").groupBy("metric").agg(F.count(F.lit(1)).alias("n_studies"))
    return rounded(t.spark.read.parquet(f"{path}/results").join(members, "metric").select("metric", "n_studies", "re_effect"))


@query("s16_audit_log", "SELECT user_id::VARCHAR AS user_id, event_type AS action, round(value,6) AS value FROM events")
def _(t):
    path = scratch(t, "audit")
    sinks.audit_log(sinks.audit_entries(t.events, "user_id", "event_type", {"value": "value"}, "ts"), path)
    e = t.spark.read.text(path).select(F.from_json("value", "timestamp string, user_id string, action string, details struct<value:double>").alias("e"))
    return e.select("e.user_id", "e.action", r6(c("e.details.value"), "value"))


@query("s17_triple_sink", "SELECT story, chapter, source_id AS subject, relation AS predicate, target_id AS object, count(*) AS n FROM relations GROUP BY ALL")
def _(t):
    """The relations that the texts state, as one list of triples per segment, written and read again."""
    path = scratch(t, "triples")
    r = en.pattern_relations(t.segments.select("story", "chapter", "text"))
    r.groupBy("story", "chapter").agg(F.collect_list(F.array("source_id", "relation", "target_id")).alias("triples")).write.json(path)
    back = t.spark.read.schema("story long, chapter long, triples array<array<string>>").json(path).select("story", "chapter", F.explode("triples").alias("x"))
    return back.groupBy("story", "chapter", c("x")[0].alias("subject"), c("x")[1].alias("predicate"), c("x")[2].alias("object")).agg(F.count(F.lit(1)).alias("n"))


@query("s18_graph_save_load", f"SELECT 'node' AS kind, type AS name, count(*) AS n, count(DISTINCT id) AS ids, {sql6('sum(first_appearance)::DOUBLE AS total')} FROM g_nodes GROUP BY type UNION ALL SELECT 'edge', relation, count(*), count(DISTINCT edge_id), round(sum(strength),6)+0.0 FROM g_edges GROUP BY relation")
def _(t):
    path = scratch(t, "graph")
    sinks.save_graph(t.g_nodes, t.g_edges, path)
    nodes, edges = sinks.load_graph(t.spark, path)
    tell = lambda df, kind, name, key, value: df.groupBy(F.lit(kind).alias("kind"), c(name).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("ids"), F.sum(c(value).cast("double")).alias("total"))
    return rounded(tell(nodes, "node", "type", "id", "first_appearance").unionByName(tell(edges, "edge", "relation", "edge_id", "strength")))


@query("s19_index_save_load", f"""SELECT 'term' AS kind, term AS name, df::BIGINT AS n, {sql6('idf AS value')} FROM bm_stats UNION ALL SELECT 'posting', doc::VARCHAR, sum(tf)::BIGINT, round(max(dl)::DOUBLE,6)+0.0 FROM bm_post GROUP BY doc
 UNION ALL SELECT 'vector', vec_id::VARCHAR, len(embedding)::BIGINT, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)),6)+0.0 FROM embeddings""")
def _(t):
    path = scratch(t, "index")
    post, stats = index(t)
    sinks.save_index(post, stats, t.embeddings.select("vec_id", "embedding"), path, 8)
    post, stats, vectors = sinks.load_index(t.spark, path)
    row = lambda df, kind, name, n, value: df.select(F.lit(kind).alias("kind"), c(name).cast("string").alias("name"), n.cast("long").alias("n"), value.cast("double").alias("value"))
    docs = post.groupBy("doc").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rounded(row(stats, "term", "term", c("df"), c("idf")).unionByName(row(docs, "posting", "doc", c("tf"), c("dl"))).unionByName(row(vectors, "vector", "vec_id", F.size("embedding"), total)))


@query("s20_narrative_lines", """SELECT conv_id AS story, -1 AS chapter, 0 AS part, 0 AS seq, '# Story '||conv_id AS line FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT DISTINCT conv_id, turn+1, 1, 0, '## Chapter '||(turn+1) FROM conversations UNION ALL SELECT conv_id, turn+1, 2, turn, text FROM conversations""")
def _(t):
    seg = t.conversations.select(c("conv_id").alias("story"), (c("turn") + 1).alias("chapter"), c("turn").alias("seq"), "text", F.concat(F.lit("Story "), c("conv_id").cast("string")).alias("title"))
    return sinks.narrative_lines(seg)


@query("s22_graph_export", "SELECT 'node' AS kind, id, coalesce(name,id) AS label, coalesce(type,'entity') AS extra FROM g_nodes UNION ALL SELECT 'edge', src, coalesce(relation,'link'), dst FROM g_edges")
def _(t):
    nodes = t.g_nodes.select(F.lit("node").alias("kind"), "id", F.coalesce("name", "id").alias("label"), F.coalesce("type", F.lit("entity")).alias("extra"))
    edges = t.g_edges.select(F.lit("edge").alias("kind"), c("src").alias("id"), F.coalesce("relation", F.lit("link")).alias("label"), c("dst").alias("extra"))
    return nodes.unionByName(edges)


@query("s23_corpus_export", f"SELECT doc_id, length(text) AS chars, source, {sql6('embedding[1]::DOUBLE AS first')} FROM documents JOIN embeddings ON doc_id=vec_id")
def _(t):
    j = t.documents.join(t.embeddings, c("doc_id") == c("vec_id"))
    return j.select("doc_id", F.length("text").cast("long").alias("chars"), "source", r6(c("embedding")[0].cast("double"), "first"))


@query("s24_study_ingest", f"SELECT study_id, {sql6('effect', 'se')}, 'synthetic' AS source_type, len(errors)=0 AS is_valid FROM (SELECT study_id, effect, se, list_filter([control_total<10, treatment_total<10, abs(effect)>5, se<1e-4 OR se>10], lambda x: x) AS errors FROM studies_tpch)")
def _(t):
    from ..operators import quality

    rows = ex.derive_studies(t.studies_tpch.select("study_id", *COUNTS)).withColumns({"p_value": F.lit(None).cast("double"), "source_type": F.lit("synthetic")})
    return rounded(quality.study_check(rows).select("study_id", "effect", "se", "source_type", "is_valid"))
