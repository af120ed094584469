"""Mapping, cleaning, filtering and conversion of experiment tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import effects, lexicons
from ..operators import experiments as ex
from ..operators.scale import quantiles
from .q_meta import rounded, sql6
from .relations import r6
from .registry import cte, query

c = F.col
K = math.pi / math.sqrt(3)


def raw(t):
    """Event experiments under the column names of a foreign file."""
    s = t.studies_events
    return s.select(c("study_id").alias("Test_ID"), c("study_name").alias("campaign"), c("metric").alias("KPI"), c("day").cast("string").alias("start_date"),
                    c("control_total").alias("control_users"), c("control_conversions").alias("Control_Success "), c("treatment_total").alias("treatment_users"),
                    c("treatment_conversions").alias("treatment_success"), c("covariate").alias("extra"))


STD = "SELECT control_conversions, control_total, treatment_conversions, treatment_total, study_id AS experiment_id, study_name AS experiment_name, metric, strftime(day,'%Y-%m-%d') AS date FROM studies_events"


@query("p1_alias_mapping", STD)
def _(t):
    return ex.map_experiments(raw(t))


@query("p2_column_override", "SELECT control_conversions, control_total, treatment_conversions, covariate AS treatment_total FROM studies_events")
def _(t):
    return ex.map_experiments(raw(t), {"control_conversions": "Control_Success ", "control_total": "control_users", "treatment_conversions": "treatment_success", "treatment_total": "extra"})


@query("p3_schema_report", "SELECT false AS valid, (SELECT count(*) FROM studies_events) AS rows, 'experiment_id,control_visitors,control_conversions,variant_visitors,variant_conversions' AS missing, 'control_visitors=control_size' AS found")
def _(t):
    df = raw(t).withColumnRenamed("control_users", "control_size")
    found = F.array_join(F.transform(F.map_entries("found_alternatives"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    report = ex.schema_report(df).select("valid", F.array_join("missing_columns", ",").alias("missing"), found.alias("found"))
    return df.agg(F.count(F.lit(1)).alias("rows")).join(report, F.lit(True)).select("valid", "rows", "missing", "found")


# Shifted counts, so that every validity rule drops some rows.
cte("loose", "SELECT study_id, covariate, control_conversions-2 AS control_conversions, control_total-150 AS control_total, treatment_conversions*5 AS treatment_conversions, treatment_total FROM studies_events")


def loose(t):
    return t.studies_events.select("study_id", "covariate", (c("control_conversions") - 2).alias("control_conversions"), (c("control_total") - 150).alias("control_total"),
                                   (c("treatment_conversions") * 5).alias("treatment_conversions"), "treatment_total")


@query("p4_valid_rows", "SELECT * FROM loose WHERE control_total>0 AND treatment_total>0 AND control_conversions>=0 AND treatment_conversions>=0 AND control_conversions<=control_total AND treatment_conversions<=treatment_total")
def _(t):
    return ex.valid_rows(loose(t))


@query("p5_finite_rows", f"SELECT study_id, {sql6('effect')} FROM (SELECT study_id, CASE covariate%3 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE ELSE effect END AS effect FROM studies_events) WHERE isfinite(effect)")
def _(t):
    bad = t.studies_events.select("study_id", F.when(c("covariate") % 3 == 0, float("nan")).when(c("covariate") % 3 == 1, float("inf")).otherwise(c("effect")).alias("effect"))
    return rounded(bad.filter(ex.finite("effect")))


@query("p6_tolerant_cast", """SELECT event_id, TRY_CAST(CASE WHEN event_id%5=0 THEN 'n/a' ELSE props[7:-2] END AS DOUBLE) AS p_value,
 CASE WHEN event_id%7=0 THEN NULL ELSE strftime(ts,'%Y-%m-%d') END AS date FROM events""")
def _(t):
    k = F.expr("substring(props, 7, length(props) - 7)")
    rows = t.events.select("event_id", F.when(c("event_id") % 5 == 0, "n/a").otherwise(k).alias("p_value"),
                           F.when(c("event_id") % 7 == 0, "not a date").otherwise(c("ts").cast("string")).alias("date"))
    return ex.tolerant(rows).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("p7_defaults", "SELECT event_id, 'events_'||event_id AS experiment_id, 'Experiment '||event_id AS experiment_name, CASE WHEN event_id%2=0 THEN event_type ELSE 'conversion' END AS metric FROM events")
def _(t):
    rows = t.events.select("event_id", F.when(c("event_id") % 2 == 0, c("event_type")).alias("metric"))
    return ex.with_defaults(rows, "events", "event_id")


@query("p8_study_derivation", f"SELECT study_id, {sql6('effect', 'se', 'effect-1.96*se AS ci_lower', 'effect+1.96*se AS ci_upper', 'variance', '1/variance AS weight')}, total_n FROM studies_tpch")
def _(t):
    counts = t.studies_tpch.select("study_id", "control_conversions", "control_total", "treatment_conversions", "treatment_total")
    return rounded(ex.derive_studies(counts)).select("study_id", "effect", "se", "ci_lower", "ci_upper", "variance", "weight", "total_n")


def visits(t):
    return t.studies_tpch.select("study_id", c("control_total").alias("control_visitors"), "control_conversions", c("treatment_total").alias("variant_visitors"), c("treatment_conversions").alias("variant_conversions"))


CORRECTED = """SELECT study_id, control_visitors, control_conversions, variant_visitors, variant_conversions, {cols} FROM (
 SELECT *, control_conversions/control_visitors AS control_rate, variant_conversions/variant_visitors AS treatment_rate,
  ln(((variant_conversions+0.5::DOUBLE)*(control_visitors-control_conversions+0.5::DOUBLE))/((control_conversions+0.5::DOUBLE)*(variant_visitors-variant_conversions+0.5::DOUBLE))) AS effect_size,
  sqrt(1/(control_conversions+0.5::DOUBLE)+1/(control_visitors-control_conversions+0.5::DOUBLE)+1/(variant_conversions+0.5::DOUBLE)+1/(variant_visitors-variant_conversions+0.5::DOUBLE)) AS standard_error
 FROM (SELECT study_id, control_total AS control_visitors, control_conversions, treatment_total AS variant_visitors, treatment_conversions AS variant_conversions FROM studies_tpch))"""
CORR6 = sql6('effect_size', 'standard_error', 'control_rate', 'treatment_rate', '(treatment_rate-control_rate)/greatest(control_rate,1e-6) AS relative_lift', '(control_visitors+variant_visitors)::DOUBLE AS total_sample_size')


@query("p9_corrected_effects", CORRECTED.format(cols=CORR6))
def _(t):
    return rounded(ex.corrected_effects(visits(t)))


@query("p10_domain_renames", CORRECTED.format(cols=CORR6 + ", control_visitors AS control_total, variant_visitors AS treatment_total, variant_conversions AS treatment_conversions").replace("SELECT study_id, control_visitors", "SELECT study_id AS experiment_id, control_visitors", 1))
def _(t):
    saas = visits(t).withColumnsRenamed({"variant_visitors": "users", "variant_conversions": "activations"})
    return rounded(ex.from_domain(saas, "saas"))


@query("p11_study_schema", CORRECTED.format(cols=CORR6 + ", control_visitors AS control_total, variant_visitors AS treatment_total, variant_conversions AS treatment_conversions, study_id[:4] AS region, 'web' AS platform").replace("SELECT study_id, control_visitors", "SELECT study_id AS experiment_id, control_visitors", 1))
def _(t):
    rows = visits(t).withColumnsRenamed({"control_visitors": "control_n", "variant_visitors": "treatment_n", "variant_conversions": "treatment_events"})
    return rounded(ex.to_study_schema(rows.withColumns({"region": F.substring("study_id", 1, 4), "platform": F.lit("web"), "ignored": F.lit(1)})))


@query("p12_clean_import", """SELECT study_id AS experiment_name, a AS control_total, b AS control_conversions, p AS treatment_total, q AS treatment_conversions FROM (
 SELECT study_id, CASE WHEN covariate%5=0 THEN NULL ELSE control_total-150 END AS a, control_conversions AS b, treatment_total AS p, treatment_conversions*4 AS q FROM studies_events) WHERE a IS NOT NULL AND b<=a AND q<=p AND a>0 AND p>0""")
def _(t):
    s = t.studies_events
    text = s.select(c("study_id").alias("campaign"), F.when(c("covariate") % 5 == 0, "unknown").otherwise((c("control_total") - 150).cast("string")).alias("control_users"),
                    c("control_conversions").cast("string").alias("control_success"), c("treatment_total").alias("treatment_users"), (c("treatment_conversions") * 4).alias("treatment_success"))
    return ex.clean_import(text)


@query("p13_filter_experiments", "SELECT study_id, total_n FROM studies_events WHERE day>=DATE '2024-01-05' AND day<=DATE '2024-01-20' AND total_n>=320 AND (contains(lower(study_name),'pur') OR contains(lower(metric),'pur'))")
def _(t):
    return ex.filter_experiments(t.studies_events, "2024-01-05", "2024-01-20", 320, "PUR").select("study_id", "total_n")


@query("p14_fetch_experiments", "SELECT study_id, total_n FROM studies_events WHERE study_id IN (SELECT strftime(ts,'%Y-%m-%d')||'|'||event_type FROM events WHERE value>200) AND total_n>=320 AND day>=DATE '2024-01-03'")
def _(t):
    ids = t.events.filter("value > 200").select(F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd"), "event_type").alias("study_id"))
    return ex.fetch_experiments(t.studies_events, ids, 320, "2024-01-03", text="ignored").select("study_id", "total_n")


@query("p15_list_experiments", "SELECT study_id, study_name, metric, total_n, strftime(day,'%Y-%m-%d') AS date FROM studies_events")
def _(t):
    return t.studies_events.select("study_id", "study_name", "metric", "total_n", c("day").cast("string").alias("date"))


@query("p15_experiment_detail", f"SELECT study_id, {sql6('effect', 'se')} FROM studies_events WHERE study_id='2024-01-07|view' ORDER BY day LIMIT 1")
def _(t):
    return rounded(ex.first_by_id(t.studies_events, "2024-01-07|view", ["day"]).select("study_id", "effect", "se"))


@query("p16_segment_lookup", f"SELECT 'purchase' AS study_id, segment, {sql6('avg(effect) AS value')} FROM studies_events WHERE metric='purchase' GROUP BY segment")
def _(t):
    per = t.studies_events.groupBy("metric", "segment").agg(F.avg("effect").alias("e"))
    maps = per.groupBy(c("metric").alias("study_id")).agg(F.map_from_entries(F.collect_list(F.struct("segment", "e"))).alias("m"))  # seven weekdays at most
    return rounded(ex.segment_results(maps.select("study_id", F.create_map(F.lit("weekday"), "m").alias("segments")), "purchase", "weekday"))


@query("p17_collect_sources", "SELECT source, count(*) AS studies, CAST(sum(total_n) AS BIGINT) AS total_n FROM (SELECT 'events' AS source, total_n, day FROM studies_events UNION ALL SELECT 'returns', total_n, NULL FROM studies_tpch) GROUP BY 1")
def _(t):
    both = ex.collect_sources({"events": t.studies_events, "returns": t.studies_tpch}, 2020)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("studies"), F.sum("total_n").alias("total_n"))


@query("p18_archive_search", "SELECT study_id, total_n FROM studies_events WHERE contains(lower(study_name),'2024-01-1') AND metric='click' AND total_n>=300 ORDER BY study_id LIMIT 50")
def _(t):
    return ex.search_archive(t.studies_events, "2024-01-1", "click", 300).select("study_id", "total_n")


# Request texts: a passage and planted words that depend on its number.
PLANTS = ["please pool the tests with a fixed effect model, sample size: 500", "check bias and funnel, n > 40 since 2021", "robust? explain the revenue results",
          "segment by region and recommend, random effect", "compare retention with the benchmark from 2019", "combine conversion tests"]


def requests(t):
    # conversations extend the passages, so the table grows with the data
    words = F.element_at(F.array(*[F.lit(x) for x in PLANTS]), ((c("conv_id") + c("turn")) % len(PLANTS) + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", F.concat_ws(" ", "text", words).alias("text"))


cte("requests", f"SELECT conv_id, turn, text||' '||([{','.join(chr(39) + x + chr(39) for x in PLANTS)}])[(conv_id+turn)%{len(PLANTS)}+1] AS text FROM conversations")


def any_sql(words):
    return "(" + " OR ".join(f"contains(lower(text),'{w}')" for w in words) + ")"


def listed(groups):
    return "list_filter([" + ",".join(f"CASE WHEN {any_sql(w)} THEN '{k}' END" for k, w in groups.items()) + "], lambda x: x IS NOT NULL)"


@query("p19_request_classes", f"""SELECT conv_id, turn, array_to_string(CASE WHEN len(k)>0 THEN k ELSE ['meta_analysis','publication_bias','sensitivity'] END,',') AS analysis_types, model, min_sample_size, year_from, metric_type, array_to_string(r,',') AS requests FROM (
 SELECT conv_id, turn, {listed(ex.ANALYSIS_WORDS)} AS k, CASE WHEN contains(lower(text),'fixed effect') THEN 'fixed' WHEN contains(lower(text),'random effect') THEN 'random' ELSE 'auto' END AS model,
 coalesce(TRY_CAST(regexp_extract(lower(text),'(?:sample|n)\\s*(?:size)?[:\\s>]+(\\d+)',1) AS BIGINT),-1) AS min_sample_size, coalesce(TRY_CAST(regexp_extract(lower(text),'(?:from|since|after)\\s+(\\d{{4}})',1) AS BIGINT),-1) AS year_from,
 CASE WHEN contains(lower(text),'conversion') THEN 'conversion' WHEN contains(lower(text),'revenue') THEN 'revenue' WHEN contains(lower(text),'retention') THEN 'retention' END AS metric_type, {listed(ex.REQUEST_WORDS)} AS r FROM requests)""")
def _(t):
    out = ex.classify_requests(requests(t), "text")
    return out.select("conv_id", "turn", F.array_join("analysis_types", ",").alias("analysis_types"), "model", F.coalesce("min_sample_size", F.lit(-1)).alias("min_sample_size"),
                      F.coalesce("year_from", F.lit(-1)).alias("year_from"), "metric_type", F.array_join("requests", ",").alias("requests"))


@query("p20_constraints", f"""SELECT study_id, {sql6('greatest(0.001,least(0.999,greatest(0.01,least(0.3,control_conversions/control_total)))) AS conversion_rate', 'greatest(0.01,least(0.15,effect)) AS ctr')},
 greatest(500,least(500000,control_total)) AS control_visitors, least(abs(control_conversions*3-20), control_total) AS control_conversions, greatest(7,least(30,control_total%50)) AS test_duration_days FROM studies_tpch""")
def _(t):
    s = t.studies_tpch.select("study_id", (c("control_conversions") / c("control_total")).alias("conversion_rate"), c("effect").alias("ctr"), c("control_total").alias("control_visitors"),
                              (c("control_conversions") * 3 - 20).alias("control_conversions"), (c("control_total") % 50).alias("test_duration_days"))
    return rounded(ex.enforce_constraints(s, "ecommerce"))


SEGS = [(d, s, v) for d, m in lexicons.SEGMENT_VALUES.items() for s, vs in m.items() for v in vs]


@query("p21_segment_values", "SELECT event_type, device AS value, count(*) AS n FROM (SELECT event_type, (['mobile','desktop','tablet','watch'])[user_id%4+1] AS device FROM events) WHERE device IN (" + ",".join(f"'{v}'" for d, s, v in SEGS if (d, s) == ("ecommerce", "device_type")) + ") GROUP BY 1,2")
def _(t):
    dim = ex.segment_dimension(t.spark, "ecommerce").filter("segment = 'device_type'")
    seen = t.events.select("event_type", F.element_at(F.array(*[F.lit(x) for x in ("mobile", "desktop", "tablet", "watch")]), (c("user_id") % 4 + 1).cast("int")).alias("value"))
    return seen.join(F.broadcast(dim), "value").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))


def cells(t):
    s = t.studies_tpch
    return s, [c("control_conversions"), c("control_total") - c("control_conversions"), c("treatment_conversions"), c("treatment_total") - c("treatment_conversions")]


@query("c1_log_odds_ratio", f"SELECT study_id, {sql6('effect')} FROM studies_tpch")
def _(t):
    s, x = cells(t)
    return s.select("study_id", r6(effects.log_odds_ratio(*x), "effect"))


@query("c2_log_odds_se", f"SELECT study_id, {sql6('se')} FROM studies_tpch")
def _(t):
    s, x = cells(t)
    return s.select("study_id", r6(effects.log_odds_se(*x), "se"))


@query("c3_cohens_d", f"SELECT study_id, {sql6(f'effect*pi()/sqrt(3) AS from_d', 'effect/(pi()/sqrt(3)) AS to_d')} FROM studies_events")
def _(t):
    return t.studies_events.select("study_id", r6(effects.d_to_log_odds(c("effect")), "from_d"), r6(effects.log_odds_to_d(c("effect")), "to_d"))


RR = "(treatment_conversions/treatment_total)/(control_conversions/control_total)"


@query("c4_risk_ratio", f"SELECT study_id, round(CASE WHEN rr*4*b<1 AND rr>0 THEN ln((rr*4*b/(1-rr*4*b))/(b/(1-b))) END,6)+0.0 AS log_odds FROM (SELECT study_id, {RR} AS rr, control_conversions/control_total AS b FROM studies_events WHERE control_conversions>0)")
def _(t):
    b = c("control_conversions") / c("control_total")
    rr = c("treatment_conversions") / c("treatment_total") / b
    return t.studies_events.filter("control_conversions > 0").select("study_id", r6(effects.risk_ratio_to_log_odds(rr * 4, b), "log_odds"))


@query("c5_log_odds_to_risk_ratio", f"SELECT study_id, {sql6('exp(effect)/(1-b+b*exp(effect)) AS risk_ratio')} FROM (SELECT *, control_conversions/control_total AS b FROM studies_events)")
def _(t):
    return t.studies_events.select("study_id", r6(effects.log_odds_to_risk_ratio(c("effect"), c("control_conversions") / c("control_total")), "risk_ratio"))


KINDS = ["log_odds_ratio", "cohens_d", "correlation", "mean_difference"]


def kinds(names=KINDS):
    return F.element_at(F.array(*[F.lit(k) for k in names]), (c("covariate") % len(names) + 1).cast("int"))


@query("c6_se_from_n", f"SELECT study_id, kind, {sql6('''CASE kind WHEN 'cohens_d' THEN sqrt(4/total_n+effect*effect/(2*total_n)) WHEN 'correlation' THEN 1/sqrt(total_n-3) ELSE sqrt(4/total_n) END AS se''')} FROM (SELECT *, ({KINDS!r})[covariate%4+1] AS kind FROM studies_events)")
def _(t):
    s = t.studies_events.withColumn("kind", kinds())
    return s.select("study_id", "kind", r6(effects.se_from_n(c("effect"), c("total_n"), c("kind")), "se"))


TYPES = ["log_odds_ratio", "cohens_d", "risk_ratio", "hazard_ratio"]
cte("typed", f"SELECT study_id, covariate, total_n, se, ({TYPES!r})[covariate%4+1] AS effect_type, CASE WHEN covariate%4=2 THEN abs(effect)*12 ELSE effect END AS effect FROM studies_events")


def typed(t):
    return t.studies_events.select("study_id", "covariate", "total_n", "se", kinds(TYPES).alias("effect_type"), F.when(c("covariate") % 4 == 2, F.abs("effect") * 12).otherwise(c("effect")).alias("effect"))


RRL = "CASE WHEN effect*0.1<1 AND effect>0 THEN ln((effect*0.1/(1-effect*0.1))/(0.1/0.9)) END"


@query("c7_convert_effect", f"""SELECT study_id, effect_type, {sql6('e AS effect', 'sqrt(4/total_n+e*e/(2*total_n)) AS se')} FROM (SELECT *, CASE effect_type WHEN 'log_odds_ratio' THEN effect WHEN 'cohens_d' THEN effect*{K!r} WHEN 'risk_ratio' THEN {RRL} END/{K!r} AS e FROM typed) WHERE e IS NOT NULL""")
def _(t):
    s = typed(t).withColumn("r", ex.convert_effect(c("effect"), c("effect_type"), F.lit("cohens_d"), c("total_n"), F.lit(0.1))).filter("r IS NOT NULL")
    return s.select("study_id", "effect_type", r6(c("r.effect"), "effect"), r6(c("r.se"), "se"))


@query("c8_pooled_sd", "SELECT l_linestatus, round(sqrt(((n1-1)*s1*s1+(n2-1)*s2*s2)/(n1+n2-2)),6)+0.0 AS pooled_sd FROM (SELECT l_linestatus, count(*) FILTER (l_returnflag='R') AS n1, stddev_samp(l_extendedprice) FILTER (l_returnflag='R') AS s1, count(*) FILTER (l_returnflag<>'R') AS n2, stddev_samp(l_extendedprice) FILTER (l_returnflag<>'R') AS s2 FROM lineitem GROUP BY 1)")
def _(t):
    r = c("l_returnflag") == "R"
    g = t.lineitem.groupBy("l_linestatus").agg(F.count_if(r).alias("n1"), F.stddev_samp(F.when(r, c("l_extendedprice"))).alias("s1"), F.count_if(~r).alias("n2"), F.stddev_samp(F.when(~r, c("l_extendedprice"))).alias("s2"))
    return g.select("l_linestatus", r6(effects.pooled_sd(c("n1"), c("s1"), c("n2"), c("s2")), "pooled_sd"))


@query("c9_hedges_correction", "SELECT study_id, round(CASE WHEN total_n<=2 THEN 1.0 ELSE 1-3/(4.0*(total_n-2)-1) END,6)+0.0 AS g FROM studies_tpch")
def _(t):
    return t.studies_tpch.select("study_id", r6(effects.hedges_correction(c("total_n")), "g"))


@query("c10_harmonize", f"""SELECT study_id, {sql6('e AS new_effect', 's AS new_se')}, effect_type<>'log_odds_ratio' AS converted FROM (SELECT *, CASE effect_type WHEN 'log_odds_ratio' THEN effect WHEN 'cohens_d' THEN effect*{K!r} WHEN 'risk_ratio' THEN {RRL} END AS e,
 CASE effect_type WHEN 'log_odds_ratio' THEN se WHEN 'cohens_d' THEN se*{K!r} ELSE sqrt(4/total_n) END AS s FROM typed) WHERE e IS NOT NULL""")
def _(t):
    out = ex.harmonize(typed(t))
    return rounded(out.select("study_id", "new_effect", "new_se", F.map_contains_key("metadata", "original_effect_type").alias("converted")))


@query("c11_standard_metadata", "SELECT study_id, CASE WHEN covariate%2=0 THEN 'own' ELSE 'csv' END AS source_platform, 'true' AS harmonized, '2024-02-01' AS harmonization_date FROM studies_events")
def _(t):
    s = t.studies_events.select("study_id", F.lit("csv").alias("platform"), F.when(c("covariate") % 2 == 0, F.create_map(F.lit("source_platform"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"))
    m = ex.standard_metadata(s, "2024-02-01")
    return m.select("study_id", *[F.element_at("metadata", k).alias(k) for k in ("source_platform", "harmonized", "harmonization_date")])


@query("c12_summary_statistics", f"SELECT metric, count(*) AS n, {sql6('avg(effect) AS effect_mean', 'median(effect) AS effect_median', 'stddev_pop(effect) AS effect_std', 'min(effect) AS effect_min', 'max(effect) AS effect_max', 'max(effect)-min(effect) AS effect_range', 'avg(se) AS se_mean', 'min(se) AS se_min', 'max(se) AS se_max', 'avg(total_n) AS n_mean')}, CAST(sum(total_n) AS BIGINT) AS n_total FROM studies_events GROUP BY 1")
def _(t):
    s = t.studies_events
    g = s.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("effect").alias("effect_mean"), F.stddev_pop("effect").alias("effect_std"), F.min("effect").alias("effect_min"), F.max("effect").alias("effect_max"),
                                (F.max("effect") - F.min("effect")).alias("effect_range"), F.avg("se").alias("se_mean"), F.min("se").alias("se_min"), F.max("se").alias("se_max"), F.avg("total_n").alias("n_mean"), F.sum("total_n").alias("n_total"))
    return rounded(g.join(quantiles(s, ["metric"], "effect", {"effect_median": 0.5}), "metric"))


@query("c13_conversion_totals", f"SELECT metric, {sql6('sum(control_conversions)*100.0/sum(control_total) AS control_pct', 'sum(treatment_conversions)*100.0/sum(treatment_total) AS treatment_pct')} FROM studies_events GROUP BY 1")
def _(t):
    return rounded(t.studies_events.groupBy("metric").agg((F.sum("control_conversions") / F.sum("control_total") * 100).alias("control_pct"), (F.sum("treatment_conversions") / F.sum("treatment_total") * 100).alias("treatment_pct")))
