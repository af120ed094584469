"""Chart tables, verdicts, recommendations, benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.stats import norm_p_sql, z_quantile
from ..operators import bias, meta, reports, sensitivity
from ..operators.scale import settle
from .q_bias import Z, brands, sensitivity_parts
from .q_meta import normal_sql, pooled, rounded, sql6
from .registry import cte, query

BR, ME = ["brand"], ["metric"]


def case_sql(value: str, limits) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {value}<{a} THEN {q(b)}" if a is not None else f"ELSE {q(b)}" for a, b in limits) + " END"


cte("weights_tp", "SELECT s.*, 100/(s.variance+p.tau2)/p.rw AS weight_pct, p.k FROM studies_tpch s JOIN pool_tp p USING (brand)")


def weights(t):
    s, p = brands(t)
    return meta.study_weights(s, p, BR)


@query("m24_forest_table", f"""SELECT brand, study_id, CASE WHEN length(study_id)>30 THEN study_id[1:30]||'...' ELSE study_id END AS label, rn, k+3-rn AS y,
 {sql6('effect', 'se', 'weight_pct', 'sqrt(weight_pct)*3+5 AS marker')} FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY round(effect,9) DESC, study_id) AS rn FROM weights_tp)""")
def _(t):
    return rounded(reports.forest_table(weights(t), BR))


@query("m25_funnel_contours", f"""SELECT metric, level, step, {sql6('se', 're_effect-z*se AS lower', 're_effect+z*se AS upper')} FROM (
 SELECT metric, re_effect, step, 0.001+(top-0.001)*step/99 AS se FROM pool_ev JOIN (SELECT metric, max(se)*1.2 AS top FROM studies_events GROUP BY 1) USING (metric), (SELECT unnest(range(0,100))::INT AS step)),
 (VALUES (95, 1.96::DOUBLE), (99, 2.576::DOUBLE)) v(level, z)""")
def _(t):
    s = t.studies_events
    return rounded(reports.funnel_contours(s, meta.pool(s, ME), ME))


@query("m26_heterogeneity_chart", f"SELECT metric, {sql6('q', 'q/df AS q_ratio', 'sqrt(tau2) AS tau', 'i2')} FROM pool_ev")
def _(t):
    return rounded(pooled(t).select("metric", "q", (F.col("q") / F.col("df")).alias("q_ratio"), F.sqrt("tau2").alias("tau"), "i2"))


@query("m26_bubble_fit", f"""SELECT brand, n, {sql6('slope', 'my-slope*mx AS intercept', 'x_min', 'x_max')} FROM (
 SELECT brand, n, mx, my, x_min, x_max, sum(w*(x-mx)*(y-my))/sum(w*(x-mx)*(x-mx)) AS slope FROM (
  SELECT brand, 1/se AS x, effect AS y, weight_pct*weight_pct AS w FROM weights_tp) JOIN (
  SELECT brand, count(*) AS n, sum(weight_pct*weight_pct/se)/sum(weight_pct*weight_pct) AS mx, sum(weight_pct*weight_pct*effect)/sum(weight_pct*weight_pct) AS my,
   min(1/se) AS x_min, max(1/se) AS x_max FROM weights_tp GROUP BY 1) USING (brand) WHERE n>2 GROUP BY ALL)""")
def _(t):
    return rounded(reports.bubble_fit(weights(t), BR))


@query("m26_influence_chart", f"""SELECT metric, study_id, {sql6('leverage', 'std_residual', 'least(50.0, greatest(10.0, 100*cooks_distance+10)) AS marker')}, is_influential FROM influence_ev""")
def _(t):
    s = t.studies_events
    return rounded(reports.influence_sizes(sensitivity.influence(s, meta.pool(s, ME), ME), ME))


@query("m26_leave_one_out_chart", f"SELECT l.metric, l.study_id, {sql6('l.e AS effect', f'l.e-{Z!r}*l.s AS ci_lower', f'l.e+{Z!r}*l.s AS ci_upper', 'p.re_effect AS overall')}, CAST(row_number() OVER (PARTITION BY l.metric ORDER BY l.study_id) AS BIGINT) AS place FROM loo_ev l JOIN pool_ev p USING (metric)")
def _(t):
    s = t.studies_events
    p = settle(meta.pool(s, ME))
    return rounded(reports.leave_one_out_chart(sensitivity.leave_one_out(s, p, ME), p, ME))


@query("m26_cumulative_chart", f"SELECT metric, study_id, strftime(day,'%Y-%m-%d') AS timestamp, k AS n_studies, {sql6('e AS effect', f'e-{Z!r}*s AS ci_lower', f'e+{Z!r}*s AS ci_upper')}, p_value<0.05 AS significant FROM cumulative_ev")
def _(t):
    return rounded(reports.cumulative_chart(sensitivity.cumulative(t.studies_events, ME, "day"), ME))




@query("m27_traffic_light", f"""SELECT brand, CASE WHEN p_value<0.05 AND ci_lower>0 AND ci_upper>0 THEN 'green' WHEN p_value<0.05 AND ci_lower<0 AND ci_upper<0 THEN 'red' ELSE 'yellow' END AS colour,
 {case_sql('p_value', reports.CONFIDENCE)} AS confidence, {case_sql('i2', reports.SPREAD)} AS heterogeneity FROM (
 SELECT brand, i2, {norm_p_sql('(re_effect/re_se)')} AS p_value, re_effect-{Z!r}*re_se AS ci_lower, re_effect+{Z!r}*re_se AS ci_upper FROM pool_tp)""")
def _(t):
    return reports.traffic_light(meta.random_effects(brands(t)[1], BR), BR)


@query("m28_comparison_panel", """SELECT brand, k AS experiments, printf('%.3f', re_effect) AS pooled_effect, printf('%.1f%%', i2) AS i2, detected
 FROM pool_tp JOIN severity_tp USING (brand)""")
def _(t):
    s, p = brands(t)
    return reports.comparison_panel(p, bias.bias_severity(s, p, BR), BR)




def report_facts(t):
    s, p = brands(t)
    loo = settle(sensitivity.leave_one_out(s, p, BR))
    flagged = sensitivity.influential(loo, sensitivity.influence(s, p, BR, loo), p, BR)
    robust = sensitivity.robustness(loo, flagged, p, BR)
    history = p.select("brand", (F.col("re_effect") - F.lit(0.3) * (F.length("brand") % 2)).alias("historical_effect"))
    return settle(reports.facts(p, bias.bias_severity(s, p, BR), robust, BR, history))


cte("influence_tp", """SELECT *, abs(dfbetas)>2/sqrt(k) OR cooks_distance>4/k AS is_influential FROM (
 SELECT brand, study_id, k, (re_effect-e)/re_se AS dfbetas, r*r*h/(k*re_se*re_se*(1-h)*(1-h)) AS cooks_distance FROM (
 SELECT s.brand, s.study_id, p.k::DOUBLE AS k, p.re_effect, p.re_se, l.e, 1/(s.variance+p.tau2)/p.rw AS h, s.effect-p.re_effect AS r
 FROM studies_tpch s JOIN pool_tp p USING (brand) JOIN loo_tp l USING (brand, study_id)))""")
cte("robust_tp", f"""SELECT p.brand, coalesce(f.flagged,0) AS flagged, NOT (coalesce(f.flagged,0)>p.k*0.3 OR x.flips OR x.apart) AS robust
 FROM pool_tp p LEFT JOIN (SELECT brand, count(*) AS flagged FROM loo_tp JOIN influence_tp USING (brand, study_id)
  WHERE relative_change>0.1 OR direction_changed OR (({norm_p_sql('(re_effect/re_se)')}<0.05)<>(p_value<0.05)) OR is_influential GROUP BY 1) f USING (brand)
 JOIN (SELECT brand, bool_or(direction_changed) AS flips, bool_or(ci_upper<re_effect-{Z!r}*re_se OR ci_lower>re_effect+{Z!r}*re_se) AS apart FROM loo_tp GROUP BY 1) x USING (brand)""")
cte("facts_tp", f"""SELECT p.brand, p.k, p.q, p.df, p.i2, p.tau2, p.re_effect, p.re_se, re_effect-{Z!r}*re_se AS lo, re_effect+{Z!r}*re_se AS hi, re_effect/re_se AS z, {norm_p_sql('(re_effect/re_se)')} AS p_value,
 v.severity, v.detected, v.egger_p, v.k0, v.adjusted_effect, r.robust, r.flagged, re_effect-0.3*(length(brand)%2) AS historical_effect
 FROM pool_tp p JOIN severity_tp v USING (brand) JOIN robust_tp r USING (brand)""")
RULE_SQL = ["i2>75", "i2>50 AND i2<=75", "severity IN ('likely','severe')", "severity='possible'", "NOT robust", "flagged>0", "k<10",
            "p_value>0.01 AND p_value<0.05", "abs(re_effect-historical_effect)>0.2"]
cte("recs_tp", "SELECT brand, CAST(row_number() OVER (PARTITION BY brand ORDER BY o, i) AS INT) AS position, kind, priority, title FROM (" + " UNION ALL ".join(
    f"SELECT brand, {dict(high=0, medium=1, low=2)[p]} AS o, {i} AS i, '{k}' AS kind, '{p}' AS priority, '{n}' AS title FROM facts_tp WHERE {w}"
    for i, (w, (k, p, n)) in enumerate(zip(RULE_SQL, reports.RULES))) + ")")


def _line(section, line, text, where="true"):
    return f"SELECT brand, {section} AS section, {line} AS line, {text} AS text FROM facts_tp WHERE {where}"


def _lit(s):
    return "'" + s.replace("'", "''") + "'"


LINES = [
    (1, 1, _lit("# Meta-Analysis Report")), (1, 2, _lit("## Executive Summary")),
    (1, 3, "printf('This meta-analysis of **%d studies** found a %s pooled effect of **%.3f** (95%% CI: %.3f to %.3f), which is %s (p = %.4f). Heterogeneity was %s (I² = %.1f%%).', k, "
           "CASE WHEN re_effect>0 THEN 'positive' ELSE 'negative' END, re_effect, lo, hi, CASE WHEN p_value<0.05 THEN 'statistically significant' ELSE 'not statistically significant' END, p_value, "
           "CASE WHEN i2>50 THEN 'high' WHEN i2>25 THEN 'moderate' ELSE 'low' END, i2)"),
    (2, 1, _lit("## Methods")), (2, 2, _lit("- **Model:** Random Effects model")), (2, 3, _lit("- **Effect Size:** Log odds ratio")), (2, 4, _lit("- **Confidence Level:** 95%")),
    (3, 1, _lit("## Results")), (3, 2, _lit("### Pooled Effect")), (3, 3, _lit("| Statistic | Value |")), (3, 4, _lit("|-----------|-------|")),
    (3, 5, "printf('| Pooled Effect | %.4f |', re_effect)"), (3, 6, "printf('| Standard Error | %.4f |', re_se)"), (3, 7, "printf('| 95%% CI Lower | %.4f |', lo)"),
    (3, 8, "printf('| 95%% CI Upper | %.4f |', hi)"), (3, 9, "printf('| Z-value | %.2f |', z)"), (3, 10, "printf('| P-value | %.4f |', p_value)"),
    (3, 11, _lit("### Heterogeneity")), (3, 12, "printf('| Q | %.2f |', q)"), (3, 13, "printf('| I² | %.1f%% |', i2)"), (3, 14, "printf('| τ² | %.4f |', tau2)"),
    (4, 1, _lit("## Publication Bias Assessment")), (4, 2, "printf('- **Egger''s test:** p = %.3f', egger_p)"), (4, 3, "'- **Bias severity:** '||severity", "detected"),
    (4, 4, "printf('- **Trim-and-fill:** %d imputed studies', k0)", "k0>0"), (4, 5, "printf('- **Adjusted effect:** %.4f', adjusted_effect)", "k0>0"),
    (5, 1, _lit("## Sensitivity Analysis")),
    (5, 2, "CASE WHEN robust THEN '✓ Results are robust to removal of individual studies.' ELSE '⚠️ Results may be sensitive to individual studies.' END"),
    (5, 3, "printf('**Influential studies:** %d', flagged)", "flagged>0"),
    (7, 1, _lit("## Limitations")), (7, 2, _lit("- Results should be interpreted in the context of original study designs")),
    (7, 3, _lit("- Heterogeneity may limit generalizability of pooled estimates")), (7, 4, _lit("- Publication bias assessment has limited power with few studies")),
]


@query("m29_report_lines", " UNION ALL ".join(_line(*x) for x in LINES) +
       " UNION ALL SELECT brand, 6, position, '### '||position||'. '||title||' — '||upper(priority) FROM recs_tp WHERE position<=5")
def _(t):
    f = report_facts(t)
    return reports.report_lines(f, reports.recommendations(f, BR), BR)


@query("m30_recommendations", "SELECT * FROM recs_tp")
def _(t):
    return reports.recommendations(report_facts(t), BR)


I2T = [(25, "low"), (50, "moderate"), (75, "substantial"), (None, "high")]
I2M = [(25, "Studies show consistent effects."), (50, "Some variation between studies exists."),
       (75, "Considerable variation exists. Random effects model appropriate."), (None, "True effects vary substantially. Consider subgroup analysis.")]
PT = [(0.01, "Significant. Good evidence against null hypothesis."), (0.05, "Marginally significant. Some evidence, but borderline."),
      (0.10, "Not significant, but approaching significance."), (None, "Not statistically significant.")]
ET = [(0.05, "Significant asymmetry detected. Publication bias possible."), (0.10, "Borderline asymmetry. Consider cautiously."), (None, "No significant asymmetry detected.")]


@query("m31_interpretations", f"""
SELECT brand, 'i2' AS statistic, printf('I² = %.1f%% indicates **%s heterogeneity**. %s', i2, {case_sql('i2', I2T)}, {case_sql('i2', I2M)}) AS text FROM facts_tp
UNION ALL SELECT brand, 'tau2', printf('τ² = %.4f (τ = %.3f). This represents the estimated variance of true effects across studies.', tau2, sqrt(tau2)) FROM facts_tp
UNION ALL SELECT brand, 'p_value', CASE WHEN p_value<0.001 THEN 'p < 0.001: Highly significant. Strong evidence against null hypothesis.' ELSE printf('p = %.3f: ', p_value)||{case_sql('p_value', PT)} END FROM facts_tp
UNION ALL SELECT brand, 'eggers_p', printf('Egger''s test p = %.3f: ', egger_p)||{case_sql('egger_p', ET)} FROM facts_tp
UNION ALL SELECT brand, 'q', printf('Q = %.2f (df = %d): Measures total heterogeneity in the meta-analysis.', q, df) FROM facts_tp""")
def _(t):
    s, p = brands(t)
    return reports.interpretations(p, bias.bias_severity(s, p, BR), BR)


@query("m32_historical_comparison", f"""SELECT brand, {sql6('re_effect AS current_effect', 'h AS historical_average', 're_effect-h AS effect_difference')},
 CASE WHEN abs(re_effect-h)<0.1 THEN 'Current results are consistent with historical findings.' WHEN re_effect>h THEN 'Current effect is larger than historical average.' ELSE 'Current effect is smaller than historical average.' END AS interpretation
 FROM pool_tp, (SELECT avg(re_effect) AS h FROM pool_ev)""")
def _(t):
    past = pooled(t).select(F.col("re_effect").alias("pooled_effect"))
    return rounded(reports.historical_comparison(brands(t)[1], past, BR))


@query("m33_archive_benchmark", f"""SELECT lower(metric) AS metric_key, count(*) AS n_experiments, {sql6('avg(effect) AS historical_effect', 'stddev_pop(effect) AS effect_std', 'min(effect) AS effect_min', 'max(effect) AS effect_max', 'median(total_n) AS median_sample_size')} FROM studies_events GROUP BY 1""")
def _(t):
    return rounded(reports.archive_benchmark(t.studies_events))


@query("m34_recent_analyses", f"SELECT month, n, {sql6('effect')} FROM (SELECT month, count(*) AS n, avg(effect) AS effect FROM studies_tpch GROUP BY 1) ORDER BY month DESC LIMIT 10")
def _(t):
    runs = t.studies_tpch.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.avg("effect").alias("effect"))
    return rounded(runs.orderBy(F.desc("month")).limit(10))


DIM = "(VALUES " + ",".join(f"({i},'{a}','{b}',{c}::DOUBLE,{d}::DOUBLE,{e}::DOUBLE,{n}::BIGINT)" for i, (a, b, c, d, e, n) in enumerate(lexicons.BENCHMARKS)) + ") d(ord,industry,benchmark_metric,median,p25,p75,base_n)"
INDUSTRIES = ["ecommerce", "saas", "mobile_games", "email_marketing"]
cte("asked", f"SELECT study_id, metric, effect, ({INDUSTRIES!r})[covariate%4+1] AS industry FROM studies_events")
cte("benched", f"""SELECT a.study_id, a.metric, a.industry, a.effect, b.benchmark_metric, b.median, b.p25, b.p75, b.base_n FROM asked a LEFT JOIN (
 SELECT * FROM (SELECT p.industry, p.metric, benchmark_metric, median, p25, p75, base_n, row_number() OVER (PARTITION BY p.industry, p.metric ORDER BY p.metric<>benchmark_metric, ord) AS rn
 FROM (SELECT DISTINCT industry, metric FROM asked) p JOIN {DIM} ON p.industry=d.industry AND (contains(replace(benchmark_metric,'_',' '), p.metric) OR contains(p.metric, replace(benchmark_metric,'_',' ')))) WHERE rn=1) b
 USING (industry, metric)""")


def asked(t):
    pick = F.element_at(F.array(*[F.lit(i) for i in INDUSTRIES]), (F.col("covariate") % 4 + 1).cast("int"))
    return t.studies_events.select("study_id", "metric", "effect", pick.alias("industry"))


@query("m35_benchmark_lookup", "SELECT study_id, industry, metric, benchmark_metric, median, coalesce(base_n,0) AS base_n FROM benched")
def _(t):
    return reports.benchmark_lookup(asked(t)).select("study_id", "industry", "metric", "benchmark_metric", "median", F.coalesce("base_n", F.lit(0)).alias("base_n"))


@query("m36_benchmark_band", "SELECT study_id, benchmark_metric, CASE WHEN effect<=p25 THEN 'below_average' WHEN effect<=median THEN 'average' WHEN effect<=p75 THEN 'above_average' ELSE 'exceptional' END AS category FROM benched WHERE benchmark_metric IS NOT NULL")
def _(t):
    return reports.benchmark_band(reports.benchmark_lookup(asked(t))).select("study_id", "benchmark_metric", "category")


@query("m37_sample_size", "SELECT study_id, CASE WHEN benchmark_metric IS NULL THEN 10000 WHEN abs(effect)<median THEN CAST(trunc(base_n*least(pow(median/abs(effect),2),4.0)) AS BIGINT) ELSE base_n END AS recommendation FROM benched")
def _(t):
    found = reports.benchmark_lookup(asked(t)).withColumn("mde", F.abs("effect"))
    return reports.sample_size_suggestion(found, "mde").select("study_id", "recommendation")


REFS = "(VALUES " + ",".join(f"({i},{_lit(k)},{_lit(ti)},[{','.join(_lit(x) for x in cs)}],{_lit(su)})" for i, (k, ti, cs, su) in enumerate(lexicons.METHOD_REFERENCES)) + ") r(ord,ref_key,title,concepts,summary)"


@query("m38_reference_search", f"""SELECT request, CAST(rn AS INT) AS rank, ref_key, score FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, ord) AS rn FROM (
 SELECT request, ord, ref_key, CAST(CASE WHEN contains(lower(title),request) THEN 3 ELSE 0 END+2*len(list_filter(concepts, lambda x: contains(lower(x),request)))+CASE WHEN contains(lower(summary),request) THEN 1 ELSE 0 END AS BIGINT) AS score
 FROM (SELECT DISTINCT unnest(string_split(lower(text),' ')) AS request FROM benchmark), {REFS} WHERE length(request)>=3) WHERE score>0) WHERE rn<=3""")
def _(t):
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("request")).filter(F.length("request") >= 3)
    return reports.search_references(words)
