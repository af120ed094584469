"""Study validation and two-sample comparison queries."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import quality
from .q_meta import rounded, sql6
from .registry import cte, query

# A smaller denominator makes some arms small, so that the rules have something to find.
cte("daily_tp", """SELECT study_id, brand, effect*3 AS effect, se, control_total, treatment_total, total_n, effect-0.1 AS ci_lower, effect*2.9+0.2 AS ci_upper,
 CASE WHEN control_total%7=0 THEN 1.5 ELSE 0.5 END AS p_value FROM studies_tpch""")


def daily(t):
    e = F.col("effect")
    return t.studies_tpch.select("study_id", "brand", (e * 3).alias("effect"), "se", "control_total", "treatment_total", "total_n",
                                 (e - 0.1).alias("ci_lower"), (e * 2.9 + 0.2).alias("ci_upper"),
                                 F.when(F.col("control_total") % 7 == 0, 1.5).otherwise(0.5).alias("p_value"))


@query("v1_batch_issues", """SELECT study_id, 'effect_size' AS field, 'warning' AS severity, printf('Unusually large effect size: %.3f', effect) AS message, round(effect,6)+0.0 AS value FROM daily_tp WHERE abs(effect)>5
UNION ALL SELECT study_id, 'standard_error','error',printf('Invalid standard error: %.3f', se), round(se,6) FROM daily_tp WHERE se<=0
UNION ALL SELECT study_id, 'sample_size','warning',printf('Small sample size: control=%d, treatment=%d', control_total, treatment_total), total_n::DOUBLE FROM daily_tp WHERE control_total<10 OR treatment_total<10""")
def _(t):
    return rounded(quality.batch_issues(daily(t)))


@query("v1_batch_summary", f"""SELECT brand, count(*) AS total_records, count(*) FILTER (se>0) AS valid_records, {sql6('avg(effect) AS mean_effect', 'stddev_pop(effect) AS std_effect', 'min(effect) AS min_effect', 'max(effect) AS max_effect', 'median(total_n) AS median_n')}, CAST(sum(total_n) AS BIGINT) AS total_n FROM daily_tp GROUP BY 1""")
def _(t):
    return rounded(quality.batch_summary(daily(t), ["brand"]))


cte("checked_tp", """SELECT *, list_filter([CASE WHEN abs(effect)>5 THEN printf('Effect size: %.3f outside range', effect) END, CASE WHEN se<1e-4 OR se>10 THEN printf('Standard error: %.4f outside range', se) END,
 CASE WHEN control_total<10 THEN printf('Control sample: Sample size %d below minimum 10', control_total) END, CASE WHEN treatment_total<10 THEN printf('Treatment sample: Sample size %d below minimum 10', treatment_total) END,
 CASE WHEN ci_lower>ci_upper THEN 'CI lower bound exceeds upper bound' END, CASE WHEN p_value<0 OR p_value>1 THEN printf('Invalid p-value: %.3f', p_value) END], lambda x: x IS NOT NULL) AS errors,
 list_filter([CASE WHEN abs(effect)<=5 AND abs(effect)>2 THEN printf('Large effect size: %.3f', effect) END, CASE WHEN control_total>=10 AND control_total<30 THEN printf('Small control sample: %d', control_total) END,
 CASE WHEN treatment_total>=10 AND treatment_total<30 THEN printf('Small treatment sample: %d', treatment_total) END, CASE WHEN NOT (effect>=ci_lower AND effect<=ci_upper) THEN 'Effect size not within confidence interval' END], lambda x: x IS NOT NULL) AS warnings FROM daily_tp""")


@query("v2_study_check", "SELECT study_id, array_to_string(errors,'; ') AS errors, array_to_string(warnings,'; ') AS warnings, len(errors)=0 AS is_valid FROM checked_tp")
def _(t):
    return quality.study_check(daily(t)).select("study_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "is_valid")


@query("v3_collection_check", f"""SELECT brand, count(*) AS total_studies, count(*) FILTER (len(errors)=0) AS valid_studies, {sql6('avg(effect) FILTER (len(errors)=0) AS mean_effect', 'stddev_pop(effect) FILTER (len(errors)=0) AS std_effect', 'min(effect) FILTER (len(errors)=0) AS min_effect', 'max(effect) FILTER (len(errors)=0) AS max_effect')},
 CAST(coalesce(sum(total_n) FILTER (len(errors)=0),0) AS BIGINT) AS total_sample_size, count(*)>=3 AS is_valid, coalesce(max(effect) FILTER (len(errors)=0)-min(effect) FILTER (len(errors)=0)>2, false) AS wide_range FROM checked_tp GROUP BY 1""")
def _(t):
    return rounded(quality.collection_check(quality.study_check(daily(t)), ["brand"]).withColumn("total_sample_size", F.coalesce("total_sample_size", F.lit(0))))


@query("v4_iqr_outliers", f"SELECT metric, study_id, {sql6('effect')} FROM studies_events JOIN (SELECT metric, quantile_cont(effect,0.25) AS q1, quantile_cont(effect,0.75) AS q3 FROM studies_events GROUP BY 1) USING (metric) WHERE effect<q1-1.5*(q3-q1) OR effect>q3+1.5*(q3-q1)")
def _(t):
    return rounded(quality.iqr_outliers(t.studies_events.select("metric", "study_id", "effect"), ["metric"], "effect").select("metric", "study_id", "effect"))


@query("v4_price_outliers", "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice,0.25) AS q1, quantile_cont(l_extendedprice,0.75) AS q3 FROM lineitem GROUP BY 1) USING (l_returnflag) WHERE l_extendedprice<q1-0.3*(q3-q1) OR l_extendedprice>q3+0.3*(q3-q1)")
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return quality.iqr_outliers(rows, ["l_returnflag"], "l_extendedprice", 0.3).select(*rows.columns)


@query("v4_zscore_outliers", f"SELECT metric, study_id, {sql6('effect')} FROM studies_events JOIN (SELECT metric, avg(effect) AS m, stddev_pop(effect) AS s FROM studies_events GROUP BY 1) USING (metric) WHERE abs(effect-m)/s>1.5")
def _(t):
    return rounded(quality.zscore_outliers(t.studies_events.select("metric", "study_id", "effect"), ["metric"], "effect", 1.5).select("metric", "study_id", "effect"))


# Visits and clicks per brand and month, shaped like a marketing test table.
cte("shop", """SELECT study_id, control_total-5 AS control_visitors, control_conversions AS control_conversions, treatment_total*9 AS variant_visitors, treatment_conversions AS variant_conversions,
 control_conversions::DOUBLE/control_total AS conversion_rate, effect AS ctr, (covar%40)*20.0 AS avg_order_value FROM (SELECT *, control_total+treatment_total AS covar FROM studies_tpch)""")


def shop(t):
    c = F.col
    return t.studies_tpch.select("study_id", (c("control_total") - 5).alias("control_visitors"), "control_conversions", (c("treatment_total") * 9).alias("variant_visitors"),
                                 c("treatment_conversions").alias("variant_conversions"), (c("control_conversions") / c("control_total")).alias("conversion_rate"), c("effect").alias("ctr"),
                                 (c("total_n") % 40 * F.lit(20.0)).alias("avg_order_value"))


@query("v5_violations", """WITH a AS (SELECT min(conversion_rate) a, max(conversion_rate) b, min(avg_order_value) c, max(avg_order_value) d, min(ctr) e, max(ctr) f, min(control_visitors)::DOUBLE g, min(variant_visitors)::DOUBLE h,
 count(*) FILTER (control_visitors<0)::DOUBLE i, count(*) FILTER (ctr<0)::DOUBLE j, count(*) FILTER (control_conversions>control_visitors)::DOUBLE k, count(*) FILTER (variant_conversions>variant_visitors)::DOUBLE l FROM shop)
SELECT rule, "column", round(value,6)+0.0 AS value FROM (
SELECT 'below minimum' AS rule, 'conversion_rate' AS "column", a AS value FROM a WHERE a<0.01 UNION ALL SELECT 'above maximum','conversion_rate',b FROM a WHERE b>0.3 UNION ALL
SELECT 'below minimum','avg_order_value',c FROM a WHERE c<10 UNION ALL SELECT 'above maximum','avg_order_value',d FROM a WHERE d>500 UNION ALL SELECT 'below minimum','ctr',e FROM a WHERE e<0.01 UNION ALL SELECT 'above maximum','ctr',f FROM a WHERE f>0.15 UNION ALL
SELECT 'too small','control_visitors',g FROM a WHERE g<500 UNION ALL SELECT 'too small','variant_visitors',h FROM a WHERE h<500 UNION ALL SELECT 'negative values','control_visitors',i FROM a WHERE i>0 UNION ALL
SELECT 'negative values','ctr',j FROM a WHERE j>0 UNION ALL SELECT 'conversions > visitors','control',k FROM a WHERE k>0 UNION ALL SELECT 'conversions > visitors','variant',l FROM a WHERE l>0)""")
def _(t):
    return rounded(quality.violations(shop(t), "ecommerce"))


# The sampled pair of event types per comparison.
TYPES = ["click", "error", "purchase", "signup", "view"]
PAIRS = list(itertools.combinations(TYPES, 2))


def type_pairs(t):
    """Each event once per comparison it takes part in (four of the ten fixed pairs)."""
    mine = F.array_compact(F.array(*[F.when(F.col("event_type").isin(a, b), F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col("event_type") == a).alias("first"))) for a, b in PAIRS]))
    return t.events.select("value", F.explode(mine).alias("m")).select("value", "m.*")


cte("type_pairs", " UNION ALL ".join(f"SELECT '{a}-{b}' AS pair, event_type='{a}' AS first, value FROM events WHERE event_type IN ('{a}','{b}')" for a, b in PAIRS))


@query("v6_ks_test", f"""WITH d AS (SELECT pair, value, count(*) FILTER (first) AS a, count(*) FILTER (NOT first) AS b FROM type_pairs GROUP BY 1,2), n AS (SELECT pair, CAST(sum(a) AS BIGINT) AS na, CAST(sum(b) AS BIGINT) AS nb FROM d GROUP BY 1),
 s AS (SELECT pair, na, nb, max(abs(ca/na-cb/nb)) AS d FROM (SELECT pair, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM d WINDOW w AS (PARTITION BY pair ORDER BY value)) JOIN n USING (pair) GROUP BY 1,2,3)
SELECT pair, na, nb, {sql6('d AS statistic', 'least(1.0, greatest(0.0, list_sum(list_transform(range(1,101), lambda k: (CASE WHEN k%2=1 THEN 2.0 ELSE -2.0 END)*exp(-2.0*k*k*d*d*na*nb/(na+nb)))))) AS p_value')} FROM s""")
def _(t):
    return rounded(quality.ks_statistic(type_pairs(t), ["pair"], "value", "first"))


@query("v7_js_distance", """WITH r AS (SELECT pair, min(value) AS lo, max(value) AS hi, count(*) FILTER (first) AS na, count(*) FILTER (NOT first) AS nb FROM type_pairs GROUP BY 1),
 h AS (SELECT pair, least(CAST(floor((value-lo)/((hi-lo)/50)) AS BIGINT),49) AS bin, count(*) FILTER (first) AS a, count(*) FILTER (NOT first) AS b FROM type_pairs JOIN r USING (pair) GROUP BY 1,2),
 f AS (SELECT r.pair, coalesce(a,0)/na/((hi-lo)/50)+1e-10 AS pa, coalesce(b,0)/nb/((hi-lo)/50)+1e-10 AS pb FROM (SELECT *, unnest(range(0,50)) AS bin FROM r) r LEFT JOIN h ON r.pair=h.pair AND r.bin=h.bin),
 p AS (SELECT pair, pa/sum(pa) OVER (PARTITION BY pair) AS p, pb/sum(pb) OVER (PARTITION BY pair) AS q FROM f)
SELECT pair, round(sqrt(sum(p*ln(p/((p+q)/2)))/2+sum(q*ln(q/((p+q)/2)))/2),6)+0.0 AS js_distance FROM p GROUP BY 1""")
def _(t):
    return rounded(quality.js_distance(type_pairs(t), ["pair"], "value", "first"))


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORR = "+".join(f"2*pow(coalesce(corr({x},{y}) FILTER (l_returnflag='R'),0)-coalesce(corr({x},{y}) FILTER (l_returnflag<>'R'),0),2)" for x, y in itertools.combinations(NUMS, 2))


@query("v8_correlation_similarity", f"SELECT l_linestatus, round(1-sqrt({CORR})/sqrt(32),6)+0.0 AS similarity FROM lineitem GROUP BY 1")
def _(t):
    rows = t.lineitem.withColumn("first", F.col("l_returnflag") == "R")
    return rounded(quality.correlation_similarity(rows, ["l_linestatus"], NUMS, "first"))


@query("v9_column_statistics", "SELECT l_shipmonth AS month, " + ", ".join(
    f"round({f}(l_extendedprice) FILTER ({c}),6)+0.0 AS {n}_{m}" for n, c in (("real", "l_returnflag='R'"), ("synth", "l_returnflag<>'R'"))
    for m, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM (SELECT *, strftime(l_shipdate,'%m') AS l_shipmonth FROM lineitem) GROUP BY 1")
def _(t):
    rows = t.lineitem.select(F.date_format("l_shipdate", "MM").alias("month"), "l_extendedprice", (F.col("l_returnflag") == "R").alias("first"))
    return rounded(quality.column_statistics(rows, ["month"], "l_extendedprice", "first"))


VCORR = "+".join(f"2*pow(coalesce(corr({x},{y}) FILTER (first),0)-coalesce(corr({x},{y}) FILTER (NOT first),0),2)" for x, y in itertools.combinations(["conversion_rate", "ctr", "avg_order_value"], 2))


@query("v10_quality_verdict", f"""WITH s AS (SELECT *, substr(study_id,7,1)='1' AS first FROM shop), l AS (SELECT first, unnest(['conversion_rate','ctr','avg_order_value']) AS c, unnest([conversion_rate, ctr, avg_order_value]) AS value FROM s),
 d AS (SELECT c, value, count(*) FILTER (first) AS a, count(*) FILTER (NOT first) AS b FROM l GROUP BY 1,2), n AS (SELECT c, sum(a) AS na, sum(b) AS nb FROM d GROUP BY 1),
 ks AS (SELECT avg(d) AS ks FROM (SELECT c, max(abs(ca/na-cb/nb)) AS d FROM (SELECT c, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM d WINDOW w AS (PARTITION BY c ORDER BY value)) JOIN n USING (c) GROUP BY 1)),
 r AS (SELECT c, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1),
 h AS (SELECT c, least(CAST(floor((value-lo)/((hi-lo)/50)) AS BIGINT),49) AS bin, count(*) FILTER (first) AS a, count(*) FILTER (NOT first) AS b FROM l JOIN r USING (c) GROUP BY 1,2),
 f AS (SELECT r.c, coalesce(a,0)/na/((hi-lo)/50)+1e-10 AS pa, coalesce(b,0)/nb/((hi-lo)/50)+1e-10 AS pb FROM (SELECT r.*, na, nb, unnest(range(0,50)) AS bin FROM r JOIN n USING (c)) r LEFT JOIN h ON r.c=h.c AND r.bin=h.bin),
 p AS (SELECT c, pa/sum(pa) OVER (PARTITION BY c) AS p, pb/sum(pb) OVER (PARTITION BY c) AS q FROM f), js AS (SELECT avg(x) AS js FROM (SELECT c, sqrt(sum(p*ln(p/((p+q)/2)))/2+sum(q*ln(q/((p+q)/2)))/2) AS x FROM p GROUP BY 1)),
 co AS (SELECT 1-sqrt({VCORR})/sqrt(18) AS similarity FROM s),
 v AS (SELECT CAST((min(conversion_rate)<0.01)::INT+(max(conversion_rate)>0.3)::INT+(min(avg_order_value)<10)::INT+(max(avg_order_value)>500)::INT+(min(ctr)<0.01)::INT+(max(ctr)>0.15)::INT+(min(ctr)<0)::INT AS BIGINT) AS violations FROM s WHERE NOT first)
SELECT round(ks,6) AS ks, round(js,6) AS js, round(similarity,6) AS similarity, violations, ks<0.1 AND js<0.3 AND similarity>0.8 AND violations=0 AS passes FROM ks, js, co, v""")
def _(t):
    s = shop(t).withColumn("first", F.substring("study_id", 7, 1) == "1")
    return rounded(quality.quality_verdict(s.select("first", "conversion_rate", "ctr", "avg_order_value"), ["conversion_rate", "ctr", "avg_order_value"], "first", "ecommerce"))
