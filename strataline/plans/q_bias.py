"""Publication-bias and sensitivity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import norm_p_sql, t_p_sql, z_quantile
from ..operators import bias, meta, sensitivity
from ..operators.scale import settle
from .q_meta import rounded, sql6
from .registry import cte, query

Z = z_quantile()

cte("egger_tp", f"""
SELECT *, {t_p_sql('t_value', 'df')} AS p_value FROM (
SELECT brand, n, df, intercept, slope, sqrt(ssr/df*swxx/denom) AS se_intercept, intercept/sqrt(ssr/df*swxx/denom) AS t_value FROM (
 SELECT s.brand, n, n-2 AS df, intercept, slope, swxx, denom, sum((effect/se-intercept-slope/se)*(effect/se-intercept-slope/se)/variance) AS ssr
 FROM studies_tpch s JOIN (
  SELECT brand, n, swxx, denom, slope, (swy-slope*swx)/sw AS intercept FROM (
   SELECT *, (sw*swxy-swx*swy)/(sw*swxx-swx*swx) AS slope, sw*swxx-swx*swx AS denom FROM (
    SELECT brand, count(*) AS n, sum(1/variance) AS sw, sum(1/variance/se) AS swx, sum(effect/se/variance) AS swy,
     sum(effect/se/se/variance) AS swxy, sum(1/variance/variance) AS swxx FROM studies_tpch GROUP BY 1))) r ON s.brand=r.brand
 GROUP BY ALL))""")

EGGER = f"SELECT brand, n, df, {sql6('intercept', 'slope', 'se_intercept', 't_value', 'p_value')}, p_value<0.05 AS significant FROM egger_tp"


def brands(t):
    """Studies are read by many steps below, so they are written once."""
    s = t.studies_tpch
    return s, settle(meta.pool(s, ["brand"]))


@query("m14_eggers_test", EGGER)
def _(t):
    return rounded(bias.eggers_test(t.studies_tpch, ["brand"]))


cte("begg_tp", f"""
SELECT *, {norm_p_sql('z')} AS p FROM (SELECT *, tau/sqrt(2*(2*n+5)/(9.0*n*(n-1))) AS z FROM (
SELECT brand, n, sum(sign(a.r-b.r)*sign(a.v-b.v))/sqrt(sum(abs(sign(a.r-b.r)))*sum(abs(sign(a.v-b.v)))) AS tau FROM
 (SELECT brand, study_id, round((effect-m)/se, 12) AS r, round(variance, 12) AS v, n FROM studies_tpch JOIN (SELECT brand, sum(effect/variance)/sum(1/variance) AS m, count(*) AS n FROM studies_tpch GROUP BY 1) USING (brand)) a
 JOIN (SELECT brand, study_id, round((effect-m)/se, 12) AS r, round(variance, 12) AS v FROM studies_tpch JOIN (SELECT brand, sum(effect/variance)/sum(1/variance) AS m FROM studies_tpch GROUP BY 1) USING (brand)) b USING (brand)
WHERE a.study_id<b.study_id AND n>=5 GROUP BY brand, n))""")


@query("m15_beggs_test", f"SELECT brand, n, {sql6('tau', 'z AS z_value', 'p AS p_value')}, p<0.05 AS significant FROM begg_tp")
def _(t):
    return rounded(bias.beggs_test(t.studies_tpch, ["brand"]))


cte("fill_rows", """
SELECT s.brand, s.study_id, s.effect, s.se, s.variance, p.k, p.re_effect AS mu, s.effect-p.re_effect AS c,
 rank() OVER (PARTITION BY s.brand ORDER BY abs(s.effect-p.re_effect)) + (count(*) OVER (PARTITION BY s.brand, abs(s.effect-p.re_effect))-1)/2.0 AS rk,
 row_number() OVER (PARTITION BY s.brand ORDER BY abs(s.effect-p.re_effect) DESC, s.study_id) AS rd
FROM studies_tpch s JOIN pool_tp p USING (brand)""")
cte("fill_k0", """SELECT brand, k, mu, pos, greatest(0, CAST(trunc(4*s/k-(k+1)/2) AS BIGINT)) AS k0 FROM (
 SELECT brand, k, mu, count(*) FILTER (c>0)>count(*) FILTER (c<0) AS pos,
  CASE WHEN count(*) FILTER (c>0)>count(*) FILTER (c<0) THEN sum(rk) FILTER (c>0) ELSE sum(rk) FILTER (c<0) END AS s FROM fill_rows GROUP BY 1,2,3)""")
cte("fill_mirror", """SELECT r.brand, r.study_id, 2*r.mu-r.effect AS effect, r.se, r.variance FROM fill_rows r JOIN fill_k0 k USING (brand)
 WHERE rd<=k0 AND CASE WHEN pos THEN c>0 ELSE c<0 END""")
cte("fill_tp", """SELECT brand, k0, k.k AS original_n, k.k+k0 AS adjusted_n, count(*) FILTER (f=1) AS imputed, mu AS original_effect,
 CASE WHEN count(*) FILTER (f=1)>0 THEN sum(effect/variance)/sum(1/variance) ELSE mu END AS adjusted_effect FROM fill_k0 k JOIN (
 SELECT brand, effect, variance, 0 AS f FROM studies_tpch UNION ALL SELECT brand, effect, variance, 1 FROM fill_mirror) a USING (brand) GROUP BY brand, k0, k.k, mu""")


@query("m16_trim_and_fill", f"""SELECT brand, k0, original_n, adjusted_n, imputed, {sql6('original_effect', 'adjusted_effect',
 'abs(adjusted_effect-original_effect) AS effect_change', 'abs(adjusted_effect-original_effect)/abs(original_effect)*100 AS percent_change')} FROM fill_tp""")
def _(t):
    s, p = brands(t)
    return rounded(bias.trim_and_fill(s, p, ["brand"])[0])


@query("m16_imputed_rows", f"SELECT brand, study_id, {sql6('effect', 'se')} FROM fill_mirror")
def _(t):
    s, p = brands(t)
    return rounded(bias.trim_and_fill(s, p, ["brand"])[1])


FAILSAFE = f"SELECT brand, k, greatest(0, CAST(trunc(pow(re_effect/re_se*sqrt(k)/{Z!r},2)-k) AS BIGINT)) AS failsafe FROM pool_tp"


@query("m17_failsafe_n", FAILSAFE)
def _(t):
    return bias.failsafe_n(brands(t)[1], ["brand"])


cte("severity_tp", """SELECT *, points>1 AS detected, CASE WHEN points=0 THEN 'none' WHEN points<=1 THEN 'possible' WHEN points<=3 THEN 'likely' ELSE 'severe' END AS severity FROM (
 SELECT brand, e.p_value AS egger_p, f.k0, f.adjusted_effect, f.original_effect, CAST(
  CASE WHEN e.p_value<0.05 THEN 2 WHEN e.p_value<0.1 THEN 1 ELSE 0 END + CASE WHEN b.p<0.05 THEN 1 ELSE 0 END
  + CASE WHEN k0>original_n*0.3 THEN 2 WHEN k0>0 THEN 1 ELSE 0 END
  + CASE WHEN abs(adjusted_effect-original_effect)/abs(original_effect)*100>20 THEN 1 ELSE 0 END AS BIGINT) AS points
 FROM egger_tp e LEFT JOIN begg_tp b USING (brand) JOIN fill_tp f USING (brand))""")


@query("m18_bias_severity", f"SELECT brand, {sql6('egger_p', 'adjusted_effect', 'original_effect')}, k0, points, detected, severity FROM severity_tp")
def _(t):
    s, p = brands(t)
    return rounded(bias.bias_severity(s, p, ["brand"]))


def loo_cte(name, src, pool, key):
    cte(name, f"""
SELECT *, e-re_effect AS effect_change, abs((e-re_effect)/re_effect) AS relative_change, sign(e)<>sign(re_effect) AS direction_changed, {norm_p_sql('(e/s)')} AS p_value,
 e-{Z!r}*s AS ci_lower, e+{Z!r}*s AS ci_upper FROM (
SELECT t.{key}, t.out_id AS study_id, t.i2, p.re_effect, p.re_se, sum(b.effect/(b.variance+t.tau2))/sum(1/(b.variance+t.tau2)) AS e, 1/sqrt(sum(1/(b.variance+t.tau2))) AS s
FROM (SELECT {key}, out_id, CASE WHEN q>0 THEN greatest(0,(q-(k-1))/q*100) ELSE 0 END AS i2, greatest(0,(q-(k-1))/(sw-sw2/sw)) AS tau2 FROM (
  SELECT a.{key}, a.study_id AS out_id, count(*) AS k, sum(1/b.variance) AS sw, sum(1/b.variance/b.variance) AS sw2,
   sum(b.effect*b.effect/b.variance)-sum(b.effect/b.variance)*sum(b.effect/b.variance)/sum(1/b.variance) AS q
  FROM {src} a JOIN {src} b ON a.{key}=b.{key} AND a.study_id<>b.study_id GROUP BY 1,2)) t
JOIN {src} b ON t.{key}=b.{key} AND t.out_id<>b.study_id JOIN {pool} p ON p.{key}=t.{key} AND p.k>=3 GROUP BY ALL)""")


loo_cte("loo_ev", "studies_events", "pool_ev", "metric")
loo_cte("loo_tp", "studies_tpch", "pool_tp", "brand")
LOO_COLS = sql6('e AS pooled_effect', 's AS standard_error', 'ci_lower', 'ci_upper', 'p_value', 'effect_change', 'relative_change', 'i2')


@query("m19_leave_one_out", f"SELECT metric, study_id, {LOO_COLS}, direction_changed FROM loo_ev")
def _(t):
    s = t.studies_events
    return rounded(sensitivity.leave_one_out(s, meta.pool(s, ["metric"]), ["metric"]))


@query("m19_leave_one_out_brands", f"SELECT brand, study_id, {LOO_COLS}, direction_changed FROM loo_tp")
def _(t):
    s, p = brands(t)
    return rounded(sensitivity.leave_one_out(s, p, ["brand"]))


cte("influence_ev", """SELECT *, abs(std_residual)>2 AS is_outlier, abs(dfbetas)>2/sqrt(k) OR cooks_distance>4/k AS is_influential FROM (
 SELECT metric, study_id, k, h AS leverage, r AS residual, r/sqrt((1-h)*v) AS std_residual, (re_effect-e)/re_se AS dfbetas, r*r*h/(k*re_se*re_se*(1-h)*(1-h)) AS cooks_distance FROM (
 SELECT s.metric, s.study_id, p.k::DOUBLE AS k, p.re_effect, p.re_se, l.e, s.variance+p.tau2 AS v, 1/(s.variance+p.tau2)/p.rw AS h, s.effect-p.re_effect AS r
 FROM studies_events s JOIN pool_ev p USING (metric) JOIN loo_ev l USING (metric, study_id)))""")


@query("m20_influence", f"SELECT metric, study_id, {sql6('leverage', 'residual', 'std_residual', 'dfbetas', 'cooks_distance')}, is_outlier, is_influential FROM influence_ev")
def _(t):
    s = t.studies_events
    return rounded(sensitivity.influence(s, meta.pool(s, ["metric"]), ["metric"]))


cte("cumulative_ev", f"""
SELECT *, {norm_p_sql('(e/s)')} AS p_value FROM (
SELECT t.metric, t.study_id, t.day, t.k, sum(b.effect/(b.variance+t.tau2))/sum(1/(b.variance+t.tau2)) AS e, 1/sqrt(sum(1/(b.variance+t.tau2))) AS s
FROM (SELECT metric, study_id, day, k, greatest(0,(q-(k-1))/(sw-sw2/sw)) AS tau2 FROM (
  SELECT a.metric, a.study_id, a.day, count(*) AS k, sum(1/b.variance) AS sw, sum(1/b.variance/b.variance) AS sw2,
   sum(b.effect*b.effect/b.variance)-sum(b.effect/b.variance)*sum(b.effect/b.variance)/sum(1/b.variance) AS q
  FROM studies_events a JOIN studies_events b ON a.metric=b.metric AND b.day<=a.day GROUP BY 1,2,3) WHERE k>=2) t
JOIN studies_events b ON t.metric=b.metric AND b.day<=t.day GROUP BY ALL)""")


@query("m21_cumulative", f"""SELECT metric, study_id, strftime(day,'%Y-%m-%d') AS timestamp, k AS n_studies, {sql6('e AS pooled_effect',
 f'e-{Z!r}*s AS ci_lower', f'e+{Z!r}*s AS ci_upper', 'p_value')} FROM cumulative_ev""")
def _(t):
    return rounded(sensitivity.cumulative(t.studies_events, ["metric"], "day"))


cte("influential_ev", f"""SELECT l.metric, l.study_id FROM loo_ev l JOIN influence_ev i USING (metric, study_id)
 WHERE relative_change>0.1 OR direction_changed OR (({norm_p_sql('(re_effect/re_se)')}<0.05)<>(p_value<0.05)) OR is_influential""")


def sensitivity_parts(t):
    s, by = t.studies_events, ["metric"]
    p = meta.pool(s, by)
    loo = settle(sensitivity.leave_one_out(s, p, by))
    return p, loo, sensitivity.influential(loo, sensitivity.influence(s, p, by, loo), p, by)


@query("m22_influential_studies", "SELECT metric, study_id FROM influential_ev")
def _(t):
    return sensitivity_parts(t)[2]


cte("robust_ev", f"""SELECT p.metric, p.k AS n, coalesce(f.flagged,0) AS flagged, x.flips AS any_direction_change,
 NOT (coalesce(f.flagged,0)>p.k*0.3 OR x.flips OR x.apart) AS robust
 FROM pool_ev p LEFT JOIN (SELECT metric, count(*) AS flagged FROM influential_ev GROUP BY 1) f USING (metric)
 JOIN (SELECT metric, bool_or(direction_changed) AS flips, bool_or(ci_upper<re_effect-{Z!r}*re_se OR ci_lower>re_effect+{Z!r}*re_se) AS apart FROM loo_ev GROUP BY 1) x USING (metric)""")


@query("m23_robustness", "SELECT * FROM robust_ev")
def _(t):
    p, loo, flagged = sensitivity_parts(t)
    return sensitivity.robustness(loo, flagged, p, ["metric"])
