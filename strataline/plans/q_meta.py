"""Pooling queries: metrics of the event experiments, brands of the return experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import chi2_sf, chi2_sf_sql, norm_p_sql, t_p_sql, t_quantile_sql, z_quantile
from ..operators import meta
from .registry import query
from .relations import r6

BY = ["metric"]
Z = z_quantile()


def sql6(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]},6)+0.0 AS {n.split(' AS ')[-1]}" for n in names)


def pooled(t):
    return meta.pool(t.studies_events, BY)


@query("m1_heterogeneity", f"""
SELECT metric, k, df, {sql6('q', 'i2', 'tau2', 'sqrt(tau2) AS tau', 'h2', chi2_sf_sql('q', 'df') + ' AS q_p')} FROM pool_ev""")
def _(t):
    h = meta.heterogeneity(t.studies_events, BY)
    return h.select("metric", "k", "df", r6("q"), r6("i2"), r6("tau2"), r6(F.sqrt("tau2"), "tau"), r6("h2"),
                    r6(chi2_sf(F.col("q"), F.col("df")), "q_p"))


@query("m1_heterogeneity_brands", f"SELECT brand, k, df, {sql6('q', 'i2', 'tau2')} FROM pool_tp")
def _(t):
    return meta.heterogeneity(t.studies_tpch, ["brand"]).select("brand", "k", "df", r6("q"), r6("i2"), r6("tau2"))


def normal_sql(effect: str, se: str, src: str = "pool_ev", key: str = "metric") -> str:
    return f"""SELECT {key}, k, {sql6(f'{effect} AS pooled_effect', f'{se} AS standard_error',
        f'{effect}-{Z!r}*{se} AS ci_lower', f'{effect}+{Z!r}*{se} AS ci_upper', f'{effect}/{se} AS z_value',
        norm_p_sql(f'({effect}/{se})') + ' AS p_value', 'q', 'i2', 'tau2')} FROM {src}"""


def rounded(df, keep=()):
    skip = {"k", *keep}
    return df.select(*[r6(c) if dt == "double" and c not in skip else F.col(c) for c, dt in df.dtypes])


@query("m2_fixed_effects", normal_sql("fe_effect", "fe_se"))
def _(t):
    return rounded(meta.fixed_effects(pooled(t), BY))


@query("m2_fixed_weights", """SELECT s.metric, s.study_id, round(100/s.variance/p.sw,6)+0.0 AS weight_pct
FROM studies_events s JOIN pool_ev p USING (metric)""")
def _(t):
    w = meta.study_weights(t.studies_events, pooled(t), BY, "fixed")
    return w.select("metric", "study_id", r6("weight_pct"))


@query("m3_random_effects", normal_sql("re_effect", "re_se"))
def _(t):
    return rounded(meta.random_effects(pooled(t), BY))


@query("m3_random_effects_brands", normal_sql("re_effect", "re_se", "pool_tp", "brand"))
def _(t):
    return rounded(meta.random_effects(meta.pool(t.studies_tpch, ["brand"]), ["brand"]))


@query("m3_random_weights", """SELECT s.metric, s.study_id, round(100/(s.variance+p.tau2)/p.rw,6)+0.0 AS weight_pct
FROM studies_events s JOIN pool_ev p USING (metric)""")
def _(t):
    w = meta.study_weights(t.studies_events, pooled(t), BY)
    return w.select("metric", "study_id", r6("weight_pct"))


@query("m4_hartung_knapp", f"""
SELECT metric, k, {sql6('re_effect AS pooled_effect', 'hk_se AS standard_error', f're_effect-{t_quantile_sql("df")}*hk_se AS ci_lower',
 f're_effect+{t_quantile_sql("df")}*hk_se AS ci_upper', 't_value', t_p_sql('t_value', 'df') + ' AS p_value')} FROM (
 SELECT *, re_effect/hk_se AS t_value FROM (
 SELECT p.metric, p.k, p.df, p.re_effect, p.re_se*sqrt(greatest(1.0, sum((s.effect-p.re_effect)*(s.effect-p.re_effect)/(s.variance+p.tau2)/p.rw)/p.df)) AS hk_se
 FROM pool_ev p JOIN studies_events s USING (metric) GROUP BY p.metric,p.k,p.df,p.re_effect,p.re_se))""")
def _(t):
    return rounded(meta.hartung_knapp(pooled(t), BY))


AUTO = "(SELECT *, CASE WHEN i2>25 THEN re_effect ELSE fe_effect END AS e, CASE WHEN i2>25 THEN re_se ELSE fe_se END AS s FROM pool_ev)"


@query("m5_auto_model", normal_sql("e", "s", AUTO).replace("SELECT metric,", "SELECT metric, CASE WHEN i2>25 THEN 'random' ELSE 'fixed' END AS model,", 1))
def _(t):
    return rounded(meta.auto_model(pooled(t), BY))


@query("m6_direction_flags", f"""SELECT brand, {norm_p_sql('(re_effect/re_se)')} < 0.05 AS significant,
 CASE WHEN re_effect>0 THEN 'positive' WHEN re_effect<0 THEN 'negative' ELSE 'none' END AS direction FROM pool_tp""")
def _(t):
    r = meta.random_effects(meta.pool(t.studies_tpch, ["brand"]), ["brand"])
    return meta.with_direction(r).select("brand", "significant", "direction")


PI_SQL = f"""SELECT metric, k, {sql6(f're_effect-{t_quantile_sql("(k-2)")}*sqrt(re_se*re_se+tau2) AS pi_lower',
 f're_effect+{t_quantile_sql("(k-2)")}*sqrt(re_se*re_se+tau2) AS pi_upper')} FROM pool_ev"""


@query("m7_prediction_interval", PI_SQL)
def _(t):
    return rounded(meta.prediction_interval(pooled(t), BY))


TEXT_CASE = "CASE " + " ".join(
    (f"WHEN i2<{lim} THEN '{w}'" if lim else f"ELSE '{w}'") for lim, w in meta.COMPARISON_TEXT) + " END"
COMPARE_SQL = f"""SELECT brand, k, {sql6('fe_effect', 'fe_se', 're_effect', 're_se', 'abs(fe_effect-re_effect) AS difference')},
 CASE WHEN i2>25 THEN 'random' ELSE 'fixed' END AS recommended, {TEXT_CASE}||' '||
 CASE WHEN abs(fe_effect-re_effect)>0.1 THEN printf('Models differ by %.3f - model choice matters.', abs(fe_effect-re_effect))
 ELSE 'Models give similar estimates.' END AS interpretation FROM pool_tp"""


@query("m8_compare_models", COMPARE_SQL)
def _(t):
    return rounded(meta.compare_models(meta.pool(t.studies_tpch, ["brand"]), ["brand"]))


@query("m9_analysis_row", f"""SELECT r.*, c.recommended, c.difference, p.pi_lower, p.pi_upper FROM ({normal_sql('re_effect', 're_se')}) r
 JOIN ({COMPARE_SQL.replace('brand', 'metric').replace('pool_tp', 'pool_ev')}) c USING (metric) JOIN ({PI_SQL}) p USING (metric)""")
def _(t):
    p = pooled(t)
    out = meta.random_effects(p, BY).join(meta.compare_models(p, BY).select("metric", "recommended", "difference"), "metric")
    return rounded(out.join(meta.prediction_interval(p, BY).drop("k"), "metric"))


STRATA_SQL = normal_sql("re_effect", "re_se", "pool_seg WHERE k>=2", "metric, segment")


@query("m10_stratified", STRATA_SQL)
def _(t):
    return rounded(meta.stratified(t.studies_events, BY, "segment"))


@query("m11_subgroup_difference", f"""
SELECT metric, groups, {sql6('q AS q_between')}, df, {sql6(chi2_sf_sql('q', 'df') + ' AS p_value')}, {chi2_sf_sql('q', 'df')} < 0.05 AS significant FROM (
SELECT metric, m.groups, m.groups-1 AS df, sum((re_effect-m.mu)*(re_effect-m.mu)/re_se/re_se) AS q FROM pool_seg JOIN (
 SELECT metric, count(*) AS groups, sum(re_effect/re_se/re_se)/sum(1/re_se/re_se) AS mu FROM pool_seg WHERE k>=2 GROUP BY metric) m USING (metric)
 WHERE k>=2 GROUP BY metric, m.groups)""")
def _(t):
    return rounded(meta.subgroup_difference(meta.stratified(t.studies_events, BY, "segment"), BY))


@query("m12_reversals", f"""SELECT s.metric, s.segment, {sql6('s.re_effect AS subgroup_effect', 'o.re_effect AS overall_effect',
 'abs(s.re_effect)+abs(o.re_effect) AS reversal_magnitude')} FROM pool_seg s JOIN pool_ev o USING (metric)
 WHERE s.k>=2 AND sign(s.re_effect)*sign(o.re_effect)<0""")
def _(t):
    s = t.studies_events
    return rounded(meta.reversals(meta.pool(s, BY), meta.stratified(s, BY, "segment"), BY, "segment"))


@query("m13_meta_regression", f"""
WITH s AS (SELECT metric, effect AS y, 1/variance AS w, covariate::DOUBLE AS x FROM studies_events),
 m AS (SELECT metric, count(*) AS n, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM s GROUP BY 1),
 c AS (SELECT metric, n, mx, my, sum(w*(x-mx)*(y-my))/sum(w*(x-mx)*(x-mx)) AS slope, sum(w*(x-mx)*(x-mx)) AS sxx,
  sum(w*(y-my)*(y-my)) AS ss_tot FROM s JOIN m USING (metric) GROUP BY 1,2,3,4),
 e AS (SELECT metric, n, n-2 AS df, slope, my-slope*mx AS intercept, sxx, ss_tot, sum(w*(y-my-slope*(x-mx))*(y-my-slope*(x-mx))) AS ss_res
  FROM s JOIN c USING (metric) GROUP BY ALL),
 f AS (SELECT *, sqrt(ss_res/df/sxx) AS se_slope, slope/sqrt(ss_res/df/sxx) AS t_value FROM e),
 g AS (SELECT *, {t_p_sql('t_value', 'df')} AS p_value FROM f)
SELECT metric, n, true AS success, {sql6('slope', 'intercept', 'se_slope', 't_value', 'p_value', '1-ss_res/ss_tot AS r_squared')}, p_value<0.05 AS significant FROM g""")
def _(t):
    return rounded(meta.meta_regression(t.studies_events, BY, "covariate"))
