"""Pooling of studies per group. Input columns: study_id, effect, se plus the grouping keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf, norm_p, t_p, t_quantile, z_quantile


def heterogeneity(studies: DataFrame, by: list[str]) -> DataFrame:
    """Q, I2, tau2 and the fixed-effect sums in one aggregation per group.

    Q is taken from weighted moments in the same pass, so no row is joined back
    to its group; the effects are log odds near zero, where that loses nothing.
    """
    v = F.col("se") * F.col("se")
    w = 1 / v
    y = F.col("effect")
    sums = studies.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"),
        F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"), F.min(v).alias("v_min"))
    return with_heterogeneity(sums)


def with_heterogeneity(sums: DataFrame) -> DataFrame:
    """Derive the heterogeneity columns from k, sw, sw2, swy, swyy."""
    out = sums.withColumn("q", F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")))
    out = out.withColumn("df", F.col("k") - 1)
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    excess = F.col("q") - F.col("df")
    return out.withColumns({
        "i2": F.when(F.col("q") > 0, F.greatest(F.lit(0.0), excess / F.col("q") * 100)).otherwise(F.lit(0.0)),
        "tau2": F.when(c > 0, F.greatest(F.lit(0.0), excess / c)).otherwise(F.lit(0.0)),
        "h2": F.when(F.col("df") > 0, F.col("q") / F.col("df")).otherwise(F.lit(1.0)),
    })


def pool(studies: DataFrame, by: list[str]) -> DataFrame:
    """Fixed-effect and random-effects (DerSimonian-Laird) pooling, one row per group.

    The per-group sums are joined back once, because the random-effects weights
    need tau2; groups are few next to studies, so the join is left to AQE
    (broadcast when small, skew-split otherwise).
    """
    het = heterogeneity(studies, by)
    w = 1 / (F.col("se") * F.col("se") + F.col("tau2"))
    y = F.col("effect")
    re = studies.select(*by, "effect", "se").join(het.select(*by, "tau2"), by).groupBy(*by).agg(
        F.sum(w).alias("rw"), F.sum(w * y).alias("rwy"), F.sum(w * y * y).alias("rwyy"))
    return het.join(re, by).withColumns({
        "fe_effect": F.col("swy") / F.col("sw"), "fe_se": 1 / F.sqrt(F.col("sw")),
        "re_effect": F.col("rwy") / F.col("rw"), "re_se": 1 / F.sqrt(F.col("rw")),
    })


def interval(effect: Column, se: Column, crit) -> dict[str, Column]:
    return {"ci_lower": effect - crit * se, "ci_upper": effect + crit * se}


def _normal_result(p: DataFrame, by, effect: str, se: str, confidence: float) -> DataFrame:
    e, s = F.col(effect), F.col(se)
    z = e / s
    return p.select(*by, "k", e.alias("pooled_effect"), s.alias("standard_error"),
                    *[c.alias(n) for n, c in interval(e, s, z_quantile(confidence)).items()],
                    z.alias("z_value"), norm_p(z).alias("p_value"), "q", "i2", "tau2")


def fixed_effects(pooled: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    return _normal_result(pooled, by, "fe_effect", "fe_se", confidence)


def random_effects(pooled: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    return _normal_result(pooled, by, "re_effect", "re_se", confidence)


def hartung_knapp(pooled: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """t interval with the variance factor of normalised weights, never below one."""
    p = pooled.filter(F.col("k") >= 2)
    spread = (F.col("rwyy") - F.col("rwy") * F.col("rwy") / F.col("rw")) / F.col("rw")
    q = F.greatest(F.lit(1.0), spread / (F.col("k") - 1))
    p = p.withColumn("hk_se", F.col("re_se") * F.sqrt(q)).withColumn("t_value", F.col("re_effect") / F.col("hk_se"))
    crit = t_quantile(F.col("k") - 1, confidence)
    return p.select(*by, "k", F.col("re_effect").alias("pooled_effect"), F.col("hk_se").alias("standard_error"),
                    *[c.alias(n) for n, c in interval(F.col("re_effect"), F.col("hk_se"), crit).items()],
                    "t_value", t_p(F.col("t_value"), F.col("k") - 1).alias("p_value"))


def study_weights(studies: DataFrame, pooled: DataFrame, by: list[str], model: str = "random") -> DataFrame:
    """Share of each study in the pooled estimate, in percent."""
    tau2 = F.col("tau2") if model == "random" else F.lit(0.0)
    total = F.col("rw") if model == "random" else F.col("sw")
    return studies.join(pooled.select(*by, "tau2", "rw", "sw"), by).withColumn(
        "weight_pct", 100 / (F.col("se") * F.col("se") + tau2) / total).drop("tau2", "rw", "sw")


def auto_model(pooled: DataFrame, by: list[str], threshold: float = 0.25, confidence: float = 0.95) -> DataFrame:
    """Random effects where I2 exceeds the threshold, fixed effects elsewhere."""
    heavy = F.col("i2") > threshold * 100
    p = pooled.filter(F.col("k") >= 2).withColumns({
        "model": F.when(heavy, "random").otherwise("fixed"),
        "_e": F.when(heavy, F.col("re_effect")).otherwise(F.col("fe_effect")),
        "_s": F.when(heavy, F.col("re_se")).otherwise(F.col("fe_se"))})
    out = _normal_result(p, [*by, "model"], "_e", "_s", confidence)
    return out


def with_direction(result: DataFrame, alpha: float = 0.05) -> DataFrame:
    return result.withColumns({
        "significant": F.col("p_value") < alpha,
        "direction": F.when(F.col("pooled_effect") > 0, "positive")
        .when(F.col("pooled_effect") < 0, "negative").otherwise("none")})


def prediction_interval(pooled: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    sd = F.sqrt(F.col("re_se") * F.col("re_se") + F.col("tau2"))
    crit = F.when(F.col("k") > 2, t_quantile(F.col("k") - 2, confidence)).otherwise(F.lit(z_quantile(confidence)))
    return pooled.select(*by, "k", (F.col("re_effect") - crit * sd).alias("pi_lower"),
                         (F.col("re_effect") + crit * sd).alias("pi_upper"))


# Texts of the model comparison, by heterogeneity band.
COMPARISON_TEXT = [
    (25, "Low heterogeneity suggests homogeneous effects. Fixed effects model is appropriate."),
    (50, "Moderate heterogeneity detected. Consider random effects model for generalizability."),
    (75, "Substantial heterogeneity indicates varying true effects. Random effects model recommended. Explore sources of heterogeneity."),
    (None, "High heterogeneity suggests very different true effects across studies. Consider subgroup analysis or meta-regression."),
]


def compare_models(pooled: DataFrame, by: list[str]) -> DataFrame:
    diff = F.abs(F.col("fe_effect") - F.col("re_effect"))
    text = F.when(F.lit(False), "")
    for limit, words in COMPARISON_TEXT:
        text = text.when(F.col("i2") < limit, words) if limit else text.otherwise(words)
    tail = F.when(diff > 0.1, F.format_string("Models differ by %.3f - model choice matters.", diff)).otherwise(
        "Models give similar estimates.")
    return pooled.select(
        *by, "k", "fe_effect", "fe_se", "re_effect", "re_se", diff.alias("difference"),
        F.when(F.col("i2") > 25, "random").otherwise("fixed").alias("recommended"),
        F.concat_ws(" ", text, tail).alias("interpretation"))


def stratified(studies: DataFrame, by: list[str], stratum: str, confidence: float = 0.95) -> DataFrame:
    """Random-effects pooling per stratum with at least two studies."""
    p = pool(studies, [*by, stratum]).filter(F.col("k") >= 2)
    return random_effects(p, [*by, stratum], confidence)


def subgroup_difference(strata: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Between-subgroup Q over pooled strata."""
    w = 1 / (F.col("standard_error") * F.col("standard_error"))
    y = F.col("pooled_effect")
    s = strata.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.sum(w).alias("sw"), F.sum(w * y).alias("swy"),
                                F.sum(w * y * y).alias("swyy")).filter(F.col("groups") >= 2)
    s = s.withColumn("q_between", F.greatest(F.lit(0.0), F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")))
    s = s.withColumn("df", F.col("groups") - 1).withColumn("p_value", chi2_sf(F.col("q_between"), F.col("df")))
    return s.select(*by, "groups", "q_between", "df", "p_value", (F.col("p_value") < alpha).alias("significant"))


def reversals(overall: DataFrame, strata: DataFrame, by: list[str], stratum: str) -> DataFrame:
    """Strata whose pooled sign is opposite to the overall sign."""
    o = overall.select(*by, F.col("re_effect").alias("overall_effect"))
    j = strata.select(*by, stratum, F.col("pooled_effect").alias("subgroup_effect")).join(o, by)
    return j.filter(F.signum("subgroup_effect") * F.signum("overall_effect") < 0).withColumn(
        "reversal_magnitude", F.abs(F.col("subgroup_effect")) + F.abs(F.col("overall_effect")))


def meta_regression(studies: DataFrame, by: list[str], covariate: str, alpha: float = 0.05) -> DataFrame:
    """Inverse-variance weighted line of effect on one covariate."""
    w, x, y = 1 / (F.col("se") * F.col("se")), F.col(covariate).cast("double"), F.col("effect")
    s = studies.filter(x.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * y).alias("swy"),
        F.sum(w * x * y).alias("swxy"), F.sum(w * x * x).alias("swxx"), F.sum(w * y * y).alias("swyy"))
    s = s.withColumn("denom", F.col("sw") * F.col("swxx") - F.col("swx") * F.col("swx"))
    s = s.withColumn("success", (F.col("n") >= 3) & (F.abs(F.col("denom")) >= 1e-10))
    ok = F.col("success")
    s = s.withColumn("slope", F.when(ok, (F.col("sw") * F.col("swxy") - F.col("swx") * F.col("swy")) / F.col("denom")))
    s = s.withColumn("intercept", F.when(ok, (F.col("swy") - F.col("slope") * F.col("swx")) / F.col("sw")))
    s = s.withColumn("ss_tot", F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw"))
    s = s.withColumn("ss_res", F.greatest(F.lit(0.0), F.col("ss_tot") - F.col("slope") * F.col("slope") * F.col("denom") / F.col("sw")))
    s = s.withColumn("se_slope", F.sqrt(F.col("ss_res") / (F.col("n") - 2) * F.col("sw") / F.col("denom")))
    s = s.withColumn("t_value", F.when(F.col("se_slope") > 0, F.col("slope") / F.col("se_slope")).when(ok, F.lit(0.0)))
    s = s.withColumn("p_value", F.when(ok, t_p(F.col("t_value"), F.col("n") - 2)))
    s = s.withColumn("r_squared", F.when(ok, F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(0.0)))
    return s.select(*by, "n", "success", "slope", "intercept", "se_slope", "t_value", "p_value", "r_squared",
                    (F.col("p_value") < alpha).alias("significant"))
