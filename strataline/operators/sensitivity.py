"""Leave-one-out, influence and cumulative pooling, linear in the number of studies.

Every left-out study and every prefix has its own tau2, so the random-effects
sums  S(t) = sum 1/(v+t)  and  sum y/(v+t)  are needed at as many points t as
there are studies; joining studies with studies would be quadratic. S is an
analytic function of s = ln(t + v_min) in the strip |Im s| < pi, so it is
evaluated exactly to double precision from its values at Chebyshev points of
the range of s that a group needs. The number of points per group follows from
the length of that range (about 16 for narrow ranges), not from the group size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import norm_p, z_quantile
from . import meta
from .scale import running, settle

_DIGITS = 40.0  # natural-log size of the error reduction that is asked for


def _nodes(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Per group (t_lo, t_hi, v_min) the evaluation points: node, count, s-interval, t."""
    lo, hi = F.log(F.col("t_lo") + F.col("v_min")), F.log(F.col("t_hi") + F.col("v_min"))
    r = ranges.withColumns({"s_lo": lo, "s_hi": F.greatest(hi, lo + 1e-3)})
    b = 2 * math.pi / (F.col("s_hi") - F.col("s_lo"))
    rho = F.least(b + F.sqrt(b * b + 1), F.lit(100.0))
    r = r.withColumn("m", (F.ceil(_DIGITS / F.log(rho)) + 4).cast("int"))
    r = r.withColumn("node", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    x = F.cos((2 * F.col("node") + 1) * math.pi / (2 * F.col("m")))
    s = (F.col("s_lo") + F.col("s_hi")) / 2 + (F.col("s_hi") - F.col("s_lo")) / 2 * x
    return r.withColumn("t", F.exp(s) - F.col("v_min"))


def _share(t: Column) -> Column:
    """Barycentric weight of the node in the row for the value at ``t``."""
    angle = (2 * F.col("node") + 1) * math.pi / (2 * F.col("m"))
    x = (2 * F.log(t + F.col("v_min")) - F.col("s_lo") - F.col("s_hi")) / (F.col("s_hi") - F.col("s_lo"))
    gap = x - F.cos(angle)
    gap = F.when(F.abs(gap) < 1e-15, F.lit(1e-15)).otherwise(gap)
    return F.when(F.col("node") % 2 == 0, F.sin(angle)).otherwise(-F.sin(angle)) / gap


def _without(pooled: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the heterogeneity of their group without themselves."""
    g = pooled.filter(F.col("k") >= 3).select(*by, "k", "sw", "sw2", "swy", "swyy", "v_min",
                                              F.col("re_effect").alias("effect_all"), F.col("re_se").alias("se_all"),
                                              F.col("tau2").alias("tau2_all"), F.col("rw").alias("rw_all"))
    v = F.col("se") * F.col("se")
    j = rows.select(*by, "study_id", "effect", "se").join(g, by)
    left = j.select(*by, "study_id", F.col("effect").alias("y"), v.alias("v"), "v_min", F.col("k").alias("k_all"),
                    "effect_all", "se_all", "tau2_all", "rw_all",
                    (F.col("k") - 1).alias("k"), (F.col("sw") - 1 / v).alias("sw"), (F.col("sw2") - 1 / v / v).alias("sw2"),
                    (F.col("swy") - F.col("effect") / v).alias("swy"),
                    (F.col("swyy") - F.col("effect") * F.col("effect") / v).alias("swyy"))
    return meta.with_heterogeneity(left)


def leave_one_out(studies: DataFrame, pooled: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    """Random-effects result of each group without each of its studies (groups of three or more)."""
    rest = _without(pooled, studies, by)
    nodes = _nodes(rest.groupBy(*by, "v_min").agg(F.min("tau2").alias("t_lo"), F.max("tau2").alias("t_hi")), by)
    sums = studies.select(*by, "effect", "se").join(nodes.select(*by, "node", "t"), by).groupBy(*by, "node").agg(
        F.sum(1 / (F.col("se") * F.col("se") + F.col("t"))).alias("a"),
        F.sum(F.col("effect") / (F.col("se") * F.col("se") + F.col("t"))).alias("b"))
    table = nodes.join(sums, [*by, "node"]).groupBy(*by).agg(
        F.collect_list(F.struct("node", "m", "s_lo", "s_hi", "a", "b")).alias("table"))
    # The table has a bounded number of points per group, so each study reads it as an array.
    j = rest.join(table, by)
    span = F.col("table")[0]
    x = (2 * F.log(F.col("tau2") + F.col("v_min")) - span.s_lo - span.s_hi) / (span.s_hi - span.s_lo)
    j = j.withColumn("_x", x)

    def add(acc, p):
        angle = (2 * p.node + 1) * math.pi / (2 * p.m)
        gap = F.col("_x") - F.cos(angle)
        gap = F.when(F.abs(gap) < 1e-15, F.lit(1e-15)).otherwise(gap)
        c = F.when(p.node % 2 == 0, F.sin(angle)).otherwise(-F.sin(angle)) / gap
        return F.struct((acc.c + c).alias("c"), (acc.a + c * p.a).alias("a"), (acc.b + c * p.b).alias("b"))

    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    j = j.withColumn("_s", F.aggregate("table", zero, add))
    own = 1 / (F.col("v") + F.col("tau2"))
    j = j.withColumns({"rw": F.col("_s.a") / F.col("_s.c") - own, "rwy": F.col("_s.b") / F.col("_s.c") - own * F.col("y")})
    e, s = F.col("rwy") / F.col("rw"), 1 / F.sqrt(F.col("rw"))
    z = z_quantile(confidence)
    j = j.withColumns({"pooled_effect": e, "standard_error": s})
    e, s, base = F.col("pooled_effect"), F.col("standard_error"), F.col("effect_all")
    return j.select(*by, "study_id", "pooled_effect", "standard_error", (e - z * s).alias("ci_lower"), (e + z * s).alias("ci_upper"),
                    norm_p(e / s).alias("p_value"), (e - base).alias("effect_change"),
                    F.when(base != 0, F.abs((e - base) / base)).otherwise(0.0).alias("relative_change"),
                    (F.signum(e) != F.signum(base)).alias("direction_changed"), "i2")


def influence(studies: DataFrame, pooled: DataFrame, by: list[str], loo: DataFrame | None = None) -> DataFrame:
    """Leverage, residuals, DFBETAS and Cook's distance per study."""
    loo = leave_one_out(studies, pooled, by) if loo is None else loo
    g = pooled.filter(F.col("k") >= 3).select(*by, "k", "tau2", "rw", "re_effect", "re_se")
    j = studies.select(*by, "study_id", "effect", "se").join(g, by).join(
        loo.select(*by, "study_id", F.col("pooled_effect").alias("loo_effect")), [*by, "study_id"])
    v = F.col("se") * F.col("se") + F.col("tau2")
    j = j.withColumns({"leverage": 1 / v / F.col("rw"), "residual": F.col("effect") - F.col("re_effect")})
    rest = 1 - F.col("leverage")
    j = j.withColumns({
        "std_residual": F.when(rest * v > 0, F.col("residual") / F.sqrt(rest * v)).otherwise(0.0),
        "dfbetas": (F.col("re_effect") - F.col("loo_effect")) / F.col("re_se"),
        "cooks_distance": F.when(rest > 0, F.col("residual") * F.col("residual") * F.col("leverage")
                                 / (F.col("k") * F.col("re_se") * F.col("re_se") * rest * rest)).otherwise(0.0)})
    return j.select(*by, "study_id", "leverage", "residual", "std_residual", "dfbetas", "cooks_distance",
                    (F.abs(F.col("std_residual")) > 2).alias("is_outlier"),
                    ((F.abs(F.col("dfbetas")) > 2 / F.sqrt("k")) | (F.col("cooks_distance") > 4 / F.col("k"))).alias("is_influential"))


def cumulative(studies: DataFrame, by: list[str], when: str, confidence: float = 0.95) -> DataFrame:
    """Random-effects result of every time-ordered prefix with two or more studies."""
    dated = studies.filter(F.col(when).isNotNull())
    enough = dated.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"), F.min(F.col("se") * F.col("se")).alias("v_min"))
    dated = dated.join(enough.filter(F.col("_k") >= 3), by)
    v, y = F.col("se") * F.col("se"), F.col("effect")
    pre = running(dated.select(*by, "study_id", when, "effect", "se", "v_min"), by, [when, "study_id"], {
        "k": F.lit(1).cast("long"), "sw": 1 / v, "sw2": 1 / v / v, "swy": y / v, "swyy": y * y / v})
    pre = settle(meta.with_heterogeneity(pre).drop("sw", "sw2", "swy", "swyy"))
    usable = pre.filter(F.col("k") >= 2)
    nodes = _nodes(usable.groupBy(*by, "v_min").agg(F.min("tau2").alias("t_lo"), F.max("tau2").alias("t_hi")), by)
    spread = pre.select(*by, "study_id", when, "effect", "se", "k", "tau2").join(
        nodes.select(*by, "node", "m", "s_lo", "s_hi", "v_min", "t"), by)
    w = 1 / (F.col("se") * F.col("se") + F.col("t"))
    at = running(spread, [*by, "node"], [when, "study_id"], {"a": w, "b": w * F.col("effect")})
    c = _share(F.col("tau2"))
    res = at.filter(F.col("k") >= 2).groupBy(*by, "study_id", F.col(when).cast("string").alias("timestamp"), "k").agg(
        F.sum(c).alias("c"), F.sum(c * F.col("a")).alias("a"), F.sum(c * F.col("b")).alias("b"))
    res = res.withColumns({"pooled_effect": F.col("b") / F.col("a"), "_se": F.sqrt(F.col("c") / F.col("a"))})
    e, s, z = F.col("pooled_effect"), F.col("_se"), z_quantile(confidence)
    return res.select(*by, "study_id", "timestamp", F.col("k").alias("n_studies"), "pooled_effect",
                      (e - z * s).alias("ci_lower"), (e + z * s).alias("ci_upper"), norm_p(e / s).alias("p_value"))


def influential(loo: DataFrame, diag: DataFrame, pooled: DataFrame, by: list[str], threshold: float = 0.1) -> DataFrame:
    p_all = pooled.select(*by, norm_p(F.col("re_effect") / F.col("re_se")).alias("p_all"))
    j = loo.join(diag.select(*by, "study_id", "is_influential"), [*by, "study_id"]).join(p_all, by)
    hit = ((F.col("relative_change") > threshold) | F.col("direction_changed")
           | ((F.col("p_all") < 0.05) != (F.col("p_value") < 0.05)) | F.col("is_influential"))
    return j.filter(hit).select(*by, "study_id")


def robustness(loo: DataFrame, flagged: DataFrame, pooled: DataFrame, by: list[str], confidence: float = 0.95) -> DataFrame:
    z = z_quantile(confidence)
    g = pooled.select(*by, F.col("k").alias("n"), (F.col("re_effect") - z * F.col("re_se")).alias("lo"),
                      (F.col("re_effect") + z * F.col("re_se")).alias("hi"))
    many = flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("flagged"))
    facts = loo.join(g.select(*by, "lo", "hi"), by).groupBy(*by).agg(
        F.bool_or("direction_changed").alias("flips"),
        F.bool_or((F.col("ci_upper") < F.col("lo")) | (F.col("ci_lower") > F.col("hi"))).alias("apart"))
    j = g.join(many, by, "left").join(facts, by, "left").withColumn("flagged", F.coalesce("flagged", F.lit(0)))
    robust = ~((F.col("flagged") > F.col("n") * 0.3) | F.coalesce("flips", F.lit(False)) | F.coalesce("apart", F.lit(False)))
    return j.select(*by, "n", "flagged", F.coalesce("flips", F.lit(False)).alias("any_direction_change"), robust.alias("robust"))
