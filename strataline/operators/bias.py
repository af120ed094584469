"""Publication-bias tests per group of studies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import norm_p, t_p, z_quantile
from .scale import numbered, running, settle, value_runs


def eggers_test(studies: DataFrame, by: list[str], alpha: float = 0.05, weighted: bool = True) -> DataFrame:
    """Regression of effect/se on 1/se.

    ``weighted`` keeps the squared-precision weights on top of the already
    standardised variables; without it the classic unweighted line is fitted.
    """
    x = 1 / F.col("se")
    y = F.col("effect") / F.col("se")
    w = x * x if weighted else F.lit(1.0)
    s = studies.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * y).alias("swy"),
        F.sum(w * x * y).alias("swxy"), F.sum(w * x * x).alias("swxx"), F.sum(w * y * y).alias("swyy"))
    c = F.col
    s = s.withColumn("denom", c("sw") * c("swxx") - c("swx") * c("swx")).withColumn("ok", F.abs(c("denom")) >= 1e-10)
    s = s.withColumn("slope", F.when(c("ok"), (c("sw") * c("swxy") - c("swx") * c("swy")) / c("denom")).otherwise(0.0))
    s = s.withColumn("intercept", F.when(c("ok"), (c("swy") - c("slope") * c("swx")) / c("sw")).otherwise(0.0))
    ss_tot = c("swyy") - c("swy") * c("swy") / c("sw")
    s = s.withColumn("ss_res", F.greatest(F.lit(0.0), ss_tot - c("slope") * c("slope") * c("denom") / c("sw")))
    mse = F.when(c("n") > 2, c("ss_res") / (c("n") - 2)).otherwise(0.0)
    s = s.withColumn("se_intercept", F.when(c("ok"), F.sqrt(mse * c("swxx") / c("denom"))).otherwise(float("inf")))
    s = s.withColumn("t_value", F.when(c("ok") & (c("se_intercept") > 0), c("intercept") / c("se_intercept")).otherwise(0.0))
    s = s.withColumn("df", c("n") - 2)
    s = s.withColumn("p_value", F.when(c("ok") & (c("df") > 0), t_p(c("t_value"), c("df"))).otherwise(1.0))
    return s.select(*by, "n", "intercept", "slope", "se_intercept", "t_value", "df", "p_value",
                    (c("ok") & (c("p_value") < alpha)).alias("significant"))


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Kendall tau-b per group without forming pairs.

    Rows are put in x order and y is replaced by its rank. Two rows are
    discordant exactly at the highest bit in which their ranks differ, so per
    bit level the ones seen before each zero inside a shared prefix are counted
    with running sums: n log n rows instead of n squared pairs.
    """
    pts = df.groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("m"))
    pts = settle(pts)
    ranks = running(pts.groupBy(*by, "_y").agg(F.sum("m").alias("cy")), by, ["_y"], {"ry": F.lit(1).cast("long")})
    size = pts.groupBy(*by).agg(F.sum("m").alias("n"), F.max("m").alias("_mx"))
    levels = ranks.groupBy(*by).agg(F.max("ry").alias("_top"))
    pts = settle(pts.join(ranks, [*by, "_y"]).join(levels, by))
    bits = F.sequence(F.lit(0), F.ceil(F.log2(F.col("_top") + 1)).cast("int"))
    bitted = pts.withColumn("_b", F.explode(bits)).withColumns({
        "_one": F.expr("(shiftright(ry, _b) & 1) = 1"), "_pre": F.expr("shiftright(ry, _b + 1)")})
    # Order by x then rank: rows tied on x never count against each other.
    seen = running(bitted, [*by, "_b", "_pre"], ["_x", "ry"],
                   {"ones": F.when(F.col("_one"), F.col("m")).otherwise(0)})
    disc = seen.groupBy(*by).agg(F.sum(F.when(~F.col("_one"), F.col("ones") * F.col("m")).otherwise(0)).alias("disc"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    tx = pts.groupBy(*by, "_x").agg(F.sum("m").alias("c")).groupBy(*by).agg(pairs("c").alias("tx"))
    ty = pts.groupBy(*by, "_y").agg(F.first("cy").alias("cy")).groupBy(*by).agg(pairs("cy").alias("ty"))
    txy = pts.groupBy(*by).agg(pairs("m").alias("txy"))
    out = size.join(disc, by).join(tx, by).join(ty, by).join(txy, by)
    n0 = F.col("n") * (F.col("n") - 1) / 2
    conc = n0 - F.col("tx") - F.col("ty") + F.col("txy") - F.col("disc")
    tau = (conc - F.col("disc")) / F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))
    return out.select(*by, "n", "disc", tau.alias("tau"))


def beggs_test(studies: DataFrame, by: list[str], min_studies: int = 5, alpha: float = 0.05) -> DataFrame:
    """Rank correlation of standardised residuals and variances (normal p-value).

    Both are rounded to twelve digits before they are ranked, so that equal
    values tie whatever the order of summation was.
    """
    w = 1 / (F.col("se") * F.col("se"))
    mean = studies.groupBy(*by).agg((F.sum(w * F.col("effect")) / F.sum(w)).alias("_m"), F.count(F.lit(1)).alias("_k"))
    rows = studies.join(mean.filter(F.col("_k") >= min_studies), by).select(
        *by, F.round((F.col("effect") - F.col("_m")) / F.col("se"), 12).alias("resid"), F.round(F.col("se") * F.col("se"), 12).alias("var"))
    out = rank_correlation(rows, by, "resid", "var")
    n = F.col("n")
    z = F.col("tau") / F.sqrt(2 * (2 * n + 5) / (9.0 * n * (n - 1)))
    return out.withColumn("z_value", z).withColumn("p_value", norm_p(F.col("z_value"))).withColumn(
        "significant", F.col("p_value") < alpha).select(*by, "n", "tau", "z_value", "p_value", "significant")


def _centred(studies: DataFrame, pooled: DataFrame, by: list[str]) -> DataFrame:
    return studies.select(*by, "study_id", "effect", "se").join(
        pooled.select(*by, "k", F.col("re_effect").alias("pooled")), by).withColumns({
            "dev": F.col("effect") - F.col("pooled"), "mag": F.abs(F.col("effect") - F.col("pooled"))})


def trim_and_fill(studies: DataFrame, pooled: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Summary per group and the mirrored rows. Average ranks come from counts per distinct magnitude."""
    rows = settle(_centred(studies, pooled, by))
    runs = value_runs(rows, by, "mag").withColumn("rank", F.col("upto") - (F.col("cnt") - 1) / 2.0)
    sides = rows.join(runs.select(*by, "mag", "rank"), [*by, "mag"]).groupBy(*by, "k", "pooled").agg(
        F.count_if(F.col("dev") > 0).alias("right"), F.count_if(F.col("dev") < 0).alias("left"),
        F.sum(F.when(F.col("dev") > 0, F.col("rank")).otherwise(0.0)).alias("sr"),
        F.sum(F.when(F.col("dev") < 0, F.col("rank")).otherwise(0.0)).alias("sl"))
    positive = F.col("right") > F.col("left")
    s = F.when(positive, F.col("sr")).otherwise(F.col("sl"))
    sides = sides.select(*by, "k", "pooled", positive.alias("trim_positive"), F.greatest(
        F.lit(0), (4 * s / F.col("k") - (F.col("k") + 1) / 2).cast("long")).alias("k0"))
    sides = settle(sides)
    order = rows.withColumn("_desc", -F.col("mag"))
    top = numbered(order, by, ["_desc", "study_id"]).join(sides.select(*by, "k0", "trim_positive"), by)
    mirrored = top.filter((F.col("rn") <= F.col("k0")) & F.when(F.col("trim_positive"), F.col("dev") > 0).otherwise(F.col("dev") < 0))
    mirrored = settle(mirrored.select(*by, "study_id", (2 * F.col("pooled") - F.col("effect")).alias("effect"), "se"))
    w = 1 / (F.col("se") * F.col("se"))
    both = studies.select(*by, "effect", "se", F.lit(0).alias("_f")).unionByName(
        mirrored.select(*by, "effect", "se", F.lit(1).alias("_f")))
    adj = both.groupBy(*by).agg((F.sum(w * F.col("effect")) / F.sum(w)).alias("_adj"), F.sum("_f").alias("imputed"))
    out = sides.join(adj, by).withColumn("adjusted", F.when(F.col("imputed") > 0, F.col("_adj")).otherwise(F.col("pooled")))
    change = F.abs(F.col("adjusted") - F.col("pooled"))
    summary = out.select(*by, "k0", F.col("k").alias("original_n"), (F.col("k") + F.col("k0")).alias("adjusted_n"), "imputed",
                         F.col("pooled").alias("original_effect"), F.col("adjusted").alias("adjusted_effect"),
                         change.alias("effect_change"),
                         F.when(F.col("pooled") != 0, change / F.abs(F.col("pooled")) * 100).otherwise(0.0).alias("percent_change"))
    return summary, mirrored


def failsafe_n(pooled: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    z = F.col("re_effect") / F.col("re_se")
    n = F.pow(z * F.sqrt(F.col("k")) / z_quantile(1 - alpha), 2) - F.col("k")
    return pooled.select(*by, "k", F.greatest(F.lit(0), n.cast("long")).alias("failsafe"))


def bias_severity(studies: DataFrame, pooled: DataFrame, by: list[str]) -> DataFrame:
    """Points from the three tests, and the band they fall in."""
    egger = eggers_test(studies, by).select(*by, F.col("p_value").alias("egger_p"), F.col("significant").alias("egger_sig"))
    begg = beggs_test(studies, by).select(*by, F.col("significant").alias("begg_sig"))
    fill, _ = trim_and_fill(studies, pooled, by)
    j = egger.join(begg, by, "left").join(fill, by)
    points = (
        F.when(F.col("egger_sig"), 2).when(F.col("egger_p") < 0.1, 1).otherwise(0)
        + F.when(F.coalesce("begg_sig", F.lit(False)), 1).otherwise(0)
        + F.when(F.col("k0") > F.col("original_n") * 0.3, 2).when(F.col("k0") > 0, 1).otherwise(0)
        + F.when((F.col("percent_change") > 20), 1).otherwise(0))
    j = j.withColumn("points", points.cast("long"))
    return j.select(*by, "egger_p", "k0", "adjusted_effect", "original_effect", "points", (F.col("points") > 1).alias("detected"),
                    F.when(F.col("points") == 0, "none").when(F.col("points") <= 1, "possible")
                    .when(F.col("points") <= 3, "likely").otherwise("severe").alias("severity"))
