"""Validation of studies and comparison of two samples."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import DOMAINS
from .scale import quantiles, running, settle


def _messages(*pairs):
    return F.array_compact(F.array(*[F.when(test, text) for test, text in pairs]))


def batch_issues(studies: DataFrame) -> DataFrame:
    """One row per problem of a study: field, severity, message, value."""
    c, fs = F.col, F.format_string
    made = [
        F.when(F.abs(c("effect")) > 5, F.struct(F.lit("effect_size").alias("field"), F.lit("warning").alias("severity"),
               fs("Unusually large effect size: %.3f", c("effect")).alias("message"), c("effect").alias("value"))),
        F.when(c("se") <= 0, F.struct(F.lit("standard_error").alias("field"), F.lit("error").alias("severity"),
               fs("Invalid standard error: %.3f", c("se")).alias("message"), c("se").alias("value"))),
        F.when((c("control_total") < 10) | (c("treatment_total") < 10), F.struct(
            F.lit("sample_size").alias("field"), F.lit("warning").alias("severity"),
            fs("Small sample size: control=%d, treatment=%d", c("control_total"), c("treatment_total")).alias("message"),
            c("total_n").cast("double").alias("value"))),
    ]
    return studies.select("study_id", F.explode(F.array_compact(F.array(*made))).alias("i")).select("study_id", "i.*")


def batch_summary(studies: DataFrame, by: list[str]) -> DataFrame:
    ok = studies.filter(F.col("se") > 0)
    s = studies.groupBy(*by).agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("se") > 0).alias("valid_records"))
    v = ok.groupBy(*by).agg(F.avg("effect").alias("mean_effect"), F.stddev_pop("effect").alias("std_effect"), F.min("effect").alias("min_effect"),
                            F.max("effect").alias("max_effect"), F.sum("total_n").alias("total_n"))
    return s.join(v, by, "left").join(quantiles(ok, by, "total_n", {"median_n": 0.5}), by, "left")


def study_check(studies: DataFrame, strict: bool = False) -> DataFrame:
    """Errors and warnings per study as arrays."""
    c, fs = F.col, F.format_string
    e, se = c("effect"), c("se")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def size_checks(col, name):
        n = c(col)
        return ([(n < 10, fs(f"{name} sample: Sample size %d below minimum 10", n))],
                [((n >= 10) & (n < 30), fs(f"Small {name.lower()} sample: %d", n))])

    ce, cw = size_checks("control_total", "Control")
    te, tw = size_checks("treatment_total", "Treatment")
    errors = _messages(
        (~finite(e), F.lit("Effect size: not finite")), (finite(e) & (F.abs(e) > 5), fs("Effect size: %.3f outside range", e)),
        (~finite(se), F.lit("Standard error: not finite")), (finite(se) & ((se < 1e-4) | (se > 10)), fs("Standard error: %.4f outside range", se)),
        *ce, *te, (c("ci_lower") > c("ci_upper"), F.lit("CI lower bound exceeds upper bound")),
        ((c("p_value") < 0) | (c("p_value") > 1), fs("Invalid p-value: %.3f", c("p_value"))),
        (F.coalesce(F.length("study_id"), F.lit(0)) < 1, F.lit("Missing or empty study ID")))
    warnings = _messages((finite(e) & (F.abs(e) <= 5) & (F.abs(e) > 2), fs("Large effect size: %.3f", e)), *cw, *tw,
                         (~e.between(c("ci_lower"), c("ci_upper")), F.lit("Effect size not within confidence interval")))
    out = studies.withColumns({"errors": errors, "warnings": warnings})
    ok = F.size("errors") == 0
    return out.withColumn("is_valid", (ok & (F.size("warnings") == 0)) if strict else ok)


def collection_check(checked: DataFrame, by: list[str], min_studies: int = 3) -> DataFrame:
    v = F.when(F.col("is_valid"), F.col("effect"))
    s = checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_studies"), F.count_if("is_valid").alias("valid_studies"), F.avg(v).alias("mean_effect"),
        F.stddev_pop(v).alias("std_effect"), F.min(v).alias("min_effect"), F.max(v).alias("max_effect"),
        F.sum(F.when(F.col("is_valid"), F.col("total_n"))).alias("total_sample_size"))
    return s.withColumns({"is_valid": F.col("total_studies") >= min_studies,
                          "wide_range": F.coalesce(F.col("max_effect") - F.col("min_effect") > 2, F.lit(False))})


def iqr_outliers(df: DataFrame, by: list[str], value: str, factor: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences; groups under three rows give none.

    The fences are written, so that their true size decides the join: rows of
    a few groups stay where they are read.
    """
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    q = settle(quantiles(df, by, value, {"q1": 0.25, "q3": 0.75}).join(size.filter(F.col("_n") >= 3), by).drop("_n"))
    spread = factor * (F.col("q3") - F.col("q1"))
    return df.join(q, by).filter((F.col(value) < F.col("q1") - spread) | (F.col(value) > F.col("q3") + spread))


def zscore_outliers(df: DataFrame, by: list[str], value: str, limit: float = 3.0) -> DataFrame:
    s = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return df.join(s.filter((F.col("_n") >= 3) & (F.col("std") > 0)).drop("_n"), by).filter(
        F.abs(F.col(value) - F.col("mean")) / F.col("std") > limit)


def violations(df: DataFrame, domain: str) -> DataFrame:
    """Rule breaches of a table against a domain, from one aggregation: rule, column, count or bound."""
    conf = DOMAINS[domain]
    cols = set(df.columns)
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    lo_size = conf["sample_size"][0] // 2
    found, aggs = [], []

    def rule(name, column, agg, test, value):
        key = f"a{len(aggs)}"
        aggs.append(agg.alias(key))
        found.append(F.when(test(F.col(key)), F.struct(F.lit(name).alias("rule"), F.lit(column).alias("column"),
                                                       value(F.col(key)).cast("double").alias("value"))))

    for c, (lo, hi) in conf["metrics"].items():
        if c in cols:
            rule("below minimum", c, F.min(c), lambda x, lo=lo: x < lo, lambda x: x)
            rule("above maximum", c, F.max(c), lambda x, hi=hi: x > hi, lambda x: x)
    for c in ("sample_size", "control_visitors", "variant_visitors"):
        if c in cols:
            rule("too small", c, F.min(c), lambda x: x < lo_size, lambda x: x)
    for c in numeric:
        rule("negative values", c, F.count_if(F.col(c) < 0), lambda x: x > 0, lambda x: x)
    for arm in ("control", "variant"):
        if {f"{arm}_conversions", f"{arm}_visitors"} <= cols:
            rule("conversions > visitors", arm, F.count_if(F.col(f"{arm}_conversions") > F.col(f"{arm}_visitors")), lambda x: x > 0, lambda x: x)
    one = df.agg(*aggs)
    return one.select(F.explode(F.array_compact(F.array(*found))).alias("v")).select("v.*")


def ks_statistic(df: DataFrame, by: list[str], value: str, side: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per group; ``side`` is true for the first sample."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    upto = running(counts, by, [value], {"ca": F.col("a"), "cb": F.col("b")})
    n = counts.groupBy(*by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    d = upto.join(n, by).groupBy(*by, "na", "nb").agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("d"))
    empty = (F.col("na") == 0) | (F.col("nb") == 0)
    en = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0)
                         * F.exp(-2 * k * k * F.pow(en * F.col("d"), 2)))
    p = F.when(F.col("d") * en < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return d.select(*by, "na", "nb", F.when(empty, 1.0).otherwise(F.col("d")).alias("statistic"), F.when(empty, 0.0).otherwise(p).alias("p_value"))


def js_distance(df: DataFrame, by: list[str], value: str, side: str, bins: int = 50) -> DataFrame:
    """Jensen-Shannon distance over equal bins of the joint range."""
    rows = df.filter(F.col(value).isNotNull())
    rng = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count_if(F.col(side)).alias("na"), F.count_if(~F.col(side)).alias("nb"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    hist = rows.select(*by, value, side).join(rng, by).groupBy(*by, b.alias("bin")).agg(
        F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    full = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>"))).join(hist, [*by, "bin"], "left")
    full = full.withColumns({"pa": F.coalesce("a", F.lit(0)) / F.col("na") / width + 1e-10, "pb": F.coalesce("b", F.lit(0)) / F.col("nb") / width + 1e-10})
    tot = full.groupBy(*by).agg(F.sum("pa").alias("ta"), F.sum("pb").alias("tb"))
    full = full.join(tot, by).withColumns({"p": F.col("pa") / F.col("ta"), "q": F.col("pb") / F.col("tb")})
    m = (F.col("p") + F.col("q")) / 2
    kl = F.sum(F.col("p") * F.log(F.col("p") / m)) / 2 + F.sum(F.col("q") * F.log(F.col("q") / m)) / 2
    out = full.groupBy(*by, "lo", "hi", "na", "nb").agg(kl.alias("js"))
    return out.select(*by, F.when((F.col("na") == 0) | (F.col("nb") == 0), 1.0).when(F.col("lo") == F.col("hi"), 0.0)
                      .otherwise(F.sqrt(F.greatest(F.col("js"), F.lit(0.0)))).alias("js_distance"))


def correlation_similarity(df: DataFrame, by: list[str], columns: list[str], side: str) -> DataFrame:
    """1 - Frobenius distance of the two correlation matrices over its bound; all pairs in one aggregation."""
    pairs = list(itertools.combinations(columns, 2))
    if not pairs:
        return df.groupBy(*by).agg(F.lit(1.0).alias("similarity"))
    aggs = []
    for i, (x, y) in enumerate(pairs):
        for tag, cond in (("a", F.col(side)), ("b", ~F.col(side))):
            r = F.corr(F.when(cond, F.col(x)), F.when(cond, F.col(y)))
            aggs.append(r.alias(f"{tag}{i}"))
    clean = lambda c: F.when(F.isnan(F.coalesce(F.col(c), F.lit(0.0))), 0.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    total = sum((2 * F.pow(clean(f"a{i}") - clean(f"b{i}"), 2) for i in range(len(pairs))), F.lit(0.0))
    bound = (2 * len(columns) ** 2) ** 0.5
    return df.groupBy(*by).agg(*aggs).select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(total) / bound)).alias("similarity"))


def column_statistics(df: DataFrame, by: list[str], value: str, side: str) -> DataFrame:
    a, b = F.when(F.col(side), F.col(value)), F.when(~F.col(side), F.col(value))
    return df.groupBy(*by).agg(*[f(x).alias(f"{n}_{m}") for n, x in (("real", a), ("synth", b))
                                 for m, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def quality_verdict(df: DataFrame, columns: list[str], side: str, domain: str) -> DataFrame:
    """Mean KS and JS over the columns, correlation similarity, breaches, and the pass flag."""
    long = df.unpivot([side], columns, "column", "value")
    ks = ks_statistic(long, ["column"], "value", side).agg(F.avg("statistic").alias("ks"))
    js = js_distance(long, ["column"], "value", side).agg(F.avg("js_distance").alias("js"))
    corr = correlation_similarity(df.withColumn("_g", F.lit(1)), ["_g"], columns, side).select("similarity")
    bad = violations(df.filter(~F.col(side)).select(*columns), domain).agg(F.count(F.lit(1)).alias("violations"))
    one = ks.join(js, F.lit(True)).join(corr, F.lit(True)).join(bad, F.lit(True))  # four one-row relations
    return one.withColumn("passes", (F.col("ks") < 0.1) & (F.col("js") < 0.3) & (F.col("similarity") > 0.8) & (F.col("violations") == 0))
