"""Chart tables, verdicts, recommendations and report lines built from pooled results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.stats import norm_p, z_quantile
from .scale import numbered, quantiles


def bands(value: Column, limits: list[tuple]) -> Column:
    """First label whose limit exceeds the value; the last entry has no limit."""
    out = None
    for limit, label in limits:
        if limit is None:
            return out.otherwise(label)
        out = F.when(value < limit, label) if out is None else out.when(value < limit, label)
    return out


def forest_table(weighted: DataFrame, by: list[str], sort_by: str = "effect") -> DataFrame:
    """Rows in plotting order with their height and marker size; ``weighted`` carries weight_pct."""
    key = {"effect": -F.round("effect", 9), "weight": -F.col("weight_pct"), "se": F.col("se")}.get(sort_by, F.col("study_id"))
    rows = numbered(weighted.withColumn("_key", key), by, ["_key", "study_id"])
    size = weighted.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    label = F.when(F.length("study_id") > 30, F.concat(F.substring("study_id", 1, 30), F.lit("..."))).otherwise(F.col("study_id"))
    return rows.join(size, by).select(
        *by, "study_id", label.alias("label"), "effect", "se", "weight_pct", "rn", (F.col("_n") + 3 - F.col("rn")).alias("y"),
        (F.sqrt("weight_pct") * 3 + 5).alias("marker"))


def funnel_contours(studies: DataFrame, pooled: DataFrame, by: list[str], steps: int = 100) -> DataFrame:
    """Pseudo-interval lines at 95 and 99 percent over the range of standard errors."""
    top = studies.groupBy(*by).agg((F.max("se") * 1.2).alias("_top")).join(pooled.select(*by, "re_effect"), by)
    pts = top.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    se = 0.001 + (F.col("_top") - 0.001) * F.col("step") / (steps - 1)
    pts = pts.withColumn("se", se).withColumn("level", F.explode(F.array(F.lit(95), F.lit(99))))
    z = F.when(F.col("level") == 95, 1.96).otherwise(2.576)
    return pts.select(*by, "level", "step", "se", (F.col("re_effect") - z * F.col("se")).alias("lower"),
                      (F.col("re_effect") + z * F.col("se")).alias("upper"))


def bubble_fit(weighted: DataFrame, by: list[str]) -> DataFrame:
    """Line of effect on precision; the weights multiply residuals, so they enter squared."""
    x, y, w = 1 / F.col("se"), F.col("effect"), F.col("weight_pct") * F.col("weight_pct")
    s = weighted.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"),
                                  F.sum(w * x * y).alias("sxy"), F.sum(w * x * x).alias("sxx"),
                                  F.min(x).alias("x_min"), F.max(x).alias("x_max")).filter(F.col("n") > 2)
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.withColumn("slope", slope).select(
        *by, "n", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("intercept"), "x_min", "x_max")


def influence_sizes(diag: DataFrame, by: list[str]) -> DataFrame:
    size = F.least(F.lit(50.0), F.greatest(F.lit(10.0), 100 * F.col("cooks_distance") + 10))
    return diag.select(*by, "study_id", "leverage", "std_residual", size.alias("marker"), "is_influential")


def leave_one_out_chart(loo: DataFrame, pooled: DataFrame, by: list[str]) -> DataFrame:
    """One interval per study left out, its place on the axis, and the overall effect as the line to compare with."""
    rows = numbered(loo.select(*by, "study_id", F.col("pooled_effect").alias("effect"), "ci_lower", "ci_upper"), by, ["study_id"], "place")
    return rows.join(pooled.select(*by, F.col("re_effect").alias("overall")), by)


def cumulative_chart(cumulative: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """The pooled effect and its interval after each further study, and whether it is significant by then."""
    return cumulative.select(*by, "study_id", "timestamp", "n_studies", F.col("pooled_effect").alias("effect"), "ci_lower", "ci_upper", (F.col("p_value") < alpha).alias("significant"))


# Confidence words by p-value and consistency words by I2.
CONFIDENCE = [(0.001, "Very High"), (0.01, "High"), (0.05, "Moderate"), (0.10, "Low"), (None, "Very Low")]
SPREAD = [(25, "Low (experiments show consistent results)"), (50, "Moderate (some variation between experiments)"),
          (75, "Substantial (notable differences between experiments)"), (None, "High (experiments show very different results)")]


def traffic_light(result: DataFrame, by: list[str]) -> DataFrame:
    sure = F.col("p_value") < 0.05
    colour = (F.when(sure & (F.col("ci_lower") > 0) & (F.col("ci_upper") > 0), "green")
              .when(sure & (F.col("ci_lower") < 0) & (F.col("ci_upper") < 0), "red").otherwise("yellow"))
    return result.select(*by, colour.alias("colour"), bands(F.col("p_value"), CONFIDENCE).alias("confidence"),
                         bands(F.col("i2"), SPREAD).alias("heterogeneity"))


def comparison_panel(pooled: DataFrame, severity: DataFrame, by: list[str]) -> DataFrame:
    return pooled.join(severity.select(*by, "detected"), by).select(
        *by, F.col("k").alias("experiments"), F.format_string("%.3f", "re_effect").alias("pooled_effect"),
        F.format_string("%.1f%%", "i2").alias("i2"), "detected")


# Recommendation rules (kind, priority, title), in rule order.
RULES = [
    ("heterogeneity", "high", "High Heterogeneity Detected"), ("heterogeneity", "medium", "Substantial Heterogeneity"),
    ("publication_bias", "high", "Publication Bias Concerns"), ("publication_bias", "medium", "Possible Publication Bias"),
    ("sensitivity", "high", "Sensitivity Concerns"), ("influential_studies", "medium", "Influential Studies Identified"),
    ("sample_size", "medium", "Small Number of Studies"), ("significance", "low", "Marginal Significance"),
    ("benchmark", "medium", "Deviation from Historical Benchmark"),
]


def facts(pooled: DataFrame, severity: DataFrame, robust: DataFrame, by: list[str], history: DataFrame | None = None) -> DataFrame:
    """One row per group with everything the rules and the report read."""
    z = F.col("re_effect") / F.col("re_se")
    f = pooled.select(*by, "k", "q", "df", "i2", "tau2", "re_effect", "re_se", norm_p(z).alias("p_value"), z.alias("z_value"))
    f = f.join(severity.select(*by, "severity", "detected", "egger_p", "k0", "adjusted_effect"), by)
    f = f.join(robust.select(*by, "robust", "flagged"), by)
    if history is not None:
        return f.join(history.select(*by, "historical_effect"), by, "left")
    return f.withColumn("historical_effect", F.lit(None).cast("double"))


def recommendations(facts_: DataFrame, by: list[str]) -> DataFrame:
    """Rows (position, kind, priority, title) that apply, high priority first."""
    c = F.col
    tests = [c("i2") > 75, (c("i2") > 50) & (c("i2") <= 75), c("severity").isin("likely", "severe"), c("severity") == "possible",
             ~c("robust"), c("flagged") > 0, c("k") < 10, (c("p_value") > 0.01) & (c("p_value") < 0.05),
             F.abs(c("re_effect") - c("historical_effect")) > 0.2]
    order = {"high": 0, "medium": 1, "low": 2}
    made = [F.when(test, F.struct(F.lit(order[p]).alias("o"), F.lit(i).alias("i"), F.lit(kind).alias("kind"),
                                  F.lit(p).alias("priority"), F.lit(title).alias("title")))
            for i, (test, (kind, p, title)) in enumerate(zip(tests, RULES))]
    # At most one entry per rule, so the array has a fixed bound.
    return facts_.select(*by, F.posexplode(F.array_sort(F.array_compact(F.array(*made)))).alias("pos", "r")).select(
        *by, (c("pos") + 1).alias("position"), c("r.kind").alias("kind"), c("r.priority").alias("priority"), c("r.title").alias("title"))


def report_lines(facts_: DataFrame, recs: DataFrame, by: list[str]) -> DataFrame:
    """The report as ordered lines (section, line, text), one set per group. The wording is fixed."""
    z = z_quantile()
    c = F.col
    lo, hi = c("re_effect") - z * c("re_se"), c("re_effect") + z * c("re_se")
    fs = F.format_string
    direction = F.when(c("re_effect") > 0, "positive").otherwise("negative")
    sig = F.when(c("p_value") < 0.05, "statistically significant").otherwise("not statistically significant")
    spread = F.when(c("i2") > 50, "high").when(c("i2") > 25, "moderate").otherwise("low")
    sections = [
        (1, [F.lit("# Meta-Analysis Report"), F.lit("## Executive Summary"),
             fs("This meta-analysis of **%d studies** found a %s pooled effect of **%.3f** (95%% CI: %.3f to %.3f), which is %s (p = %.4f). "
                "Heterogeneity was %s (I² = %.1f%%).", c("k"), direction, c("re_effect"), lo, hi, sig, c("p_value"), spread, c("i2"))]),
        (2, [F.lit("## Methods"), F.lit("- **Model:** Random Effects model"), F.lit("- **Effect Size:** Log odds ratio"),
             F.lit("- **Confidence Level:** 95%")]),
        (3, [F.lit("## Results"), F.lit("### Pooled Effect"), F.lit("| Statistic | Value |"), F.lit("|-----------|-------|"),
             fs("| Pooled Effect | %.4f |", c("re_effect")), fs("| Standard Error | %.4f |", c("re_se")),
             fs("| 95%% CI Lower | %.4f |", lo), fs("| 95%% CI Upper | %.4f |", hi), fs("| Z-value | %.2f |", c("z_value")),
             fs("| P-value | %.4f |", c("p_value")), F.lit("### Heterogeneity"), fs("| Q | %.2f |", c("q")),
             fs("| I² | %.1f%% |", c("i2")), fs("| τ² | %.4f |", c("tau2"))]),
        (4, [F.lit("## Publication Bias Assessment"), fs("- **Egger's test:** p = %.3f", c("egger_p")),
             F.when(c("detected"), F.concat(F.lit("- **Bias severity:** "), c("severity"))),
             F.when(c("k0") > 0, fs("- **Trim-and-fill:** %d imputed studies", c("k0"))),
             F.when(c("k0") > 0, fs("- **Adjusted effect:** %.4f", c("adjusted_effect")))]),
        (5, [F.lit("## Sensitivity Analysis"),
             F.when(c("robust"), "✓ Results are robust to removal of individual studies.").otherwise(
                 "⚠️ Results may be sensitive to individual studies."),
             F.when(c("flagged") > 0, fs("**Influential studies:** %d", c("flagged")))]),
        (7, [F.lit("## Limitations"), F.lit("- Results should be interpreted in the context of original study designs"),
             F.lit("- Heterogeneity may limit generalizability of pooled estimates"),
             F.lit("- Publication bias assessment has limited power with few studies")]),
    ]
    entries = [F.struct(F.lit(s).alias("section"), F.lit(i).alias("line"), text.alias("text"))
               for s, texts in sections for i, text in enumerate(texts, 1)]
    body = facts_.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*").filter(c("text").isNotNull())
    top = recs.filter(c("position") <= 5).select(
        *by, F.lit(6).alias("section"), c("position").alias("line"),
        F.concat(F.lit("### "), c("position").cast("string"), F.lit(". "), c("title"), F.lit(" — "), F.upper("priority")).alias("text"))
    return body.unionByName(top)


# The wording of interpretations, as (upper limit, ...) bands and format strings.
I2_BANDS = [
    (25, "low", "Studies show consistent effects."),
    (50, "moderate", "Some variation between studies exists."),
    (75, "substantial", "Considerable variation exists. Random effects model appropriate."),
    (None, "high", "True effects vary substantially. Consider subgroup analysis."),
]
I2_TEXT = "I² = %.1f%% indicates **%s heterogeneity**. %s"
TAU2_TEXT = "τ² = %.4f (τ = %.3f). This represents the estimated variance of true effects across studies."
P_TINY_TEXT = "p < 0.001: Highly significant. Strong evidence against null hypothesis."
P_TEXT = "p = %.3f: "
P_BANDS = [
    (0.01, "Significant. Good evidence against null hypothesis."),
    (0.05, "Marginally significant. Some evidence, but borderline."),
    (0.10, "Not significant, but approaching significance."),
    (None, "Not statistically significant."),
]
EGGER_TEXT = "Egger's test p = %.3f: "
EGGER_BANDS = [
    (0.05, "Significant asymmetry detected. Publication bias possible."),
    (0.10, "Borderline asymmetry. Consider cautiously."),
    (None, "No significant asymmetry detected."),
]
Q_TEXT = "Q = %.2f (df = %d): Measures total heterogeneity in the meta-analysis."


def interpretations(pooled: DataFrame, severity: DataFrame, by: list[str]) -> DataFrame:
    """Banded text for I2, tau2, p, Egger p and Q, one row per statistic."""
    c, fs = F.col, F.format_string
    p = norm_p(c("re_effect") / c("re_se"))
    j = pooled.join(severity.select(*by, "egger_p"), by).withColumn("p", p)
    level, meaning = bands(c("i2"), [(a, b) for a, b, _ in I2_BANDS]), bands(c("i2"), [(a, m) for a, _, m in I2_BANDS])
    texts = [
        ("i2", fs(I2_TEXT, c("i2"), level, meaning)),
        ("tau2", fs(TAU2_TEXT, c("tau2"), F.sqrt("tau2"))),
        ("p_value", F.when(c("p") < 0.001, F.lit(P_TINY_TEXT)).otherwise(F.concat(fs(P_TEXT, c("p")), bands(c("p"), P_BANDS)))),
        ("eggers_p", F.concat(fs(EGGER_TEXT, c("egger_p")), bands(c("egger_p"), EGGER_BANDS))),
        ("q", fs(Q_TEXT, c("q"), c("df"))),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), x.alias("text")) for n, x in texts])).alias("e")
    return j.select(*by, rows).select(*by, "e.*")


def historical_comparison(pooled: DataFrame, history: DataFrame, by: list[str]) -> DataFrame:
    """Current effect against the mean of past effects (one scalar row)."""
    past = history.agg(F.avg("pooled_effect").alias("historical_average"))
    j = pooled.select(*by, F.col("re_effect").alias("current_effect")).join(F.broadcast(past), F.lit(True))
    d = F.col("current_effect") - F.col("historical_average")
    return j.withColumn("effect_difference", d).withColumn(
        "interpretation", F.when(F.abs(d) < 0.1, "Current results are consistent with historical findings.")
        .when(d > 0, "Current effect is larger than historical average.").otherwise("Current effect is smaller than historical average."))


def archive_benchmark(archive: DataFrame) -> DataFrame:
    """Per metric (case-insensitive): past effects and the exact median sample size."""
    a = archive.withColumn("metric_key", F.lower("metric"))
    s = a.groupBy("metric_key").agg(F.count(F.lit(1)).alias("n_experiments"), F.avg("effect").alias("historical_effect"),
                                    F.stddev_pop("effect").alias("effect_std"), F.min("effect").alias("effect_min"), F.max("effect").alias("effect_max"))
    return s.join(quantiles(a, ["metric_key"], "total_n", {"median_sample_size": 0.5}), "metric_key")


def benchmark_lookup(asked: DataFrame) -> DataFrame:
    """Attach the benchmark of (industry, metric): exact name first, then containment either way.

    Only distinct pairs meet the fixed 12-row table; rows follow by equi-join.
    """
    dim = asked.sparkSession.createDataFrame(
        [(i, *r) for i, r in enumerate(lexicons.BENCHMARKS)],
        "ord int, industry_key string, benchmark_metric string, median double, p25 double, p75 double, base_n long")
    m, b = F.lower("metric"), F.col("benchmark_metric")
    exact = m == b
    words_m, words_b = F.replace(m, F.lit("_"), F.lit(" ")), F.replace(b, F.lit("_"), F.lit(" "))
    pairs = asked.select("industry", "metric").distinct()
    hit = pairs.join(F.broadcast(dim), (F.lower("industry") == F.col("industry_key"))
                     & (exact | words_b.contains(words_m) | words_m.contains(words_b)))
    best = hit.groupBy("industry", "metric").agg(F.min_by(
        F.struct("benchmark_metric", "median", "p25", "p75", "base_n"), F.struct((~exact).cast("int"), F.col("ord"))).alias("b"))
    return asked.join(best, ["industry", "metric"], "left").select(*asked.columns, "b.*")


def benchmark_band(found: DataFrame) -> DataFrame:
    e = F.col("effect")
    hit = found.filter(F.col("benchmark_metric").isNotNull())
    return hit.withColumn("category", F.when(e <= F.col("p25"), "below_average").when(e <= F.col("median"), "average")
                          .when(e <= F.col("p75"), "above_average").otherwise("exceptional"))


def sample_size_suggestion(found: DataFrame, mde: str) -> DataFrame:
    scale = F.least(F.pow(F.col("median") / F.col(mde), 2), F.lit(4.0))
    return found.withColumn("recommendation", F.when(F.col("benchmark_metric").isNull(), F.lit(10000).cast("long"))
                            .when(F.col(mde) < F.col("median"), (F.col("base_n") * scale).cast("long")).otherwise(F.col("base_n")))


def search_references(requests: DataFrame, limit: int = 3) -> DataFrame:
    """Score the fixed method references for each distinct request text."""
    dim = requests.sparkSession.createDataFrame(
        [(i, *r) for i, r in enumerate(lexicons.METHOD_REFERENCES)], "ord int, ref_key string, title string, concepts array<string>, summary string")
    q = F.lower("request")
    score = (F.when(F.lower("title").contains(q), 3).otherwise(0)
             + 2 * F.size(F.filter("concepts", lambda x: F.lower(x).contains(q)))
             + F.when(F.lower("summary").contains(q), 1).otherwise(0))
    # The reference table is fixed at six rows, so each request grows by at most that factor.
    hits = requests.select("request").distinct().join(F.broadcast(dim), F.lit(True)).withColumn("score", score).filter(F.col("score") > 0)
    per = hits.groupBy("request").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "ref_key"))).alias("h"))
    return per.select("request", F.posexplode(F.slice("h", 1, limit)).alias("pos", "r")).select(
        "request", (F.col("pos") + 1).alias("rank"), F.col("r.ref_key").alias("ref_key"), (-F.col("r.s")).cast("long").alias("score"))
