"""Experiment tables: column mapping, cleaning, derivation, filters and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import effects, lexicons


def resolve_aliases(columns: list[str], aliases: dict[str, list[str]], exact: bool = False) -> dict[str, str]:
    """Standard name -> first alias that occurs among the column names. Reads names only, no data."""
    seen = {(c if exact else c.lower().strip()): c for c in reversed(columns)}
    return {std: seen[next(a for a in names if a in seen)] for std, names in aliases.items() if any(a in seen for a in names)}


def map_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """One select that renames the mapped columns."""
    return df.select(*[F.col(f"`{src}`").alias(std) for std, src in mapping.items()])


def map_experiments(df: DataFrame, override: dict[str, str] | None = None, auto: bool = True) -> DataFrame:
    """Detect the standard columns, or use the given mapping instead of detection."""
    if override is None and not auto:
        raise ValueError("a column mapping is needed when detection is off")
    mapping = override or resolve_aliases(df.columns, lexicons.EXPERIMENT_ALIASES)
    missing = missing_columns(mapping)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return map_columns(df, mapping)


REQUIRED = ["control_conversions", "control_total", "treatment_conversions", "treatment_total"]


def missing_columns(mapping: dict[str, str], required: list[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in mapping]


def schema_report(df: DataFrame) -> DataFrame:
    """One row: which required columns are missing and which aliases could stand in."""
    required = ["experiment_id", "control_visitors", "control_conversions", "variant_visitors", "variant_conversions"]
    missing = [c for c in required if c not in df.columns]
    found = {c: a for c in missing for a in reversed(lexicons.STUDY_ALIASES[c]) if a in df.columns}
    return df.sparkSession.createDataFrame(
        [(len(found) == len(missing), missing, found, df.columns)],
        "valid boolean, missing_columns array<string>, found_alternatives map<string,string>, available_columns array<string>")


def valid_rows(df: DataFrame) -> DataFrame:
    c = F.col
    return df.filter((c("control_total") > 0) & (c("treatment_total") > 0) & (c("control_conversions") >= 0) & (c("treatment_conversions") >= 0)
                     & (c("control_conversions") <= c("control_total")) & (c("treatment_conversions") <= c("treatment_total")))


def finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def tolerant(df: DataFrame) -> DataFrame:
    """p_value to double and date to timestamp; what cannot be read becomes null."""
    out = df
    if "p_value" in df.columns:
        out = out.withColumn("p_value", F.expr("try_cast(p_value AS double)"))
    if "date" in df.columns:
        out = out.withColumn("date", F.try_to_timestamp(F.col("date").cast("string")))
    return out


def with_defaults(df: DataFrame, stem: str, index: str) -> DataFrame:
    """Fill id, name and metric where the table has none."""
    i = F.col(index).cast("string")
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    return df.withColumns({
        "experiment_id": F.coalesce(have("experiment_id"), F.concat(F.lit(f"{stem}_"), i)),
        "experiment_name": F.coalesce(have("experiment_name"), F.concat(F.lit("Experiment "), i)),
        "metric": F.coalesce(have("metric"), F.lit("conversion"))})


def derive_studies(df: DataFrame) -> DataFrame:
    """Valid rows with effect, standard error, interval, variance, weight and total size."""
    cells = [F.col("control_conversions"), F.col("control_total") - F.col("control_conversions"),
             F.col("treatment_conversions"), F.col("treatment_total") - F.col("treatment_conversions")]
    out = valid_rows(df).withColumns({"effect": effects.log_odds_ratio(*cells), "se": effects.log_odds_se(*cells)})
    out = out.filter(finite("effect", "se"))
    return out.withColumns({
        "ci_lower": F.col("effect") - 1.96 * F.col("se"), "ci_upper": F.col("effect") + 1.96 * F.col("se"),
        "variance": F.col("se") * F.col("se"),
        "weight": F.when(F.col("se") > 0, 1 / (F.col("se") * F.col("se"))).otherwise(0.0),
        "total_n": F.col("control_total") + F.col("treatment_total")})


def corrected_effects(df: DataFrame) -> DataFrame:
    """Half a count on every cell always; rates, lift and total size."""
    c = F.col
    ce, cn, te, tn = c("control_conversions") + 0.5, c("control_visitors") - c("control_conversions") + 0.5, \
        c("variant_conversions") + 0.5, c("variant_visitors") - c("variant_conversions") + 0.5
    out = df.withColumns({
        "effect_size": F.log((te * cn) / (ce * tn)), "standard_error": F.sqrt(1 / ce + 1 / cn + 1 / te + 1 / tn),
        "control_rate": c("control_conversions") / c("control_visitors"), "treatment_rate": c("variant_conversions") / c("variant_visitors"),
        "total_sample_size": (c("control_visitors") + c("variant_visitors")).cast("double")})
    return out.withColumn("relative_lift", (c("treatment_rate") - c("control_rate")) / F.greatest(c("control_rate"), F.lit(1e-6)))


def from_domain(df: DataFrame, domain: str) -> DataFrame:
    """Copy the columns a domain names differently to their standard names."""
    renames = lexicons.DOMAIN_RENAMES.get(domain, {})
    return to_study_schema(df.withColumns({std: F.col(src) for src, std in renames.items() if src in df.columns}))


def to_study_schema(df: DataFrame) -> DataFrame:
    """Aliases picked, effects added when possible, totals and segment columns passed through."""
    mapping = resolve_aliases(df.columns, lexicons.STUDY_ALIASES, exact=True)
    extra = [c for c in ("platform", "domain", "test_duration_days", *lexicons.SEGMENT_COLUMNS) if c in df.columns and c not in mapping]
    extra = list(dict.fromkeys(extra))
    out = df.select(*[F.col(s).alias(d) for d, s in mapping.items()], *extra)
    if {"control_visitors", "control_conversions", "variant_visitors", "variant_conversions"} <= set(out.columns):
        out = corrected_effects(out)
    same = {"control_total": "control_visitors", "treatment_total": "variant_visitors", "treatment_conversions": "variant_conversions"}
    return out.withColumns({new: F.col(old) for new, old in same.items() if old in out.columns})


def clean_import(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Names to text, counts to numbers, rows with gaps or impossible counts dropped, totals renamed."""
    m = mapping or resolve_aliases(df.columns, lexicons.IMPORT_ALIASES)
    need = ["control_visitors", "control_conversions", "variant_visitors", "variant_conversions"]
    if missing_columns(m, need):
        raise ValueError(f"missing required columns: {missing_columns(m, need)}")
    num = lambda c: F.expr(f"try_cast(try_cast(`{m[c]}` AS double) AS bigint)")
    name = F.col(m["experiment_name"]).cast("string") if "experiment_name" in m else F.concat(F.lit("experiment_"), F.col("row_index").cast("string"))
    out = df.select(name.alias("experiment_name"), *[num(c).alias(c) for c in need]).dropna(subset=need)
    out = out.filter((F.col("control_conversions") <= F.col("control_visitors")) & (F.col("variant_conversions") <= F.col("variant_visitors"))
                     & (F.col("control_visitors") > 0) & (F.col("variant_visitors") > 0))
    return out.withColumnsRenamed({"control_visitors": "control_total", "variant_visitors": "treatment_total", "variant_conversions": "treatment_conversions"})


def filter_experiments(df: DataFrame, date_from=None, date_to=None, min_n=None, text=None, ids=None, when="day",
                       name="study_name", metric="metric", size="total_n") -> DataFrame:
    """Inclusive dates, minimum size, case-insensitive substring of name or metric, id list."""
    ok = F.lit(True)
    if ids is not None:
        ok = ok & F.col("study_id").isin(*ids)
    if date_from is not None:
        ok = ok & (F.col(when) >= F.lit(date_from))
    if date_to is not None:
        ok = ok & (F.col(when) <= F.lit(date_to))
    if min_n:
        ok = ok & (F.col(size) >= min_n)
    if text:
        ok = ok & (F.lower(name).contains(text.lower()) | F.lower(metric).contains(text.lower()))
    return df.filter(ok)


def fetch_experiments(df: DataFrame, ids: DataFrame | None = None, min_n=None, date_from=None, date_to=None, text=None,
                      use_text: bool = False, when="day") -> DataFrame:
    """Rows of the wanted ids; the text is ignored unless asked for, as the fetch always did."""
    out = df.join(ids, "study_id", "left_semi") if ids is not None else df
    return filter_experiments(out, date_from, date_to, min_n, text if use_text else None, when=when)


def first_by_id(df: DataFrame, study_id: str, order: list[str]) -> DataFrame:
    return df.filter(F.col("study_id") == study_id).orderBy(*order).limit(1)


def search_archive(df: DataFrame, text=None, metric=None, min_n=None, date_from=None, date_to=None, use_dates: bool = False,
                   limit: int = 50, order=("study_id",)) -> DataFrame:
    out = filter_experiments(df, date_from if use_dates else None, date_to if use_dates else None, min_n, text)
    if metric:
        out = out.filter(F.col("metric") == metric)
    return out.orderBy(*order).limit(limit)


def segment_results(df: DataFrame, study_id: str, segment_by: str) -> DataFrame:
    """Entries of one segment map of one experiment; none when absent."""
    return df.filter(F.col("study_id") == study_id).select("study_id", F.explode(F.element_at("segments", segment_by)).alias("segment", "value"))


def collect_sources(sources: dict[str, DataFrame], year_from: int | None = None, when="day") -> DataFrame:
    """Union of the sources by name with a source column."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source", F.lit(name))
        if year_from is not None and when in df.columns:
            part = part.filter(F.col(when) >= F.make_date(F.lit(year_from), F.lit(1), F.lit(1)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# Words of a request -> analysis; metric words in order of preference.
ANALYSIS_WORDS = {"meta_analysis": ["meta-analysis", "meta analysis", "pool", "combine"], "publication_bias": ["bias", "funnel", "egger"],
                  "sensitivity": ["sensitivity", "robust", "leave-one-out"], "subgroup": ["subgroup", "segment", "stratif", "simpson"]}
METRIC_WORDS = ["conversion", "revenue", "retention"]
REQUEST_WORDS = {"interpretation": ["explain", "interpret"], "recommendations": ["recommend"], "benchmarking": ["compare", "benchmark"]}


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def classify_requests(df: DataFrame, text: str) -> DataFrame:
    """Analyses, model, filters and extra requests read from free text."""
    q = F.lower(text)
    kinds = F.array_compact(F.array(*[F.when(has_any(q, w), F.lit(k)) for k, w in ANALYSIS_WORDS.items()]))
    default = F.array(*[F.lit(k) for k in ("meta_analysis", "publication_bias", "sensitivity")])
    metric = F.when(q.contains(METRIC_WORDS[0]), METRIC_WORDS[0])
    for w in METRIC_WORDS[1:]:
        metric = metric.when(q.contains(w), w)
    number = lambda pattern: F.expr("try_cast(nullif(x, '') AS bigint)".replace("x", f"regexp_extract(lower({text}), r'{pattern}', 1)"))
    return df.withColumns({
        "analysis_types": F.when(F.size(kinds) > 0, kinds).otherwise(default),
        "model": F.when(q.contains("fixed effect"), "fixed").when(q.contains("random effect"), "random").otherwise("auto"),
        "min_sample_size": number(r"(?:sample|n)\s*(?:size)?[:\s>]+(\d+)"), "year_from": number(r"(?:from|since|after)\s+(\d{4})"),
        "metric_type": metric,
        "requests": F.array_compact(F.array(*[F.when(has_any(q, w), F.lit(k)) for k, w in REQUEST_WORDS.items()]))})


def enforce_constraints(df: DataFrame, domain: str) -> DataFrame:
    """Clip metrics, sizes, durations and rates into the ranges of a domain."""
    conf = lexicons.DOMAINS[domain]
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    out = df
    cols = set(df.columns)
    for c, (lo, hi) in conf["metrics"].items():
        if c in cols:
            out = out.withColumn(c, clip(F.col(c), lo, hi))
    whole = ["sample_size", "control_sample_size", "treatment_sample_size", "control_visitors", "variant_visitors",
             "control_conversions", "variant_conversions", "successes", "events"]
    out = out.withColumns({c: F.abs(F.col(c)).cast("long") for c in whole if c in cols})
    for arm in ("control", "variant"):
        if {f"{arm}_conversions", f"{arm}_visitors"} <= cols:
            out = out.withColumn(f"{arm}_conversions", F.least(f"{arm}_conversions", f"{arm}_visitors"))
    lo, hi = conf["sample_size"]
    for c in ("sample_size", "control_visitors", "variant_visitors"):
        if c in cols:
            out = out.withColumn(c, clip(F.col(c), lo if c == "sample_size" else lo // 2, hi).cast("long"))
    if "test_duration_days" in cols:
        out = out.withColumn("test_duration_days", clip(F.col("test_duration_days"), *conf["duration"]))
    return out.withColumns({c: clip(F.col(c), 0.001, 0.999) for c in df.columns if "rate" in c.lower()})


def segment_dimension(spark, domain: str | None = None) -> DataFrame:
    rows = [(d, s, v) for d, m in lexicons.SEGMENT_VALUES.items() if domain in (None, d) for s, vs in m.items() for v in vs]
    return spark.createDataFrame(rows, "domain string, segment string, value string")


def harmonize(df: DataFrame, target: str = "log_odds_ratio", baseline: float = 0.1) -> DataFrame:
    """Effects in one scale; rows that cannot be converted are dropped, originals go to metadata."""
    c = F.col
    same = c("effect_type") == target
    if target == "log_odds_ratio":
        rr = effects.risk_ratio_to_log_odds(c("effect"), F.lit(baseline))
        value = F.when(same, c("effect")).when(c("effect_type") == "cohens_d", effects.d_to_log_odds(c("effect"))).when(c("effect_type") == "risk_ratio", rr)
        se = F.when(same, c("se")).when(c("effect_type") == "cohens_d", c("se") * effects.D_TO_LOG_ODDS).when(c("effect_type") == "risk_ratio", F.sqrt(4 / c("total_n")))
    else:
        value = F.when(same, c("effect")).when(c("effect_type") == "log_odds_ratio", effects.log_odds_to_d(c("effect")))
        se = F.when(same, c("se")).when(c("effect_type") == "log_odds_ratio", c("se") / effects.D_TO_LOG_ODDS)
    origin = F.create_map(F.lit("original_effect_type"), c("effect_type"), F.lit("original_effect_size"), c("effect").cast("string"),
                          F.lit("original_se"), c("se").cast("string"))
    held = c("metadata") if "metadata" in df.columns else F.create_map().cast("map<string,string>")
    clean = F.map_filter(held, lambda k, _: ~F.array_contains(F.map_keys(origin), k))
    return df.withColumns({"new_effect": value, "new_se": se, "metadata": F.when(same, held).otherwise(F.map_concat(clean, origin))}).filter(
        c("new_effect").isNotNull())


def standard_metadata(df: DataFrame, date: str, platform: str = "platform") -> DataFrame:
    """Default keys of the metadata map; keys already present win."""
    base = F.create_map(F.lit("source_platform"), F.col(platform), F.lit("harmonized"), F.lit("true"), F.lit("harmonization_date"), F.lit(date))
    fresh = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys("metadata"), k))
    return df.withColumn("metadata", F.map_concat("metadata", fresh))


def convert_effect(value: Column, kind_from: Column, kind_to: Column, n: Column, baseline: Column) -> Column:
    """Struct (effect, se): through log odds; null for unsupported pairs."""
    log_odds = (F.when(kind_from == "log_odds_ratio", value).when(kind_from == "cohens_d", effects.d_to_log_odds(value))
                .when(kind_from == "risk_ratio", effects.risk_ratio_to_log_odds(value, baseline)))
    out = (F.when(kind_to == "log_odds_ratio", log_odds).when(kind_to == "cohens_d", effects.log_odds_to_d(log_odds))
           .when(kind_to == "risk_ratio", effects.log_odds_to_risk_ratio(log_odds, baseline)))
    return F.when(out.isNotNull(), F.struct(out.alias("effect"), effects.se_from_n(out, F.coalesce(n, F.lit(100)), kind_to).alias("se")))
