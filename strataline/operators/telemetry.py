"""Query logs and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import value_runs


def query_summary(log: DataFrame, by: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.avg(F.when(F.col("cached"), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg("latency").alias("mean_latency"),
                                F.avg("results").alias("mean_results"), F.avg("evaluation").alias("mean_evaluation"), F.count_if("error").alias("errors"))


def recent(log: DataFrame, order: str, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def latency(log: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """Mean and the value at position int(share * n) of the sorted list, from counts per distinct value."""
    s = log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    runs = value_runs(log, by, value).join(s, by)
    at = F.floor(F.lit(share) * F.col("n"))
    return runs.groupBy(*by, "n", "mean").agg(F.max(F.when((F.col("upto") - F.col("cnt") <= at) & (at < F.col("upto")), F.col(value))).alias("p95"))


def run_summary(metrics: DataFrame, run: str = "run_id") -> DataFrame:
    return metrics.groupBy(run).agg(F.count(F.lit(1)).alias("steps"), F.min("loss").alias("min_loss"), F.max("loss").alias("max_loss"), F.avg("loss").alias("avg_loss"),
                                    F.max_by("loss", "step").alias("final_loss"), (F.max("seconds") - F.min("seconds")).alias("duration"))


def system_row(log: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: queries, hits, documents, sources, chunks, hit rate; three one-row aggregates."""
    a = log.agg(F.count(F.lit(1)).alias("queries"), F.count_if("cached").alias("cache_hits"))
    b = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    return a.join(b, F.lit(True)).join(c, F.lit(True)).withColumn("hit_rate", F.when(F.col("queries") > 0, F.col("cache_hits") / F.col("queries")).otherwise(0.0))


def narrative_dashboard(nodes: DataFrame, edges: DataFrame, segments: DataFrame, states: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    s = segments.agg(F.count(F.lit(1)).alias("segments"))
    t = states.agg(F.count_distinct("character").alias("characters_tracked"))
    return n.join(e, F.lit(True)).join(s, F.lit(True)).join(t, F.lit(True))
