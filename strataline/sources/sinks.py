"""Writers. Appends go to partitioned tables; nothing is gathered before it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def archive_experiments(studies: DataFrame, path: str, archived_at: str | None = None) -> None:
    """Append studies under the key exp_<id>_<time>, partitioned by metric."""
    at = F.to_timestamp(F.lit(archived_at)) if archived_at else F.current_timestamp()
    rows = studies.withColumn("archived_at", at).withColumn(
        "archive_id", F.concat_ws("_", F.lit("exp"), "study_id", F.date_format("archived_at", "yyyyMMddHHmmss")))
    rows.write.mode("append").partitionBy("metric").parquet(path)


def archive_analysis(result: DataFrame, studies: DataFrame, by: list[str], path: str, archived_at: str | None = None) -> None:
    """Append pooled rows and, as rows of a second table, the studies they are made of."""
    at = F.to_timestamp(F.lit(archived_at)) if archived_at else F.current_timestamp()
    result.withColumn("archived_at", at).write.mode("append").parquet(f"{path}/results")
    studies.select(*by, "study_id").withColumn("archived_at", at).write.mode("append").parquet(f"{path}/members")


def audit_entries(df: DataFrame, user: str, action: str, details: dict, at: str) -> DataFrame:
    return df.select(F.struct(F.col(at).cast("string").alias("timestamp"), F.col(user).cast("string").alias("user_id"), F.col(action).alias("action"),
                              F.struct(*[F.col(s).alias(d) for d, s in details.items()]).alias("details")).alias("e")).select(F.to_json("e").alias("value"))


def audit_log(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").text(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_index(postings: DataFrame, statistics: DataFrame, vectors: DataFrame, path: str, buckets: int = 64) -> None:
    """Index tables laid out by term bucket, so later joins read only what they need.

    Each task of the postings writes its share of every bucket, so none gathers
    a bucket. The writers of all buckets are open at once, so nothing is sorted.
    """
    spark, writers = postings.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, None)
    spark.conf.set(writers, str(buckets))
    try:
        postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    finally:
        spark.conf.set(writers, before) if before else spark.conf.unset(writers)
    statistics.write.mode("overwrite").parquet(f"{path}/terms")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings").drop("bucket"), spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/vectors")


def narrative_lines(segments: DataFrame, title: str = "title") -> DataFrame:
    """Markdown lines per story: title, a header per chapter, then its segments in order."""
    head = segments.select("story", title).distinct().select("story", F.lit(-1).cast("long").alias("chapter"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("# "), title).alias("line"))
    chapters = segments.select("story", "chapter").distinct().select("story", "chapter", F.lit(1).alias("part"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("## Chapter "), F.col("chapter").cast("string")).alias("line"))
    body = segments.select("story", "chapter", F.lit(2).alias("part"), F.col("seq").cast("long").alias("seq"), F.col("text").alias("line"))
    return head.unionByName(chapters).unionByName(body)


def feedback(df: DataFrame, path: str) -> None:
    names = ["overall", "consistency", "creativity", "character_authenticity", "plot_coherence"]
    df.select(*[c for c in df.columns if c not in names], F.struct(*names).alias("ratings")).write.mode("overwrite").json(path)
