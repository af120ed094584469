"""Structured Streaming jobs. Each takes a streaming DataFrame and gives a streaming DataFrame or a started query."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.feedback import START, average, step
from ..operators.textprep import redact
from .ordered import decisions, rocksdb


def table_stream(spark: SparkSession, folder: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table (file or folder) as a stream with the schema of the stored files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return r.parquet(f"{folder}/{table}.parquet")
    return r.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def drain(df: DataFrame, path: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there, with a checkpoint next to the output, and stop."""
    with rocksdb(df.sparkSession):
        q = (df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return q


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp, which watermarks and windows work on."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def window_counts(events: DataFrame, size: str, slide: str | None, by: list[str], delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Requests and latency per event-time window and key."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return timed(events, ts).withWatermark(ts, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean")


def sessions(events: DataFrame, gap: str, by: list[str], delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    return timed(events, ts).withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def dedupe(events: DataFrame, key: str, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """First row per content key; keys are forgotten behind the watermark."""
    return timed(events, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def admit(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Admission decisions for sorted times; only admitted requests count against the limit."""
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def admissions(events: DataFrame, key: str, limit: int, window: float, ts: str = "ts", row: str = "event_id", delay: str = "10 minutes", grain: float = 60.0, buckets: int = 256) -> DataFrame:
    """Per-key request limit in event time, as a decision stream: (key, row, admitted), see :func:`ordered.decisions`.

    A key remembers at most ``limit`` times, and none that are ``window``
    seconds old.
    """

    def fold(times: list[float], held: list[float]) -> tuple[list[bool], list[float], float]:
        ok, held = admit(times, held, limit, window)
        return ok, held, (held[-1] if held else times[-1]) + window

    return decisions(events, key, row, ts, fold, "admitted", delay, grain, buckets)


def expire(times: list[float], born: float | None, ttl: float) -> tuple[list[bool], float | None]:
    """Cache hits for sorted lookups of one key; a miss inserts."""
    out = []
    for t in times:
        hit = born is not None and t - born <= ttl
        born = born if hit else t
        out.append(hit)
    return out, born


def ttl_cache(events: DataFrame, key: str, ttl: float, ts: str = "ts", row: str = "event_id", delay: str = "10 minutes", grain: float = 60.0, buckets: int = 256) -> DataFrame:
    """Cache lookups in event time with entries that expire ``ttl`` seconds after insertion: (key, row, hit), see :func:`ordered.decisions`."""

    def fold(times: list[float], held: list[float]) -> tuple[list[bool], list[float], float]:
        hits, born = expire(times, held[0] if held else None, ttl)
        return hits, [born], born + ttl

    return decisions(events, key, row, ts, fold, "hit", delay, grain, buckets)


def daily_studies(events: DataFrame, path: str, delay: str = "2 days", ts: str = "ts") -> StreamingQuery:
    """Counts per day, metric and arm in update mode; every micro-batch writes its changed rows with its number."""
    per = timed(events, ts).withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), F.col("event_type").alias("metric")).agg(
        F.count_if(F.col("user_id") % 2 == 0).alias("control_conversions"), F.count_if(F.col("user_id") % 2 == 1).alias("treatment_conversions"))
    rows = per.select(F.to_date("w.start").alias("day"), "metric", "control_conversions", "treatment_conversions")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def current_rows(updates: DataFrame, keys: list[str], version: str = "batch") -> DataFrame:
    """Latest version per key of an update log."""
    rest = [c for c in updates.columns if c not in (*keys, version)]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")


def online_weights(feedback: DataFrame) -> DataFrame:
    """Approach weights after every batch of ratings, per story; the state is the three weights."""

    def learn(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, *START.values())
        n, w = held[0], dict(zip(START, held[1:]))
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            w, n = step(w, r.approach, r.mean, r.selected_best), n + 1
        state.update((n, *w.values()))
        yield pd.DataFrame([(k[0], n, *w.values())], columns=["story", "n", *START])

    rows = feedback.select("story", "seq", "approach", average().alias("mean"), "selected_best")
    return rows.groupBy("story").applyInPandasWithState(learn, "story long, n long, unified double, graph double, hybrid double",
                                                        "n long, unified double, graph double, hybrid double", "update", GroupStateTimeout.NoTimeout)


def redacted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stateless redaction with the number of findings, ready for an append sink."""
    clean, n = redact(F.col(text))
    return docs.select(key, clean.alias(text), n.alias("findings"))
