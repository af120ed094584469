"""Streaming queries: a table is streamed to the end and the output is read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..streaming import jobs
from . import stories
from .q_meta import rounded, sql6
from .q_narrative import WEIGHTS
from .q_sources import scratch
from .q_text import _redact_sql
from .registry import query

c = F.col


def events(t):
    return jobs.table_stream(t.spark, t.folder, "events")


def finished(t, df, name, mode="append"):
    path = scratch(t, name)
    jobs.drain(df, path, mode)
    return t.spark.read.parquet(f"{path}/out")


def in_event_order(t, name, job):
    """A decision stream over the events in files of any order, one per micro-batch; then a last row that only moves the watermark.

    The watermark trails by the span of the events, as the first file may have
    the last of them. Buckets of users rise with the events, so what a task
    holds of one does not.
    """
    path = scratch(t, name)
    e = t.events.select("event_id", "user_id", "ts")
    e.repartition(3, F.xxhash64("event_id")).write.parquet(f"{path}/in")
    first, last, n = e.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    span = last - first if last else dt.timedelta(0)
    s = lambda: job(t.spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), delay=f"{int(span.total_seconds()) + 1} seconds", buckets=max(64, n // 50_000))
    jobs.drain(s(), path)
    if last:
        closing = t.spark.createDataFrame([(None, None, last + 2 * span + dt.timedelta(days=1))], e.schema)
        closing.write.mode("append").parquet(f"{path}/in")
        jobs.drain(s(), path)
    return t.spark.read.parquet(f"{path}/out")


STAMP = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")


_SEQ = "SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events"


@query("st1_admissions", f"""WITH RECURSIVE e AS ({_SEQ}), s AS (SELECT user_id, event_id, i, true AS ok, [t] AS held FROM e WHERE i=1 UNION ALL
 SELECT user_id, event_id, i, len(live)<3, CASE WHEN len(live)<3 THEN list_append(live, t) ELSE live END FROM (SELECT e.user_id, e.event_id, e.i, e.t, list_filter(s.held, lambda h: h>e.t-21600) AS live FROM s JOIN e ON e.user_id=s.user_id AND e.i=s.i+1))
SELECT user_id AS key, event_id AS "row", ok AS admitted FROM s""")
def _(t):
    return in_event_order(t, "admissions", lambda s, **how: jobs.admissions(s, "user_id", 3, 6 * 3600.0, grain=86400.0, **how))


@query("st1_sliding_counts", """SELECT strftime(s,'%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01')-INTERVAL '1 hour']) AS s FROM events)
 WHERE s+INTERVAL '2 hours'<=(SELECT max(ts)-INTERVAL '10 minutes' FROM events) GROUP BY 1,2""")
def _(t):
    w = jobs.window_counts(events(t), "2 hours", "1 hour", ["user_id"])
    return finished(t, w, "sliding").select(STAMP("start").alias("start"), "user_id", "n")


@query("st2_tumbling", f"SELECT strftime(s,'%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, {sql6('avg(value) AS mean')} FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') AS s FROM events) WHERE s+INTERVAL '1 hour'<=(SELECT max(ts)-INTERVAL '10 minutes' FROM events) GROUP BY s, event_type")
def _(t):
    w = jobs.window_counts(events(t), "1 hour", None, ["event_type"])
    return rounded(finished(t, w, "tumbling").select(STAMP("start").alias("start"), "event_type", "n", "mean"))


@query("st2_sessions", """WITH g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts>=lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)+INTERVAL '2 hours' THEN 1 ELSE 0 END AS b FROM events))
SELECT user_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, g HAVING max(ts)+INTERVAL '2 hours'<=(SELECT max(ts)-INTERVAL '10 minutes' FROM events)""")
def _(t):
    s = jobs.sessions(events(t), "2 hours", ["user_id"])
    return finished(t, s, "sessions").select("user_id", STAMP("start").alias("start"), "n")


@query("st3_dedupe", "SELECT DISTINCT md5(event_id||'|'||event_type) AS hash, event_type FROM events")
def _(t):
    e = events(t)
    twice = e.unionByName(e).withColumn("hash", F.md5(F.concat_ws("|", c("event_id").cast("string"), "event_type")))
    return finished(t, jobs.dedupe(twice, "hash", "40 days"), "dedupe").select("hash", "event_type")


@query("st4_ttl_cache", f"""WITH RECURSIVE e AS ({_SEQ}), s AS (SELECT user_id, event_id, i, false AS hit, t AS born FROM e WHERE i=1 UNION ALL
 SELECT e.user_id, e.event_id, e.i, e.t-s.born<=3600, CASE WHEN e.t-s.born<=3600 THEN s.born ELSE e.t END FROM s JOIN e ON e.user_id=s.user_id AND e.i=s.i+1)
SELECT user_id AS key, event_id AS "row", hit FROM s""")
def _(t):
    return in_event_order(t, "ttl", lambda s, **how: jobs.ttl_cache(s, "user_id", 3600.0, grain=86400.0, **how))


@query("st5_daily_studies", "SELECT strftime(CAST(ts AS DATE),'%Y-%m-%d') AS day, event_type AS metric, count(*) FILTER (user_id%2=0) AS control_conversions, count(*) FILTER (user_id%2=1) AS treatment_conversions FROM events GROUP BY 1,2")
def _(t):
    path = scratch(t, "studies")
    jobs.daily_studies(events(t), path)
    rows = jobs.current_rows(t.spark.read.parquet(f"{path}/out"), ["day", "metric"])
    return rows.select(c("day").cast("string").alias("day"), "metric", "control_conversions", "treatment_conversions")


@query("st6_online_weights", f"SELECT story, n, unified, graph, hybrid FROM ({WEIGHTS})")
def _(t):
    path = scratch(t, "weights")
    done = []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        done.append(number)

    q = jobs.online_weights(stories.feedback(events(t))).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(jobs.current_rows(t.spark.read.parquet(f"{path}/out"), ["story"]))


@query("st7_stream_redaction", f"SELECT doc_id, md5(x) AS redacted_md5, CAST(n AS INT) AS findings FROM ({_redact_sql('text')})")
def _(t):
    docs = jobs.table_stream(t.spark, t.folder, "documents")
    return finished(t, jobs.redacted(docs, "doc_id", "text"), "redacted").select("doc_id", F.md5("text").alias("redacted_md5"), "findings")


@query("st8_late_data", """WITH e AS (SELECT *, event_id%10 AS k, CASE WHEN event_id%10=0 THEN ts-INTERVAL '12 hours' ELSE ts END AS moved FROM events),
 w AS (SELECT max(ts) FILTER (k>1)-INTERVAL '1 day' AS m1, max(ts) FILTER (k>0)-INTERVAL '1 day' AS m2 FROM e),
 u AS (SELECT time_bucket(INTERVAL '1 day', moved, TIMESTAMP '2000-01-01') AS s, k FROM e)
SELECT strftime(s,'%Y-%m-%d') AS day, count(*) AS n FROM u, w WHERE s+INTERVAL '1 day'<=m2 AND (k>1 OR s+INTERVAL '1 day'>CASE k WHEN 1 THEN m1 ELSE m2 END) GROUP BY s""")
def _(t):
    """Three parts of the events, the third twelve hours late; windows that a part has closed drop what comes later.

    Each part is written by as many tasks as hold it and drained by a run of
    its own on one checkpoint, so the order of the parts doesn't hang on files.
    """
    path = scratch(t, "late")
    e = t.events.select("event_id", "ts", "value")
    for k, part in enumerate(("event_id % 10 > 1", "event_id % 10 = 1", "event_id % 10 = 0")):
        rows = e.filter(part)
        if k == 2:
            rows = rows.withColumn("ts", c("ts") - F.expr("INTERVAL 12 HOURS"))
        rows.write.mode("append").parquet(f"{path}/in")
        s = t.spark.readStream.schema(e.schema).parquet(f"{path}/in")
        jobs.drain(jobs.window_counts(s, "1 day", None, [], "1 day"), f"{path}/done")
    return t.spark.read.parquet(f"{path}/done/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")
