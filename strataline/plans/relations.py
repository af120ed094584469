"""Source tables and the relations derived from them, each with its SQL twin."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.effects import log_odds_ratio, log_odds_se
from ..operators.scale import settle
from . import stories
from .registry import cte


def r6(c, name: str | None = None) -> Column:
    """Six digits for comparison; adding zero turns -0.0 into 0.0."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 6) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


#: Turns of conversations that a task reads: many compress into one split of a file.
TURNS = 4_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Give text work to every core when the scan has fewer splits than cores, or than tasks of so many ``rows``.

    A small file is one split; a large table has many, and is left as it is.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        want = max(want, math.ceil(df.count() / rows))
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


class Tables:
    """Lazy access to the parquet tables of one folder and to derived relations."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        df = spread(df, TURNS if name == "conversations" else None) if name in ("documents", "conversations", "pages") else df
        self.__dict__[name] = df  # the footer is read once per query
        return df

    @cached_property
    def studies_events(self) -> DataFrame:
        return settle(studies_events(self.events))  # pooling reads a study table several times

    @cached_property
    def studies_tpch(self) -> DataFrame:
        return settle(studies_tpch(self.lineitem, self.part))

    @cached_property
    def segments(self) -> DataFrame:
        return stories.segments(self.conversations)

    @cached_property
    def char_states(self) -> DataFrame:
        return stories.char_states(self.events)

    @cached_property
    def feedback(self) -> DataFrame:
        return stories.feedback(self.events)

    @cached_property
    def g_nodes(self) -> DataFrame:
        return settle(stories.g_nodes(self), "type", "zstd")

    @cached_property
    def g_edges(self) -> DataFrame:
        return settle(stories.g_edges(self), "relation", "zstd")


def with_effects(counts: DataFrame) -> DataFrame:
    """Add effect, se, variance and weight to rows with the four counts, dropping invalid rows."""
    ok = ((F.col("control_total") > 0) & (F.col("treatment_total") > 0)
          & (F.col("control_conversions") >= 0) & (F.col("treatment_conversions") >= 0)
          & (F.col("control_conversions") <= F.col("control_total"))
          & (F.col("treatment_conversions") <= F.col("treatment_total")))
    cells = [F.col("control_conversions"), F.col("control_total") - F.col("control_conversions"),
             F.col("treatment_conversions"), F.col("treatment_total") - F.col("treatment_conversions")]
    out = counts.filter(ok).withColumns({"effect": log_odds_ratio(*cells), "se": log_odds_se(*cells)})
    return out.withColumns({
        "variance": F.col("se") * F.col("se"),
        "total_n": F.col("control_total") + F.col("treatment_total")})


def studies_events(events: DataFrame) -> DataFrame:
    """One study per day and event type; the arm is the parity of the user."""
    per = events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("metric")).agg(
        F.count_if(F.col("user_id") % 2 == 0).alias("control_conversions"),
        F.count_if(F.col("user_id") % 2 == 1).alias("treatment_conversions"))
    totals = per.groupBy("day").agg(F.sum("control_conversions").alias("control_total"),
                                    F.sum("treatment_conversions").alias("treatment_total"))
    s = with_effects(per.join(totals, "day"))
    return s.select(
        F.concat_ws("|", F.col("day").cast("string"), "metric").alias("study_id"),
        F.concat(F.lit("Test of "), "metric", F.lit(" on "), F.col("day").cast("string")).alias("study_name"),
        "metric", "day", F.dayofweek("day").cast("string").alias("segment"),
        F.datediff("day", F.lit("2024-01-01").cast("date")).alias("covariate"),
        "control_conversions", "control_total", "treatment_conversions", "treatment_total",
        "effect", "se", "variance", "total_n")


def studies_tpch(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One study per ship month and brand; conversion means returned.

    A part has fewer line items than there are months, so counting before the
    join would not shrink anything; the join feeds the partial aggregation.
    """
    arm = F.col("l_linenumber") % 2
    back = F.col("l_returnflag") == "R"
    j = lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_linenumber", "l_returnflag", "l_shipdate").join(part.select("p_partkey", "p_brand"), "p_partkey")
    s = j.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("p_brand").alias("brand")).agg(
        F.count_if((arm == 0) & back).alias("control_conversions"), F.count_if(arm == 0).alias("control_total"),
        F.count_if((arm == 1) & back).alias("treatment_conversions"), F.count_if(arm == 1).alias("treatment_total"))
    return with_effects(s).withColumn("study_id", F.concat_ws("|", "month", "brand"))


_EFFECT = """
  ln(((tc+cc0)/(tt-tc+cc0))/((cc+cc0)/(ct-cc+cc0))) AS effect,
  sqrt(1/(cc+cc0)+1/(ct-cc+cc0)+1/(tc+cc0)+1/(tt-tc+cc0)) AS se
"""

cte("studies_events", f"""
SELECT *, se*se AS variance, ct+tt AS total_n, cc AS control_conversions, ct AS control_total,
       tc AS treatment_conversions, tt AS treatment_total FROM (
SELECT strftime(day,'%Y-%m-%d')||'|'||metric AS study_id, 'Test of '||metric||' on '||strftime(day,'%Y-%m-%d') AS study_name,
  metric, day, CAST(dayofweek(day)+1 AS VARCHAR) AS segment, date_diff('day', DATE '2024-01-01', day) AS covariate,
  cc, ct, tc, tt, {_EFFECT}
FROM (SELECT *, CASE WHEN cc=0 OR ct=cc OR tc=0 OR tt=tc THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS cc0 FROM (
  SELECT p.*, CAST(sum(cc) OVER (PARTITION BY day) AS BIGINT) AS ct, CAST(sum(tc) OVER (PARTITION BY day) AS BIGINT) AS tt FROM (
    SELECT CAST(ts AS DATE) AS day, event_type AS metric, count(*) FILTER (user_id%2=0) AS cc, count(*) FILTER (user_id%2=1) AS tc
    FROM events GROUP BY 1,2) p)
  WHERE ct>0 AND tt>0))
""")

cte("studies_tpch", f"""
SELECT *, se*se AS variance, ct+tt AS total_n, cc AS control_conversions, ct AS control_total,
       tc AS treatment_conversions, tt AS treatment_total FROM (
SELECT month||'|'||brand AS study_id, month, brand, cc, ct, tc, tt, {_EFFECT}
FROM (SELECT *, CASE WHEN cc=0 OR ct=cc OR tc=0 OR tt=tc THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS cc0 FROM (
    SELECT strftime(l_shipdate,'%Y-%m') AS month, p_brand AS brand,
      count(*) FILTER (l_linenumber%2=0 AND l_returnflag='R') AS cc, count(*) FILTER (l_linenumber%2=0) AS ct,
      count(*) FILTER (l_linenumber%2=1 AND l_returnflag='R') AS tc, count(*) FILTER (l_linenumber%2=1) AS tt
    FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2) WHERE ct>0 AND tt>0))
""")


def pool_sql(src: str, keys: str) -> str:
    """Pooling of a study relation per group, written with centred second passes."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"s.{k}=g.{k}" for k in ks)
    gk = ",".join(f"g.{k}" for k in ks)
    return f"""
SELECT *, swy/sw AS fe_effect, 1/sqrt(sw) AS fe_se, rwy/rw AS re_effect, 1/sqrt(rw) AS re_se FROM (
 SELECT {gk}, g.k, g.df, g.q, g.i2, g.tau2, g.h2, g.sw, g.swy, sum(1/(s.variance+g.tau2)) AS rw,
   sum(s.effect/(s.variance+g.tau2)) AS rwy
 FROM {src} s JOIN (
  SELECT *, CASE WHEN q>0 THEN greatest(0,(q-df)/q*100) ELSE 0 END AS i2,
    CASE WHEN sw-sw2/sw>0 THEN greatest(0,(q-df)/(sw-sw2/sw)) ELSE 0 END AS tau2,
    CASE WHEN df>0 THEN q/df ELSE 1 END AS h2 FROM (
   SELECT {gk}, g.k, g.k-1 AS df, g.sw, g.sw2, g.swy, sum((s.effect-g.swy/g.sw)*(s.effect-g.swy/g.sw)/s.variance) AS q
   FROM {src} s JOIN (SELECT {keys}, count(*) AS k, sum(1/variance) AS sw, sum(1/variance/variance) AS sw2,
      sum(effect/variance) AS swy FROM {src} GROUP BY {keys}) g ON {on}
   GROUP BY {gk}, g.k, g.sw, g.sw2, g.swy)) g ON {on}
 GROUP BY {gk}, g.k, g.df, g.q, g.i2, g.tau2, g.h2, g.sw, g.swy)"""


cte("pool_ev", pool_sql("studies_events", "metric"))
cte("pool_tp", pool_sql("studies_tpch", "brand"))
cte("pool_seg", pool_sql("studies_events", "metric, segment"))
