"""Consistency checks of segments(story, chapter, approach, text); each gives rows (keys, check, severity, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import any_hit
from .coherence import tokens
from .entities import names

K = ["story", "chapter", "approach"]


def _row(df: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    return df.select(*K, F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))


def name_variants(segments: DataFrame, entities: DataFrame) -> DataFrame:
    """Texts that use two known names with the same first word."""
    low = F.transform(names(F.col("text")), F.lower)
    used = F.array_distinct(F.concat(low, F.transform(low, lambda n: F.split(n, " ")[0])))
    m = segments.select(*K, F.explode(used).alias("name")).join(entities.select(F.lower("name").alias("name")).distinct(), "name", "left_semi")
    g = m.groupBy(*K, F.split("name", " ")[0].alias("base")).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("a"), F.max("name").alias("b"))
    return _row(g.filter("n > 1"), "name_inconsistency", "minor", F.concat(F.lit("Mixed name references: "), "a", F.lit(" and "), "b"))


def contradictions(with_prev: DataFrame) -> DataFrame:
    """A state named in the last three segments and its opposite for the same subject now."""
    before, now = F.lower(F.array_join("prev", " ")), F.lower("text")
    subject = lambda tail: F.array_distinct(F.regexp_extract_all(before, F.lit(r"(\w+) " + tail), F.lit(1)))
    again = lambda tail, ends: F.exists(subject(tail), lambda s: _ors([F.contains(now, F.concat(s, F.lit(" " + e))) for e in ends]))
    tests = [("alive then dead", again("was alive", ["was dead", "had been dead"])), ("dead then alive", again("was dead", ["was alive", "is alive"])),
             ("trusted then hated", again("trusted", ["hated", "distrusted"])),
             ("morning then night", before.contains("in the morning") & now.contains("at night")),
             ("bright then dark", (before.contains("it was bright") | before.contains("it was sunny")) & (now.contains("it was dark") | now.contains("it was night")))]
    hit = with_prev.filter(F.size("prev") > 0).withColumn("d", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))))
    return _row(hit, "contradiction", "major", F.col("d"))


def _ors(tests):
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def temporal_errors(segments: DataFrame) -> DataFrame:
    low = F.lower("text")
    bad = F.array_contains(tokens(F.col("text")), "before") & (low.contains("will") | low.contains("going to")) & low.rlike("before.*will")
    return _row(segments.filter(bad), "temporal_error", "minor", F.lit("before with future tense"))


def relationship_violations(segments: DataFrame, mentions: DataFrame, ties: DataFrame) -> DataFrame:
    """Both ends of a tie in one text together with behaviour that contradicts it.

    Ties meet texts through the mention rows (story, chapter, name), never all with all.
    """
    m = mentions.select("story", "chapter", F.lower("name").alias("source"))
    both = m.join(ties.filter(F.col("relation").isin(*lexicons.CONTRARY_BEHAVIOUR)).select(F.lower("source").alias("source"), F.lower("target").alias("target"), "relation").distinct(), "source")
    both = both.join(m.withColumnRenamed("source", "target"), ["story", "chapter", "target"], "left_semi")
    phrases = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(p).alias("p")) for r, ps in lexicons.CONTRARY_BEHAVIOUR.items() for p in ps])
    low = F.lower("text")
    found = segments.select(*K, F.explode(F.filter(phrases, lambda x: F.contains(low, x.p))).alias("x")).select(*K, F.col("x.r").alias("relation"), F.col("x.p").alias("phrase"))
    hit = found.join(both, ["story", "chapter", "relation"])
    return _row(hit, "relationship_violation", "major", F.concat_ws(" ", "phrase", F.lit("contradicts"), "relation", F.lit("of"), "source", "target"))


def state_violations(segments: DataFrame, mentions: DataFrame, latest: DataFrame) -> DataFrame:
    """Phrases against the latest emotion of a mentioned name; latest holds (story, name, emotion)."""
    phrases = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(p).alias("p")) for e, ps in lexicons.CONTRARY_EMOTION.items() for p in ps])
    low = F.lower("text")
    found = segments.select(*K, F.explode(F.filter(phrases, lambda x: F.contains(low, x.p))).alias("x")).select(*K, F.col("x.e").alias("emotion"), F.col("x.p").alias("phrase"))
    who = mentions.join(latest, ["story", "name"])
    hit = found.join(who, ["story", "chapter", "emotion"])
    return _row(hit, "character_state_violation", "major", F.concat_ws(" ", "name", F.lit("acts"), "phrase", F.lit("despite being"), "emotion"))


def location_violations(segments: DataFrame, mentions: DataFrame, located: DataFrame, places: list[str]) -> DataFrame:
    """A name in a text that names another place with a static phrase; located holds (name, place)."""
    low = F.lower("text")
    other = segments.filter(any_hit(low, lexicons.STATIC_PLACES)).select(
        *K, F.explode(F.filter(F.array(*[F.lit(p.lower()) for p in places]), lambda p: F.contains(low, p))).alias("there"))
    who = mentions.select("story", "chapter", "name").join(located.select("name", F.lower("place").alias("place")), "name")
    hit = other.join(who, ["story", "chapter"]).filter(F.col("there") != F.col("place"))
    return _row(hit, "location_impossibility", "critical", F.concat_ws(" ", "name", F.lit("in"), "there", F.lit("but established in"), "place"))


def report(violations: DataFrame, by: list[str] = ["story"]) -> DataFrame:
    """Counts by check and severity, and the score."""
    checks = ["name_inconsistency", "contradiction", "temporal_error", "relationship_violation", "character_state_violation", "location_impossibility"]
    w = F.lit(0.1)
    for s, x in lexicons.SEVERITY_WEIGHTS.items():
        w = F.when(F.col("severity") == s, x).otherwise(w)
    g = violations.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("check") == x).alias(x) for x in checks],
                                    *[F.count_if(F.col("severity") == s).alias(s) for s in lexicons.SEVERITY_WEIGHTS], F.sum(w).alias("_p"))
    return g.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("_p"))).drop("_p")


def prevented(violations: DataFrame) -> DataFrame:
    """Details that occur for the unified approach of a story but not for its graph approach."""
    u = violations.filter("approach = 'unified'").select("story", "detail").distinct()
    return u.join(violations.filter("approach = 'graph'").select("story", "detail").distinct(), ["story", "detail"], "left_anti")
