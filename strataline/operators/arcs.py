"""Character arcs: states(character, chapter, emotion, goals, relationships, knowledge, phase)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import any_hit
from .retrieval import top_k
from .scale import numbered, running, with_prior

C = "character"


def phase_of(chapter: Column) -> Column:
    out = F.lit(lexicons.PHASE_LIMITS[-1][1])
    for limit, name in reversed(lexicons.PHASE_LIMITS[:-1]):
        out = F.when(chapter <= limit, name).otherwise(out)
    return out


def shift_weight(before: Column, after: Column) -> Column:
    out = F.lit(0.5)
    for (a, b), w in lexicons.SHIFT_WEIGHTS.items():
        out = F.when((before == a) & (after == b), w).otherwise(out)
    return out


def transitions(states: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Significant changes between consecutive states of a character."""
    s = with_prior(states, [C], ["chapter"])
    c = F.col
    moved = F.size(F.array_except("prev_goals", "goals")) + F.size(F.array_except("goals", "prev_goals"))
    diffs = F.transform(F.array_union(F.map_keys("relationships"), F.map_keys("prev_relationships")), lambda k: F.abs(
        F.coalesce(F.try_element_at("relationships", k), F.lit(0.0)) - F.coalesce(F.try_element_at("prev_relationships", k), F.lit(0.0))))
    s = s.withColumn("rel", F.round(F.aggregate(diffs, F.lit(0.0), lambda a, x: a + x), 6))
    parts = {
        "w_emotion": F.when(c("emotion") != c("prev_emotion"), shift_weight(c("prev_emotion"), c("emotion"))),
        "w_goals": F.when(moved > 0, F.least(0.7 + 0.1 * moved, F.lit(1.0))),
        "w_rel": F.when(c("rel") > 0.3, F.least(c("rel"), F.lit(1.0))),
        "w_know": F.when(F.size(F.array_except("knowledge", "prev_knowledge")) > 0, 0.8),
        "w_phase": F.when(c("phase") != c("prev_phase"), 0.9),
    }
    s = s.withColumns(parts)
    there = F.array_compact(F.array(*parts))
    s = s.withColumn("magnitude", F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)))
    kind = (F.when(c("w_know").isNotNull(), "revelation").when(c("w_phase").isNotNull(), "arc_progression")
            .when(c("w_goals").isNotNull() & c("w_emotion").isNotNull(), "growth").when(c("w_rel") > 0.7, "reversal")
            .when(c("w_rel").isNotNull(), "relationship_shift").otherwise("gradual_change"))
    return s.filter(F.round("magnitude", 9) >= threshold).select(C, c("prev_chapter").alias("from_chapter"), c("chapter").alias("to_chapter"), kind.alias("transformation"), "magnitude")


def trigger_events(moves: DataFrame, chapter_events: DataFrame) -> DataFrame:
    """Last event in the chapters of a move; chapter_events holds (chapter, seq, name)."""
    last = chapter_events.groupBy("chapter").agg(F.max_by("name", "seq").alias("name"))
    spread = moves.withColumn("chapter", F.explode(F.sequence("from_chapter", "to_chapter")))
    hit = spread.join(last, "chapter").groupBy(C, "from_chapter", "to_chapter").agg(F.max_by("name", "chapter").alias("trigger"))
    return moves.join(hit, [C, "from_chapter", "to_chapter"], "left").withColumn("trigger", F.coalesce("trigger", F.lit("unknown_catalyst")))


def trajectory(states: DataFrame) -> DataFrame:
    """Shape of the arc from the first and the last state."""
    total = F.aggregate(F.map_values("relationships"), F.lit(0.0), lambda a, x: a + x)
    s = states.withColumn("_s", F.struct("emotion", F.size("goals").alias("g"), F.round(total, 6).alias("r")))
    g = s.groupBy(C).agg(F.count(F.lit(1)).alias("n"), F.min_by("_s", "chapter").alias("a"), F.max_by("_s", "chapter").alias("b"))
    good = lambda x: F.col(f"{x}.emotion").isin(*lexicons.POSITIVE_EMOTIONS)
    one = lambda t: F.when(t, 1).otherwise(0)
    c = F.col
    up = one(c("b.g") > c("a.g")) + one(c("b.r") > c("a.r")) + one(good("b"))
    down = one(c("b.g") < c("a.g")) + one(c("b.r") < c("a.r")) + one(good("a") & ~good("b"))
    shape = F.when(c("n") < 3, "early_development").when(up > down, "ascending_arc").when(down > up, "descending_arc").otherwise("flat_arc")
    return g.select(C, "n", shape.alias("trajectory"))


def relationship_evolution(states: DataFrame) -> DataFrame:
    return states.select(C, "chapter", F.explode("relationships").alias("other", "strength"))


def themes(states: DataFrame, k: int = 3) -> DataFrame:
    """The most frequent goals and emotions, ties by name."""
    goals = states.select(C, F.explode("goals").alias("theme"), F.lit(0).alias("kind"))
    moods = states.select(C, F.col("emotion").alias("theme"), F.lit(1).alias("kind"))
    n = goals.unionByName(moods).groupBy(C, "kind", "theme").agg(F.count(F.lit(1)).alias("n"))
    return top_k(n, [C, "kind"], [F.desc("n"), "theme"], k).select(C, "theme").distinct()


def state_as_of(requests: DataFrame, states: DataFrame) -> DataFrame:
    """State at or before the asked chapter. A running count over both tables gives the state's number, then an equi-join fetches it."""
    marks = states.select(C, "chapter", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("request")).unionByName(
        requests.select(C, "chapter", F.lit(1).alias("kind"), F.col("request").cast("long").alias("request")))
    at = running(marks, [C], ["chapter", "kind", "request"], {"k": F.when(F.col("kind") == 0, 1).otherwise(0).cast("long")})
    wanted = at.filter("kind = 1").select(C, "request", F.col("chapter").alias("asked"), F.col("k").alias("rn"))
    return wanted.join(numbered(states, [C], ["chapter"]), [C, "rn"], "left").drop("rn")


def latest(states: DataFrame) -> DataFrame:
    rest = [c for c in states.columns if c not in (C, "chapter")]
    return states.groupBy(C).agg(F.max("chapter").alias("chapter"), *[F.max_by(c, "chapter").alias(c) for c in rest])


def next_phase(phase: Column) -> Column:
    order = F.array(*[F.lit(p) for p in lexicons.PHASES])
    at = F.array_position(order, phase).cast("int")
    return F.when(at == 0, "resolution").when(at < len(lexicons.PHASES), F.element_at(order, F.least(at + 1, F.lit(len(lexicons.PHASES))))).otherwise("resolution")


def infer_emotion(text: Column, name: Column) -> Column:
    low = F.lower(text)
    out = F.lit("neutral")
    for mood, words in reversed(lexicons.EMOTION_WORDS.items()):
        out = F.when(any_hit(low, words), mood).otherwise(out)
    return F.when(F.contains(low, F.lower(name)), out).otherwise("neutral")


def extract_goals(text: Column, name: Column, limit: int = 3) -> Column:
    """What follows a goal phrase in sentences that name the character, 50 characters each."""
    def of(sentence):
        low = F.lower(sentence)
        return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.substring(F.trim(F.split(low, p)[1]), 1, 50)) for p in lexicons.GOAL_PHRASES]))
    named = F.filter(F.split(text, r"\."), lambda s: F.contains(F.lower(s), F.lower(name)))
    return F.slice(F.filter(F.flatten(F.transform(named, of)), lambda g: g != ""), 1, limit)


def observed_states(segments: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Emotion, goals and phase of each listed name a segment mentions."""
    s = segments.withColumn("name", F.explode(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower("text"), F.lower(n)))))
    return s.select(*keys, "name", infer_emotion(F.col("text"), F.col("name")).alias("emotion"), extract_goals(F.col("text"), F.col("name")).alias("goals"), phase_of(F.col("chapter")).alias("phase"))


def emotion_value(mood: Column) -> Column:
    out = F.lit(0.5)
    for k, v in lexicons.EMOTION_VALUES.items():
        out = F.when(F.lower(mood) == k, v).otherwise(out)
    return out


def abrupt_changes(states: DataFrame, limit: float = 0.7) -> DataFrame:
    s = with_prior(states.select(C, "chapter", "emotion"), [C], ["chapter"])
    jump = F.round(F.abs(emotion_value(F.col("emotion")) - emotion_value(F.col("prev_emotion"))), 6)
    return s.withColumn("jump", jump).filter(F.col("jump") > limit).select(C, "chapter", F.col("prev_emotion").alias("from_emotion"), "emotion", "jump")
