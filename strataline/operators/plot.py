"""Tropes, plot points, pacing, foreshadowing, story health and suggestions over segments(story, chapter, .., text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import count_hits, head, sentences, strip, words
from . import arcs, graph
from .retrieval import top_k
from .scale import settle, with_prior

K = ["story", "chapter"]


def tropes(segments: DataFrame, names: list[str]) -> DataFrame:
    """First chapter of each trope per story with confidence, evidence and involved names.

    The words found become rows that are counted per (segment, trope); the
    texts themselves are not shuffled until the first chapters are known.
    """
    spec = [(t, i, k, False) for t, (_, keys, _, _) in lexicons.TROPES.items() for i, k in enumerate(keys)]
    spec += [(t, -1, k, True) for t, (_, _, anti, _) in lexicons.TROPES.items() for k in anti]
    rows = F.array(*[F.struct(F.lit(t).alias("trope"), F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(x).alias("anti")) for t, i, k, x in spec])
    low = segments.select(*K, F.lower("text").alias("low"))
    hits = low.select(*K, F.explode(F.filter(rows, lambda r: F.contains(F.col("low"), r.k))).alias("h")).select(*K, "h.*")
    need = F.create_map(*[x for t, (_, _, _, n) in lexicons.TROPES.items() for x in (F.lit(t), F.lit(n))])
    kind = F.create_map(*[x for t, (c, _, _, _) in lexicons.TROPES.items() for x in (F.lit(t), F.lit(c))])
    per = hits.groupBy(*K, "trope").agg(F.count_if(~F.col("anti")).alias("n"), F.bool_or("anti").alias("anti"),
                                        F.array_sort(F.collect_list(F.when(~F.col("anti"), F.struct("i", "k")))).alias("h"))  # ten words at most
    ok = per.filter(~F.col("anti") & (F.col("n") >= need[F.col("trope")]))
    first = ok.groupBy("story", "trope").agg(F.min_by(F.struct("chapter", "n", "h"), "chapter").alias("f"))
    found = first.select("story", "trope", kind[F.col("trope")].alias("category"), "f.chapter", F.round(F.least(F.lit(1.0), F.col("f.n") / (need[F.col("trope")] + 2)), 6).alias("confidence"),
                         F.transform("f.h", lambda x: x.k).alias("hits"))
    one = found.join(segments.select(*K, "text"), K)
    sentence_of = lambda k: F.substring(strip(F.get(F.filter(F.split("text", r"\."), lambda s: F.contains(F.lower(s), k)), F.lit(0))), 1, 100)
    involved = F.slice(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower("text"), F.lower(n))), 1, 3)
    return one.select("story", "trope", "category", "chapter", "confidence", F.transform(F.slice("hits", 1, 3), sentence_of).alias("evidence"), involved.alias("involved"))


def thematic_summary(found: DataFrame) -> DataFrame:
    """Per story: counts by category, dominant category, style, strongest tropes and suggestions."""
    cats = sorted({c for c, *_ in lexicons.TROPES.values()})
    g = found.groupBy("story").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("category") == x).alias(f"n_{x}") for x in cats],
                                   F.collect_set("trope").alias("have"))  # sixteen tropes at most
    has = lambda *t: F.arrays_overlap("have", F.array(*[F.lit(x) for x in t]))
    style = (F.when(has("hero_journey", "quest_narrative"), "Epic Adventure").when(has("mystery_reveal"), "Mystery/Thriller")
             .when(has("love_triangle", "rivals_to_lovers"), "Romance/Drama").when(has("good_vs_evil"), "Classic Fantasy")
             .when(has("internal_conflict"), "Character Study").when(has("coming_of_age"), "Coming-of-Age").otherwise("Mixed Genre"))
    dominant = F.array_min(F.array(*[F.struct((-F.col(f"n_{x}")).alias("n"), F.lit(x).alias("c")) for x in cats]))["c"]
    hints = F.slice(F.array_compact(F.array(
        F.when(has("hero_journey") & ~has("sacrifice_theme"), "add a sacrifice"), F.when(has("betrayal") & ~has("redemption_arc"), "redeem the betrayer"),
        F.when(has("good_vs_evil"), "add moral grey areas"), F.when(F.col("n_relationship") == 0, "develop relationships"), F.when(F.col("total") < 3, "continue the story"))), 1, 3)
    top = top_k(found, ["story"], [F.desc("confidence"), "trope"], 5).groupBy("story").agg(F.array_sort(F.collect_list(F.struct("rank", "trope"))).alias("l"))  # five per story
    return g.join(top, "story").select("story", "total", *[f"n_{x}" for x in cats], dominant.alias("dominant"), style.alias("style"),
                                       F.transform("l", lambda x: x.trope).alias("top"), hints.alias("suggestions"))


def _classify(sentence: Column) -> Column:
    low = F.lower(sentence)
    scored = [F.struct(sum((low.rlike(p).cast("int") for p in pats), F.lit(0)).alias("s"), F.lit(-i).alias("o"), F.lit(kind).alias("k"))
              for i, (kind, pats) in enumerate(lexicons.PLOT_PATTERNS.items())]
    best = F.array_max(F.array(*scored))
    grows = (F.length(sentence) > 50) & (count_hits(low, lexicons.DEVELOPMENT_WORDS) > 0)
    return F.when(best.s > 0, best.k).when(grows, "development")


def plot_points(segments: DataFrame, names: list[str]) -> DataFrame:
    """Classified sentences with position, title, involved names and the causal words they contain."""
    keep = F.filter(sentences(F.col("text")), lambda s: F.length(s) > 20)
    s = segments.select(*K, F.posexplode(keep).alias("seq", "sentence")).withColumn("event_type", _classify(F.col("sentence"))).filter("event_type IS NOT NULL")
    title = F.array_join(F.slice(words(F.col("sentence")), 1, 6), " ")
    body = F.substring("sentence", 1, 200)
    return s.select(*K, "seq", "event_type", F.when(F.length(title) > 50, F.concat(F.substring(title, 1, 47), F.lit("..."))).otherwise(title).alias("title"), body.alias("description"),
                    F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower("sentence"), F.lower(n))).alias("involved"),
                    F.filter(F.array(*[F.lit(w) for w in lexicons.CAUSAL_WORDS]), lambda w: F.contains(F.lower(F.col("sentence")), w)).alias("causal"))


def causal_links(points: DataFrame) -> DataFrame:
    """Edge from the point before in the same segment, once per causal word."""
    p = with_prior(points.select(*K, "seq", "causal"), K, ["seq"])
    return p.select(*K, F.col("prev_seq").alias("cause"), F.col("seq").alias("effect"), F.explode("causal").alias("word"))


def structure(points: DataFrame) -> DataFrame:
    """Events per chapter, pacing and the dominant type of each act, per story."""
    c = F.col
    total = points.groupBy("story").agg(F.count(F.lit(1)).alias("total_events"), F.max("chapter").alias("chapters"))
    per = F.col("total_events") / F.col("chapters")
    pace = F.when(per < 1, "slow").when(per < 2, "moderate").when(per < 4, "fast").otherwise("very_fast")
    end1 = F.greatest(F.lit(1), F.floor(c("chapters") / 4))
    end2 = F.greatest(end1 + 1, F.floor(c("chapters") * 3 / 4))
    act = F.when(c("chapter") <= end1, 1).when(c("chapter") <= end2, 2).otherwise(3)
    n = points.join(total, "story").filter("chapters >= 3").groupBy("story", act.alias("act"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("story", "act").agg(F.min(F.struct((-c("n")).alias("n"), "event_type")).alias("b"), F.sum("n").alias("m"))
    acts = best.groupBy("story").agg(*[x for a in (1, 2, 3) for x in (
        F.max(F.when(c("act") == a, c("b.event_type"))).alias(f"act{a}"), F.sum(F.when(c("act") == a, c("m"))).alias(f"act{a}_events"))])
    out = total.join(acts, "story", "left")
    return out.select("story", "total_events", "chapters", F.round(per, 2).alias("events_per_chapter"), pace.alias("pacing"),
                      *[x for a in (1, 2, 3) for x in (F.coalesce(f"act{a}", F.lit("none")).alias(f"act{a}"), F.coalesce(f"act{a}_events", F.lit(0)).alias(f"act{a}_events"))])


def timeline_holes(points: DataFrame, links: DataFrame) -> DataFrame:
    """Revelations nothing leads to, conflicts without a later resolution, links to unknown points."""
    led = links.select(*K, F.col("effect").alias("seq")).distinct()
    bare = points.filter("event_type = 'revelation'").join(led, [*K, "seq"], "left_anti").select(*K, "seq", F.lit("revelation_without_setup").alias("hole"))
    last = points.filter("event_type = 'resolution'").groupBy("story").agg(F.max("chapter").alias("_last"))
    open_ = points.filter("event_type = 'conflict'").join(last, "story", "left").filter("_last IS NULL OR _last <= chapter").select(*K, "seq", F.lit("unresolved_conflict").alias("hole"))
    lost = links.select(*K, F.col("effect").alias("seq")).distinct().join(points.select(*K, "seq"), [*K, "seq"], "left_anti").select(*K, "seq", F.lit("dangling_reference").alias("hole"))
    return bare.unionByName(open_).unionByName(lost)


def mentions(segments: DataFrame, names: list[str]) -> DataFrame:
    return segments.select(*K, F.explode(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower("text"), F.lower(n)))).alias("name"))


def disappeared(segments: DataFrame, names: list[str], gap: int = 2) -> DataFrame:
    now = segments.groupBy("story").agg(F.max("chapter").alias("now"))
    last = mentions(segments, names).groupBy("story", "name").agg(F.max("chapter").alias("last"))
    return last.join(now, "story").filter(F.col("now") - F.col("last") > gap)


def unused_artifacts(nodes: DataFrame, edges: DataFrame, chapter: int) -> DataFrame:
    """Artifacts introduced two or more chapters ago with fewer than two outgoing edges."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.filter((F.col("type") == "ARTIFACT") & (chapter - F.col("first_appearance") >= 2)).join(out, "id", "left").filter(F.coalesce("n", F.lit(0)) < 2)


def story_health(nodes: DataFrame, edges: DataFrame, segments: DataFrame, states: DataFrame, names: list[str], chapter: int) -> DataFrame:
    """Issue counts per detector and severity with the score and its band."""
    count = lambda df, kind, sev: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(sev).alias("severity"), "n")
    rows = (count(graph.conflicting_pairs(edges), "relationship_conflict", "high").unionByName(count(graph.orphaned_events(nodes, edges), "orphaned_event", "high"))
            .unionByName(count(disappeared(segments, names), "disappeared_character", "medium")).unionByName(count(unused_artifacts(nodes, edges, chapter), "chekhovs_gun", "medium"))
            .unionByName(count(arcs.abrupt_changes(states), "abrupt_change", "low")))
    rows = settle(rows)
    s = rows.agg((100 - 20 * F.sum(F.when(F.col("severity") == "high", F.col("n")).otherwise(0)) - 5 * F.sum(F.when(F.col("severity") == "medium", F.col("n")).otherwise(0))).alias("score"))
    band = F.when(F.col("score") >= 90, "Excellent").when(F.col("score") >= 70, "Good").when(F.col("score") >= 50, "Needs Work").otherwise("Critical")
    return rows.join(F.broadcast(s), F.lit(True)).select("kind", "severity", "n", "score", band.alias("health"))  # one-row side


def foreshadowing(segments: DataFrame) -> DataFrame:
    """Planted words with their sentence; resolved when the word returns in a later chapter of the story."""
    low = F.lower("text")
    p = segments.select(*K, "text", F.explode(F.filter(F.array(*[F.lit(w) for w in lexicons.FORESHADOW_WORDS]), lambda w: F.contains(low, w))).alias("word"))
    hint = F.substring(strip(F.get(F.filter(F.split("text", r"\."), lambda s: F.contains(F.lower(s), F.col("word"))), F.lit(0))), 1, 80)
    p = p.select(*K, "word", hint.alias("hint"))
    last = p.groupBy("story", "word").agg(F.max("chapter").alias("_last"))
    return p.join(last, ["story", "word"]).select(*K, "word", "hint", (F.col("_last") > F.col("chapter")).alias("resolved"))


def pacing(segments: DataFrame) -> DataFrame:
    low = F.lower("text")
    t, c = count_hits(low, lexicons.TENSION_WORDS), count_hits(low, lexicons.CALM_WORDS)
    level = ((t - c) / F.greatest(F.lit(1), t + c) + 1) / 2
    s = segments.select(*K, level.alias("_l"), F.size(words(F.col("text"))).alias("word_count"))
    return s.select(*K, F.round("_l", 2).alias("tension_level"), "word_count", F.when(F.col("_l") > 0.7, "intense").when(F.col("_l") < 0.3, "slow").otherwise("balanced").alias("pacing"))


def pacing_issues(paced: DataFrame) -> DataFrame:
    p = with_prior(paced.select(*K, "pacing"), ["story"], ["chapter"])
    return p.filter((F.col("pacing") == F.col("prev_pacing")) & F.col("pacing").isin("slow", "intense")).select(
        "story", F.col("prev_chapter").alias("from_chapter"), F.col("chapter").alias("to_chapter"), "pacing")


def unmet_pairs(nodes: DataFrame, edges: DataFrame, chapter: int, limit: int) -> DataFrame:
    """First ``limit`` pairs of characters without an edge, in id order.

    How many partners each character lacks follows from its rank and its known
    partners, so only the characters that can supply the first pairs meet the rest.
    """
    from .scale import numbered

    chars = settle(numbered(nodes.filter((F.col("type") == "CHARACTER") & (chapter - F.col("first_appearance") >= 1)).select("id", F.lit(0).alias("_g")), ["_g"], ["id"]).select("id", "rn"))
    n = chars.agg(F.count(F.lit(1)).alias("n"))
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    pair = settle(pair.join(chars.select(F.col("id").alias("a")), "a", "left_semi").join(chars.select(F.col("id").alias("b")), "b", "left_semi"))
    known = pair.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("known"))
    open_ = F.col("n") - F.col("rn") - F.coalesce("known", F.lit(0))
    lack = chars.join(known, "id", "left").join(F.broadcast(n), F.lit(True)).withColumn("lack", open_).filter("lack > 0")
    # At most ``limit`` rows; of these only the first few are needed to supply that many pairs.
    first = lack.orderBy("id").limit(limit)
    upto = F.sum("lack").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    lead = first.withColumn("_before", F.coalesce(upto, F.lit(0))).filter(F.col("_before") < limit).select(F.col("id").alias("a"))
    # Whom a lead lacks are the ranks between those of its partners, and after the last one: no character is tried that it knows.
    rank = lambda c, as_: chars.select(F.col("id").alias(c), F.col("rn").alias(as_))
    lead = lead.join(rank("a", "ra"), "a")
    marks = pair.join(lead, "a").join(rank("b", "rb"), "b").select("a", "ra", "rb").unionByName(lead.join(F.broadcast(n), F.lit(True)).select("a", "ra", (F.col("n") + 1).alias("rb")))
    low = F.coalesce(F.lag("rb").over(Window.partitionBy("a").orderBy("rb")), F.col("ra")) + 1
    gaps = marks.withColumn("low", low).filter(F.col("low") < F.col("rb")).orderBy("ra", "low").limit(limit)
    lacks = gaps.select("a", "ra", F.explode(F.sequence("low", F.least(F.col("rb") - 1, F.col("low") + limit - 1))).alias("rb")).orderBy("ra", "rb").limit(limit)
    return lacks.join(rank("b", "rb"), "rb").select("a", "b").orderBy("a", "b")


PRIORITIES = ["urgent", "high", "medium", "low"]


def suggestions(nodes: DataFrame, edges: DataFrame, states: DataFrame, chapter: int, limit: int = 5, used: DataFrame | None = None) -> DataFrame:
    """Five detectors, scored by (urgency + impact) / 2, used titles left out, best first."""
    c = F.col
    names = nodes.select("id", "name", "type", "first_appearance")
    row = lambda df, title, kind, urgency, impact: df.select(title.alias("title"), F.lit(kind).alias("kind"), F.round(urgency, 6).cast("double").alias("urgency"), F.lit(impact).alias("impact"))
    since = chapter - c("chapter")
    con = edges.filter((c("relation") == "CONFLICTS_WITH") & (since >= 2)).join(names.select(c("id").alias("src"), c("name").alias("a")), "src").join(names.select(c("id").alias("dst"), c("name").alias("b")), "dst")
    parts = [row(con, F.concat(F.lit("Resolve "), "a", F.lit(" vs "), "b", F.lit(" conflict")), "unresolved_conflict", F.least(F.lit(1.0), since / 5), 0.8)]
    now = arcs.latest(states.select("character", "chapter", "emotion"))
    who = c("character").cast("string")
    parts.append(row(now.filter(since >= 2), F.concat(F.lit("Develop "), who, F.lit("'s character arc")), "character_arc_gap", F.least(F.lit(1.0), since / 5), 0.7))
    flat = top_k(states.select("character", "chapter", "emotion"), ["character"], [F.desc("chapter")], 3).groupBy("character").agg(F.count(F.lit(1)).alias("n"), F.min("emotion").alias("lo"), F.max("emotion").alias("hi"))
    parts.append(row(flat.filter("n = 3 AND lo = hi"), F.concat(F.lit("Shift "), who, F.lit("'s emotional state")), "character_arc_gap", F.lit(0.5), 0.6))
    age = chapter - c("first_appearance")
    events = edges.join(nodes.filter("type = 'EVENT'").select(c("id").alias("dst")), "dst", "left_semi").select(c("src").alias("id"))
    parts.append(row(names.filter(c("type").isin("ARTIFACT", "ITEM", "OBJECT") & (age >= 2)).join(events, "id", "left_anti"), F.concat(F.lit("Use the "), "name", F.lit(" "), "id"), "chekhov_gun", F.least(F.lit(1.0), age / 4), 0.8))
    seen = edges.groupBy(c("src").alias("id")).agg(F.max("chapter").alias("_c"))
    quiet = chapter - F.greatest(c("first_appearance"), F.coalesce("_c", c("first_appearance")))
    parts.append(row(names.filter("type = 'LOCATION'").join(seen, "id", "left").filter(quiet >= 3), F.concat(F.lit("Return to "), "name"), "underutilized_location", F.lit(0.3), 0.4))
    extra = unmet_pairs(nodes, edges, chapter, limit)
    parts.append(row(extra, F.concat(F.lit("Connect "), "a", F.lit(" and "), "b"), "relationship_opportunity", F.lit(0.4), 0.6))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    avg = F.round((c("urgency") + c("impact")) / 2, 6)
    level = F.when(avg >= 0.8, 0).when(avg >= 0.6, 1).when(avg >= 0.4, 2).otherwise(3)
    if used is not None:
        out = out.join(used.select("title"), "title", "left_anti")
    best = out.withColumn("_p", level).orderBy("_p", F.desc("urgency"), F.desc("impact"), "title").limit(limit)
    return best.select("title", "kind", F.element_at(F.array(*[F.lit(p) for p in PRIORITIES]), c("_p") + 1).alias("priority"), "urgency", "impact")


def narrative_statistics(segments: DataFrame) -> DataFrame:
    return segments.groupBy("story").agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("chapter").alias("chapters"), F.sum(F.size(words(F.col("text")))).alias("words"),
                                         F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


def chapter_segments(segments: DataFrame, method: str | None = None) -> DataFrame:
    s = segments if method is None else segments.filter(F.col("method") == method)
    return s.select(*K, "method", "text", F.size(words(F.col("text"))).alias("words"))


def approach_metrics(df: DataFrame, names: list[str], issues: int) -> DataFrame:
    """Coherence and consistency heuristics per approach; input text, context, approach."""
    low = F.lower("text")
    c = F.col
    overlap = F.size(F.array_intersect(F.array_distinct(words(low)), F.array_distinct(words(F.lower("context")))))
    seen = count_hits(low, [n.lower() for n in names])
    base = (F.when(c("approach") == "unified", F.least(F.lit(0.8), 0.4 + overlap * 0.05)).when(c("approach") == "graph", F.least(F.lit(0.9), 0.5 + seen * 0.08))
            .otherwise(F.least(F.lit(0.95), 0.5 + overlap * 0.03 + seen * 0.05)))
    coh = base + F.when(F.length("text") > 500, 0.05).otherwise(0.0) + F.when(count_hits(low, lexicons.CONNECTIVES) > 0, 0.03).otherwise(0.0)
    start = max(0.0, 1 - 0.1 * issues)
    con = (F.when(c("approach") == "unified", start * 0.5 + seen / max(1, len(names)) * 0.3 + 0.1)
           .when(c("approach") == "graph", F.least(F.lit(0.98), min(0.98, start + 0.15) + F.when(count_hits(low, lexicons.KIN_WORDS) > 0, 0.05).otherwise(0.0))).otherwise(F.lit(min(0.95, start + 0.08))))
    clamp = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.1), x))
    short = F.length("text") < 20
    return df.withColumns({"coherence": F.when(short, 0.3).otherwise(clamp(coh)), "consistency": F.when(short, 0.5).otherwise(clamp(con))})


def source_diversity(sources: DataFrame, by: list[str], text: str, chars: int | None = None) -> DataFrame:
    """Distinct texts (or first ``chars`` characters) among all."""
    return sources.groupBy(*by).agg((F.count_distinct(head(text, chars)) / F.count(F.lit(1))).alias("diversity"))


def fusion_context(segments: DataFrame, entities: DataFrame, shown: int | None = None, chars: int | None = None) -> DataFrame:
    """Per story: the first two semantic sources (``shown`` characters of each, or all), and the diversity over sources and entities.

    Sources are told apart by their text, or its first ``chars`` characters.
    """
    top = top_k(segments.filter("approach = 'unified'"), ["story"], ["chapter"], 2).groupBy("story").agg(
        F.array_sort(F.collect_list(F.struct("chapter", head("text", shown).alias("t")))).alias("l"))  # two per story
    src = segments.filter("approach = 'unified'").select("story", F.lit(0).alias("kind"), head("text", chars).alias("key")).distinct()
    ent = entities.select("story", F.lit(1).alias("kind"), F.col("id").alias("key")).distinct()
    both = src.unionByName(ent)
    div = both.groupBy("story").agg((F.count_distinct("key") / F.count(F.lit(1))).alias("diversity"))
    return div.join(top, "story", "left").select("story", F.coalesce(F.array_join(F.transform("l", lambda x: x.t), "\n"), F.lit("")).alias("semantic"), "diversity")
