"""Entities, relations and events read from text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import sentences, strip, tokens

KEYS = ["story", "chapter"]


def names(text: Column) -> Column:
    """Distinct capitalised words or pairs that are no common words."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(lexicons.NAME_PATTERN), F.lit(1)))
    return F.filter(found, lambda n: ~n.isin(*lexicons.COMMON_WORDS))


def basic_entities(df: DataFrame, text: str = "text") -> DataFrame:
    out = df.select(*[c for c in df.columns if c != text], F.explode(names(F.col(text))).alias("name"))
    return out.withColumns({"id": F.concat(F.lit("char_"), F.replace(F.lower("name"), F.lit(" "), F.lit("_"))),
                            "type": F.lit("CHARACTER"), "confidence": F.lit(0.5)})


def canonical_names(entities: DataFrame) -> DataFrame:
    """name -> longest name with the same first word (ties: first in order)."""
    distinct = entities.select("name").distinct().withColumn("base", F.lower(F.split("name", " ")[0]))
    best = distinct.groupBy("base").agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("b"))
    return distinct.join(best, "base").select("name", F.col("b.name").alias("canonical"))


def entity_id(text: Column, label: Column) -> Column:
    prefix = F.lit("entity")
    for k, v in reversed(lexicons.LABEL_PREFIX.items()):
        prefix = F.when(label == k, v).otherwise(prefix)
    return F.concat(prefix, F.lit("_"), F.regexp_replace(F.lower(text), "[^a-z0-9]", "_"))


def entity_type(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in lexicons.LABEL_TYPE.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def _entity_like(w: Column) -> Column:
    first = F.substring(w, 1, 1)
    return ((F.length(w) >= 2) & (F.upper(first) == first) & (F.lower(first) != first) & (F.upper(w) != w) & ~F.lower(w).isin(*lexicons.NOT_ENTITY))


def _relation_row(i: int, kind: str, sure: float):
    return lambda x: F.struct(F.lit(i).alias("ord"), x["s"].alias("source"), x["t"].alias("target"), F.lit(kind).alias("relation"), F.lit(sure).alias("confidence"))


def fixed_words(pattern: str) -> list[str]:
    """Words that every match of a relation pattern holds, with white space on both sides."""
    return re.findall(r"(?<=\\s\+)([a-z]+)(?=\\s\+)", pattern)


def pattern_relations(df: DataFrame, text: str = "text") -> DataFrame:
    """Relations by the fixed patterns, all in one pass over each text; a pattern is tried only where its fixed words occur."""
    per = []
    low = F.lower(text)
    none = F.array().cast("array<struct<ord:int,source:string,target:string,relation:string,confidence:double>>")
    for i, (pattern, kind, sure) in enumerate(lexicons.RELATION_PATTERNS):
        p = F.lit("(?i)" + pattern)
        pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), p, F.lit(1)).alias("s"), F.regexp_extract_all(F.col(text), p, F.lit(2)).alias("t"))
        per.append(F.when(F.array_min(F.array(F.lit(True), *[F.contains(low, F.lit(w)) for w in fixed_words(pattern)])), F.transform(pairs, _relation_row(i, kind, sure))).otherwise(none))
    found = F.filter(F.concat(*per), lambda r: _entity_like(r.source) & _entity_like(r.target))
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(found).alias("seq", "r"))
    rel = out.select(*[c for c in out.columns if c != "r"], "r.*")
    return rel.withColumns({"source_id": entity_id(F.col("source"), F.lit("PERSON")), "target_id": entity_id(F.col("target"), F.lit("PERSON")), "strength": F.lit(0.8)})


def verb_relation(verb: Column) -> Column:
    out = F.lit("INTERACTS_WITH")
    for kind, verbs in reversed(lexicons.VERB_CLASSES):
        out = F.when(verb.isin(*verbs), kind).otherwise(out)
    return out


def verb_strength(verb: Column) -> Column:
    c = dict(lexicons.VERB_CLASSES)
    s = F.lit(0.5) + F.when(verb.isin(*c["CONFLICTS_WITH"], *c["ALLIES_WITH"]), 0.2).otherwise(0.0) + F.when(verb.isin(*c["FAMILY"]), 0.3).otherwise(0.0)
    return F.least(s, F.lit(1.0))


def verb_relations(df: DataFrame, text: str = "text") -> DataFrame:
    """Words of the text that carry a relation class, counted per class and word before any shuffle of texts."""
    words = df.select(F.explode(tokens(F.col(text))).alias("verb")).withColumn("verb", F.regexp_replace("verb", "[^a-z]", ""))
    known = words.groupBy("verb").agg(F.count(F.lit(1)).alias("n")).withColumns({"relation": verb_relation(F.col("verb")), "strength": verb_strength(F.col("verb"))})
    return known.filter(F.col("relation") != "INTERACTS_WITH")


def sentence_mentions(df: DataFrame, text: str = "text") -> DataFrame:
    """(keys, sent, sentence, names): the names of each sentence in order of first mention."""
    rest = [c for c in df.columns if c != text]
    s = df.select(*rest, F.posexplode(sentences(F.col(text))).alias("sent", "sentence"))
    return s.withColumn("names", names(F.col("sentence")))


def cooccurrence(df: DataFrame, text: str = "text") -> DataFrame:
    """Pairs of names of one sentence. A sentence is a bounded value, so pairs are made inside the row."""
    rest = [c for c in df.columns if c != text]
    s = sentence_mentions(df, text).filter(F.size("names") > 1)
    pairs = F.flatten(F.transform("names", lambda a, i: F.transform(F.slice(F.col("names"), i + 2, F.size("names")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    p = s.select(*rest, "sent", F.substring("sentence", 1, 100).alias("context"), F.explode(pairs).alias("p")).select(*rest, "sent", "context", "p.*")
    return p.filter(F.lower("source") != F.lower("target")).withColumns({"relation": F.lit("INTERACTS_WITH"), "strength": F.lit(0.3), "confidence": F.lit(0.5)})


def dedupe_relations(relations: DataFrame, order: list[str], by: list[str] = ["source_id", "target_id", "relation"]) -> DataFrame:
    """Highest confidence per (source, target, relation), earliest on ties; partial maxima before the shuffle."""
    rest = [c for c in relations.columns if c not in by and c != "confidence" and c not in order]
    best = relations.groupBy(*by).agg(F.min(F.struct((-F.col("confidence")).alias("_c"), *order, *rest)).alias("b"))
    return best.select(*by, (-F.col("b._c")).alias("confidence"), *[F.col(f"b.{c}").alias(c) for c in [*order, *rest]])


def keyword_events(df: DataFrame, text: str = "text") -> DataFrame:
    """Sentences with an event noun (0.8) or else an action verb (0.7), one row each with the first such word."""
    rest = [c for c in df.columns if c != text]
    s = df.select(*rest, F.posexplode(sentences(F.col(text))).alias("sent", "description"))
    w = F.transform(tokens(F.col("description")), lambda x: F.regexp_replace(x, "[^a-z]", ""))
    s = s.withColumn("_w", w)
    pick = lambda values: F.get(F.filter("_w", lambda x: x.isin(*values)), F.lit(0))
    s = s.withColumns({"_n": pick(lexicons.EVENT_NOUNS), "_v": pick(lexicons.EVENT_VERBS)})
    s = s.withColumns({"action": F.coalesce("_n", "_v"), "confidence": F.when(F.col("_n").isNotNull(), 0.8).otherwise(0.7)})
    return s.filter(F.col("action").isNotNull()).drop("_w", "_n", "_v").withColumn("id", F.concat(F.lit("event_"), "action"))


def trait_words(df: DataFrame, known: list[str], adjectives: list[str], text: str = "text", reach: int = 5) -> DataFrame:
    """Adjectives at most ``reach`` words from a known name in the same sentence, counted per name."""
    s = df.select(F.explode(sentences(F.col(text))).alias("_s"))
    w = F.transform(F.split("_s", r"\s+"), lambda x: F.regexp_replace(F.lower(x), "[^a-z]", ""))
    low = [n.lower() for n in known]
    s = s.select(w.alias("_w")).filter(F.exists("_w", lambda x: x.isin(*low)))
    hits = F.flatten(F.transform("_w", lambda x, i: F.when(x.isin(*low), F.transform(
        F.filter(F.slice(F.col("_w"), F.greatest(i + 1 - reach, F.lit(1)), F.least(i + 1 + reach, F.size("_w")) - F.greatest(i - reach, F.lit(0))),
                 lambda a: a.isin(*adjectives)), lambda a: F.struct(x.alias("name"), a.alias("trait")))).otherwise(
        F.array().cast("array<struct<name:string,trait:string>>"))))
    return s.select(F.explode(hits).alias("h")).groupBy(F.col("h.name").alias("name"), F.col("h.trait").alias("trait")).agg(F.count(F.lit(1)).alias("n"))


def mention_graph(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges document -> lower-case entity, once per document; whole texts are read."""
    found = F.array_distinct(F.transform(names(F.col(text)), F.lower))
    return docs.select(F.col(doc).cast("string").alias("src"), F.explode(found).alias("dst")).withColumn("relation", F.lit("mentions"))
