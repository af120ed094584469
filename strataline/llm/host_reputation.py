"""Verdicts on URLs: path rules first, then an empirical-Bayes reputation of hosts."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import _beta_fraction, _lgamma
from .common import settle

# Suffixes of more than one label below which names are registered.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw",
            "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: A prior counts as this many pages at least and at most; without two labelled children under any parent it counts as WEAK.
LEAST, MOST, WEAK = 1.0, 10_000.0, 10.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and without ``://``; a query or fragment belongs to neither."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct(name, verdict); null if none does. Of equally long ones the longer host, then the lesser name."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def domain_and_suffix(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix): user, port and a last dot are cut off; an address of numbers is its own domain under no suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$|\.$", "")
    labels = F.split(bare, r"\.", -1)
    n = F.size(labels)
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    known = (n >= 2) & two.isin(*suffixes) if suffixes else F.lit(False)
    k = F.when(known, 2).otherwise(1)
    address = bare.rlike(r"^[0-9.]+$") | bare.contains("[")
    tail = lambda m: F.concat_ws(".", F.slice(labels, F.greatest(n - m, F.lit(0)) + 1, m))
    return F.when(address, bare).otherwise(tail(k + 1)), F.when(address, "").otherwise(tail(k))


def article_key(html: Column) -> Column:
    """Digest of the words between a page's ``<article>`` marks, without headings and tags; null if there are none.

    Digests are 128 bits wide, so equal keys mean equal words.
    """
    body = F.regexp_replace(F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1), r"(?s)<h1>.*?</h1>", "")
    text = F.regexp_replace(body, r"<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text_key(text)


def text_key(text: Column) -> Column:
    """Digest of a text's words joined by single spaces; null for null and blank texts."""
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(plain != "", F.md5(F.encode(plain, "UTF-8")))


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(item, bad) of every labelled text: bad if any label of a document with that text says toxic or of no quality.

    A document's repeated labels and a text's repeated documents meet in one
    row; labels whose two values are null say nothing.
    """
    marks = labels.select("doc_id", F.coalesce(F.greatest(1 - F.col("quality"), F.col("toxic")), F.lit(-1)).cast("int").alias("bad")).filter("doc_id IS NOT NULL AND bad >= 0")
    marks = marks.groupBy("doc_id").agg((F.max("bad") > 0).alias("bad"))
    texts = documents.select("doc_id", text_key(F.col("text")).alias("item")).filter("doc_id IS NOT NULL AND item IS NOT NULL")
    return texts.join(marks, "doc_id").groupBy("item").agg(F.max("bad").alias("bad"))


def host_counts(pages: DataFrame, item: Column, outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, x): labelled outcomes and bad ones of every host of ``pages`` (url); copies of a text on one host are one outcome."""
    seen = pages.select(url_parts(F.col("url"))[0].alias("host"), item.alias("item")).distinct()
    known = outcomes.filter(F.col("bad").isNotNull()).groupBy("item").agg(F.max("bad").alias("bad"))
    hosts = seen.join(known, "item", "left").groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("x"))
    domain, suffix = domain_and_suffix(F.col("host"))
    return hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "x")


def _spread(children: DataFrame, parent: list[str]) -> DataFrame:
    """Per parent the totals n and x and what the spread of its children adds to the fit of their prior."""
    some = F.col("n") > 0
    return children.groupBy(*parent).agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"), F.count(F.when(some, 1)).alias("k"),
        F.sum(F.col("n").cast("double") ** 2).alias("nn"), F.sum(F.when(some, F.col("x").cast("double") ** 2 / F.col("n"))).alias("xx"))


def _strength(parents: DataFrame) -> DataFrame:
    """One row: how many pages the prior of a child counts for, by the analysis of variance of children within parents.

    With p labelled parents, k labelled children and N outcomes, the mean squares between and within children give the
    correlation r of two outcomes of one child, and a beta prior of strength (1 - r) / r has that correlation.
    """
    p = parents.filter("n > 0").agg(
        F.count(F.lit(1)).alias("p"), F.sum("k").alias("k"), F.sum("n").cast("double").alias("total"), F.sum("x").cast("double").alias("bad"),
        F.sum("xx").alias("a"), F.sum(F.col("x").cast("double") ** 2 / F.col("n")).alias("b"), F.sum(F.col("nn") / F.col("n")).alias("c"))
    between = (F.col("a") - F.col("b")) / (F.col("k") - F.col("p"))
    within = (F.col("bad") - F.col("a")) / (F.col("total") - F.col("k"))
    size = (F.col("total") - F.col("c")) / (F.col("k") - F.col("p"))
    # (1 - r) / r of r = (between - within) / (between + (size - 1) * within)
    ratio = size * within / (between - within)
    told = (F.col("k") > F.col("p")) & (F.col("total") > F.col("k"))
    m = F.when(~told, F.lit(WEAK)).when(between <= within, F.lit(MOST)).otherwise(F.least(F.greatest(ratio, F.lit(LEAST)), F.lit(MOST)))
    return p.select(F.coalesce(m, F.lit(WEAK)).alias("m"))


def beta_below(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(rate <= x) of Beta(a, b), 0 < x < 1."""
    front = lambda u, v, z: np.exp(_lgamma(u + v) - _lgamma(u) - _lgamma(v) + u * math.log(z) + v * math.log1p(-z)) / u
    low = x < (a + 1) / (a + b + 2)
    out = np.empty(len(a))
    if low.any():
        u, v = a[low], b[low]
        out[low] = front(u, v, x) * _beta_fraction(u, v, np.full(len(u), x))
    if (~low).any():
        u, v = b[~low], a[~low]
        out[~low] = 1 - front(u, v, 1 - x) * _beta_fraction(u, v, np.full(len(u), 1 - x))
    return np.clip(out, 0, 1)


def reputations(hosts: DataFrame, max_bad: float = 0.5, confidence: float = 0.95) -> DataFrame:
    """Hosts with prior_mean, strength, bad_rate (posterior mean), likely_below = P(bad rate <= max_bad) rounded to nine places, and blocked.

    Rates shrink from the level below to the level above: all outcomes give the
    prior of suffixes, a suffix that of its registered domains, a domain that
    of its hosts. Means are posterior means, strengths are fitted per level.
    A host is blocked if its bad rate is above ``max_bad`` with ``confidence``;
    a host without labelled pages is judged by its domain's rate, and so on up.
    """
    domains = settle(_spread(hosts, ["suffix", "domain"]))
    suffixes = settle(_spread(domains, ["suffix"]))
    top = suffixes.agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("k"),
                       F.sum(F.col("n").cast("double") ** 2).alias("nn"), F.sum(F.when(F.col("n") > 0, F.col("x").cast("double") ** 2 / F.col("n"))).alias("xx"))
    # One row each: the strengths and the overall rate.
    world = F.broadcast(top.select(((F.coalesce("x", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("mean")))
    by_suffix, by_domain, by_host = (F.broadcast(_strength(x)) for x in (top, suffixes, domains))
    shrunk = (F.col("m") * F.col("mean") + F.col("x")) / (F.col("m") + F.col("n"))
    s = suffixes.crossJoin(world).crossJoin(by_suffix).select("suffix", shrunk.alias("mean"))
    d = domains.join(s, "suffix").crossJoin(by_domain).select("suffix", "domain", shrunk.alias("mean"))
    h = hosts.join(d, ["suffix", "domain"]).crossJoin(by_host)
    a, b = F.col("m") * F.col("mean") + F.col("x"), F.col("m") * (1 - F.col("mean")) + F.col("n") - F.col("x")
    below = F.pandas_udf(lambda a, b: pd.Series(beta_below(max_bad, a.to_numpy(float), b.to_numpy(float)), dtype=float), "double")
    h = h.withColumn("likely_below", F.round(below(a, b), 9))
    return h.select("host", "domain", "suffix", "n", "x", F.col("mean").alias("prior_mean"), F.col("m").alias("strength"), (a / (a + b)).alias("bad_rate"), "likely_below", (F.col("likely_below") < 1 - confidence).alias("blocked"))


def url_verdicts(pages: DataFrame, item: Column, outcomes: DataFrame, rules: Sequence[Rule], max_bad: float = 0.5, confidence: float = 0.95) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad, and bad_rate and likely_below to six places, of every row of ``pages``.

    ``item`` names what a page shows, ``outcomes`` (item, bad) has the labelled
    ones. A page under a rule gets the longest rule's verdict; all others are
    blocked if their host is (:func:`reputations`). Null urls and urls without
    ``://`` have an empty host, which is judged like any host; null items have
    no outcome; repeated rows are judged each, and their copies on one host
    count as one outcome. Items with several outcomes are bad if one is. An
    empty table gives an empty table, without outcomes nothing but rules
    blocks, and other columns are not read.
    """
    hosts = reputations(settle(host_counts(pages, item, outcomes)), max_bad, confidence).select("host", "n", "x", "bad_rate", "likely_below", "blocked")
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    out = rows.join(settle(hosts), "host").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"),
                      F.col("n").alias("n_labelled"), F.col("x").alias("n_bad"), F.round("bad_rate", 6).alias("bad_rate"), F.round("likely_below", 6).alias("likely_below"))
