"""Phrase collocations, hard negatives and URL verdicts against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import LOWER, awkward, frame
from pyspark.sql import functions as F

from strataline.llm import collocations as co
from strataline.llm import hard_negatives as hn
from strataline.llm import host_reputation as hr


# Phrases


def grams_of(docs):
    """lang -> (number of words, Counter of phrases of 1 to 5 words, list of pieces)."""
    out = defaultdict(lambda: [0, Counter(), []])
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            mine = out[lang or "und"]
            mine[0] += len(w)
            mine[2].append(w)
            for k in range(1, 6):
                mine[1].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return out


def brute_phrases(docs, least, percent=100, top=2000):
    rows = []
    for lang, (n, f, _) in grams_of(docs).items():
        able = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = set()
        for p, c in able.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * c >= percent * f[p[i:j]]:
                        inside.add(p[i:j])
        mine = []
        for p, a in able.items():
            if p not in inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1)]
    return sorted(rows)


def story(rng, n, vocabulary=7):
    return "".join(rng.choice(["A", "b", "c", "D", "e", "été", "日本"][:vocabulary]) + rng.choice([" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\r\n", "! ?"]) for _ in range(n))


@pytest.mark.parametrize("least,percent", [(2, 100), (5, 100), (4, 80)])
def test_phrases_by_brute_force(spark, least, percent):
    rng = random.Random(least)
    texts = [story(rng, rng.choice([0, 1, 3, 20, 200]), rng.choice([2, 5, 7])) for _ in range(60)] + ["x y z u v w"] * 6 + awkward()
    langs = [rng.choice(["en", "de", None, "und"]) for _ in texts]
    got = co.collocations(frame(spark, texts, langs=langs), least, percent).collect()
    assert sorted(map(tuple, got)) == brute_phrases(list(zip(texts, langs)), least, percent)


def test_phrases_limit_ties_and_empty_table(spark):
    texts = ["p q. r s. t u. v w. x y."] * 3
    got = co.collocations(frame(spark, texts), 3, top=2).collect()
    assert [(r.rank, r.phrase) for r in sorted(got, key=lambda r: r.rank)] == [(1, "p q"), (2, "r s")]
    assert co.collocations(frame(spark, ["a"]).limit(0)).count() == 0 and co.collocations(frame(spark, [None, ""]), 1).count() == 0


def test_scores_beyond_64_bits(spark):
    """1000 * a * n passes 2^63 in the expression that the operator uses."""
    row = spark.sql("SELECT (CAST(1000 AS DECIMAL(38,0)) * CAST(3000000000000 AS DECIMAL(38,0)) * CAST(70000000000000 AS DECIMAL(38,0))) div (CAST(3100000000000 AS DECIMAL(38,0)) * CAST(2900000000000 AS DECIMAL(38,0))) AS s").first()
    assert row.s == 1000 * 3 * 10**12 * 7 * 10**13 // (31 * 10**11 * 29 * 10**11)


def test_counts_do_not_depend_on_buckets_or_chunks(spark, monkeypatch):
    rng = random.Random(1)
    texts = [story(rng, 100) for _ in range(40)]
    want = brute_phrases([(t, "en") for t in texts], 3)
    for buckets, chunk, known in ((16, 4_000_000, 1_000_000), (26, 50, 3), (17, 500, 10)):
        monkeypatch.setattr(co, "BUCKETS_LOG2", buckets)
        monkeypatch.setattr(co, "CHUNK", chunk)
        monkeypatch.setattr(co, "KNOWN_WORDS", known)
        assert sorted(map(tuple, co.collocations(frame(spark, texts), 3).collect())) == want


def test_passages_are_maximal_unary_paths(spark):
    long = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(12))
    texts = [f"x{k} {long} y{k}. {other}" for k in range(4)] + [f"{long}."] + ["w3 w4 w5 w6 z1 z2"] * 2 + ["a a a a a a a a a"] * 3
    got = {(r.passage, r.n_words, r.f) for r in co.passages(co.flows(co.edges(co.words_by_lang(frame(spark, texts)), 3)), 3).collect()}
    # The node "w3 w4 w5 w6" has another way out, so the edges to and from it join no path.
    w = long.split()
    assert got == {(" ".join(w[:6]), 6, 5), (" ".join(w[4:]), 36, 5), (other, 12, 4)}


# Hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    able = [(i, y, [math.floor(scale * float(np.float32(x))) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in able:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (y, v)), (y, v))
    out = []
    for a, (y, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, x)), i, z) for i, z, x in able if i != a and len(x) == len(v))
        for s, p, _ in [r for r in scored if r[2] == y][:positives]:
            inside = [(i, -t) for t, i, z in scored if z != y and -low * s <= -100 * t <= -high * s][:negatives]
            out += [(a, p, k, i, -s, t) for k, (i, t) in enumerate(inside, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, score string, anchor_id long"


@pytest.mark.parametrize("seed,dim", [(1, 8), (2, 2), (3, 1)])
def test_negatives_by_brute_force(spark, seed, dim):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in np.round(rng.normal(0, 1, dim), 1)]) for i in range(300)]
    rows += rows[:20] + [(int(i), int(rng.integers(0, 3)), [0.5] * dim) for i in range(300, 400)]  # repeated rows, and many ties
    rows += [(None, 1, [1.0] * dim), (500, None, [1.0] * dim), (510, 1, None), (520, 1, [float("nan")] * dim), (530, 1, [None] * dim), (540, 1, [float("inf")] * dim),
             (550, 1, []), (551, 2, []), (560, 1, [1.0] * (dim + 1)), (561, 1, [2.0] * (dim + 1)), (562, 2, [1.0] * (dim + 1)), (570, 7, [0.0] * dim)]
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, y, v in rows], VECTORS).repartition(5)
    for sizes in ((64, 16), (10_000, 1_000)):
        got = hn.hard_negatives(df, F.col("vec_id") % 10 == 0, shard_rows=sizes[0], block_anchors=sizes[1])
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_an_empty_table(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hn.hard_negatives(empty, F.col("vec_id") % 10 == 0).collect() == []


def test_keys_sort_and_come_back():
    rng = np.random.default_rng(0)
    n = 500
    a, s, i = (rng.integers(-5, 5, n) * rng.choice([1, 2**59], n) for _ in range(3))
    kind = rng.integers(0, 2, n)
    raw = hn.keys(a, s, kind, i)
    back = hn.unpacked(raw)
    assert all((x == y).all() for x, y in zip(back, (a, s, kind, i)))
    by = sorted(range(n), key=lambda r: raw[r].tobytes())
    assert by == sorted(range(n), key=lambda r: (a[r], -s[r], kind[r], i[r]))


@pytest.mark.parametrize("s", [0, 1, 7, 10, 99, 12345, 2**62, -1, -10])
def test_window_is_exact(s):
    least, most = hn.window(s)
    assert [100 * x >= 30 * s for x in (least - 1, least)] == [False, True] and [100 * x <= 90 * s for x in (most, most + 1)] == [True, False]


def test_negatives_travel_in_one_sorted_shuffle(spark):
    """Nothing above the last shuffle gathers an anchor: a sort inside partitions, then the iterator."""
    df = spark.createDataFrame([(i, [float(i % 7)], i % 3, "x", 1) for i in range(100)], VECTORS)
    out = hn.hard_negatives(df, F.col("vec_id") % 10 == 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    top = plan[:plan.index("Exchange")]
    assert "MapInArrow" in top and "Sort [key" in top and not re.search("Aggregate|Window|FlatMapGroups", top)


# URLs


def beta_cdf(x, a, b, n=200_000):
    """By the midpoint rule on a logarithmic density."""
    t = (np.arange(n) + 0.5) / n
    d = (a - 1) * np.log(t) + (b - 1) * np.log1p(-t)
    w = np.exp(d - d.max())
    return w[t <= x].sum() / w.sum()


def test_beta_distribution():
    a, b = np.array([1.5, 3, 40, 2000, 7, 900.5]), np.array([2, 9, 20, 2100, 7, 901.25])
    for x in (0.5, 0.3):
        assert np.allclose(hr.beta_below(x, a, b), [beta_cdf(x, p, q) for p, q in zip(a, b)], atol=2e-5)
    assert hr.beta_below(0.5, np.array([5e8]), np.array([4e8]))[0] < 1e-9


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host):]).group()


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/ES/x", "https://a.example.org/es/x?q=/en/1#f", "http://example.org/en/12", "http://example.org/en/2", "http://myexample.org/es/",
        "http://example.org?x=/es/", "http://shop.org", "http://shop.org/", "ftp://b.c.com/fr/", "x://com/de/", "http://b.c.com/de", "http://b.c.com:8080/de/", "http://u@b.c.com/de/a://b", "http://ÄB.com/fr/",
        "http://org/", "http://sorg/", "://only.com/de/\n?x", "http://x.org.evil/es/", "http://a\nb.com/de/x"]
RULES = [hr.Rule("org", "/", "allow"), hr.Rule("example.org", "/es/", "block"), hr.Rule("example.org", "/en/1", "block"), hr.Rule("com", "/fr/", "allow"), hr.Rule("com", "/de/", "block")]


def brute_rule(host, path, rules=RULES):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


PAGES = "page_id long, url string, html string, host string, rule string, n long"


def pages(spark, urls, htmls=None):
    return spark.createDataFrame([(k, u, (htmls or [None] * len(urls))[k], "x", "y", 1) for k, u in enumerate(urls)], PAGES)


def test_rules_and_parts(spark):
    outcomes = spark.createDataFrame([], "item string, bad boolean")
    got = {r.page_id: r for r in hr.url_verdicts(pages(spark, URLS), F.col("html"), outcomes, RULES).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, rule and rule.name, rule.verdict if rule else "allow"), u
    assert hr.url_verdicts(pages(spark, []), F.col("html"), outcomes, RULES).count() == 0


def test_domains(spark):
    hosts = ["a.b.example.co.uk", "co.uk", "x.co.uk", "example.com", "a.example.com:80", "u:p@a.example.com", "com", "", "10.0.0.1", "10.0.0.1:99", "[::1]:8", "a.b.c.", "b"]
    domain, suffix = hr.domain_and_suffix(F.col("h"))
    got = [(r.d, r.s) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(domain.alias("d"), suffix.alias("s")).collect()]
    assert got == [("example.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("example.com", "com"), ("example.com", "com"), ("example.com", "com"), ("com", "com"), ("", ""),
                   ("10.0.0.1", ""), ("10.0.0.1", ""), ("[::1]", ""), ("b.c", "c"), ("b", "b")]


def brute_strength(children, parents):
    """children: (parent, n, x); the analysis of variance straight from its definition."""
    some = [c for c in children if c[1]]
    p = {k for k in parents if parents[k][0]}
    total, bad = sum(c[1] for c in some), sum(c[2] for c in some)
    if not (len(some) > len(p) and total > len(some)):
        return hr.WEAK
    rate = {k: parents[k][1] / parents[k][0] for k in p}
    between = sum(n * (x / n - rate[k]) ** 2 for k, n, x in some) / (len(some) - len(p))
    within = sum(x * (1 - x / n) for _, n, x in some) / (total - len(some))
    size = (total - sum(n * n / parents[k][0] for k, n, _ in some)) / (len(some) - len(p))
    if between <= within:
        return hr.MOST
    r = (between - within) / (between + (size - 1) * within)
    return min(max((1 - r) / r, hr.LEAST), hr.MOST)


def brute_reputation(counts):
    """host -> (n, x, posterior mean, P(rate <= 1/2)); counts: host -> (domain, suffix, n, x)."""
    domains, suffixes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for d, s, n, x in counts.values():
        for t in (domains[s, d], suffixes[s]):
            t[0] += n
            t[1] += x
    total = [sum(t[0] for t in suffixes.values()), sum(t[1] for t in suffixes.values())]
    m1 = brute_strength([((), *t) for t in suffixes.values()], {(): total})
    m2 = brute_strength([(s, *t) for (s, _), t in domains.items()], suffixes)
    m3 = brute_strength([((s, d), n, x) for d, s, n, x in counts.values()], domains)
    world, out = (total[1] + 1) / (total[0] + 2), {}
    for h, (d, s, n, x) in counts.items():
        top = (m1 * world + suffixes[s][1]) / (m1 + suffixes[s][0])
        mean = (m2 * top + domains[s, d][1]) / (m2 + domains[s, d][0])
        a, b = m3 * mean + x, m3 * (1 - mean) + n - x
        out[h] = (n, x, a / (a + b), beta_cdf(0.5, a, b) if a > 1 and b > 1 else None)
    return out


def test_hosts_with_bad_pages_are_blocked(spark):
    """Two bad hosts on good domains, a domain of bad hosts with a new host, clean hosts; copies of one text count once."""
    rng = random.Random(3)
    hosts = [(f"h{k}.good{k % 7}.net", 0.1) for k in range(40)] + [("bad.good1.net", 0.95), ("worse.good2.info", 1.0)] + [(f"s{k}.spam.biz", 0.9) for k in range(8)]
    urls, items, outcome = [], [], {}
    for h, rate in hosts:
        for k in range(30):
            item = f"{h} {k}"
            urls.append(f"https://{h}/p/{k}")
            items.append(item)
            if k < 25:
                outcome[item] = rng.random() < rate
    urls += ["https://new.spam.biz/x", "https://new.good1.net/x"] + ["https://h0.good0.net/copy"] * 200
    items += [None, "unlabelled"] + ["copied"] * 200
    outcome["copied"] = True
    df = pages(spark, urls, items)
    table = spark.createDataFrame([(i, b) for i, b in outcome.items()] + [(None, True), ("h1.good1.net 1", None)], "item string, bad boolean")
    rows = hr.url_verdicts(df, F.col("html"), table, RULES).collect()
    seen = defaultdict(set)
    for u, i in zip(urls, items):
        seen[brute_parts(u)[0]].add(i)
    want = brute_reputation({h: (".".join(h.split(".")[-2:]), h.split(".")[-1], sum(i in outcome for i in s), sum(outcome.get(i, False) for i in s)) for h, s in seen.items()})
    assert len(rows) == len(urls)
    for r in rows:
        n, x, mean, below = want[r.host]
        assert (r.n_labelled, r.n_bad) == (n, x) and abs(r.bad_rate - mean) < 2e-6 and (below is None or abs(r.likely_below - below) < 1e-4)
    blocked = {r.host for r in rows if r.verdict == "block"}
    assert {"bad.good1.net", "worse.good2.info", "new.spam.biz", *(f"s{k}.spam.biz" for k in range(8))} == blocked


def test_items_of_pages_and_texts(spark):
    html = "<html><article><h1>Title</h1><p>one  &amp; <b>two</b>\n</p>\n<p>&lt;three&gt; &quot;x&quot; it&#39;s &amp;lt;</p></article><p>foot</p></html>"
    row = spark.createDataFrame([(html, "one & two <three> \"x\" it's &lt;"), ("<p>none</p>", " \n"), (None, None), ("<article></article>", "")], "html string, text string")
    got = row.select(hr.article_key(F.col("html")).alias("a"), hr.text_key(F.col("text")).alias("b")).collect()
    assert got[0].a == got[0].b is not None and all(r.a is None and r.b is None for r in got[1:])
    docs = frame(spark, ["same  text", "same text", "other", None, "unlabelled"])
    marks = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (2, None, None), (3, 0, 1), (4, None, None), (None, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.item: r.bad for r in hr.labelled_texts(docs, marks).collect()}
    keys = {r.text: r.k for r in docs.select("text", hr.text_key(F.col("text")).alias("k")).collect()}
    assert got == {keys["same text"]: True, keys["other"]: False}
