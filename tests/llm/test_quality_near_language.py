import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from helpers import awkward, frame, near_components, shingles, words

from strataline.llm import langid, quality, setsketch
from strataline.llm.components import components


def test_repeated_words():
    rng = np.random.default_rng(1)
    for _ in range(400):
        w = [b"abcd"[i:i + 1] for i in rng.integers(0, 4, int(rng.integers(0, 25)))]
        seen, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i:i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        assert quality.repeated_words(w) == len(covered)


def test_binomial_tail():
    for n, p in ((10, 0.3), (60, 0.02), (200, 0.5)):
        for k in range(n + 1):
            assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)), abs=1e-9)


def test_cutoffs_are_safe():
    """Loose cutoffs are accepted, and none beyond the first that can't be proved."""
    cuts = quality.RULES["symbols"][1]
    counts = {(0, "symbols", 0): 5_000, (0, "symbols", 4): 3, (0, "symbols", 9): 2_000}
    chosen = quality.choose_cutoffs(counts, 0.03, 0.05)
    assert (0, "symbols") not in chosen  # the loosest already loses 2,003 of 7,003
    counts = {(0, "symbols", 0): 5_000, (0, "symbols", 4): 3}
    assert quality.choose_cutoffs(counts, 0.03, 0.05)[0, "symbols"] == cuts[-1]
    assert quality.choose_cutoffs({(0, "symbols", 0): 50}, 0.03, 0.05) == {}


def test_quality_rules(spark):
    good = ["the cat sat on a mat %d while dogs ran far away over hills " % k * 1 + " ".join(f"w{k}x{j}" for j in range(60)) for k in range(2_500)]
    bad = [" ".join(f"w{k}x{j}###" for j in range(70)) for k in range(30)]
    texts = good + bad + awkward()
    labels = spark.createDataFrame([(k, 1, 0) for k in range(2_500)] + [(2_501, 0, 0), (None, 1, 0), (3, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(frame(spark, texts), labels).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for x in w for c in x)
        assert r.base_failed == (len(w) < 50 or 100 * r.n_repeat_words > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert all(r.kept for r in rows[:2_500]) and not any(r.kept for r in rows[2_500:2_530])
    assert all(r.kept != r.base_failed for r in quality.quality_rules(frame(spark, texts), labels.limit(0)).collect())
    assert quality.quality_rules(frame(spark, texts).limit(0), labels).collect() == []


def near_texts(seed=2):
    """Groups of copies with a few changed words, so that some links lead through others."""
    rng = np.random.default_rng(seed)
    out = awkward()
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 5_000, int(rng.integers(20, 300)))]
        for _ in range(int(rng.integers(2, 40))):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[at] = f"n{rng.integers(0, 10**6)}"
            out.append(" ".join(w))
    return out + out[-3:] + [out[-1].upper()]


@pytest.mark.parametrize("block", [128, 7])
def test_near_duplicates_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setsketch, "BLOCK_DOCS", block)
    texts = near_texts()
    order = np.random.default_rng(3).permutation(len(texts)).tolist()
    rows = setsketch.near_duplicates(frame(spark, texts, ids=order)).collect()
    want = near_components(list(zip(order, texts)))
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == want[r.doc_id]) and r.n_shingles == len(shingles(texts[order.index(r.doc_id)])) for r in rows)


def test_near_dedup_nulls_repeats_and_empty_table(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f", "A B C D E F", None, "x"], ids=[4, 4, 9, None, None])
    rows = setsketch.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in rows), key=str) == [(4, 4, True), (4, 4, True), (9, 4, False), (None, None, True), (None, None, True)]
    kept = setsketch.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert setsketch.near_duplicates(docs.limit(0)).collect() == []


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**63, 9_000).astype(np.uint64) * np.uint64(2654435761))
    a, b = pool[:4_000], pool[1_000:5_000]
    x, y, both = setsketch.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(x, y) == both).all()
    equal, above = float((x == y).sum()), float((x > y).sum())
    one = lambda v: np.array([v])
    got = setsketch.estimate(one(above), one(setsketch.REGISTERS - equal - above), one(equal), one(0.5))[0]
    assert abs(got - 0.6) < 0.15
    assert setsketch.plausible(np.array([x]), np.array([x]), one(4_000), one(4_000), 85).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (3, 2)] + [(100 + k, 101 + k) for k in range(60)] + [(1_000, 2_000 + k) for k in range(300)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {k: 100 for k in range(100, 161)} | {1_000: 1_000} | {2_000 + k: 1_000 for k in range(300)}
    assert {r.node: r.root for r in rows} == want


def test_language_identification(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(None, None, "en", None), (10_001, "", "en", None), (10_002, "12 34 !", None, None), (10_003, "the of and", None, "s"), (10_003, "the of and", None, "s")], docs.schema)
    rows = langid.language_rows(docs.unionByName(odd)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    others = sorted((r.doc_id or 0, r.lang_pred) for r in rows if r.doc_id not in truth)
    assert [x for _, x in others[:3]] == ["und"] * 3 and others[3] == others[4]
    assert sum(r.accepted for r in rows if r.doc_id in truth) >= 0.97 * len(truth)
    unlabelled = langid.identify(docs.limit(5).withColumn("lang", docs.lang.cast("string").substr(0, 0)).selectExpr("doc_id", "text", "cast(null as string) lang", "'x' score"))
    assert [(r.lang_pred, r.accepted) for r in unlabelled.collect()] == [("und", False)] * 5
    assert langid.identify(docs.limit(0)).collect() == []


def test_all_languages_are_learned(spark):
    """70 languages, each with words of its own; the last has one labelled text, for calibration (doc_id % 4 is 3) and outside the held-out part."""
    rng = np.random.default_rng(5)
    texts, langs, ids = [], [], []
    last = next(d for d in range(10_003, 20_000, 4) if zlib.crc32(str(d).encode()) % 3 != 1)
    for k in range(70):
        letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:6]
        own = ["".join(rng.choice(letters, 6)) + f"{k:02d}" for _ in range(12)]
        for d in range(20 if k < 69 else 1):
            texts.append(" ".join(rng.choice(own, 40)))
            langs.append(f"l{k:02d}")
            ids.append(len(ids) if k < 69 else last)
    rows = langid.identify(frame(spark, texts, ids=ids, langs=langs)).collect()
    assert {r.lang for r in rows} == {r.lang_pred for r in rows}
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
