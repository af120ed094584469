import hashlib
import textwrap
from collections import defaultdict

import pytest
from helpers import LOWER, awkward, frame, words

from strataline.llm.licenses import KEYS, RULES, SENTENCES, license_scan, normal
from strataline.llm.line_dedup import line_dedup, without_shared_lines
from strataline.llm.mixing import mix, mix_plan, water_fill


def kept_lines(docs):
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20 and d is not None:
                held[key(x)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(held[key(x)]) < 3 or max(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_line_dedup_is_brute_force(spark):
    texts = awkward() + ["a line without an id, but twenty chars"]
    ids = [*range(len(texts) - 1), None]
    got = line_dedup(frame(spark, texts, ids=ids))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "pos", "score", "n_lines", "n_dropped"]
    rows = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str)
    assert rows == kept_lines(list(zip(ids, texts)))
    assert hashlib.sha256(rows[0][3].encode()).hexdigest()


def test_line_dedup_repeats_and_empty_table(spark):
    line = "A line that several documents share"
    docs = frame(spark, [line, line, line, line], ids=[1, 1, 2, 2])
    assert [r.n_dropped for r in line_dedup(docs).collect()] == [0, 0, 0, 0]  # two documents only
    docs = frame(spark, [line] * 4, ids=[1, 1, 2, 3])
    assert sorted((r.doc_id, r.text) for r in without_shared_lines(docs).collect()) == [(1, ""), (1, ""), (2, ""), (3, line)]
    assert line_dedup(docs.limit(0)).collect() == []


def filled(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Clamp and redistribute until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(epochs * sizes[s] for s in full)
        target = {s: epochs * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in names}
        above = {s for s in open_ if target[s] > epochs * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 7, "c": 50, None: 3}, {"a": 1, "b": 1000}, {"z": 0, "é": 4, "Z": 9}, {"a": 5}])
def test_water_filling(spark, sizes):
    rows = water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = filled(sizes)
    assert {r.source: pytest.approx(r.target) for r in rows} == want


def test_mix_meets_targets_and_repeats(spark):
    texts = ["w " * (1 + k % 9) for k in range(900)] + awkward()
    sources = [("a", "b", None, "d")[min(3, k % 7)] for k in range(len(texts))]
    docs = frame(spark, texts, sources)
    plan = mix_plan(docs).collect()
    sizes = defaultdict(int)
    for t, s in zip(texts, sources):
        sizes[s] += len(words(t))
    want, taken = filled(sizes), defaultdict(int)
    for r in plan:
        assert r.size == len(words(texts[r.doc_id])) and r.source_size == sizes[r.source] and 0 <= r.times <= 2
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.size * r.times
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r.size for r in plan if r.source == s)
    copies = mix(docs)
    assert copies.columns == docs.columns
    assert sorted(r.doc_id for r in copies.collect()) == sorted(r.doc_id for r in plan for _ in range(r.times))
    assert sorted(r.doc_id for r in mix(docs.repartition(7)).collect()) == sorted(r.doc_id for r in copies.collect())
    assert mix_plan(docs.limit(0)).collect() == [] and mix(docs.limit(0)).collect() == []
    twice = mix_plan(frame(spark, ["a b"] * 3, ids=[5, 5, None])).collect()
    assert len(twice) == 3 and twice[0].times == twice[1].times


def test_license_rules(spark):
    assert len(KEYS) == len(SENTENCES) and all(i in SENTENCES for _, run in RULES for i in run)
    mit = "\n".join(SENTENCES[i] for i in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")).replace("including", "including\n *")
    bsd3 = "\n\n".join(SENTENCES[i] for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"))
    bsd2 = "\n".join("# " + SENTENCES[i] for i in ("bsd-grant", "bsd-source", "bsd-binary"))
    apache = "\n".join(SENTENCES[i] for i in ("apache-licensed", "apache-may", "apache-obtain", "apache-see"))
    texts = ["Copyright (c) somebody\n\n" + mit, bsd3, bsd2, apache, "A title\nReleased under the MIT License.\nmore", "We like the MIT License.",
             "x. LICENSED UNDER cc by-nc 4.0. All rights reserved.", None, "", "w " * 50_000 + "\nReleased under the MIT License."]
    rows = license_scan(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "MIT", "", "CC-BY-NC-4.0,all rights reserved", "", "", "MIT"]
    assert normal("  The (MIT)\nLicense! ") == "the mit license"
    assert license_scan(frame(spark, ["Released under the MIT License."] * 2, ids=[None, None])).select("licenses").collect() == [("MIT",), ("MIT",)]
    assert license_scan(frame(spark, texts).limit(0)).collect() == []


def test_license_headers_in_comment_blocks(spark):
    """A licence is found behind each comment mark, below a copyright line and with any name in the BSD clause."""
    def wrapped(mark, *parts, width=70):
        lines = [line for part in parts for line in [*textwrap.wrap(part, width), ""]]
        return "\n".join(f"{mark} {x}".rstrip() if mark else x for x in lines)

    mit = [SENTENCES[i] for i in ("mit-grant", "mit-notice")] + [SENTENCES["mit-warranty"] + " " + SENTENCES["mit-liability"]]
    bsd = [SENTENCES["bsd-grant"], "1. " + SENTENCES["bsd-source"], "2. " + SENTENCES["bsd-binary"]]
    clause = lambda name: "3. " + SENTENCES["bsd-names"].replace("the copyright holder", name)
    owner = "Copyright (c) 2020 Foo"
    texts = [wrapped(mark, owner, *mit) for mark in (" *", "#", "//", "")]
    texts += ["/*\n" + wrapped(" *", owner, *mit) + "\n */\nint x;", owner + "\n" + wrapped("", *mit), f"# {owner}\n# Copyright 2021 Bar\n" + wrapped("#", *mit)]
    texts += [wrapped("#", owner, "Permission to use is granted to all:", *mit[1:])]
    texts += [wrapped(mark, owner, *bsd, clause(name)) for mark in ("", " *") for name in ("the copyright holder", "the University of Foo", "Foo, Inc.")]
    texts += [wrapped("//", owner, *bsd), wrapped("#", owner, SENTENCES["isc-grant"]), wrapped("#", owner, *mit[2:]), "Neither the name of Foo nor the names of its contributors matter."]
    rows = license_scan(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == ["MIT"] * 8 + ["BSD-3-Clause"] * 6 + ["BSD-2-Clause", "ISC", "", ""]
